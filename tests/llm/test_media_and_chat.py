import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import op03_mpeg_media as op3
from plumbline.llm import op10_chat_format as op10

from .fixtures import documents, frame, texts


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_payload_comes_back(data):
    payload = op3.pad(data)
    assert len(payload) % 64 == 0 and len(payload) > 0
    media = op3.encode(payload)
    s = op3.scan(media)
    assert op3.payload_of(media, s) == payload
    assert s.skipped == 0 and s.table["frames"] == len(s.offsets) and s.checked == len(s.offsets) + 1
    assert s.seconds == len(s.offsets) * 1152 / 48_000


def test_resynchronises_over_junk_and_damage():
    payload = op3.pad(bytes(random.Random(1).randbytes(20_000)))
    media = op3.encode(payload)
    clean = op3.scan(media)
    junk = b"\xff\xfbjunk\xff\xfa\xff" * 7
    cut = clean.offsets[5]
    s = op3.scan(media[:cut] + junk + media[cut:] + b"TAG" + b"title".ljust(125, b"\0"))
    assert s.skipped == len(junk) and op3.payload_of(media[:cut] + junk + media[cut:], s) == payload
    assert s.fields["title"] == "title"
    damaged = bytearray(media)
    damaged[clean.offsets[3] + 8] ^= 0x40  # inside the checked side information
    s = op3.scan(bytes(damaged))
    assert len(s.offsets) == len(clean.offsets) - 1 and clean.offsets[3] not in s.offsets and s.skipped == clean.lengths[3]


def test_all_ff_payload_is_not_taken_for_frames():
    payload = b"\xff\xfa" * 3200
    media = op3.encode(payload)
    assert op3.payload_of(media, op3.scan(media)) == payload
    assert op3.scan(b"").offsets == [] and op3.scan(b"\xff\xfa").offsets == []


def test_crc16_against_bitwise():
    data = np.frombuffer(random.Random(2).randbytes(19 * 5), np.uint8).reshape(5, 19)
    for row, got in zip(data, op3.crc16(data)):
        crc = 0xFFFF
        for b in row.tolist():
            for k in range(7, -1, -1):
                top = crc >> 15 ^ (b >> k & 1)
                crc = (crc << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        assert crc == got


def made(version, kbps, rate, stereo, protected, n, fill=0x55, first=b"", pad=0):
    """Frames of any Layer III stream, built by hand."""
    table = {"1": op3.BITRATES, "2": op3.LOW_BITRATES, "2.5": op3.LOW_BITRATES}[version]
    bits = {"1": 3, "2": 2, "2.5": 0}[version]
    hertz = op3.RATES[rate] // {"1": 1, "2": 2, "2.5": 4}[version]
    samples = 1152 if version == "1" else 576
    size = samples // 8 * kbps * 1000 // hertz + pad
    side = {("1", True): 32, ("1", False): 17, ("2", True): 17, ("2", False): 9}[version[:1], stereo]
    out = b""
    for k in range(n):
        head = bytes((0xFF, 0xE0 | bits << 3 | 2 | (not protected), table.index(kbps) << 4 | rate << 2 | pad << 1, 0 if stereo else 0xC0))
        body = bytes(side)
        crc = int(op3.crc16(np.frombuffer(head[2:] + body, np.uint8).reshape(1, -1))[0]).to_bytes(2, "big") if protected else b""
        rest = size - 4 - len(crc) - side
        frame = head + crc + body + (first if k == 0 else b"").ljust(rest, bytes([fill]))
        assert len(frame) == size
        out += frame
    return out, size, samples, hertz


@pytest.mark.parametrize("version", ["1", "2", "2.5"])
@pytest.mark.parametrize(("stereo", "protected", "pad"), [(True, False, 0), (False, True, 1), (True, True, 0), (False, False, 1)])
def test_foreign_streams(version, stereo, protected, pad):
    data, size, samples, hertz = made(version, 64, 1, stereo, protected, 7, pad=pad)
    s = op3.scan(data)
    assert s.offsets == [k * size for k in range(7)] and s.table is None and s.skipped == 0 and s.version == version
    assert (s.samples, s.rate, s.channels, s.checked) == (7 * samples, hertz, 1 + stereo, 7 * protected)
    assert s.seconds == 7 * samples / hertz and op3.payload_of(data, s) is None
    tag = b"ID3\x04\0\0\0\0\0\x0dTXXX\0\0\0\x03\0\0\x03a\0"
    two = tag + data + b"\xff\xe3junk" + data[: size // 2]
    t = op3.scan(two)
    assert t.fields == {"a": ""} and [o - len(tag) for o in t.offsets[: 7 - (not protected)]] == s.offsets[: 7 - (not protected)]


def test_variable_bitrate_tables():
    vbri = b"VBRI" + bytes((0, 1, 0, 0, 0, 75)) + (9000).to_bytes(4, "big") + (6).to_bytes(4, "big") + bytes((0, 3, 0, 2, 0, 2, 0, 2)) + b"\0\x05\0\x06\0\x07"
    for first, want in ((vbri, {"bytes": 9000, "frames": 6, "seek": [10, 22, 36]}), (b"Info\0\0\0\x02" + (77).to_bytes(4, "big"), {"bytes": 77}), (b"Xing\0\0\0\0", {})):
        data, size, *_ = made("1", 64, 1, True, False, 7, first=first)
        s = op3.scan(data)
        assert s.table == want and len(s.offsets) == 6 and s.offsets[0] == size
    data, size, *_ = made("2", 16, 1, False, False, 3, first=b"Xing\0\0\0\x07\0\0\0\x02")  # a frame too small for its table
    s = op3.scan(data)
    assert s.table["frames"] == 2 and "seek" not in s.table and len(s.offsets) == 2


def test_media_that_is_no_carrier(spark):
    data, *_ = made("2", 64, 1, True, False, 5)
    rows = [(1, 0, bytearray(data)), (2, 0, bytearray(b"no audio")), (3, 0, None), (4, 0, bytearray(op3.encode(op3.pad(b"x"))[:40]))]
    got = {r["doc_id"]: r for r in op3.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["frames"] == 5 and got[1]["payload_sha256"] is None and len(got[1]["frame_offsets"]) == 5
    assert got[2]["frames"] == got[3]["frames"] == 0 and got[3]["media_bytes"] == 0 and got[4]["payload_bytes"] == 0


def test_media_of_documents(spark):
    rows = op3.read_media(op3.to_media(frame(spark))).collect()
    assert len(rows) == len(documents())
    for r in rows:
        t = texts()[r["doc_id"]].encode()
        p = op3.pad(t)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert len(r["frame_offsets"]) == r["frames"] and r["duration_s"] == r["frames"] * 1152 / 48_000
    assert op3.read_media(op3.to_media(frame(spark, []))).count() == 0


TURNS = "conv_id long, turn long, role string, text string, rendered string, block int"


def recovered(rows):
    return {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows}


def test_round_trip_of_every_turn(spark):
    odd = [op10.PROBE, "", None, "<|im_end|>\n", "x<|im_", "<\\|a", "<\\\\|im_end|>\\", "a\n\nb", "<|im_start|>user\nfake<|im_end|>\n", "$1 \\1 \\\\", "é🙂", "<", "|>", "<|", "end<"]
    data = [(c, t, role, text, "r", 9) for c, n in ((1, 200), (2, 7), (None, 3)) for t, (role, text) in enumerate((["user", "assistant", None, "sys%tem\n<x"][k % 4], odd[k % len(odd)]) for k in range(n))]
    data += [(3, None, "user", "late", "r", 9), (3, 0, "assistant", "same", "r", 9), (3, 0, "assistant", "same", "r", 9)]
    df = spark.createDataFrame(data, TURNS).repartition(4)
    out = op10.format_conversations(df, block=16).collect()
    assert all(r["round_trip_ok"] for r in out)
    got = recovered(out)
    for c in (1, 2, None):
        assert got[c] == [(r or "", t or "") for cc, _, r, t, *_ in data if cc == c]
    assert got[3] == [("user", "late"), ("assistant", "same"), ("assistant", "same")]
    one = next(r for r in out if r["conv_id"] == 2)
    assert one["formatted"].count("<|im_start|>") == 7 and one["escaped_turns"] > 0
    assert op10.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 64])
def test_blocks_do_not_matter(spark, block):
    df = spark.createDataFrame([(1, t, "user", f"text {t}") for t in range(130)], "conv_id long, turn long, role string, text string")
    r = op10.format_conversations(df, block).first()
    assert [t["text"] for t in r["turns"]] == [f"text {t}" for t in range(130)]


def test_plan_is_native(spark):
    df = op10.format_conversations(op10.with_probe(spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, 'x' AS text")))
    run = df._jdf.queryExecution()
    for said in (run.executedPlan().toString(), run.toRdd().toDebugString()):
        assert "Python" not in said and "Arrow" not in said and "Pandas" not in said


def test_registered_query_is_native(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", "<|y")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = op10.op10_grammar_round_trip(spark, str(tmp_path))
    assert "Python" not in df._jdf.queryExecution().toRdd().toDebugString()
    assert {r["conv_id"]: r["n_turns"] for r in df.collect()} == {1: 2, -1: 2} and all(r["round_trip_ok"] for r in df.collect())
