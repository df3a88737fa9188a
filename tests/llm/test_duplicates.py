import functools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import op04_multi_bwt as op4
from plumbline.llm import op07_simhash as op7
from plumbline.llm.components import components, local_components

from .fixtures import documents, frame, texts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=12))
def test_collection_order_and_common_prefixes(sample):
    suffixes = [(t[j:], i, j) for i, t in enumerate(sample) for j in range(len(t) + 1)]
    key = lambda s: [*s[0], -1000 + s[1]]  # noqa: E731  every end is a symbol of its own, in document order
    suffixes.sort(key=functools.cmp_to_key(lambda a, b: (key(a) > key(b)) - (key(a) < key(b))))
    bwt, lcp = op4.build(sample)
    assert bwt.tolist() == [op4.END if j == 0 else sample[i][j - 1] for _, i, j in suffixes]
    want = [0]
    for a, b in zip(suffixes, suffixes[1:]):
        n = 0
        while n < min(len(a[0]), len(b[0])) and a[0][n] == b[0][n]:
            n += 1
        want.append(n)
    assert lcp.tolist() == want


@pytest.mark.parametrize(("spool", "piece"), [(1 << 20, 7), (16, 7), (200, 50), (1 << 20, 1 << 18)])
def test_columns_in_blocks_and_files(monkeypatch, tmp_path, spool, piece):
    rng = random.Random(5)
    sample = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40))) for _ in range(20)] + [b"c", b"abc" * 9]
    whole = op4.build(sample)
    monkeypatch.setattr(op4, "SPOOL", spool)
    monkeypatch.setattr(op4, "PIECE", piece)
    files = op4.build(sample, str(tmp_path))
    assert all((a == b).all() for a, b in zip(whole, files))
    assert not [p for p in tmp_path.iterdir()]  # gone when read


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("abc é"), max_size=400))
def test_segments_hold_every_window_once(text):
    data = text.encode()
    keys, start, size = op4.segments(data)
    windows = [a + i for a, n in zip(start.tolist(), size.tolist()) for i in range(n - 99)]
    assert windows == list(range(max(0, len(data) - 99)))
    assert not len(size) or size.max() <= 2 * 100 - op4.GRAM
    # equal windows have equal anchors, wherever they stand
    again, start2, size2 = op4.segments(b"x7z" + data)
    of = lambda d, k, a, m: {(d[x + i : x + i + 100], key) for key, x, n in zip(k.tolist(), a.tolist(), m.tolist()) for i in range(n - 99)}
    assert of(data, keys, start, size) <= of(b"x7z" + data, again, start2, size2)


def test_ranges_are_maximal():
    doc, start, size = op4.ranges(np.array([2, 1, 1, 1, 2]), np.array([0, 10, 5, 30, 100]), np.array([100, 10, 5, 5, 5]))
    assert list(zip(doc.tolist(), start.tolist(), size.tolist())) == [(1, 5, 15), (1, 30, 5), (2, 0, 105)]
    assert len(op4.ranges(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))[0]) == 0


def brute_removed(rows):
    """Bytes of each document covered by a 100-byte string that starts earlier."""
    seen, out = set(), {}
    for d, t in sorted(rows.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        data = t.encode()
        mask = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                mask[s : s + 100] = True
            seen.add(w)
        out[d] = mask
    return out


def test_removed_bytes_against_brute_force(spark):
    want = brute_removed(texts())
    rows = op4.cleaned(frame(spark)).collect()
    assert len(rows) == len(documents())
    for r in rows:
        data, mask = texts()[r["doc_id"]].encode(), want[r["doc_id"]]
        assert bytes(r["kept"]) == np.frombuffer(data, np.uint8)[~mask].tobytes()
        assert (r["n_bytes"], r["n_removed"]) == (len(data), int(mask.sum()))
        assert r["n_spans"] == int((mask & ~np.r_[False, mask[:-1]]).sum())
    assert sum(m.sum() for m in want.values()) > 1500
    assert op4.cleaned(frame(spark, [])).count() == 0


def test_periodic_and_shifted_passages(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdef ") for _ in range(700))
    rows = {1: base, 2: base[3:400] + "Z" + base[401:], 3: "q" * 350, 4: "ab" * 180 + base[100:260], 5: base[:99], 6: base[50:150], 7: "é" * 120, 8: "xé" + "é" * 110}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    want = brute_removed(rows)
    for r in op4.cleaned(df).collect():
        assert r["n_removed"] == int(want[r["doc_id"]].sum()), r["doc_id"]


def test_ids_that_repeat_or_lack(spark):
    """Rows of one doc_id, or of none, with different texts are documents of their own; equal rows are one."""
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(4)]
    rows = [(7, base[0]), (7, base[0] + base[1]), (7, "short"), (None, base[2]), (None, base[2][:150] + base[3]), (None, None), (None, base[2]), (8, base[1] + base[3]), (8, base[1] + base[3]), (9, base[0])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_chars int").repartition(3)
    ties = {(r["doc"], r["text"]): r["tie"] for r in op4.documents(docs).collect()}
    distinct = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, ties[op4.NONE if x[0] is None else x[0], x[1]]))
    want = dict(zip(distinct, brute_removed(dict(enumerate(t for _, t in distinct))).values()))
    got = op4.cleaned(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in got) == sorted((str(d), len(t or ""), int(want[d, t or ""].sum())) for d, t in rows)
    left = op4.without_ranges(docs, op4.removed_ranges(docs)).collect()
    kept = lambda d, t: None if t is None else "".join(c for c, gone in zip(t, want[d, t]) if not gone)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left) == sorted((str(d), kept(d, t) or "") for d, t in rows)
    assert sum(m.sum() for m in want.values()) > 900


def test_crowded_anchors(spark):
    """A passage in other surroundings each time: its anchors at the edges have as many segments as documents."""
    rng = random.Random(17)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(230)
    rows = {i: text(80) + passage[: 230 - i % 5] + text(90) for i in range(60)} | {90: passage, 91: text(400)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    want = {d: int(m.sum()) for d, m in brute_removed(rows).items()}
    for crowd, often in ((500, 25), (4, 10_000), (500, 10_000), (4, 2)):
        assert (len(op4.hot_anchors(op4.documents(df), len(rows), often)) > 0) == (often < 100)
        assert {r["doc_id"]: r["n_removed"] for r in op4.cleaned(df, crowd=crowd, often=often).collect()} == want


def test_texts_without_ranges_stay_valid(spark):
    rows = {1: "é" * 200, 2: "a" + "é" * 199 + "end"}
    df = spark.createDataFrame([(d, t, 5) for d, t in rows.items()], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in op4.without_ranges(df, op4.removed_ranges(df)).collect()}
    want = brute_removed(rows)
    for d, r in out.items():
        data = np.frombuffer(rows[d].encode(), np.uint8)[~want[d]].tobytes().decode("utf-8", "ignore")
        assert r["text"] == data and r["n_chars"] == len(data)


# fingerprints


def brute_fingerprint(text):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("aB é \x1c\n\t\x0b.Z"), max_size=60))
def test_fingerprints(text):
    assert op7.fingerprint(text.encode()) == brute_fingerprint(text)


def brute_labels(fps):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    label = np.arange(len(f))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            return label
        label = new


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.lists(st.integers(0, 63), max_size=7), min_size=1, max_size=40))
def test_buckets_connect_what_distance_connects(base, flips):
    fps = sorted({functools.reduce(lambda x, k: x ^ 1 << k, f, base) for f in flips} | {0, 2**64 - 1})
    signed = np.array(fps, np.uint64).view(np.int64)
    a, b = op7.forest(*op7._entries(signed), most=50)
    node = {v: i for i, v in enumerate(signed.tolist())}
    got = local_components(len(fps), np.array([node[x] for x in a.tolist()], int), np.array([node[x] for x in b.tolist()], int))
    want = brute_labels(fps)
    assert len(a) <= len(fps)
    assert (got[:, None] == got[None, :]).tolist() == (want[:, None] == want[None, :]).tolist()


def test_components_of_long_chains(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(200 + i, 200) for i in range(1, 30)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(200, 230), 200), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_buckets_in_pieces():
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    near = [base ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), False)) for _ in range(300)]
    fps = np.unique(np.array(near + rng.integers(0, 2**62, 50).tolist(), np.uint64).view(np.int64))
    bucket, fp, home = op7._entries(fps)
    kinds, n = np.unique(bucket, return_counts=True)
    hot = kinds[n > 5]
    b, piece, f, h = op7._dealt(bucket, fp, home, hot, np.full(len(hot), 3))
    assert h.sum() == home.sum() and len(b) > len(bucket)

    def groups(links):
        node = {v: i for i, v in enumerate(fps.tolist())}
        return local_components(len(fps), *(np.array([node[x] for x in v.tolist()], int) for v in links))

    order = np.lexsort((piece, b))
    whole, split = op7.forest(bucket, fp, home), op7.forest((b << 20 | piece)[order], f[order], h[order])
    a, b = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps.view(np.uint64)[a] ^ fps.view(np.uint64)[b]) <= op7.DISTANCE
    everything = local_components(len(fps), a[near], b[near])
    assert groups(split).tolist() == groups(whole).tolist() == everything.tolist()


@pytest.mark.parametrize("copies", [1, 3])
def test_near_duplicates_against_brute_force(spark, copies):
    rng = random.Random(9)
    rows = {d: t for d, t in texts().items() if d is not None}
    long = texts()[65].split()
    for k in range(12):  # near copies of a long text
        w = list(long)
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed"
        rows[100 + k] = " ".join(w)
    df = spark.createDataFrame([(d, t) for d, t in rows.items()] * copies, "doc_id long, text string").repartition(3)
    ids = sorted(rows)
    label = brute_labels([brute_fingerprint(rows[d]) for d in ids])
    got = op7.near_duplicates(df).collect()
    assert len(got) == copies * len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(d, ids[k]) for d, k in zip(ids, label)}
    assert len(set(label.tolist())) < len(ids) - 8


def test_near_duplicates_of_nothing(spark):
    assert op7.near_duplicates(frame(spark, [])).count() == 0
    null = op7.near_duplicates(spark.createDataFrame([(None, "some text"), (None, None), (4, "")], "doc_id long, text string")).collect()
    assert sorted((r["fp"] == 0, r["component_id"] or -1) for r in null) == [(False, -1), (True, 4), (True, 4)]
