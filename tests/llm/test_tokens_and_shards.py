import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import op02_token_counts as op2
from plumbline.llm import op05_feistel_shards as op5
from plumbline.llm import op08_token_records as op8
from plumbline.llm import op09_linear_grouping as op9
from plumbline.llm.common import scratch
from plumbline.llm.vocab import Chunked, vocabulary_path

from .fixtures import SCHEMA, documents, frame, texts

WORD, BYTE = vocabulary_path("word_bpe_49k.json"), vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def coders():
    return Chunked(WORD), Chunked(BYTE)


def library(coder, text):
    return coder.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é́'sTll.,\n\t \x1c0½ßΣİ<|>endoftx🙂漢 "), max_size=40), min_size=1, max_size=4))
def test_chunked_ids_are_the_librarys(coders, sample):
    word, byte = coders
    flat, lens = word.ids(sample, 1)
    ends = np.r_[0, np.cumsum(lens)]
    for i, t in enumerate(sample):
        assert flat[ends[i] : ends[i + 1]].tolist() == library(word, t) + [1]
    assert byte.counts(sample).tolist() == [len(library(byte, t)) for t in sample]


def test_memo_forgets_without_changing_ids(coders, monkeypatch):
    monkeypatch.setattr("plumbline.llm.vocab.MEMO", 50)
    small = Chunked(WORD)
    for k in range(5):
        sample = [f"word{i}x{k}, common." for i in range(80)]
        flat, lens = small.ids(sample)
        assert flat.tolist() == [x for t in sample for x in library(coders[0], t)]


def test_counts_from_the_digest_cache(spark, coders):
    docs, cache = frame(spark), scratch(spark, "cache")
    once = {(r["doc_id"], r["n_tokens"], r["n_bytes"]) for r in op2.count_tokens(docs, cache, BYTE).collect()}
    assert once == {(d, len(library(coders[1], t)), len(t.encode())) for d, t in texts().items()}
    stored = spark.read.parquet(cache).count()
    assert stored == len(set(texts().values()))
    again = op2.count_tokens(docs, cache, BYTE)
    assert again.count() == len(documents())  # repeated rows stay
    assert spark.read.parquet(cache).count() == stored  # nothing was missing
    more = spark.createDataFrame([(1, "something new")], "doc_id long, text string")
    assert op2.count_tokens(more, cache, BYTE).first()["n_tokens"] == len(library(coders[1], "something new"))
    assert spark.read.parquet(cache).count() == stored + 1
    assert op2.count_tokens(docs.limit(0), scratch(spark, "cache"), BYTE).count() == 0


def test_letters_that_lower_to_a_letter_and_a_mark(coders):
    word, _ = coders
    sample = ["İ<", "İ,", "aİ.", "İa.", "ŉ!", "ǰ.", "x İ< y"] * 2
    flat, lens = word.ids(sample, 1)
    ends = np.r_[0, np.cumsum(lens)]
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library(word, t) + [1] for t in sample]


def test_hot_text_and_a_filled_cache(spark, coders):
    """Copies go before texts are held against the cache: the plan drops them first, and only misses are encoded."""
    cache = scratch(spark, "cache")
    hot, old = "hot text " * 50, [f"old {k}" for k in range(30)]
    op2.remember(spark.createDataFrame([(k, t) for k, t in enumerate(old)], "doc_id long, text string"), cache, BYTE)
    rows = [(k, hot) for k in range(300)] + [(1000 + k, old[k % 30]) for k in range(90)] + [(2000 + k, f"new {k}") for k in range(20)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = op2._seen(docs).groupBy("content_digest").agg(F.first("text").alias("text"))
    spark.conf.set(op2._EXCLUDED, op2._EARLY)
    try:
        plan = seen.join(op2._appended(spark, cache).select("content_digest"), "content_digest", "left_anti")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(op2._EXCLUDED)
    assert plan.index("LeftAnti") < plan.index("Aggregate")
    got = {(r["doc_id"], r["n_tokens"]) for r in op2.count_tokens(docs, cache, BYTE).collect()}
    assert got == {(d, len(library(coders[1], t or ""))) for d, t in rows}
    assert spark.read.parquet(cache).count() == 30 + 1 + 20 + 1 and spark.conf.get(op2._EXCLUDED, None) is None


def test_records_roll_into_small_files(spark):
    """Many files a part, copies of one row in several, an index that is written as it grows."""
    rows = [(k // 3, f"text {k} " * (k % 40)) for k in range(400)] + [(7, "same")] * 300 + [(None, None)] * 5
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(6), scratch(spark, "records")
    parts = op8.write_records(docs, path, WORD, 2, roll=3000)
    listed = parts.orderBy("part", "place").collect()
    assert len(listed) > 15 and max(r["place"] for r in listed) > 2 and sum(r["records"] for r in listed) == len(rows)
    assert all(len(op8.read_index(path, r["name"])) == r["records"] for r in listed)
    back = op8.read_records(parts, path).collect()
    got = op8.digests(parts, path).collect()
    assert len(back) == len(got) == len(rows) and sorted(r["ids_crc32"] for r in got) == sorted(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in back)
    ids = [r["doc_id"] for f in listed for r in sorted((r for r in got if r["name"] == f["name"]), key=lambda r: r["start_in_file"])]
    assert ids == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))


def test_hot_digests_are_joined_in_place(spark, coders, monkeypatch):
    monkeypatch.setattr(op2, "HOT", 4)
    rows = [(i, "one text that very many rows share" if i % 3 else f"text {i}") for i in range(60)] + [(None, None), (None, "one text that very many rows share")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in op2.count_tokens(docs, scratch(spark, "cache"), BYTE).collect())
    assert got == sorted((str(d), len(library(coders[1], t or ""))) for d, t in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    out = op5.permute(np.arange(n), n)
    assert sorted(out.tolist()) == list(range(n))
    assert (op5.permute(np.arange(n), n) == out).all()


def test_shards_law_of_rows(spark):
    rows = op5.shard(frame(spark), shards=7).collect()
    assert len(rows) == len(documents())
    sizes = [sum(r["shard"] == s for r in rows) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows:
        t = texts()[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 16, zlib.crc32(t))
        p = int(op5.permute(np.array([r["row_number"]]), len(rows))[0])  # shard and slot can be computed
        assert (r["shard"], r["slot"]) == (p % 7, p // 7)
    assert op5.shard(frame(spark, [])).count() == 0


def test_records_round_trip_and_seek(spark, coders):
    path = scratch(spark, "records")
    parts = op8.write_records(frame(spark), path, WORD, 2)
    want = {}
    for d, t in texts().items():
        want[d] = np.array(library(coders[0], t) + [2], "<u4")
    rows = op8.read_records(parts, path).collect()
    assert len(rows) == len(documents())
    assert all(r["ids"] == want[r["doc_id"]].tolist() for r in rows)
    ordered = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["part"], r["place"]))]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))
    for p in parts.filter("records > 0").collect():
        index = op8.read_index(path, p["name"])
        entry = index[len(index) // 2]
        doc, ids = op8.fetch(path, p["name"], entry)
        assert (ids == want[doc]).all()
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in op8.digests(parts, path).collect()}
    assert got == {(d, len(i), zlib.crc32(i.tobytes())) for d, i in want.items()}
    empty = scratch(spark, "records")
    assert op8.read_records(op8.write_records(frame(spark, []), empty, WORD, 2), empty).count() == 0


def test_records_of_equal_and_missing_ids(spark, coders):
    rows = [(None, f"text {k}") for k in range(40)] + [(5, f"more {k}") for k in range(40)] + [(5, None)]
    path = scratch(spark, "records")
    parts = op8.write_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, WORD, 2)
    got = sorted(op8.read_records(parts, path).collect(), key=lambda r: (r["part"], r["place"]))
    assert sorted((str(r["doc_id"]), r["ids"]) for r in got) == sorted((str(d), library(coders[0], t or "") + [2]) for d, t in rows)
    assert [r["doc_id"] is None for r in got] == [True] * 40 + [False] * 41 and len({r["part"] for r in got}) > 1
    again = op8.write_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), scratch(spark, "records"), WORD, 2)
    assert again.agg({"ids": "sum"}).first()[0] == parts.agg({"ids": "sum"}).first()[0]


def test_damaged_records_are_noticed():
    record = bytearray(op8.frame(b"payload"))
    assert op8.unframe(bytes(record)) == b"payload"
    for k in (0, 9, 14, len(record) - 1):
        bad = record.copy()
        bad[k] ^= 1
        with pytest.raises(ValueError):
            op8.unframe(bytes(bad))


def check_plan(hist, capacity, **options):
    runs, n = op9.plan(hist, capacity, **options)
    fill, seen = np.zeros(n, int), np.zeros(capacity + 1, int)
    spans = [[] for _ in range(n)]
    for length, a, b, seq, offset in runs:
        seen[length] += b - a
        for k in range(b - a):
            fill[seq + k] += length
            spans[seq + k].append((offset, length))
    assert (seen == hist).all() and (n == 0 or fill.max() <= capacity) and (fill > 0).all()
    for s in spans:
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
    return n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(2, 12))
def test_every_plan_is_a_packing(lengths, groups):
    check_plan(np.bincount(lengths, minlength=65) if lengths else np.zeros(65, int), 64, groups=groups, small=8)


def test_plan_is_close_to_the_bound():
    rng = np.random.default_rng(3)
    hist = np.bincount(np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1), minlength=4097)
    assert check_plan(hist, 4096) <= 1.02 * -(-int((hist * np.arange(4097)).sum()) // 4096)


def test_packing_of_documents(spark, coders):
    pieces = op9.cut_pieces(frame(spark), WORD, 64, 1, keep_ids=True).persist()
    rows = op9.pack(pieces, 64, 8).collect()
    by_doc, repeated = {}, 0
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in texts().items():
        ids = library(coders[0], t) + [1]
        mine = sorted(by_doc[d], key=lambda r: r["piece"])
        times = 2 if d == 2 else 1
        repeated += times - 1
        assert sum(r["length"] for r in mine) == times * len(ids)
        for r in mine:
            own = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 64 * r["piece"] and r["ids"] == own and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
    assert repeated == 1
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert op9.pack(op9.cut_pieces(frame(spark, []), WORD, 64, 1)).count() == 0
    pieces.unpersist()


def test_tokenizer_digest_names_the_file():
    assert op2.tokenizer_digest(WORD) == hashlib.sha256(open(WORD, "rb").read()).hexdigest()
    assert "text string" in SCHEMA
