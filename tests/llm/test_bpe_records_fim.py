"""Byte-level BPE, golden records and fill-in-middle: against the library, brute force, SQL and the exact text."""

import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import op11_byte_bpe as bpe
from plumbline.llm import op12_golden_records as gold
from plumbline.llm import op13_fill_in_middle as fim
from plumbline.llm.vocab import vocabulary_path
from tests.llm.fixtures import documents, frame


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(vocabulary_path(bpe.VOCABULARY), bpe.splitting_pattern())


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.splitting_pattern(), mergeable_ranks=codec.ranks, special_tokens={})


def split(flat, lengths):
    bounds = np.r_[0, np.cumsum(lengths)]
    return [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def odd_texts():
    rng = random.Random(5)
    alphabet = "aabbc  \n\t1239.,'sé漢字かな🙂́ßthe ing"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 50, 300]))) for _ in range(600)]
    long = ["".join(rng.choice("etaoin") for _ in range(n)) for n in (2047, 2048, 2049, 9000)]
    return texts + long + ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(1500)), "<|endoftext|>"]


def test_bpe_like_the_library(codec, library):
    texts = odd_texts()
    flat, n = codec.encode(texts)
    assert split(flat, n) == [library.encode_ordinary(t) for t in texts]
    out, sizes = codec.decode(flat, n)
    assert [bytes(x) for x in split(out, sizes)] == [t.encode() for t in texts]


def test_bpe_small_matrices_and_full_memo(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CELLS", 64)
    monkeypatch.setattr(bpe, "MEMO", 50)
    monkeypatch.setattr(bpe, "LONG", 24)
    monkeypatch.setattr(bpe, "BLOCK", 4)
    for texts in (odd_texts()[:200], odd_texts()[100:300], [], [""]):
        flat, n = codec.encode(texts)
        assert split(flat, n) == [library.encode_ordinary(t) for t in texts]


def test_pair_table():
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    rank = rng.permutation(len(key)).astype(np.int32)
    table = bpe.PairTable(key[:, 0], key[:, 1], rank)
    known = {(a, b): r for (a, b), r in zip(key.tolist(), rank.tolist())}
    ask = np.r_[key, rng.integers(-1, 300, (3000, 2))]
    assert table.find(ask[:, 0], ask[:, 1]).tolist() == [known.get((a, b), int(bpe.NEVER)) for a, b in ask.tolist()]


def test_bpe_rows(spark, library):
    """Nulls, empty and long texts, repeated rows, clashing columns; ids and bytes of each row."""
    where, pattern = vocabulary_path(bpe.VOCABULARY), bpe.splitting_pattern()
    docs = frame(spark).withColumn("IDS", F.lit(7)).withColumn("decoded", F.lit("x"))
    rows = bpe.decoded(bpe.encoded(docs, where, pattern), where, pattern, ids="_ids")
    assert rows.columns == [*docs.columns, "_ids", "_decoded"]
    got = rows.select("doc_id", "text", "_ids", "_decoded", "IDS").collect()
    assert len(got) == len(documents())
    for r in got:
        assert r["_ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["_decoded"]) == (r["text"] or "").encode() and r["IDS"] == 7
    assert bpe.encoded(frame(spark, []), where, pattern).count() == 0


def test_decode_nulls(spark):
    where, pattern = vocabulary_path(bpe.VOCABULARY), bpe.splitting_pattern()
    rows = spark.createDataFrame([(1, None), (2, []), (3, [64, None, 65])], "k int, ids array<int>").coalesce(1)
    codec = bpe.codec(where, pattern)
    both = codec.decode(np.array([64, 65]), np.array([2]))[0].tobytes()
    assert {r["k"]: bytes(r["decoded"]) for r in bpe.decoded(rows, where, pattern).collect()} == {1: b"", 2: b"", 3: both}


def test_op11_query(spark, tmp_path, library):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, bpe.op11_byte_bpe(spark, str(tmp_path)).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(i := library.encode_ordinary(t or "")), sha(",".join(map(str, i)).encode()), sha((t or "").encode())) for d, t, *_ in documents()]
    assert got == sorted(want, key=repr)


CLIENTS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, key string, n int, latest long"


def clients(seed: int, n: int, hot: float = 0.4):
    import datetime

    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    day = datetime.datetime(2024, 3, 1)
    rows = []
    for i in range(n):
        at = None if rng.random() < 0.1 else day + datetime.timedelta(hours=6 * rng.randint(0, 300), microseconds=pick(0, 0, 1))
        master = pick(1, 2, 3, None, None) if rng.random() > hot else 9
        rows.append((i if rng.random() < 0.97 else pick(None, 3), master, pick("partner", "store", "web", "crm", "fax", None), at, pick("Bo", "Al", "José É", "x\U0001f642y", " ", None, " Al "), pick("a@b", "", None, "\t", "c@d"), pick("Rom", None, "\n "), pick(1, 2, None), pick("retail", "web", None, None, ""), pick(1.005, -2.5, None, None, float("nan"), 1e300, 3.0), "k", 1, 5))
    return rows + rows[: n // 10]


def brute(rows):
    clusters = {}
    for r in rows:
        clusters.setdefault(r[1] if r[1] is not None else r[0], []).append(r)
    blank = lambda s: None if s is None or re.fullmatch(r"[\x20\x09-\x0D]*", s) else s
    none = lambda x: (x is None, 0 if x is None else x)
    text = lambda x: (x is None, "" if x is None else x)
    out = []
    for key, group in clusters.items():
        rs = [dict(id=r[0], at=r[3], trust={"partner": 0, "store": 1, "web": 2, "crm": 3}.get(r[2], 4), name=blank(r[4]), email=blank(r[5]), city=blank(r[6]), nation=r[7], segment=blank(r[8]), balance=r[9]) for r in group]
        times = [r["at"] for r in rs if r["at"]]
        for r in rs:
            r["stale"] = r["at"] is None or (max(times) - r["at"]).total_seconds() > 30 * 86400
            at = (1, 0) if r["at"] is None else (0, -(r["at"] - __import__("datetime").datetime(1970, 1, 1)) // __import__("datetime").timedelta(microseconds=1))
            # rows alike in all that RECENT names are ordered by their values
            rest = (text(r["segment"]), text(r["name"]), text(r["email"]), text(None if r["balance"] is None else "NaN" if math.isnan(r["balance"]) else str(r["balance"]) if abs(r["balance"]) < 1e7 else "1.0E300"), text(r["city"]), text(None if r["nation"] is None else str(r["nation"])))
            r["recent"] = (at, r["trust"], none(r["id"]), rest)
            r["trusted"] = (r["stale"], r["trust"], r["recent"])
        best = lambda rs, k: min(rs, key=k, default=dict(id=None, name=None, email=None, segment=None, balance=None))
        seg = best([r for r in rs if r["segment"]], lambda r: r["recent"])
        email = best([r for r in rs if r["email"]], lambda r: r["trusted"])
        name = best([r for r in rs if r["name"]], lambda r: (-len(r["name"]), r["trusted"]))
        bal = best([r for r in rs if r["balance"] is not None], lambda r: (seg["segment"] is None or r["segment"] != seg["segment"], r["recent"]))
        adr = best(rs, lambda r: (-(r["city"] is not None) - (r["nation"] is not None), r["trusted"]))
        x = bal["balance"]
        cents = None if x is None or math.isnan(x) or abs(x) >= 9e16 else math.floor(100 * x + 0.5)
        out.append((key, len(rs), sum(r["stale"] for r in rs), name["name"], email["email"], seg["segment"], adr["city"], adr["nation"], cents, name["id"], email["id"], seg["id"], bal["id"], adr["id"] if adr["city"] is not None or adr["nation"] is not None else None))
    return sorted(out, key=repr)


def op12(spark, path, rows, least_hot=None):
    spark.createDataFrame(rows, CLIENTS).repartition(3).write.mode("overwrite").parquet(f"{path}/clients.parquet")
    records = gold.golden_records(spark.read.parquet(f"{path}/clients.parquet"), F.coalesce("master_id", "client_id"), least_hot=least_hot or 1)
    assert "n_records" in records.columns
    return sorted(map(tuple, gold.op12_golden_records(spark, path).collect()), key=repr)


@pytest.mark.parametrize("seed,hot", [(1, 1), (2, 10**9), (3, 20)])
def test_golden_records_brute_force(spark, tmp_path, monkeypatch, seed, hot):
    """With every cluster cut into pieces, with none, and with some."""
    rows = clients(seed, 150)
    monkeypatch.setattr(gold.golden_records, "__defaults__", (*gold.golden_records.__defaults__[:-1], hot))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # no effect on times without a zone
    try:
        assert op12(spark, str(tmp_path), rows, hot) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_golden_records_small_batches(spark, tmp_path, monkeypatch):
    """A cluster over many batches keeps what it must."""
    rows = clients(4, 300, hot=0.8)
    path = str(tmp_path)
    spark.createDataFrame(rows, CLIENTS).repartition(3).write.parquet(f"{path}/clients.parquet")
    monkeypatch.setattr("plumbline.llm.common.BATCH_ROWS", 3)
    try:
        got = sorted(map(tuple, gold.op12_golden_records(spark, path).collect()), key=repr)
    finally:
        monkeypatch.undo()
    assert got == brute(rows)


def test_golden_records_empty_and_one(spark, tmp_path):
    assert op12(spark, str(tmp_path / "a"), []) == []
    row = (None, None, None, None, None, None, None, None, None, None, None, None, None)
    assert op12(spark, str(tmp_path / "b"), [row, row]) == [(None, 2, 2, *[None] * 11)]


def test_golden_records_other_columns(spark):
    """Other rules over columns of other types."""
    rows = spark.createDataFrame([(1, "a", 5, True, "old"), (2, "a", 9, None, "new"), (3, "b", None, False, "new")], "id int, who string, t int, ok boolean, place string")
    rows = rows.withColumn("t", F.timestamp_seconds("t"))
    rules = (gold.Rule("ok", ("ok",), "recent"), gold.Rule("t", ("t", "id"), "trusted"))
    out = gold.golden_records(rows, F.col("who"), rules, id_="id", at="t", source="place", sources=("old", "new"), stale=10**6)
    got = {r["key"]: (r["n_records"], r["n_stale"], r["ok"], r["ok_from"], r["id"], r["t_from"]) for r in out.collect()}
    assert got == {"a": (2, 1, True, 1, 2, 2), "b": (1, 1, False, 3, 3, 3)}


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_unit_ends():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("ab é🙂\t\n\x0b\x1f\xa0　") for _ in range(rng.randint(0, 12)))
        assert fim.unit_ends(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist() == [m.end() for m in UNIT.finditer(text)]


def expected(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_rows(spark):
    rows = documents() + [(100 + k, t, None, None, None, 1, "", 0.0, 1, 1, 1) for k, t in enumerate(["a <P> b", "<<S", "x<S y", "<M>", "< < <", " ", "\n\n"] * 6)]
    docs = frame(spark, rows).withColumn("form", F.lit("mine")).withColumn("Units", F.lit(1))
    made = fim.fill_in_middle(docs)
    assert made.columns == [*docs.columns, "_units", "_form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("_form"))).collect()
    assert len(got) == len(rows)
    forms = set()
    for r in got:
        assert (r["_units"], r["_form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["form"] == "mine"
        forms.add(r["_form"])
    assert forms == {"plain", "psm", "spm"} and fim.fill_in_middle(frame(spark, [])).count() == 0


def test_fill_in_middle_other_marks(spark):
    marks = ("[pre]", "|", "[mid]x")
    docs = spark.createDataFrame([(k, f"one two{k}  three [pre four\n") for k in range(40)], "doc_id long, text string")
    made = fim.fill_in_middle(docs, seed=1, rate=100, spm=50, marks=marks)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["back"] == r["text"] for r in got) and {r["form"] for r in got} == {"psm", "spm"}


@pytest.mark.parametrize("name", ["op12_golden_records", "op13_fill_in_middle"])
def test_sql(spark, name):
    """The registered query and its SQL over a sample folder, if it is there."""
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no sample tables")
    from plumbline.llm import queries

    con = duckdb.connect()
    for t in ("clients", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
