import random

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm import near_copies as near

from .fixtures import EN, prose


def brute_sets(rows, words=5):
    split = {d: t.lower().split() for d, t in rows.items()}
    return {d: {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for d, w in split.items()}


def brute_components(rows):
    """Smallest id of each id's component under Jaccard >= 0.8 over all pairs."""
    sets, label = brute_sets(rows), {d: d for d in rows}
    links = [(a, b) for a in rows for b in rows if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label, links


def corpus():
    rng = random.Random(21)
    rows = {i: prose(rng, EN, rng.randint(3, 140)) for i in range(60)}
    line = prose(rng, EN, 30)
    for i in range(40, 60):  # a common passage
        rows[i] = line + " " + rows[i]
    for k in range(40):  # near copies of all degrees
        w = rows[k].split()
        for _ in range(1 + k % 6):
            w[rng.randrange(len(w))] = "changed"
        rows[100 + k] = " ".join(w)
    for k in range(10):
        rows[200 + k] = rows[100 + k] + " one more tail"
    return rows | {300: "", 301: " \n", 302: "tiny", 303: "Tiny"}


@pytest.mark.parametrize(("often", "crowd", "piece"), [(5, 48, 100_000), (2, 3, 4), (2, 0, 7)])
def test_near_copies_against_brute_force(spark, monkeypatch, often, crowd, piece):
    rows = corpus()
    label, links = brute_components(rows)
    monkeypatch.setattr(near, "OFTEN", often)  # the order of shingles, crowds and pieces do not matter
    monkeypatch.setattr(near, "PIECE", piece)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    found = near.near_copies(df, crowd=crowd).collect()
    assert {r["doc"]: r["stays"]["doc"] for r in found} == label
    assert len(links) > 12


def test_large_groups_of_near_copies(spark):
    """Chains and heavily changed copies in one bucket, too many to meet pair by pair."""
    rng = random.Random(3)
    base = prose(rng, EN, 60).split()
    rows = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows[i] = " ".join(w[: rng.randint(50, 60)])
    label, links = brute_components(rows)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    found = near.near_copies(df, crowd=10).collect()
    assert {r["doc"]: r["stays"]["doc"] for r in found} == label
    assert len(links) > 500 and 5 < len(set(label.values())) < 140


def test_maps_bound_differences():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = rng.integers(-(2**63), 2**63 - 1, rng.integers(0, 400))
        b = np.r_[a[: rng.integers(0, len(a) + 1)], rng.integers(-(2**63), 2**63 - 1, 20)]
        x, y = (np.frombuffer(near._map(np.unique(s)), np.uint8) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
        assert near._unpacked(near._packed(np.unique(a))).tolist() == sorted(v >> 16 for v in {int(v) for v in a.view(np.uint64)})


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tie string, _h int").repartition(3)


def test_stage_drops_near_copies_that_differ_in_many_bits(spark):
    rows = corpus()
    label, _ = brute_components(rows)
    docs = frame_of(spark, [(d, t, "en", None, len(t), "x", 3) for d, t in rows.items()])
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert {r["doc_id"] for r in left.collect()} == {d for d in rows if label[d] == d} and left.columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, docs.filter("false"), "").count() == 0


def test_stage_keeps_one_row_of_each_group(spark):
    """Null and repeated ids: rows with an id are preferred, equal rows leave one."""
    rng = random.Random(1)
    one, two, three = (prose(rng, EN, 50) for _ in range(3))
    rows = [(None, one, "en"), (None, one, "en"), (None, one, None), (4, two, "en"), (4, three, "en"), (4, two, "en"), (None, two, "fr"), (9, two + " tail", "en"), (None, None, None), (None, "", "en"), (11, " \n", None)]
    left = corpus_pipeline.near_dedup(spark, frame_of(spark, [(*r, None, 1, "x", 2) for r in rows]), "").collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:9]) for r in left) == sorted([("None", one[:9]), ("4", two[:9]), ("4", three[:9]), ("11", " \n")])


def counted(monkeypatch, name, place):
    """Rows of the argument at ``place`` of each call of near.``name``."""
    rows, f = [], getattr(near, name)
    monkeypatch.setattr(near, name, lambda *a: rows.append(a[place].count()) or f(*a))
    return rows


def test_texts_that_share_a_passage_only_have_no_sets_written(spark, monkeypatch):
    """They meet by its shingles; sets of all that met were written and brought together pair by pair."""
    rng = random.Random(8)
    passages = [prose(rng, EN, 20) for _ in range(20)]
    rows = {i: f"{passages[i // 3]} {prose(rng, EN, 60)}" for i in range(60)} | {60: prose(rng, EN, 90)}
    rows[61] = rows[60] + " tail"
    wanted, compared = counted(monkeypatch, "_sets", 2), counted(monkeypatch, "_verified", 0)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r["doc"]: r["stays"]["doc"] for r in near.near_copies(df).collect()} == brute_components(rows)[0]
    assert sum(wanted) <= 10 and 1 <= sum(compared) <= 10


def test_copies_of_one_group_are_compared_a_few_times(spark, monkeypatch):
    """Of all pairs that meet, those that the first links have brought into one group are not compared."""
    rng = random.Random(9)
    base, rows = prose(rng, EN, 200).split(), {}
    for i in range(90):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows[i] = " ".join(w)
    compared = counted(monkeypatch, "_verified", 0)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    label, links = brute_components(rows)
    assert {r["doc"]: r["stays"]["doc"] for r in near.near_copies(df, crowd=100).collect()} == label
    assert len(links) > 3000 and sum(compared) < 200


def test_wide_maps_and_parts(spark, monkeypatch):
    """Sets of over 1,024 shingles have wider maps, which are folded to meet narrower ones; pairs are verified in parts."""
    rng = np.random.default_rng(5)
    for n in (900, 1030, 2040, 2060, 5000):
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.r_[a[: n - n // 20], rng.integers(-(2**63), 2**63 - 1, n // 8)])
        x, y = (near._map(s, max(near.MAP_BITS, 1 << (len(s) - 1).bit_length())) for s in (a, b))
        assert n // 30 < near._apart(x, y) == near._apart(y, x) <= len(np.setxor1d(a, b))
    words, rows = random.Random(6), {}
    for i in range(6):
        text = prose(words, EN, 1000 + 8 * i).split()
        rows |= {i: " ".join(text), 10 + i: " ".join(text + ["tail"] * 60), 20 + i: " ".join(text[: 700 + 20 * i])}
    monkeypatch.setattr(near, "PART", 10)
    compared = counted(monkeypatch, "_verified", 0)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r["doc"]: r["stays"]["doc"] for r in near.near_copies(df).collect()} == brute_components(rows)[0]
    assert len(compared) > 3
