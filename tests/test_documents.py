"""The geocoding cascade level by level, and merges of a pipeline's result with edits, against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import finalize, geocode

# what a geocoder answers


def place(region, country, lat=1.0):
    return {"lat": lat, "lon": 2.0, "region": region, "country": country}


TORONTO, RENO, STREET = place("Ontario", "Canada"), place("Nevada", "United States", 2.0), place("Nevada", "United States", 3.0)
VENEZUELA, EL_CENTRO = place("Carabobo", "Venezuela"), place("California", "United States")
ROAD, TOWN = "0 Ironwood Road", "Reno, NV 89512-2845"
CASES = {
    # name: (answers, candidates, accepted query, hits, queries asked)
    "requalified": ({ROAD: [TORONTO], TOWN: [RENO], f"{ROAD}, Nevada": [STREET, TORONTO]}, [ROAD, TOWN], f"{ROAD}, Nevada", [STREET], [ROAD, TOWN, f"{ROAD}, Nevada"]),
    "falls back": ({ROAD: [TORONTO], TOWN: [RENO]}, [ROAD, TOWN], TOWN, [RENO], [ROAD, TOWN, f"{ROAD}, Nevada"]),
    "agrees": ({ROAD: [STREET], TOWN: [RENO]}, [ROAD, TOWN], ROAD, [STREET], [ROAD, TOWN]),
    "nothing to compare with": ({ROAD: [TORONTO]}, [ROAD], ROAD, [TORONTO], [ROAD]),
    "qualified itself": ({TOWN: [RENO]}, [TOWN, ROAD], TOWN, [RENO], [TOWN]),
    "contradicts its state": ({"El Centro, CA, 92243": [VENEZUELA], "El Centro, CA 92243": [EL_CENTRO]}, ["El Centro, CA, 92243", "El Centro, CA 92243"], "El Centro, CA 92243", [EL_CENTRO], ["El Centro, CA, 92243", "CA, 92243", "El Centro, CA 92243"]),
    "coarser": ({"b, c, d": [], "c, d": [RENO]}, ["a, b, c, d", "x"], "c, d", [RENO], ["a, b, c, d", "b, c, d", "c, d"]),
    "never down to one part": ({"b": [RENO]}, ["a, b"], None, [], ["a, b"]),
    "reference unknown to the geocoder": ({ROAD: [TORONTO]}, [ROAD, TOWN], ROAD, [TORONTO], [ROAD, TOWN]),
    "reference without a region": ({ROAD: [TORONTO], TOWN: [place(None, "United States")]}, [ROAD, TOWN], TOWN, [place(None, "United States")], [ROAD, TOWN]),
    "nothing": ({}, [ROAD, TOWN], None, [], [ROAD, TOWN]),
    "blank": ({}, [" ", None], None, [], []),
}


def frames(spark, asked):
    rows = [(name, k, q) for name, (_, candidates, *_) in CASES.items() for k, q in enumerate(candidates)]
    return spark.createDataFrame(rows, "document_id string, rank int, query string"), spark.createDataFrame(asked, f"query string, hits {geocode.HITS}")


@pytest.mark.parametrize("name", CASES)
def test_asked_level_by_level(spark, name):
    """Each level asks what the unsettled document needs next, and nothing behind its first consistent hit."""
    answers, candidates, query, hits, calls = CASES[name]
    listed, _ = frames(spark, [])
    own = listed.filter(F.col("document_id") == name)
    asked = []
    for _ in range(len(calls) + 1):
        now = [r["query"] for r in geocode.open_queries(own, frames(spark, asked)[1]).collect()]
        if not now:
            break
        assert len(now) == 1
        asked.append((now[0], answers.get(now[0], [])))
    assert [q for q, _ in asked] == calls
    got = geocode.anchors(own, frames(spark, asked)[1]).collect()
    assert [(r["query"], {k: r[k] for k in ("lat", "lon", "region", "country")}) for r in got] == [(query, h) for h in hits]


def test_all_documents_at_once_and_limits(spark):
    """One table for all documents; shared queries are asked once, failed calls and repeated answers change nothing."""
    cases = {k: v for k, v in CASES.items() if k not in ("falls back", "agrees", "nothing to compare with", "nothing", "reference unknown to the geocoder", "reference without a region")}
    asked = [(q, h) for a, *_ in cases.values() for q, h in a.items()]
    asked += [(q, None) for _, _, _, _, calls in cases.values() for q in calls] + [(None, [RENO])]
    listed, answers = frames(spark, asked)
    listed = listed.filter(F.col("document_id").isin(list(cases)))
    got = {r["document_id"]: r["query"] for r in geocode.anchors(listed, answers).collect()}
    assert got == {k: v[2] for k, v in cases.items() if v[2]}
    assert geocode.open_queries(listed, answers).count() == 0
    first = {r["query"]: r["documents"] for r in geocode.open_queries(listed, answers.filter("false")).collect()}
    assert first[ROAD] == 1 and first[TOWN] == 1 and sum(first.values()) == len(cases) - 1
    two = spark.createDataFrame([("d", 0, "x")], "document_id string, rank int, query string")
    both = spark.createDataFrame([("x", [RENO, STREET, TORONTO])], f"query string, hits {geocode.HITS}")
    assert [r["place"] for r in geocode.anchors(two, both, limit=2).collect()] == [0, 1]


def test_states_in_queries(spark):
    rows = [("El Centro, CA, 92243", "california"), ("A, NV, B, CA", "california"), ("Town, CA. road", None), ("no state", None), ("Payette 83661", None), ("x, ZZ", None), (None, None)]
    got = spark.createDataFrame(rows, "q string, want string").select("want", geocode.named_state(F.col("q")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


# merges

FIELDS = ["polygon", "label"], ["area"]
STATE = "id int, polygon string, label string, area int"


def brute(base, ours, theirs):
    out = {}
    for k in {*base, *ours, *theirs}:
        b, o, t = base.get(k), ours.get(k), theirs.get(k)
        if o is None and t is None:
            continue
        if o is None or t is None:
            mine = o if t is None else t
            if b is not None and mine == b:
                continue
            out[k] = (*mine, "ours" if t is None else "theirs", 1 if b is not None else 0)
            continue
        row, refused = [], 0
        for i, owner in enumerate((o, o, t)):
            ours_changed, theirs_changed = b is None or o[i] != b[i], b is None or t[i] != b[i]
            row.append(owner[i] if ours_changed and theirs_changed else o[i] if ours_changed else t[i])
            refused += ours_changed and theirs_changed and o[i] != t[i]
        out[k] = (*row, "both", refused)
    return out


def test_three_way_against_a_loop(spark):
    rng = random.Random(6)
    some = lambda: (rng.choice(["p", "q", None]), rng.choice(["x", "y", None]), rng.choice([1, 2, None]))
    base = {k: some() for k in range(200)}
    vary = lambda: {k: tuple(x if rng.random() < 0.7 else y for x, y in zip(v, some())) for k, v in base.items() if rng.random() < 0.9} | {k: some() for k in rng.sample(range(200, 240), 15)}
    ours, theirs = vary(), vary()
    df = lambda x: spark.createDataFrame([(k, *v) for k, v in x.items()], STATE).repartition(3)
    got = finalize.three_way(df(base), df(ours), df(theirs), ["id"], *FIELDS).collect()
    assert {r["id"]: (r["polygon"], r["label"], r["area"], r["origin"], len(r["refused"])) for r in got} == brute(base, ours, theirs)
    empty = df(base).filter("false")
    assert finalize.three_way(empty, empty, empty, ["id"], *FIELDS).count() == 0


def test_users_outlines_survive_the_pipeline(spark):
    """Two outlines drawn while extraction ran, a parcel named by hand, a roster that came back without one of them."""
    df = lambda rows: spark.createDataFrame(rows, STATE)
    base = df([(1, None, "PARCEL 1", None), (2, None, "PARCEL 2", None), (3, None, "PARCEL 3", None)])
    stored = df([(1, "outline 1", "PARCEL 1", None), (2, "outline 2", "PARCEL 2", None), (3, None, "PARCEL 3", None), (9, "outline 9", "Parcel nine", None)])
    final = df([(1, None, "PARCEL 1", 100), (3, None, "PARCEL 3", 300), (4, None, "PARCEL 4", 400)])
    got = {r["id"]: r for r in finalize.three_way(base, stored, final, ["id"], *FIELDS).collect()}
    assert {k: (r["polygon"], r["area"], r["origin"]) for k, r in got.items()} == {1: ("outline 1", 100, "both"), 2: ("outline 2", None, "ours"), 3: (None, 300, "both"), 4: (None, 400, "theirs"), 9: ("outline 9", None, "ours")}
    assert [r["reason"] for r in got[2]["refused"]] == ["changed by a user, gone from the new result"] and not got[1]["refused"] and not got[9]["refused"]


def test_edits_in_any_order(spark):
    edits = [(1, "label", "a", 1, "u"), (1, "label", "b", 2, "u"), (1, "label", "c", 2, "v"), (1, "area", "7", 1, "u"), (2, "label", None, 3, "u"), (2, "label", "z", 2, "u"), (8, "label", "lost", 1, "u"), (1, "nonsense", "x", 9, "u"), (1, None, "x", 9, "u")]
    state = spark.createDataFrame([(1, "p", "old", 5), (2, "p", "old", 5), (3, "p", "old", 5)], STATE)
    seen = set()
    for order in itertools.islice(itertools.permutations(edits), 0, None, 60_000):
        e = spark.createDataFrame(list(order), "id int, field string, value string, version int, editor string").repartition(2)
        seen.add(str(sorted(map(tuple, finalize.edited(state, e, ["id"], ["label", "area"]).collect()))))
    assert seen == {str([(1, "p", "c", 7), (2, "p", None, 5), (3, "p", "old", 5)])}


def test_results_of_older_confirmations_are_refused(spark):
    state = spark.createDataFrame([(1, "c2", "pending", None), (2, "c5", "pending", None), (3, None, "pending", None)], "id int, confirmation_id string, status string, scale double")
    results = spark.createDataFrame([(1, "c1", 1, "good", 0.5), (1, "c2", 2, "good", 0.6), (1, "c2", 3, "better", None), (2, "c4", 9, "good", 0.7), (3, "c1", 1, "good", 0.1), (7, "c1", 1, "good", 0.1)], "id int, confirmation_id string, version int, status string, scale double")
    out, refused = finalize.verified(state, results, ["id"], ["status", "scale"])
    assert sorted(map(tuple, out.collect())) == [(1, "c2", "better", None), (2, "c5", "pending", None), (3, None, "pending", None)]
    assert sorted(map(tuple, refused.collect())) == [(1, "c1", 1, "confirmed anew meanwhile"), (1, "c2", 2, "replaced by a later result"), (2, "c4", 9, "confirmed anew meanwhile"), (3, "c1", 1, "confirmed anew meanwhile"), (7, "c1", 1, "no such row")]
