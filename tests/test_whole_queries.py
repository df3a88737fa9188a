"""Queries without SQL that take whole tables, against brute force."""

import math
import os
import re

import pyarrow.parquet as pq
import pytest

from plumbline.functions import patterns as P
from plumbline.operators import search
from plumbline.plans.queries import QUERIES

DATA, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def table(name, *columns, data=DATA):
    t = pq.read_table(f"{data}/{name}.parquet", columns=list(columns)).to_pydict()
    return list(zip(*(t[c] for c in columns)))


@needs_tables
def test_sheet_division_has_all_orders(spark):
    sets = {}
    for g, i in table("lineitem", "l_orderkey", "l_suppkey"):
        sets.setdefault(g, set()).add(i)
    want = {(a, b) for a, x in sets.items() for b, y in sets.items() if a != b and x <= y}
    got = [tuple(r) for r in QUERIES["sheet_division"](spark, DATA).select("inner_group", "outer_group").collect()]
    assert len(got) == len(want) and set(got) == want
    assert any(a % 5 and b % 5 for a, b in want)


@needs_tables
def test_greedy_match_has_all_customers(spark):
    want = set()
    suppliers = table("supplier", "s_suppkey", "s_nationkey", "s_acctbal", data=MORE)
    customers = table("customer", "c_custkey", "c_nationkey", "c_acctbal", data=MORE)
    for page in {n for _, n, _ in suppliers}:
        scored = []
        for s, n, a in suppliers:
            for c, m, b in customers:
                if n != page or m != page:
                    continue
                label = 4 if s % 7 == c % 7 else 0
                x, y = float(f"{abs(a):.2f}"), abs(b)
                off = abs(x - y) / max(x, y) if x and y else 0.05
                area = 2 if off <= 0.03 else -3 if off > 0.10 else 0
                if (label or area > 0) and label + area >= 2:
                    scored.append((-label - area, s, c))
        used = set()
        for k, s, c in sorted(scored):
            if ("s", s) not in used and ("c", c) not in used:
                used |= {("s", s), ("c", c)}
                want.add((page, s, c, -k))
    got = QUERIES["greedy_match"](spark, MORE).select("page_number", "entity_pos", "candidate_pos", "score").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert any(c % 10 != page % 10 for page, _, c, _ in want)


def brute_anchors(text):
    """(query, score) of the best three lines, then the county."""
    has = lambda p, s: re.search("(?i)" + p, s) is not None
    scored, states = [], []
    for n, raw in enumerate(re.split(r"\r\n|\n|\r", text)):
        raw = raw.strip(" ")
        if len(raw) < 6:
            continue
        parts = [p.strip(" ") for p in re.split("[~|]", raw)] if re.search("[~|]", raw) else []
        for k, line in enumerate([raw] + [p for p in parts if len(p) >= 6]):
            score = 5 * has(P.ADDRESS_LABEL, line) + 2 * (re.search(P.ZIP, line) is not None) + has(P.STATE_HINT, line)
            if has(P.OFFICE_HINT, line) or re.search(P.PHONE, line):
                score -= 3
            elif score >= 3 and has(P.STREET_ADDRESS, line):
                score += 1
            if score < 3:
                continue
            m = re.search(r"(?i),\s*([A-Z]{2})\b", line)
            states += [m[1].upper()] if m else []
            query = re.sub("(?i)" + P.ADDRESS_LABEL, "", line).strip(" ")
            query = re.sub("(?i)" + P.MUNICIPAL_PREFIX, "", re.sub("^[: ]+", "", query).strip(" ")).strip(" ")
            scored.append((-score, m and m[1].upper(), n, k, query))
    major = min(sorted(set(states)), key=lambda x: -states.count(x), default=None)
    ranked = sorted((s, state is not None and state != major, n, k, q) for s, state, n, k, q in scored if q)
    out = {}
    for s, _, _, _, q in ranked:
        out.setdefault(q.lower(), (q, -s))
    top = [(r, q, s) for r, (q, s) in enumerate(list(out.values())[:3], 1)]
    counties = [f"{a.title()} County, {b.title()}" for a, b in re.findall(r"([A-Z][a-z]+) County, (Idaho|Arizona)", text)]
    best = max(dict.fromkeys(counties), key=counties.count, default=None)
    return top + ([(4, best, None)] if best and best.lower() not in {q.lower() for _, q, _ in top} else [])


def test_anchor_candidates_takes_lines_and_parts_of_every_document(spark, tmp_path):
    texts = {
        1: "Site address: 700 Center Ave, Payette, ID 83661\nprose that names nothing",
        2: "City of Payette ~ 700 Center Ave ~ Payette, ID 83661\nOwner, Queen Creek, AZ 85142\nBoise, ID 83702",
        3: "nothing here\nat all",
        4: "Pima County, Arizona; Ada County, Idaho; Pima County, Arizona\n1 Main Street, Mesa, AZ 85201 | 2 Oak Road, Mesa, AZ 85202 | 3 Elm Lane, Mesa, AZ 85203 | 4 Ash Way, Mesa, AZ 85204",
        5: "Acme Surveying LLC, Boise, ID 83702\nProperty address 12 Hill Road, Eagle, ID 83616\nproperty address 12 hill road, eagle, ID 83616",
        6: "",
    }
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()] + [(7, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in QUERIES["anchor_candidates"](spark, str(tmp_path)).select("doc_id", "rank", "query", "score").collect()}
    want = {(d, *c) for d, t in texts.items() for c in brute_anchors(t)}
    assert got == want
    assert {d for d, *_ in want} == {1, 2, 4, 5} and any(s is None for *_, s in want)


def printed_calls():
    """Azimuth and distance of every call as the queries print them, by parcel and in order."""
    out = {}
    for g, n, p, s, q, e in sorted(table("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), key=lambda r: (r[0], r[1], r[2], r[3], r[5])):
        az = float(p * 7 % 360)
        q4 = az if az <= 90 else 180 - az if az <= 180 else az - 180 if az <= 270 else 360 - az
        ns, ew = ("N" if az <= 90 or az > 270 else "S"), ("E" if az <= 180 else "W")
        out.setdefault(g, []).append({"bearing": f"{ns} {int(q4):02d}°00'00\"{ew}", "distance": f"{float(q):.2f}'"})
    return out


def crossing(p):
    """First pair of edges, not neighbours, that have a point in common."""
    n = len(p)

    def side(a, b, c):
        v = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        return int(v > 0) - int(v < 0)

    def on(a, b, c):
        return side(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])

    for i in range(n):
        for j in range(i + 2, n):
            if i == 0 and j == n - 1:
                continue
            a, b, c, d = p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]
            if side(a, b, c) != side(a, b, d) and side(c, d, a) != side(c, d, b) or on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                return (i, j)
    return None


@needs_tables
def test_self_intersections(spark):
    want = {}
    for g, calls in printed_calls().items():
        pts = [tuple(map(float, p)) for p in search.points(calls)]
        length = sum(math.dist(a, b) for a, b in zip(pts, pts[1:]))
        gap = round(math.dist(pts[0], pts[-1]), 2)
        corners = pts[:-1] if len(pts) > 1 and gap <= max(1.0, 0.01 * round(length, 2)) else pts
        want[g] = crossing(corners) if len(corners) >= 4 else None
    got = {r["parcel_key"]: (r["edge_a"], r["edge_b"]) if r["self_intersects"] else None for r in QUERIES["self_intersection"](spark, DATA).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 20


@needs_tables
def test_assembled_walks(spark):
    want = {}
    for g, calls in printed_calls().items():
        kept, notes = search.assemble(search.drop_conflicting(calls))
        want[g] = (len(kept), len(notes))
    got = {r["parcel_key"]: (r["n_calls"], r["n_notes"]) for r in QUERIES["assemble_traverse"](spark, DATA).collect()}
    assert got == want and any(n < len(printed_calls()[g]) for g, (n, _) in want.items())


@needs_tables
def test_suppressed_boxes(spark):
    want = set()
    by = {}
    for k, brand, kind, price, size in table("part", "p_partkey", "p_brand", "p_type", "p_retailprice", "p_size"):
        by.setdefault(brand, []).append((-(k % 97) / 97.0, k, kind, price % 100, float(k % 10), float(size), 10.0))
    for boxes in by.values():
        kept = []
        for _, k, kind, x, y, w, h in sorted(boxes):
            def iou(o):
                i = max(0.0, min(x + w, o[1] + o[3]) - max(x, o[1])) * max(0.0, min(y + h, o[2] + o[4]) - max(y, o[2]))
                return i / (w * h + o[3] * o[4] - i) if w * h + o[3] * o[4] - i > 0 else 0.0

            if all(o[0] != kind or iou(o) < 0.6 for o in kept):
                kept.append((kind, x, y, w, h))
                want.add(k)
    got = [r["pos"] for r in QUERIES["nms"](spark, DATA).collect()]
    assert set(got) == want and len(got) == len(want) < sum(map(len, by.values()))


@needs_tables
def test_bearings_between_positions(spark):
    for r in QUERIES["bearing_between"](spark, DATA).collect():
        k = r["c_custkey"]
        a, b = map(math.radians, (39.5, 39.5 + (k % 70 - 35) / 1000))
        dl = math.radians((k % 100 - 50) / 1000)
        az = math.degrees(math.atan2(math.sin(dl) * math.cos(b), math.cos(a) * math.sin(b) - math.sin(a) * math.cos(b) * math.cos(dl))) % 360
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(dl / 2) ** 2
        assert r["distance_ft"] == pytest.approx(2 * 20_925_646.3 * math.asin(math.sqrt(h)), abs=0.02)
        if r["distance_ft"]:
            turn = abs(search.azimuth(r["bearing"].replace("'60", "'59.9")) - az) % 360
            assert min(turn, 360 - turn) < 0.0005
