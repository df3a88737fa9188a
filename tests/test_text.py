import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import evidence, legal, search


def values(spark, inputs, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, s string").coalesce(1)
    return [r["v"] for r in df.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()]


def test_bearings(spark):
    given_ = ["N 45°30'00\" E", "S0*48'45\"W", "N89o33'00”W", "s 10 e", "N0v48’45″E", "x S 95° E y", "45°", "", None]
    want = [45.5, 180 + 48 / 60 + 45 / 3600, 360 - 89.55, 170.0, 48 / 60 + 45 / 3600, 85.0, None, None, None]
    assert values(spark, given_, T.azimuth) == [pytest.approx(w) if w is not None else None for w in want]
    assert values(spark, ["N 1°02'03\"E", "S5W"], T.reverse_bearing) == ["S1°02'03\"W", "N5°E"]
    assert values(spark, ["S 0°0'10\" E", "N10E"], T.axis_key) == [180.0, 10.0]
    assert values(spark, ["123°45'00\"", "N10E", "123 45 00", "x"], T.whole_circle_azimuth) == [123.75, 10.0, 123.75, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from("NSEWnsew0123456789 °*ov'\"’”.,\t"), max_size=25), min_size=1, max_size=20))
def test_bearing_expression_equals_python(spark, sample):
    got = values(spark, sample, T.azimuth)
    want = [search.azimuth(s) for s in sample]
    assert [None if g is None else round(g, 9) for g in got] == [None if w is None else round(w, 9) for w in want]


def test_distances_and_curves(spark):
    assert values(spark, ["1,318", "250.55'", "none", None], T.distance) == [1.0, 250.55, None, None]
    assert values(spark, ["41*18'14\"", "7", "-"], T.delta) == [pytest.approx(41 + 18 / 60 + 14 / 3600), 7.0, None]


def test_areas(spark):
    assert values(spark, ["120.4 AC.±", "[40.00 AC.±]", "1.78", "43,560 SF", "n/a", None], T.acres) == [120.4, 40.0, 1.78, 1.0, None, None]
    assert values(spark, ["1.78", " 2 ", "x", ""], T.acres_to_sqft) == [pytest.approx(77_536.8), 87_120.0, None, None]
    assert values(spark, ["about 51,984 SF or 1.19 acres", "2 acres", "none"], T.stated_area_sqft) == [51_984.0, 87_120.0, None]
    two = "CONTAINING 1 acre and CONTAINING 2 acres"
    assert values(spark, ["CONTAINING 1.5 ACRES", two, "x"], T.containing_area_sqft) == [65_340.0, None, None]
    assert values(spark, ["2.78 acres", "3 acres"], lambda s: T.verified_area_sqft(s, F.lit(2.78), F.lit("acres"))) == [pytest.approx(2.78 * 43_560), None]


def test_labels_and_points(spark):
    assert values(spark, ["Remainder parcel 17-2-1-4", None], T.label_tokens) == [["REMAINDER", "PARCEL", "17-2-1-4"], []]
    assert values(spark, ["lot 3 of the"], T.core_tokens) == [["3"]]
    assert values(spark, [" n/a ", "12-A", "Unknown"], T.printed_id) == [None, "12-A", None]
    assert values(spark, ["20' Access Esmt", "LOT 1", "R/W"], T.is_encumbrance) == [True, False, True]
    assert values(spark, ["0.12345", "1.2"], lambda s: T.clean_point(s.cast("double"), F.lit(0.5))) == [[0.1234, 0.5], None]


def test_parcel_numbers(spark):
    text = "A.P.N. 085-570-29 APN: 085 500 08, S 85-500-08 E, APN 085.500.08"
    assert values(spark, [text], T.apns) == [["085-570-29", "085-500-08", "085-500-08"]]
    assert values(spark, [text, "APN 1-2-3", "APN 085-500-08 APN 085-570-29", None], T.target_apn) == ["085-500-08", None, None, None]
    assert values(spark, ["38-710-14", "038-710-14"], T.apn_variants) == [["38-710-14", "038-710-14"], ["038-710-14"]]
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    assert [(r["apn"], r["n"]) for r in evidence.apn_table(df).orderBy("rank").collect()] == [("085-500-08", 2), ("085-570-29", 1)]


def test_townships(spark):
    long = "TOWNSHIP 22 NORTH， RANGE 21 EAST， M.D.M."
    got = values(spark, [long, "T. 9 N.. R.5W.. B.M.", "Range 5 West of nothing", "Township 9 North, Range 5 West of the Boise Meridian"], T.township)
    assert tuple(got[0]) == (22, "N", 21, "E", "Mount Diablo Meridian")
    assert tuple(got[1]) == (9, "N", 5, "W", "Boise Meridian")
    assert got[2] is None
    assert values(spark, ["Gila and Salt River Base and Meridian", "6 P.M.", "ZZ"], T.meridian) == ["Gila and Salt River Meridian", "Sixth Principal Meridian", None]


def test_survey_numbers_and_factors(spark):
    assert values(spark, ["1,101.226.83", "14926910.28", "137,042", "1.234.567"], T.survey_number) == [1_101_226.83, 14_926_910.28, 137_042.0, 1_234_567.0]
    f = 1.000197939
    said = "DIVIDE GROUND COORDINATES BY THE COMBINED FACTOR OF 1.O00197939 TO C□NVERT"
    got = values(spark, [said, said.replace("DIVIDE", "MULTIPLY"), "COMBINED FACTOR OF 1.000197939", "GROUND COORDINATES FACTOR 1.0"], T.ground_to_grid)
    assert got[0] == pytest.approx(1 / f) and got[1] == pytest.approx(f) and got[2:] == [None, None]
    assert values(spark, ["Lat 39.72330 Long -90.79963; Lat. 99.12345 Long. -90.79963"], T.explicit_coordinates)[0][0].asDict() == {"lat": 39.7233, "lon": -90.79963}


def test_addresses(spark):
    lines = ["Project Address: 10235 Placerville Road, Reno, NV 89521", "Payette, ID 83661", "Surveyor, Reno, NV 89521", "2205 Cross Road, El Centro, CA 92243", "1:37435"]
    assert values(spark, lines, T.anchor_score) == [8, 3, 0, 4, 2]
    assert values(spark, ["Site Address: City OFEI Centro", "EI Paso"], T.clean_candidate) == ["EI Centro".replace("EI", "El"), "El Paso"]
    assert values(spark, ["12 Oak St, A, B, C", "A, B"], T.coarsen) == [["A, B, C", "B, C"], []]
    assert values(spark, ["12 Oak", "Reno"], T.anchor_class) == ["street", "city"]


def test_printed_evidence(spark):
    text = "N 14,834,576.92 E 2 289 281 APN 123.456 78 factor 1.OOO197939 Washoe County, Nevada"
    one = lambda e: values(spark, [text], e)[0]
    assert one(lambda s: T.printed_number(F.lit(14834576.92), s)) and not one(lambda s: T.printed_number(F.lit(4834576.0), s))
    assert one(lambda s: T.printed_apn(F.lit("123-456-78"), s)) and not one(lambda s: T.printed_apn(F.lit("23-456-78"), s))
    assert one(lambda s: T.printed_factor(F.lit(1.000197939), s)) and not one(lambda s: T.printed_factor(F.lit(1.000297939), s))
    assert one(lambda s: T.printed_words(F.lit("Washoe County"), s)) and not one(lambda s: T.printed_words(F.lit("Elko"), s))


def test_evidence_verify_and_merge(spark):
    payload = '{"apns":[{"apn":"085 500 08","role":"subject","side":"nw"},{"apn":"085-500-08"},{"apn":"999-999-99","role":"x"},{"apn":"1"}],"coordinates":[{"northing":14834576.9,"easting":2289281.0,"kind":"parcel_corner","label":"null"},{"northing":5,"easting":6}],"coordinate_system":{"coordinates_are":"ground","combined_factor":1.000197939},"plss":{"township":9,"township_dir":"north","range":5,"range_dir":"W","meridian":"Boise Meridian","sections":[34,99]},"county":"Washoe","state":"Nevada","city":" "}'
    text = "APN 085-500-08 N 14834576.92 E 2289281.05 FACTOR 1.000197939 WASHOE COUNTY NEVADA"
    df = spark.createDataFrame([("d", 1, payload, text)], "document_id string, page_number int, p string, t string")
    e = df.withColumn("e", evidence.sanitize_location(F.col("p")))
    s = e.select("e.*").first()
    assert [(a["apn"], a["role"], a["side"]) for a in s["apns"]] == [("085-500-08", "subject", "NW"), ("999-999-99", "referenced", None)]
    assert len(s["coordinates"]) == 1 and s["plss"]["sections"] == [34] and s["city"] is None
    v = e.withColumn("e", evidence.verify(F.col("e"), F.col("t")))
    r = v.select("e.*").first()
    assert r["dropped"] == ["APN 999-999-99"] and len(r["apns"]) == 1 and r["vision_only"] == []
    m = evidence.merge(v).first()
    assert m["county"] == "Washoe" and m["apns"][0]["apn"] == "085-500-08" and m["combined_factor"] == pytest.approx(1.000197939)
    assert v.select(evidence.geocode_queries(F.col("e")).alias("q")).first()["q"] == ["Washoe County, Nevada"]
    assert v.select(evidence.plss_text(F.col("e.plss")).alias("q")).first()["q"] == "SECTION 34, TOWNSHIP 9 NORTH, RANGE 5 WEST, Boise Meridian"


def test_anchor_candidates(spark):
    rows = [("d", 0, "City of Payette ~ 700 Center Ave ~ Payette, ID 83661\nOwner, Queen Creek, AZ 85142"), ("d", 1, "Boise, ID 83702\nx; Pima County, Arizona; Pima County, Arizona")]
    df = spark.createDataFrame(rows, "document_id string, pos int, text string")
    got = [(r["rank"], r["query"]) for r in evidence.anchor_candidates(df).orderBy("rank").collect()]
    assert [q for _, q in got[:3]][-1] != "Owner, Queen Creek, AZ 85142" and "Payette, ID 83661" in [q for _, q in got]
    assert got[-1] == (4, "Pima County, Arizona")


RING = [(0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01)]


def test_section_corners_and_aliquots(spark):
    ring = lambda dx: [{"x": x + dx, "y": y} for x, y in RING]
    sections = spark.createDataFrame([("a", 17, ring(0.0)), ("a", 18, ring(-0.01)), ("b", 17, ring(0.0))], "document_id string, section_no int, ring array<struct<x:double,y:double>>")
    texts = spark.createDataFrame([("a", "the 1/4 corner of sections 18 and 17"), ("b", "NE1/16 CORNER OF SECTION 17 and CE1/16 corner of section 17")], "document_id string, text string")
    got = {r["document_id"]: (round(r["lon"], 6), round(r["lat"], 6), r["corroborated"]) for r in evidence.plss_anchor(texts, sections).collect()}
    assert got == {"a": (0.0, 0.005, False), "b": (0.0075, 0.0075, True)}
    parts = values(spark, ["A PORTION OF THE N 1/2 OF S 2 OF SECTION 17", "nothing"], evidence.aliquot_parts)
    assert parts[0]["parts"] == ["N", "S"] and parts[0]["section"] == 17 and parts[0]["portion_of"] and parts[1] is None
    p = sections.filter("document_id = 'b'").select(evidence.aliquot_polygon(evidence.section_corners(F.col("ring")), F.array(F.lit("N"), F.lit("S"))).alias("p")).first()["p"]
    assert {round(v["y"], 5) for v in p} == {0.0025, 0.005} and {round(v["x"], 5) for v in p} == {0.0, 0.01}


LEGAL = "COMMENCING at a corner; thence North 00 Degrees 10 Minutes East 50 feet to the POINT OF BEGINNING; thence North 00 Degrees 00 Minutes 00 Seconds East a distance of 1,000.00 feet; thence N 90°00'00\" E 500 feet; thence S 00°00'00\" E 1000 ft; thence S 90°00'00\" W 500 ft to the POINT OF BEGINNING. CONTAINING 11.48 acres."


def test_legal_descriptions(spark):
    df = spark.createDataFrame([("d", LEGAL), ("e", LEGAL.replace("500 feet;", "500 feet along a curve;")), ("f", None), ("g", LEGAL + " " + LEGAL)], "document_id string, text string")
    rows = legal.parse_legal_descriptions(df).collect()
    assert sorted(r["document_id"] for r in rows) == ["d", "g"]
    r = next(r for r in rows if r["document_id"] == "d")
    assert [c["distance"] for c in r["calls"]] == ["1000.00'", "500'", "1000'", "500'"] and r["stated_area_acres"] == "11.48"
    assert r["calls"][0]["bearing"] == "N 00°00'00\" E"


def test_pasted_calls():
    calls, anchor = legal.pasted_calls("ANCHOR\n39.5\n-119.8\nN 22°04'05\" W 1,075.09'\nCURVE\nArc: 10\nDelta = 5°\nRadius 100\nDirection: left\nnoise")
    assert anchor == ("39.5", "-119.8") and len(calls) == 2
    assert calls[0]["distance"] == "1075.09'" and calls[1]["turn"] == "L" and calls[1]["radius"] == "100"


def test_search_hits_are_limited(spark):
    df = spark.createDataFrame([("d", 0, "lot one " * 40)], "document_id string, pos int, text string")
    assert evidence.search_text(df, "lot", most=5, context=2).count() == 5
    assert re.match("lot", "lot")
