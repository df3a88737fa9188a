"""Printed location evidence: parcel numbers, addresses, coordinates, townships; verified, merged and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as T

DOC = "document_id"


def apn_table(texts: DataFrame) -> DataFrame:
    """document_id, apn, n, first of every labelled parcel number of ``texts`` (document_id, text), most mentioned first by ``rank``."""
    at = texts.select(DOC, F.posexplode(T.apns("text")).alias("pos", "apn"))
    n = at.groupBy(DOC, "apn").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy(DOC).orderBy(F.desc("n"), "first")))


def strict_mode(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """The value that is counted strictly more often than any other of its key; ties give none."""
    w = Window.partitionBy(*keys).orderBy(F.desc(n), value)
    two = counts.withColumns({"_r": F.row_number().over(w), "_next": F.lead(n).over(w)})
    return two.filter((F.col("_r") == 1) & (F.col("_next").isNull() | (F.col(n) > F.col("_next")))).select(*keys, value, n)


def apn_site(lookups: DataFrame, anchors: DataFrame, radius_m: float = 30_000.0, cluster_m: float = 600.0) -> DataFrame:
    """County parcels of a document's numbers that lie together.

    ``lookups``: document_id, pos, apn, lon, lat, matches (features found).  Exactly one feature counts; within the
    radius of the anchor (document_id, alon, alat), and within 600 m of the upper median position.
    """
    one = lookups.filter((F.col("matches") == 1) & (F.col("pos") < 25)).join(anchors, DOC).filter(G.metres(F.col("lon"), F.col("lat"), F.col("alon"), F.col("alat")) <= radius_m)
    upper = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))
    mid = one.groupBy(DOC).agg(upper("lon").alias("mlon"), upper("lat").alias("mlat"))
    return one.join(mid, DOC).filter(G.metres(F.col("lon"), F.col("lat"), F.col("mlon"), F.col("mlat")) <= cluster_m).select(lookups.columns)


def document_coordinates(texts: DataFrame) -> DataFrame:
    """Mean of all printed Lat/Long pairs of a document."""
    at = texts.select(DOC, F.explode(T.explicit_coordinates("text")).alias("c"))
    return at.groupBy(DOC).agg(F.avg("c.lat").alias("lat"), F.avg("c.lon").alias("lon"), F.count(F.lit(1)).alias("n"))


def candidate_lines(texts: DataFrame) -> DataFrame:
    """Lines of six characters or more, and their parts between ``~`` or ``|``, in order, with ``score``.  texts: document_id, pos, text."""
    lines = texts.select(DOC, "pos", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\n|\r")).alias("line_no", "raw")).withColumn("raw", F.trim("raw")).filter(F.length("raw") >= 6)
    parts = F.when(F.col("raw").rlike("[~|]"), F.filter(F.transform(F.split("raw", "[~|]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 6)).otherwise(F.array().cast("array<string>"))
    every = lines.select(DOC, "pos", "line_no", F.posexplode(F.concat(F.array("raw"), parts)).alias("part", "line"))
    return every.withColumn("score", T.anchor_score("line"))


def anchor_candidates(texts: DataFrame, limit: int = 3) -> DataFrame:
    """Best ``limit`` distinct address lines of each document (score 3 or more), then its most named county.

    Order: score, agreement with the state that most of the lines name (smallest name on a tie), position.
    """
    scored = candidate_lines(texts).filter("score >= 3")
    state = F.upper(T.group("line", r"(?i),\s*([A-Z]{2})\b", 1))
    scored = scored.withColumn("state", state)
    named = scored.filter("state is not null").groupBy(DOC, "state").count()
    major = named.groupBy(DOC).agg(F.max_by("state", F.struct("count", F.lit(0))).alias("_any"), F.min(F.struct((-F.col("count")).alias("n"), "state"))["state"].alias("major"))
    scored = scored.join(major.select(DOC, "major"), DOC, "left").withColumns({"agrees": F.when(F.col("major").isNull() | F.col("state").isNull() | (F.col("state") == F.col("major")), 0).otherwise(1), "query": T.clean_candidate("line")}).filter("query <> ''")
    order = [F.desc("score"), F.asc("agrees"), F.asc("pos"), F.asc("line_no"), F.asc("part")]
    first = scored.withColumn("_r", F.row_number().over(Window.partitionBy(DOC, F.lower("query")).orderBy(*order))).filter("_r = 1")
    top = first.withColumn("rank", F.row_number().over(Window.partitionBy(DOC).orderBy(*order))).filter(F.col("rank") <= limit).select(DOC, "rank", "query", "score")
    county = county_candidates(texts).select(DOC, F.lit(limit + 1).alias("rank"), F.col("county").alias("query"), F.lit(None).cast("int").alias("score"))
    known = top.select(DOC, F.lower("query").alias("_q"))
    county = county.withColumn("_q", F.lower("query")).join(known, [DOC, "_q"], "left_anti").drop("_q")
    return top.unionByName(county)


def county_candidates(texts: DataFrame) -> DataFrame:
    """The "<Name> County, <State>" a document names most often, the first on a tie."""
    names = "|".join(sorted((s for s in P.STATES), key=lambda s: (-len(s), s)))
    p = r"(?i)\b([A-Z][A-Za-z.'-]+(?:\s[A-Z][A-Za-z.'-]+)?)\s+County\s*,?\s*(" + names + r")\b"
    at = texts.select(DOC, "pos", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), 0)).alias("i", "m"))
    name, state = F.initcap(F.regexp_replace(F.regexp_extract("m", p, 1), r"\s+", " ")), F.initcap(F.regexp_extract("m", p, 2))
    at = at.withColumns({"name": name, "county": F.concat(name, F.lit(" County, "), state)}).filter(~F.lower(F.substring_index("name", " ", 1)).isin("the", "of", "in", "and"))
    n = at.groupBy(DOC, "county").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "i")).alias("first"))
    return n.groupBy(DOC).agg(F.min(F.struct((-F.col("n")).alias("k"), "first", "county"))["county"].alias("county"))


LOCATION = """struct<apns:array<struct<apn:string,role:string,side:string>>,coordinates:array<struct<northing:double,easting:double,kind:string,label:string>>,
coordinate_system:struct<zone:string,datum:string,units:string,coordinates_are:string,combined_factor:double>,
plss:struct<township:int,township_dir:string,range:int,range_dir:string,meridian:string,sections:array<int>,aliquot:string>,address:string,city:string,county:string,state:string>"""


def sanitize_location(payload: Column) -> Column:
    """Model JSON to a clean struct: whitelisted roles, sides, kinds and units, plausible numbers, nothing invented."""
    raw = F.from_json(payload, LOCATION)
    digits = lambda a: F.regexp_extract_all(F.coalesce(a["apn"], F.lit("")), F.lit(r"\d+"), 0)
    one_of = lambda c, *v: F.when(c.isin(*v), c)
    named = F.transform(
        F.filter(F.coalesce(raw["apns"], F.array()), lambda a: F.length(F.array_join(digits(a), "")) >= 6),
        lambda a: F.struct(F.array_join(digits(a), "-").alias("apn"), F.coalesce(one_of(a["role"], "subject", "neighbour", "referenced"), F.lit("referenced")).alias("role"), one_of(F.upper(F.trim(a["side"])), "N", "NE", "E", "SE", "S", "SW", "W", "NW").alias("side")),
    )
    unique = F.filter(named, lambda a, i: ~F.exists(F.slice(named, F.lit(1), i), lambda b: b["apn"] == a["apn"]))
    coords = F.transform(
        F.filter(F.coalesce(raw["coordinates"], F.array()), lambda c: (c["northing"] >= 10_000) & (c["easting"] >= 10_000)),
        lambda c: F.struct(c["northing"].alias("northing"), c["easting"].alias("easting"), F.coalesce(one_of(c["kind"], "monument", "parcel_corner", "point_of_beginning", "other"), F.lit("other")).alias("kind"), T.clean_text(c["label"]).alias("label")),
    )
    cs, pl = raw["coordinate_system"], raw["plss"]
    f = cs["combined_factor"]
    system = F.struct(T.clean_text(cs["zone"]).alias("zone"), T.clean_text(cs["datum"]).alias("datum"), one_of(cs["units"], "us_survey_feet", "international_feet", "meters").alias("units"), one_of(cs["coordinates_are"], "grid", "ground").alias("coordinates_are"), F.when((f > 0.99) & (f < 1.01) & (f != 1.0), f).alias("combined_factor"))
    td, rd = F.substring(F.upper(pl["township_dir"]), 1, 1), F.substring(F.upper(pl["range_dir"]), 1, 1)
    plss = F.when(pl["township"].isNotNull() & pl["range"].isNotNull() & td.isin("N", "S") & rd.isin("E", "W"), F.struct(pl["township"].alias("township"), td.alias("township_dir"), pl["range"].alias("range"), rd.alias("range_dir"), T.clean_text(pl["meridian"]).alias("meridian"), F.filter(F.coalesce(pl["sections"], F.array()), lambda s: s.between(1, 36)).alias("sections"), T.clean_text(pl["aliquot"]).alias("aliquot")))
    return F.struct(unique.alias("apns"), coords.alias("coordinates"), system.alias("coordinate_system"), plss.alias("plss"), *(T.clean_text(raw[k]).alias(k) for k in ("address", "city", "county", "state")))


def verify(evidence: Column, ocr_text: Column) -> Column:
    """Evidence whose numbers are printed; what isn't is listed in ``dropped``, unprinted names in ``vision_only``."""
    t = T.normalise_ocr(F.coalesce(ocr_text, F.lit("")))
    ok_apn = lambda a: T.printed_apn(a["apn"], t)
    ok_xy = lambda c: T.printed_number(c["northing"], t) & T.printed_number(c["easting"], t)
    f = evidence["coordinate_system"]["combined_factor"]
    ok_f = T.printed_factor(f, t)
    dropped = F.concat(
        F.transform(F.filter(evidence["apns"], lambda a: ~ok_apn(a)), lambda a: F.concat(F.lit("APN "), a["apn"])),
        F.transform(F.filter(evidence["coordinates"], lambda c: ~ok_xy(c)), lambda c: F.concat(F.lit("coordinate N "), c["northing"].cast("string"), F.lit(" E "), c["easting"].cast("string"))),
        F.when(~ok_f, F.array(F.concat(F.lit("combined factor "), f.cast("string")))).otherwise(F.array().cast("array<string>")),
    )
    names = F.array_compact(F.array(*(F.when(evidence[k].isNotNull() & ~T.printed_words(evidence[k], t), F.lit(k)) for k in ("address", "city", "county", "state"))))
    system = evidence["coordinate_system"].withField("combined_factor", F.when(ok_f, f))
    return evidence.withField("apns", F.filter(evidence["apns"], ok_apn)).withField("coordinates", F.filter(evidence["coordinates"], ok_xy)).withField("coordinate_system", system).withField("vision_only", names).withField("dropped", dropped)


def merge(sheets: DataFrame) -> DataFrame:
    """One view of a document's sheets (document_id, page_number, e): parcel numbers with a subject role first, coordinates
    distinct to 0.01, first known value for the rest."""
    first = lambda c: F.first(c, ignorenulls=True)
    w = Window.partitionBy(DOC).orderBy("page_number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    places = ("plss", "address", "city", "county", "state")
    known = sheets.select(DOC, *(first(F.col(f"e.{k}")).over(w).alias(k) for k in places), *(first(F.col(f"e.coordinate_system.{k}")).over(w).alias(k) for k in ("zone", "datum", "units", "coordinates_are", "combined_factor"))).groupBy(DOC).agg(*(F.first(c).alias(c) for c in (*places, "zone", "datum", "units", "coordinates_are", "combined_factor")))
    a = sheets.select(DOC, "page_number", F.posexplode("e.apns").alias("i", "a"))
    a = a.groupBy(DOC, F.col("a.apn").alias("apn")).agg(F.min(F.struct(F.when(F.col("a.role") == "subject", 0).otherwise(1).alias("k"), "page_number", "i", "a")).alias("b"), F.min(F.struct("page_number", "i")).alias("o"))
    a = a.groupBy(DOC).agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "b"))), lambda s: s["b"]["a"]).alias("apns"))
    c = sheets.select(DOC, "page_number", F.posexplode("e.coordinates").alias("i", "c")).groupBy(DOC, F.bround("c.northing", 2), F.bround("c.easting", 2)).agg(F.min(F.struct("page_number", "i", "c")).alias("b"))
    c = c.groupBy(DOC).agg(F.transform(F.sort_array(F.collect_list("b")), lambda s: s["c"]).alias("coordinates"))
    return known.join(a, DOC, "left").join(c, DOC, "left")


def geocode_queries(e: Column) -> Column:
    """Address first (unless only vision read it), then county and state."""
    county = F.when(F.lower(e["county"]).rlike(r"\bcounty\b"), e["county"]).otherwise(F.concat(e["county"], F.lit(" County")))
    tail = F.concat_ws(", ", F.coalesce(e["city"], county), e["state"])
    address = F.when(e["address"].isNotNull() & ~F.array_contains(e["vision_only"], "address"), F.concat_ws(", ", e["address"], F.nullif(tail, F.lit(""))))
    return F.array_compact(F.array(address, F.when(e["county"].isNotNull() & e["state"].isNotNull(), F.concat(county, F.lit(", "), e["state"]))))


def plss_text(p: Column) -> Column:
    """A PLSS struct in the wording that ``township`` reads."""
    word = lambda d: F.create_map(*(F.lit(x) for kv in {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST"}.items() for x in kv))[d]
    sections = F.array_join(F.transform(p["sections"], lambda s: F.concat(F.lit("SECTION "), s.cast("string"), F.lit(","))), " ")
    short = F.concat(sections, F.lit(" T"), p["township"].cast("string"), p["township_dir"], F.lit(", R"), p["range"].cast("string"), p["range_dir"], F.lit(", "), p["meridian"])
    long = F.concat(F.coalesce(F.concat(p["aliquot"], F.lit(" OF ")), F.lit("")), sections, F.lit(" TOWNSHIP "), p["township"].cast("string"), F.lit(" "), word(p["township_dir"]), F.lit(", RANGE "), p["range"].cast("string"), F.lit(" "), word(p["range_dir"]), F.lit(", "), p["meridian"])
    return F.trim(F.when(F.lower(p["meridian"]).contains("meridian"), long).otherwise(short))


def consistent_with_query(query: Column, country: Column, region_code: Column) -> Column:
    """Whether a geocoder's hit agrees with the last state the query names; unknowns pass."""
    codes = F.filter(F.regexp_extract_all(query, F.lit(r"\b([A-Z]{2})\b"), 1), lambda c: c.isin(*P.STATES.values()))
    last = F.try_element_at(codes, F.lit(-1))
    return F.coalesce(last.isNull() | ((country == "US") & (F.coalesce(region_code, last) == last)), F.lit(True))


def search_text(texts: DataFrame, pattern: str, most: int = 12, context: int = 120) -> DataFrame:
    """Up to ``most`` hits of a pattern in a document's texts, with the characters around."""
    p = F.lit("(?is)(.{0,%d})(%s)(.{0,%d})" % (context, pattern, context))
    hits = texts.select(DOC, "pos", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), p, 0)).alias("i", "context"))
    return hits.withColumn("hit", F.row_number().over(Window.partitionBy(DOC).orderBy("pos", "i"))).filter(F.col("hit") <= most)


# townships

def section_corners(ring: Column, tolerance: float = 0.0008) -> Column:
    """Corners (nw, ne, sw, se) of a regular section; null if a corner of its box has no vertex near."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    west, east, south, north = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)

    def nearest(x: Column, y: Column) -> Column:
        ranked = F.array_sort(F.transform(ring, lambda p, i: F.struct((F.pow(p["x"] - x, 2) + F.pow(p["y"] - y, 2)).alias("d"), i.alias("i"), p.alias("p"))))
        p = F.get(ranked, 0)["p"]
        return F.when((F.abs(p["x"] - x) <= tolerance) & (F.abs(p["y"] - y) <= tolerance), p)

    nw, ne, sw, se = nearest(west, north), nearest(east, north), nearest(west, south), nearest(east, south)
    return F.when(nw.isNotNull() & ne.isNotNull() & sw.isNotNull() & se.isNotNull(), F.struct(nw.alias("nw"), ne.alias("ne"), sw.alias("sw"), se.alias("se")))


def section_point(corners: Column, u: Column, v: Column) -> Column:
    """Position at fractions east and north of a section: 1/16 corners, quarter corners (0.5, 1 ...) and corners alike."""
    return G.bilinear(corners["sw"], corners["se"], corners["nw"], corners["ne"], u, v)


def named_corners(texts: DataFrame) -> DataFrame:
    """Every section corner a text names: document_id, rank (two-section quarter, quarter, sixteenth, full), section, other, u, v."""
    at = lambda kv: F.create_map(*(F.lit(x) for k, (u, v) in kv.items() for x in (k, F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")))))
    quarter = at({"N": (0.5, 1.0), "S": (0.5, 0.0), "E": (1.0, 0.5), "W": (0.0, 0.5)})
    corner = at({"NE": (1.0, 1.0), "NW": (0.0, 1.0), "SE": (1.0, 0.0), "SW": (0.0, 0.0)})
    letters = lambda c: F.replace(F.replace(F.replace(F.replace(F.upper(c), F.lit("NORTH"), F.lit("N")), F.lit("SOUTH"), F.lit("S")), F.lit("EAST"), F.lit("E")), F.lit("WEST"), F.lit("W"))
    out = None
    for rank, (p, table) in enumerate(((P.TWO_SECTION_QUARTER, None), (P.ONE_SECTION_QUARTER, quarter), (P.SIXTEENTH, at(P.SIXTEENTH_AT)), (P.FULL_CORNER, corner))):
        p = "(?i)" + p
        m = texts.select(DOC, F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(p), 0)).alias("i", "m"))
        a, b = F.regexp_extract("m", p, 1), F.regexp_extract("m", p, 2).cast("int")
        if table is None:
            one = m.select(DOC, F.lit(rank).alias("rank"), "i", a.cast("int").alias("section"), b.alias("other"), F.lit(None).cast("double").alias("u"), F.lit(None).cast("double").alias("v"))
        else:
            one = m.select(DOC, F.lit(rank).alias("rank"), "i", b.alias("section"), F.lit(None).cast("int").alias("other"), table[letters(a)]["u"].alias("u"), table[letters(a)]["v"].alias("v"))
        out = one if out is None else out.unionByName(one)
    return out


def shared_quarter(a: Column, b: Column, tolerance: float = 0.0008) -> Column:
    """Midpoint of the edge that two sections share."""
    edges = lambda c: F.array(*(F.struct(c[p].alias("p"), c[q].alias("q")) for p, q in (("nw", "ne"), ("sw", "se"), ("ne", "se"), ("nw", "sw"))))
    close = lambda p, q: (F.abs(p["x"] - q["x"]) <= tolerance) & (F.abs(p["y"] - q["y"]) <= tolerance)
    hit = F.get(F.filter(edges(a), lambda e: F.exists(edges(b), lambda f: (close(e["p"], f["p"]) & close(e["q"], f["q"])) | (close(e["p"], f["q"]) & close(e["q"], f["p"])))), 0)
    return F.when(hit.isNotNull(), F.struct(((hit["p"]["x"] + hit["q"]["x"]) / 2).alias("x"), ((hit["p"]["y"] + hit["q"]["y"]) / 2).alias("y")))


def plss_anchor(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """Anchor of each document: its first named corner by kind, corroborated if two or more lie within 16 km of it.

    ``sections``: document_id (whose township was resolved), section_no, ring.
    """
    c = sections.withColumn("corners", section_corners(F.col("ring"))).filter("corners is not null").select(DOC, "section_no", "corners")
    n = named_corners(texts).join(c.withColumnRenamed("section_no", "section"), [DOC, "section"])
    n = n.join(c.select(DOC, F.col("section_no").alias("other"), F.col("corners").alias("others")), [DOC, "other"], "left")
    n = n.withColumn("p", F.when(F.col("other").isNotNull(), shared_quarter(F.col("corners"), F.col("others"))).otherwise(section_point(F.col("corners"), F.col("u"), F.col("v")))).filter("p is not null")
    first = n.groupBy(DOC).agg(F.min(F.struct("rank", "i", "p"))["p"].alias("a"), F.count_distinct("rank", "i").alias("n"))
    far = n.join(first, DOC).groupBy(DOC).agg(F.max(G.metres(F.col("p.x"), F.col("p.y"), F.col("a.x"), F.col("a.y"))).alias("spread"))
    return first.join(far, DOC).select(DOC, F.col("a.x").alias("lon"), F.col("a.y").alias("lat"), ((F.col("n") >= 2) & (F.col("spread") <= 16_000)).alias("corroborated"))


def aliquot_parts(text: Column) -> Column:
    """(section, parts, portion_of) of the first aliquot description such as ``N 1/2 OF THE SE 1/4 OF SECTION 17``."""
    p = "(?i)((?:" + P.ALIQUOT_PART.replace("(NORTH", "(?:NORTH") + r"\s+OF\s+(?:THE\s+)?)+)SECTION\s+(\d{1,2})\b"
    chain = T.group(text, p, 1)
    short = lambda c: F.replace(F.replace(F.replace(F.replace(F.upper(c), F.lit("NORTH"), F.lit("N")), F.lit("SOUTH"), F.lit("S")), F.lit("EAST"), F.lit("E")), F.lit("WEST"), F.lit("W"))
    parts = F.transform(F.regexp_extract_all(chain, F.lit("(?i)" + P.ALIQUOT_PART), 1), short)
    lead = F.regexp_extract(text, r"(?is)(.{0,60})" + p[4:], 1)
    return F.when(chain.isNotNull(), F.struct(F.regexp_extract(text, p, 2).cast("int").alias("section"), parts.alias("parts"), lead.rlike("(?i)" + P.PORTION).alias("portion_of")))


def aliquot_polygon(corners: Column, parts: Column) -> Column:
    """Ring (nw, ne, se, sw) of an aliquot part of a section."""
    b = G.aliquot_box(parts)
    return F.array(section_point(corners, b["x1"], b["y2"]), section_point(corners, b["x2"], b["y2"]), section_point(corners, b["x2"], b["y1"]), section_point(corners, b["x1"], b["y1"]))
