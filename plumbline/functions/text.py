"""Text to typed values, as Column expressions (no UDF): the parsers never guess, an unreadable value is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

SQFT_PER_ACRE = 43_560.0


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def group(text: Column | str, pattern: str, i: int) -> Column:
    """Group ``i`` of the first match; null if there is no match or the group took no part in it."""
    return F.nullif(F.regexp_extract(_col(text), pattern, i), F.lit(""))


def number(text: Column) -> Column:
    """A double from text, thousands separators removed."""
    return F.replace(text, F.lit(",")).try_cast("double")


def dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    zero = F.lit(0.0)
    return degrees.cast("double") + F.coalesce(minutes.cast("double"), zero) / 60 + F.coalesce(seconds.cast("double"), zero) / 3600


def azimuth(bearing: Column | str) -> Column:
    """Degrees clockwise from north of the first quadrant bearing; no range check."""
    quadrant = F.upper(F.concat(group(bearing, P.BEARING, 1), group(bearing, P.BEARING, 5)))
    a = dms(*(group(bearing, P.BEARING, i) for i in (2, 3, 4)))
    of = lambda values: F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), quadrant)
    return of({"NE": 0.0, "SE": 180.0, "SW": 180.0, "NW": 360.0}) + a * of({"NE": 1.0, "SE": -1.0, "SW": 1.0, "NW": -1.0})


def whole_circle_azimuth(bearing: Column | str) -> Column:
    """A quadrant bearing, or else an angle of 0 to 360 on its own (``123°45'20"``, ``123 45 20``)."""
    p = r"""^\s*(\d{1,3}(?:\.\d+)?)\s*[°\s]?\s*(?:(\d{1,2}(?:\.\d+)?)\s*['’′\s]?\s*)?(?:(\d{1,2}(?:\.\d+)?)\s*["”″]?\s*)?$"""
    whole = dms(*(group(bearing, p, i) for i in (1, 2, 3)))
    return F.coalesce(azimuth(bearing), F.when(whole <= 360, whole))


def distance(text: Column | str) -> Column:
    """First number; a comma ends it."""
    return group(text, P.DISTANCE, 1).cast("double")


def delta(text: Column | str) -> Column:
    """A curve's angle in degrees."""
    return F.when(group(text, P.DELTA, 1).isNotNull(), dms(*(group(text, P.DELTA, i) for i in (1, 2, 3))))


def reverse_bearing(bearing: Column | str) -> Column:
    """The same line walked from its other end."""
    ns, d, m, s, ew = (group(bearing, P.BEARING, i) for i in range(1, 6))
    flip = lambda c: F.translate(F.upper(c), "NSEW", "SNWE")
    return F.concat(flip(ns), d, F.lit("°"), F.coalesce(F.concat(m, F.lit("'")), F.lit("")), F.coalesce(F.concat(s, F.lit('"')), F.lit("")), flip(ew))


def axis_key(bearing: Column | str) -> Column:
    """Orientation of a line: azimuth mod 180 to one decimal (half-even, and 180.0 stays apart from 0.0)."""
    return F.bround(F.pmod(azimuth(bearing), F.lit(180.0)), 1)


def acres_to_sqft(value: Column | str) -> Column:
    return F.trim(_col(value)).try_cast("double") * SQFT_PER_ACRE


def _area(value: Column, unit: Column) -> Column:
    v = number(value)
    return F.when(F.lower(unit).startswith("ac"), v * SQFT_PER_ACRE).otherwise(v)


def stated_area_sqft(text: Column | str) -> Column:
    """First area with a unit, in square feet."""
    p = "(?i)" + P.AREA
    return _area(group(text, p, 1), group(text, p, 2))


def containing_area_sqft(text: Column | str) -> Column:
    """The area of a CONTAINING clause, if there is exactly one."""
    p = "(?i)" + P.CONTAINING
    return F.when(F.regexp_count(_col(text), F.lit(p)) == 1, _area(group(text, p, 1), group(text, p, 2)))


def acres(text: Column | str) -> Column:
    """First number in acres; square feet are converted."""
    t = F.replace(F.upper(_col(text)), F.lit(","))
    v = distance(t)
    return F.when(t.rlike(P.SQUARE_FEET), v / SQFT_PER_ACRE).otherwise(v)


def verified_area_sqft(text: Column, value: Column, unit: Column) -> Column:
    """``value`` in square feet if that number is printed in ``text``."""
    printed = F.regexp_extract_all(F.replace(text, F.lit(",")), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    same = F.exists(printed, lambda n: F.abs(n.cast("double") - value) <= 1e-6 * F.greatest(F.lit(1.0), value))
    return F.when((value > 0) & same, F.when(unit == "acres", value * SQFT_PER_ACRE).when(unit == "square_feet", value))


def label_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.upper(F.coalesce(_col(text), F.lit(""))), F.lit(P.LABEL_TOKEN), 0)


def core_tokens(text: Column | str) -> Column:
    return F.array_except(label_tokens(text), F.array(*map(F.lit, P.GENERIC_WORDS)))


def printed_id(value: Column | str) -> Column:
    t = F.trim(_col(value))
    return F.when(~F.upper(t).isin(*P.NULLISH), t)


def clean_text(value: Column | str) -> Column:
    """White space collapsed, nullish words null."""
    t = F.trim(F.regexp_replace(_col(value), r"\s+", " "))
    return F.when((t != "") & ~F.upper(t).isin(*P.NULLISH_EVIDENCE), t)


def clean_point(x: Column, y: Column) -> Column:
    return F.when(x.between(0, 1) & y.between(0, 1), F.array(F.bround(x, 4), F.bround(y, 4)))


def is_encumbrance(label: Column | str) -> Column:
    return F.coalesce(_col(label), F.lit("")).rlike("(?i)" + P.ENCUMBRANCE)


def apns(text: Column | str) -> Column:
    """All labelled parcel numbers in order, with dashes."""
    whole = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit("(?i)" + P.APN), 0)
    return F.transform(whole, lambda m: F.concat_ws("-", *(F.regexp_extract(m, "(?i)" + P.APN, i) for i in (1, 2, 3))))


def apn_counts(text: Column | str) -> Column:
    """Array of (apn, n), most mentioned first, then by first mention."""
    found = apns(text)
    counted = F.transform(F.array_distinct(found), lambda a, i: F.struct((-F.size(F.filter(found, lambda b: b == a))).alias("k"), i.alias("i"), a.alias("apn")))
    return F.transform(F.array_sort(counted), lambda s: F.struct(s["apn"].alias("apn"), (-s["k"]).alias("n")))


def target_apn(text: Column | str) -> Column:
    """The parcel number named strictly more often than any other."""
    c = apn_counts(text)
    first, second = F.get(c, 0), F.get(c, 1)
    return F.when(second.isNull() | (first["n"] > second["n"]), first["apn"])


def apn_variants(apn: Column | str) -> Column:
    """As printed, then with the first group padded to three digits."""
    head = F.substring_index(_col(apn), "-", 1)
    padded = F.when(F.length(head) < 3, F.lpad(head, 3, "0")).otherwise(head)
    return F.array_distinct(F.array(_col(apn), F.concat(padded, F.substring(_col(apn), F.length(head) + 1, F.length(_col(apn))))))


def meridian(raw: Column | str) -> Column:
    """Full name of a principal meridian from its name or abbreviation; null if unknown."""
    raw = _col(raw)
    name = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^\s*(?:OF\s+THE\s+|OF\s+|THE\s+)", ""), r"(?i)\bBASE\s+(?:AND|&)\s+", "")
    name = F.array_join(F.transform(F.split(F.trim(name), r"\s+"), lambda w: F.when(F.lower(w).isin("and", "of"), F.lower(w)).otherwise(F.initcap(w))), " ")
    known = F.create_map(*(F.lit(x) for kv in P.MERIDIANS.items() for x in kv))
    return F.when(F.upper(raw).contains("MERIDIAN"), name).otherwise(F.try_element_at(known, F.upper(F.regexp_replace(raw, r"[.\s&]", ""))))


def township(text: Column | str) -> Column:
    """(township, township_dir, range, range_dir, meridian) of the first description with a known meridian, long form first."""
    def option(pattern: str) -> Column:
        p = "(?i)" + pattern

        def one(m: Column) -> Column:
            return F.struct(
                F.regexp_extract(m, p, 1).cast("int").alias("township"),
                F.upper(F.substring(F.regexp_extract(m, p, 2), 1, 1)).alias("township_dir"),
                F.regexp_extract(m, p, 3).cast("int").alias("range"),
                F.upper(F.substring(F.regexp_extract(m, p, 4), 1, 1)).alias("range_dir"),
                meridian(F.regexp_extract(m, p, 5)).alias("meridian"),
            )

        return F.get(F.filter(F.transform(F.regexp_extract_all(_col(text), F.lit(p), 0), one), lambda s: s["meridian"].isNotNull()), 0)

    return F.coalesce(option(P.TOWNSHIP_LONG), option(P.TOWNSHIP_SHORT))


def survey_number(raw: Column | str) -> Column:
    """Every separator counts thousands, but for a last one before one or two digits."""
    raw = _col(raw)
    whole, frac = F.regexp_extract(raw, r"^([\d.,]*?)[.,](\d{1,2})$", 1), group(raw, r"^([\d.,]*?)[.,](\d{1,2})$", 2)
    digits = lambda c: F.regexp_replace(c, "[.,]", "")
    return F.when(frac.isNotNull(), F.concat(digits(whole), F.lit("."), frac).try_cast("double")).otherwise(F.nullif(digits(raw), F.lit("")).try_cast("double"))


def ground_to_grid(text: Column | str) -> Column:
    """What a printed ground coordinate is multiplied by to give its grid value; null unless the sheet states it."""
    text = _col(text)
    f = F.translate(group(text, "(?i)" + P.GROUND_FACTOR, 1), "OoIl", "0011").try_cast("double")
    ok = text.rlike(r"(?i)GROUND\s*C[O0]") & (f > 0.99) & (f < 1.01) & (f != 1.0)
    return F.when(ok, F.when(text.rlike(r"(?i)MULTIPLY\s+GROUND"), f).otherwise(1 / f))


def explicit_coordinates(text: Column | str) -> Column:
    """Array of (lat, lon) printed as Lat/Long and inside the loose US box."""
    p = "(?i)" + P.LAT_LONG
    found = F.transform(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(p), 0), lambda m: F.struct(F.regexp_extract(m, p, 1).cast("double").alias("lat"), F.regexp_extract(m, p, 2).cast("double").alias("lon")))
    return F.filter(found, lambda s: s["lat"].between(17, 72) & s["lon"].between(-180, -65))


def clean_candidate(line: Column | str) -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(_col(line), "(?i)" + P.ADDRESS_LABEL, ""), r"^[: ]+", ""))
    return F.regexp_replace(F.trim(F.regexp_replace(t, "(?i)" + P.MUNICIPAL_PREFIX, "")), r"\bEI\b(?=\s+[A-Z])", "El")


def anchor_score(line: Column | str) -> Column:
    """Additive score of an address line: label 5, postal code 2, state or county 1, office or phone -3, else street 1."""
    line = _col(line)
    hit = lambda p, n: F.when(line.rlike("(?i)" + p), n).otherwise(0)
    base = hit(P.ADDRESS_LABEL, 5) + F.when(line.rlike(P.ZIP), 2).otherwise(0) + hit(P.STATE_HINT, 1)
    office = line.rlike("(?i)" + P.OFFICE_HINT) | line.rlike(P.PHONE)
    # bound once: each pattern is tried once a line, however often its result is used
    seen = F.array(F.struct(base.alias("base"), office.alias("office")))
    score = F.transform(seen, lambda s: F.when(s["office"], s["base"] - 3).when((s["base"] >= 3) & line.rlike("(?i)" + P.STREET_ADDRESS), s["base"] + 1).otherwise(s["base"]))
    return F.get(score, 0)


def anchor_class(query: Column | str) -> Column:
    return F.when(_col(query).rlike(P.STREET_NUMBER), "street").otherwise("city")


def coarsen(query: Column | str) -> Column:
    """The query without its first 1, 2, ... comma segments, two left at least."""
    parts = F.transform(F.split(_col(query), ","), lambda p: F.trim(p))
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(parts, i + 1, n), ", "))).otherwise(F.array().cast("array<string>"))


def locality_qualified(query: Column | str) -> Column:
    return _col(query).rlike(r",\s*[A-Z]{2}\b") | _col(query).rlike(P.ZIP)


def legal_bearing(text: Column | str) -> Column:
    """Canonical text of the first word ("South 00 Degrees ...") or symbol bearing."""
    text = _col(text)

    def canon(p: str) -> Column:
        ns, d, m, s, ew = (group(text, "(?i)" + p, i) for i in range(1, 6))
        out = F.format_string("%s %02d°%02d'%s\" %s", F.upper(F.substring(ns, 1, 1)), d.cast("int"), m.cast("int"), F.coalesce(s, F.lit("0")), F.upper(F.substring(ew, 1, 1)))
        return F.when(ns.isNotNull(), out)

    return F.coalesce(canon(P.WORD_BEARING), canon(P.SYMBOL_BEARING))


def printed_number(value: Column, text: Column) -> Column:
    """Whether the whole part of ``value`` is printed, separators and O for 0 tolerated."""
    digits = F.regexp_replace(text, r"(?<=\d)[,\s](?=\d{3}\b)", "")
    digits = F.regexp_replace(digits, r"(?<=\d)[Oo](?=\d)|(?<=\d)[Oo]\b|\b[Oo](?=\d)", "0")
    return F.rlike(digits, F.concat(F.lit(r"(?<!\d)"), F.floor(F.abs(value)).cast("bigint").cast("string"), F.lit(r"(?!\d)")))


def printed_apn(apn: Column, text: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(r"(?<!\d)"), F.replace(apn, F.lit("-"), F.lit(r"[\s\-.]?")), F.lit(r"(?!\d)")))


def printed_words(phrase: Column, text: Column) -> Column:
    """Whether the phrase's first three telling words are all printed."""
    ws = F.filter(F.regexp_extract_all(phrase, F.lit("[A-Za-z0-9]+"), 0), lambda w: (F.length(w) > 1) & ~F.upper(w).isin("COUNTY", "THE", "OF"))
    return F.coalesce((F.size(ws) > 0) & F.forall(F.slice(ws, 1, 3), lambda w: F.rlike(text, F.concat(F.lit(r"(?i)\b"), w, F.lit(r"\b")))), F.lit(False))


def printed_factor(factor: Column, text: Column) -> Column:
    """Whether a factor is printed in full, or agrees through its first three significant decimals; O counts as 0."""
    # lookbehind over runs replaces repeated passes: any O next to digits, points or other such O's
    fixed = reduce(lambda t, _: F.regexp_replace(t, r"(?<=[\d.])[Oo]|[Oo](?=[\d.])", "0"), range(6), text)
    digits = F.rtrim(F.format_string("%.9f", factor), F.lit("0"))

    def lead(s: Column) -> Column:
        whole, frac = F.substring_index(s, ".", 1), F.substring_index(s, ".", -1)
        zeros = F.length(frac) - F.length(F.ltrim(frac, F.lit("0")))
        return F.when(F.length(frac) - zeros >= 3, F.concat(whole, F.lit("."), F.substring(frac, F.lit(1), (zeros + 3).cast("int"))))

    numbers = F.regexp_extract_all(fixed, F.lit(r"(?<!\d)(\d\.\d+)"), 1)
    return F.rlike(fixed, F.concat(F.lit(r"(?<!\d)"), F.replace(digits, F.lit("."), F.lit(r"\.")))) | F.exists(numbers, lambda m: lead(m) == lead(digits))


def normalise_ocr(text: Column | str) -> Column:
    return F.translate(_col(text), "：，", ":,")
