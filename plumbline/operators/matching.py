"""Joins of what was read to what was drawn: containment, nearest, tolerance and greedy one-to-one matching.

Every non-equi join has an equality to meet on first (document and page, or a grid cell); greedy choices are inherently
sequential and run per page over an explicit total order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import patterns as P
from ..functions import text as T

PAGE = ["document_id", "page_number"]
OCR_CLASSES = P.TEXT_CLASSES


CELL = ["_lx", "_ly", "_gx", "_gy"]


def box_cells(boxes: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grid cells (``CELL``) on which boxes (PAGE, region_index, bbox) and the points (PAGE, cx, cy) that may lie in them meet.

    A box has cells of a quarter to a half of its width and height, so it covers 25 at most; a point is filed once for each size of box on its page.
    Of the boxes of a cell only the smallest that covers all of it and smaller ones stay (the first of equals): no point of the cell can be
    in a better one that is left out, and how many stay doesn't grow with the boxes that lie on each other.
    """
    level = lambda n: F.ceil(F.log2(F.greatest(F.col(f"bbox.{n}").cast("double"), F.lit(1e-6)))).cast("int") - 2
    cell = {n: F.pow(F.lit(2.0), F.col(f"_l{n}")) for n in "xy"}
    span = lambda a, n: F.sequence(F.floor(F.col(f"bbox.{a}") / cell[a]), F.floor((F.col(f"bbox.{a}") + F.col(f"bbox.{n}")) / cell[a]))
    b = boxes.filter("bbox.w >= 0 and bbox.h >= 0").withColumns({"_lx": level("w"), "_ly": level("h")})
    levels = b.groupBy(*PAGE).agg(F.collect_set(F.struct("_lx", "_ly")).alias("_levels"))
    b = b.withColumn("_gx", F.explode(span("x", "w"))).withColumn("_gy", F.explode(span("y", "h")))
    # a cell's upper ends are in the next one
    reaches = lambda a, n: (F.col(f"bbox.{a}") <= F.col(f"_g{a}") * cell[a]) & (F.col(f"bbox.{a}") + F.col(f"bbox.{n}") >= (F.col(f"_g{a}") + 1) * cell[a])
    rank = F.struct((F.col("bbox.w") * F.col("bbox.h")).alias("area"), "region_index")
    b = b.withColumns({"_rank": rank, "_all": reaches("x", "w") & reaches("y", "h")})
    least = b.filter("_all").groupBy(*PAGE, *CELL).agg(F.min("_rank").alias("_least"))
    b = b.join(least, [*PAGE, *CELL], "left").filter("_least is null or _rank <= _least").drop("_least", "_rank", "_all")
    p = points.join(levels, PAGE).withColumn("_level", F.explode("_levels")).withColumns({"_lx": F.col("_level._lx"), "_ly": F.col("_level._ly")}).drop("_levels", "_level")
    return b, p.withColumns({"_gx": F.floor(F.col("cx") / cell["x"]), "_gy": F.floor(F.col("cy") / cell["y"])})


def lines_to_regions(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions with the lines whose centre they hold: the smallest of several, the first on a tie.

    Text is joined in line order, confidence averaged to three decimals.  Regions of other classes get no lines.
    """
    c = lines.select(*PAGE, "line_no", "text", "confidence", ((F.col("bbox.x1") + F.col("bbox.x2")) / 2).alias("cx"), ((F.col("bbox.y1") + F.col("bbox.y2")) / 2).alias("cy"))
    r, c = box_cells(regions.select(*PAGE, "region_index", "bbox"), c)
    inside = F.col("cx").between(F.col("bbox.x"), F.col("bbox.x") + F.col("bbox.w")) & F.col("cy").between(F.col("bbox.y"), F.col("bbox.y") + F.col("bbox.h"))
    best = c.join(r, [*PAGE, *CELL]).filter(inside).groupBy(*PAGE, "line_no", "text", "confidence").agg(F.min(F.struct((F.col("bbox.w") * F.col("bbox.h")).alias("area"), "region_index")).alias("b"))
    text = best.groupBy(*PAGE, F.col("b.region_index").alias("region_index")).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"), F.round(F.avg("confidence"), 3).alias("_conf"))
    out = regions.drop("ocr_text", "ocr_confidence").join(text, [*PAGE, "region_index"], "left")
    ok = F.col("class").isin(*OCR_CLASSES)
    return out.withColumns({
        "ocr_text": F.when(ok, F.coalesce(F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit(""))),
        "ocr_confidence": F.when(ok, F.col("_conf")),
        "ocr_status": F.when(ok, "done").otherwise("skipped"),
    }).drop("l", "_conf")


def band_count(regions: DataFrame) -> DataFrame:
    """Bands a page is read in, by its readable regions: over 40 4, over 15 3, over 5 2, else 1."""
    n = F.count_if(F.col("class").isin(*OCR_CLASSES))
    return regions.groupBy(*PAGE).agg(n.alias("eligible"), F.bool_or(F.col("class").isin(*OCR_CLASSES)).alias("needs_ocr")).withColumn("bands", F.when(F.col("eligible") > 40, 4).when(F.col("eligible") > 15, 3).when(F.col("eligible") > 5, 2).otherwise(1))


def reliable_drawing(lines: DataFrame, keys: list[str], floor: float = 0.6) -> DataFrame:
    return lines.groupBy(*keys).agg((F.coalesce(F.avg("confidence"), F.lit(0.0)) >= floor).alias("reliable"))


def _per_group(df: DataFrame, keys: list[str], keep: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(lambda pdf: pdf[keep(pdf)], df.schema)


def nms(boxes: DataFrame, keys: list[str], threshold: float = 0.6) -> DataFrame:
    """Greedy suppression: confidence descending, then ``pos``; a box goes if it overlaps a kept one of its class."""

    def keep(pdf: pd.DataFrame) -> np.ndarray:
        b, out = pdf[["x", "y", "w", "h"]].to_numpy(float), np.zeros(len(pdf), bool)
        kept, n = np.empty_like(b), 0
        for i in np.lexsort((pdf["pos"], -pdf["confidence"])):
            k = kept[:n]
            w = np.minimum(k[:, 0] + k[:, 2], b[i, 0] + b[i, 2]) - np.maximum(k[:, 0], b[i, 0])
            h = np.minimum(k[:, 1] + k[:, 3], b[i, 1] + b[i, 3]) - np.maximum(k[:, 1], b[i, 1])
            inter = np.clip(w, 0, None) * np.clip(h, 0, None)
            union = k[:, 2] * k[:, 3] + b[i, 2] * b[i, 3] - inter
            if not n or (inter / np.where(union > 0, union, 1)).max() < threshold:
                kept[n], n, out[i] = b[i], n + 1, True
        return out

    return _per_group(boxes, [*keys, "class"], keep)  # classes don't touch each other


def dedupe_near(points: DataFrame, keys: list[str], columns: tuple[str, ...], tolerance: float, norm: str = "max") -> DataFrame:
    """Keeps the first (by ``pos``) of points closer than ``tolerance``: on every axis ('max') or straight ('l2')."""

    def keep(pdf: pd.DataFrame) -> np.ndarray:
        v, out, kept = pdf[list(columns)].to_numpy(float), np.zeros(len(pdf), bool), []
        for i in np.argsort(pdf["pos"].to_numpy(), kind="stable"):
            d = np.abs(v[kept] - v[i]) if kept else np.zeros((0, v.shape[1]))
            gap = d.max(1) if norm == "max" else np.hypot(*d.T) if len(d) else np.zeros(0)
            if not (gap <= tolerance).any():
                kept.append(i)
                out[i] = True
        return out

    return _per_group(points, keys, keep)


def match_score(entity: Column, candidate: Column) -> Column:
    """Score of (label, printed_id, stated_area) against (label, acres): label 4, 3 or 0, area 2, 0 or -3; null if no match."""
    e, c = T.label_tokens(entity["label"]), T.label_tokens(candidate["label"])
    ek, ck = T.core_tokens(entity["label"]), T.core_tokens(candidate["label"])
    plain = lambda s: F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z0-9]", "")
    subset = (F.size(ek) > 0) & (F.size(ck) > 0) & ((F.size(F.array_except(ek, ck)) == 0) | (F.size(F.array_except(ck, ek)) == 0))
    by_id = (plain(entity["printed_id"]) != "") & F.contains(plain(candidate["label"]), plain(entity["printed_id"]))
    label = F.when((F.size(e) > 0) & (e == c), 4).when(subset | by_id, 3).otherwise(0)
    a, b = T.acres(entity["stated_area"]), candidate["acres"]
    off = F.abs(a - b) / F.greatest(a, b)
    area = F.when((a != 0) & (b != 0), F.when(off <= 0.03, 2).when(off > 0.10, -3).otherwise(0)).otherwise(0)
    return F.when(((label > 0) | (area > 0)) & (label + area >= 2), label + area)


class _Free:
    """Candidates by ascending value, those without one first: the least rank of a range, and taking it away."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, rank: np.ndarray, value: np.ndarray):
        order = np.lexsort((rank, value, ~np.isnan(value)))
        self.blank, self.n = int(np.isnan(value).sum()), len(rank)
        self.value = value[order[self.blank :]]
        self.size = 1 << max(self.n - 1, 0).bit_length()
        rows = [np.full(self.size, self.NONE)]
        rows[0][: self.n] = rank[order]
        while len(rows[-1]) > 1:
            rows.append(np.minimum(rows[-1][::2], rows[-1][1::2]))
        self.least = [self.NONE, *np.concatenate(rows[::-1]).tolist()]  # node k has the children 2k and 2k + 1
        self.leaf = dict(zip(rank[order].tolist(), range(self.size, self.size + self.n)))

    def within(self, a: float, limit: float) -> tuple[int, int]:
        """The range of values that are off ``a`` by at most ``limit`` of the larger: being off grows to both sides, so ends are bisected."""
        off = lambda k: abs(a - self.value[k]) / max(a, self.value[k]) <= limit
        mid = int(np.searchsorted(self.value, a))
        lo, hi = bisect_left(range(mid), True, key=off), mid + bisect_left(range(mid, len(self.value)), True, key=lambda k: not off(k))
        return self.blank + lo, self.blank + hi

    def first(self, lo: int, hi: int, used: bytearray, item: list[int]) -> int | None:
        """Least rank of a range whose item is not used."""
        while True:
            best, i, j = self.NONE, lo + self.size, hi + self.size
            while i < j:
                if i & 1:
                    best, i = min(best, self.least[i]), i + 1
                if j & 1:
                    j -= 1
                    best = min(best, self.least[j])
                i, j = i >> 1, j >> 1
            if best == self.NONE or not used[item[best]]:
                return None if best == self.NONE else best
            k = self.leaf[best]
            self.least[k] = self.NONE
            while k > 1:
                k >>= 1
                self.least[k] = min(self.least[2 * k], self.least[2 * k + 1])


def _assign(entities: pd.DataFrame, candidates: pd.DataFrame, links: pd.DataFrame) -> list[tuple[int, int, int]]:
    """entity, candidate and score of a page, best scores first, then entities and candidates by position.

    Labels that match (``links``: kind, other, pos their score) are few beside pairs, and areas that agree are ranges of the sorted areas, so a choice is the
    least position of a few ranges; an entity that is still free at 4 or 3 has nothing free left within 3 %.
    """
    candidates = candidates.sort_values("pos", kind="stable")
    position, item = np.unique(candidates["pos"].to_numpy(np.int64), return_inverse=True)
    rank, value = np.arange(len(candidates)), candidates["value"].to_numpy(float)
    free = {k: _Free(rank[rows], value[rows]) for k, rows in candidates.groupby("other", sort=False).indices.items()}
    page = _Free(rank, value)
    met = {k: list(zip(g["other"], g["pos"])) for k, g in links.groupby("kind", sort=False)}
    options: dict[int, dict[int, list[tuple[_Free, int, int]]]] = {}
    for pos, kind, a in zip(entities["pos"].tolist(), entities["kind"], entities["value"].tolist()):
        own = options.setdefault(pos, {s: [] for s in (6, 5, 4, 3, 2)})
        for other, label in met.get(kind, ()):
            f = free[other]
            if a != a:
                own[label].append((f, 0, f.n))
            else:
                own[label + 2].append((f, *f.within(a, 0.03)))
                own[label] += [(f, *f.within(a, 0.10)), (f, 0, f.blank)]
        if a == a:
            own[2].append((page, *page.within(a, 0.03)))
    used, item, out, waiting = bytearray(len(position)), item.tolist(), [], sorted(options)
    for score in (6, 5, 4, 3, 2):
        left = []
        for pos in waiting:
            found = [r for f, lo, hi in options[pos][score] if lo < hi and (r := f.first(lo, hi, used, item)) is not None]
            if found:
                used[item[min(found)]] = 1
                out.append((pos, int(position[item[min(found)]]), score))
            else:
                left.append(pos)
        waiting = left
    return out


def match_evidence(entities: DataFrame, candidates: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """entity_pos, candidate_pos, score of the greedy assignment of extracted parcels to a sheet's entities.

    One-to-one by ``match_score`` descending, then entity, then candidate position.  Pairs are never listed: distinct labels meet once for all their
    rows (by equal label words, by a core word in common, or, for printed ids, by page), and each page then chooses over sorted areas.  A page is one
    task, as a choice hangs on all before it; its work is its rows times the logarithm of their number, and a row is a position, a label and an area.
    """
    plain = lambda s: F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z0-9]", "")
    label = F.coalesce("label", F.lit("")).alias("label")
    e = entities.select(*keys, F.col("pos").cast("long").alias("pos"), label, plain(F.col("printed_id")).alias("printed_id"), T.acres("stated_area").alias("value"))
    c = candidates.select(*keys, F.col("pos").cast("long").alias("pos"), label, F.col("acres").alias("value"))
    kind = F.concat_ws("|", "printed_id", "label")

    def words(label: Column) -> Column:
        whole = F.array_join(T.label_tokens(label), " ")
        return F.array_distinct(F.concat(F.when(whole != "", F.array(F.concat(F.lit("="), whole))).otherwise(F.array().cast("array<string>")), T.core_tokens(label)))

    none = F.lit(None).cast("string")
    ek = e.select(*keys, kind.alias("kind"), F.struct("label", "printed_id", none.alias("stated_area")).alias("e")).distinct()
    ck = c.select(*keys, F.col("label").alias("other"), F.struct("label", F.lit(None).cast("double").alias("acres")).alias("c")).distinct()
    by_word = ek.withColumn("_w", F.explode(words(F.col("e.label")))).join(ck.withColumn("_w", F.explode(words(F.col("c.label")))), [*keys, "_w"]).drop("_w")
    by_id = ek.filter("e.printed_id <> ''").join(ck, keys).filter(F.contains(plain(F.col("c.label")), F.col("e.printed_id")))
    links = by_word.unionByName(by_id).dropDuplicates([*keys, "kind", "other"]).withColumn("pos", match_score(F.col("e"), F.col("c"))).filter("pos is not null")

    known = F.when(F.col("value") != 0, F.when(F.isnan("value"), -1.0).otherwise(F.col("value"))).alias("value")  # no number agrees with no area
    columns = lambda df, side, kind, other, value: df.select(*keys, F.lit(side).alias("side"), F.col("pos").cast("long").alias("pos"), kind.alias("kind"), other.alias("other"), value)
    rows = columns(e, 0, kind, none, known).unionByName(columns(c, 1, none, F.col("label"), known)).unionByName(columns(links, 2, F.col("kind"), F.col("other"), F.lit(None).cast("double").alias("value")))
    rows = rows.filter(" and ".join(f"{k} is not null" for k in keys))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = _assign(*(pdf[pdf["side"] == s] for s in range(3)))
        return pd.DataFrame([(*key, *f) for f in found], columns=[*keys, "entity_pos", "candidate_pos", "score"])

    types = {f.name: f.dataType.simpleString() for f in e.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", entity_pos long, candidate_pos long, score int"
    out = rows.groupBy(*keys).applyInPandas(run, schema)
    of = lambda df: df.schema["pos"].dataType
    return out.withColumns({"entity_pos": F.col("entity_pos").cast(of(entities)), "candidate_pos": F.col("candidate_pos").cast(of(candidates))})


def join_evidence(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Full-outer join of a sheet's entities and its extracted parcels.

    ``entities``: document_id, page_number, pos, id, label, printed_id, stated_area, linked (has evidence already).
    ``candidates``: document_id, page_number, pos, region, parcel, label, stated_area, acres, inset, likely_duplicate,
    n_calls, roster_id, deleted.  Linked or deleted candidates stay out; those that nothing matches become entities of their own, some with
    a reason to leave them out.
    """
    free = candidates.filter(F.col("roster_id").isNull() & ~F.coalesce("deleted", F.lit(False)))
    m = match_evidence(entities.filter(~F.coalesce("linked", F.lit(False))), free)
    ref = free.select(*PAGE, F.col("pos").alias("candidate_pos"), F.struct("region", "parcel").alias("evidence_ref"))
    own = entities.join(m.join(ref, [*PAGE, "candidate_pos"]).withColumnRenamed("entity_pos", "pos").select(*PAGE, "pos", "evidence_ref"), [*PAGE, "pos"], "left")
    own = own.select(*PAGE, "id", "label", "stated_area", "evidence_ref", F.lit(None).cast("string").alias("excluded_reason"), F.lit("roster").alias("source"))
    rest = free.join(m.select(*PAGE, F.col("candidate_pos").alias("pos")), [*PAGE, "pos"], "left_anti")
    have = entities.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("have"), F.max(F.regexp_extract("id", r"-x(\d+)$", 1).try_cast("int")).alias("last"))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos"))
    rest = rest.join(have, PAGE, "left").withColumn("n", n)
    reason = F.when(F.col("inset"), "inset").when(F.col("likely_duplicate"), "duplicate").when(F.col("n_calls") < 3, "too_few_calls")
    rest = rest.select(
        *PAGE,
        F.format_string("p%d-x%d", F.col("page_number"), F.coalesce("last", F.lit(0)) + F.col("n")).alias("id"),
        F.coalesce(F.nullif("label", F.lit("")), F.format_string("Parcel %d", F.coalesce("have", F.lit(0)) + F.col("n"))).alias("label"),
        "stated_area", F.struct("region", "parcel").alias("evidence_ref"), reason.alias("excluded_reason"), F.lit("extraction").alias("source"),
    )
    return own.unionByName(rest)


def verify_printed_ids(entities: DataFrame, sheet_text: DataFrame) -> DataFrame:
    """Drops ids that the sheet's text lacks; an id claimed twice stays with a label that carries it, else the first."""
    plain = lambda s: F.regexp_replace(F.upper(F.coalesce(s, F.lit(""))), "[^A-Z0-9]", "")
    e = entities.join(sheet_text.select(*PAGE, "sheet_text"), PAGE, "left")
    printed = F.when((plain(F.col("sheet_text")) == "") | F.contains(plain(F.col("sheet_text")), plain(F.col("printed_id"))), F.col("printed_id"))
    e = e.withColumn("printed_id", printed)
    key = plain(F.col("printed_id"))
    carries = F.contains(plain(F.col("label")), key)
    w = Window.partitionBy(*PAGE, key).orderBy(F.when(carries, 0).otherwise(1), "pos")
    return e.withColumn("printed_id", F.when(F.row_number().over(w) == 1, F.col("printed_id"))).drop("sheet_text")


def carry_over(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Full-outer merge by (document, page, id): new values, but confirmed polygons and manual entities of the stored state stay."""
    key = [*PAGE, "id"]
    a, b = stored.alias("a"), new.alias("b")
    has_new = new.select(*PAGE).distinct().withColumn("_sheet", F.lit(True))
    out = a.join(b, key, "full_outer").join(has_new, PAGE, "left")
    keep = F.col("b.label").isNotNull() | F.coalesce(F.col("a.manual"), F.lit(False)) | F.col("a.confirmed_polygon").isNotNull() | F.col("_sheet").isNull()
    return out.filter(keep).select(*key, F.coalesce("b.label", "a.label").alias("label"), F.coalesce("b.stated_area", "a.stated_area").alias("stated_area"), F.coalesce("a.confirmed_polygon", "b.confirmed_polygon").alias("confirmed_polygon"), F.coalesce("a.manual", F.lit(False)).alias("manual"))


def flag_duplicate_regions(regions: DataFrame) -> DataFrame:
    """Regions under a fifth of the largest that carries the same label in a document."""
    w = Window.partitionBy("document_id", F.upper("label"))
    area = F.col("bbox.w") * F.col("bbox.h")
    return regions.withColumn("likely_duplicate_region", F.coalesce((F.col("label") != "") & (area < 0.2 * F.max(area).over(w)), F.lit(False)))


def first_within(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tolerance: float, of: list[str], pos: str) -> DataFrame:
    """``of`` (columns of ``left``) with the least ``pos`` of ``right`` among rows of one key whose ``b`` differs from ``a`` by at most ``tolerance`` (under a half) of ``a``.

    Pairs are never listed.  Values lie in logarithmic bins narrower than any range: of the bin a range begins in it takes the rows from its beginning on, of the
    one it ends in those up to its end (both as running minima along the sorted bin), of the bins between the least of all.  Values that are not positive
    and finite, and null keys, meet nothing; ``of`` without a match are missing.
    """
    step = float(np.log1p(tolerance))
    bin_of = lambda c: F.floor(F.log(c) / F.lit(step)).alias("_bin")
    keyed = " and ".join(f"{k} is not null" for k in keys)
    finite = lambda c: F.expr(keyed) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    carried = list(dict.fromkeys([*keys, *of]))
    off = tolerance * F.col("_a")
    l = left.filter(finite(a)).select(*carried, F.col(a).alias("_a")).withColumns({"_lo": F.col("_a") - off, "_hi": F.col("_a") + off})  # noqa: E741
    r = right.filter(finite(b)).select(*keys, F.col(b).alias("_v"), F.col(pos).alias("_pos"), bin_of(F.col(b)))
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in of if c not in keys]

    def beyond(end: str, order: Column) -> DataFrame:
        # an end's sum is rounded: whether a value that equals it is in, its difference says, which is exact
        turn = F.when(F.abs(F.col("_a") - F.col(end)) <= off, 2).otherwise(0).alias("_turn")
        asked = l.select(*carried, F.col(end).alias("_v"), F.lit(None).cast(right.schema[pos].dataType).alias("_pos"), bin_of(F.col(end)), turn)
        rows = asked.unionByName(r.select("*", *blank, F.lit(1).alias("_turn")))
        so_far = Window.partitionBy(*keys, "_bin").orderBy(order, "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn("_first", F.min("_pos").over(so_far)).filter("_turn <> 1").select(*of, "_first")

    lo, hi = bin_of(F.col("_lo")) + 1, bin_of(F.col("_hi")) - 1
    whole = l.filter(lo <= hi).select(*carried, F.explode(F.sequence(lo, hi)).alias("_bin"))
    between = whole.join(r.groupBy(*keys, "_bin").agg(F.min("_pos").alias("_first")), [*keys, "_bin"]).select(*of, "_first")
    found = beyond("_lo", F.desc("_v")).unionByName(beyond("_hi", F.asc("_v"))).unionByName(between)
    return found.filter(F.col("_first").isNotNull()).groupBy(*of).agg(F.min("_first").alias(pos))


def legal_to_parcels(descriptions: DataFrame, parcels: DataFrame) -> DataFrame:
    """Each legal description (document_id, desc_pos, acres) with the first parcel (pos) whose stated acres agree within 5 %."""
    first = first_within(descriptions, parcels, ["document_id"], "acres", "stated_acres", 0.05, ["document_id", "desc_pos"], "pos")
    return descriptions.join(first, ["document_id", "desc_pos"], "left")


_EDGES, _POINTS = 20_000, 20_000  # most edges and about the points of a key that meet in one group


def _nearest(points: np.ndarray, edges: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and the index of the nearest edge (ax, ay, bx, by) of each point, the smallest on a tie.

    Edges lie in blocks of about the root of their number, cut along x and then y.  A point looks into the block whose box is nearest, and
    then into all whose boxes are no farther than what it found.
    """
    n = len(edges)
    mid = edges[:, :2] + edges[:, 2:]
    size = max(1, int(np.sqrt(n)))
    strips = max(1, int(np.sqrt(n / size)))
    strip = np.empty(n, int)
    strip[np.lexsort((mid[:, 1], mid[:, 0]))] = np.arange(n) * strips // n
    order = np.lexsort((mid[:, 0], mid[:, 1], strip))
    edges, index = edges[order], index[order]
    start = np.arange(0, n, size)
    stop = np.append(start[1:], n)
    lo = np.minimum.reduceat(np.minimum(edges[:, :2], edges[:, 2:]), start)
    hi = np.maximum.reduceat(np.maximum(edges[:, :2], edges[:, 2:]), start)
    best, first = np.full(len(points), np.inf), np.full(len(points), np.iinfo(np.int64).max)

    def look(rows: np.ndarray, block: int) -> None:
        e, p = edges[start[block] : stop[block]], points[rows][:, None]
        d = e[:, 2:] - e[:, :2]
        nn = (d * d).sum(1)
        t = np.clip(np.where(nn == 0, 0.0, ((p[..., 0] - e[:, 0]) * d[:, 0] + (p[..., 1] - e[:, 1]) * d[:, 1]) / np.where(nn == 0, 1, nn)), 0, 1)
        far = np.hypot(p[..., 0] - e[:, 0] - t * d[:, 0], p[..., 1] - e[:, 1] - t * d[:, 1])
        near = far.min(1)
        which = np.where(far == near[:, None], index[start[block] : stop[block]], np.iinfo(np.int64).max).min(1)
        better = (near < best[rows]) | (near == best[rows]) & (which < first[rows])
        best[rows[better]], first[rows[better]] = near[better], which[better]

    for i in range(0, len(points), 4096):
        rows = np.arange(i, min(i + 4096, len(points)))
        p = points[rows][:, None]
        gap = np.maximum(np.maximum(lo - p, p - hi), 0)
        gap = np.hypot(gap[..., 0], gap[..., 1])
        own = gap.argmin(1)
        for block in np.unique(own):
            look(rows[own == block], block)
        more = gap <= best[rows, None] * (1 + 1e-9)
        more[np.arange(len(rows)), own] = False
        for block in np.flatnonzero(more.any(0)):
            look(rows[more[:, block]], block)
    return best, first


def nearest_edge(points: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest edge (ax, ay, bx, by) of the same key for each point (px, py), the first on a tie.

    Points of a key are dealt out by their hash, and its edges too, so that a group holds a bounded number of either; repeated points are looked up
    once.  Edges without a place are nearest to nothing; a point without one, or among such edges only, gets the first edge and no distance.
    """
    at, ends = ["px", "py"], ["ax", "ay", "bx", "by"]
    placed = lambda df, cs: df.dropna(subset=[*keys, *cs])
    p, e = placed(points, at).select(*keys, *(F.col(c).cast("double").alias(c) for c in at)).distinct(), placed(edges, [*ends, "edge_index"])
    parts = lambda df, most, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    deal = p.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / _POINTS).cast("int").alias("_np")).join(parts(e, _EDGES, "_ne"), keys)
    part = lambda n, *cs: F.pmod(F.xxhash64(*cs), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    p = p.join(deal, keys).withColumn("_p", part("_np", *at)).withColumn("_e", every("_ne")).select(*keys, "_p", "_e", *at)
    e = e.join(deal, keys).withColumn("_e", part("_ne", *ends, "edge_index")).withColumn("_p", every("_np"))
    e = e.select(*keys, "_p", "_e", *(F.col(c).cast("double").alias(c) for c in ends), F.col("edge_index").cast("long").alias("edge_index"))
    group = [*keys, "_p", "_e"]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=[*keys, *at, "distance", "edge_index"])
        distance, index = _nearest(a[at].to_numpy(float), b[ends].to_numpy(float), b["edge_index"].to_numpy())
        return a[[*keys, *at]].assign(distance=distance, edge_index=index)

    named = ", ".join(f"{k} {p.schema[k].dataType.simpleString()}" for k in keys)
    found = p.groupBy(*group).cogroup(e.groupBy(*group)).applyInPandas(run, f"{named}, px double, py double, distance double, edge_index long")
    best = found.groupBy(*keys, *at).agg(F.min(F.struct("distance", "edge_index")).alias("e"))
    any_ = edges.groupBy(*keys).agg(F.min("edge_index").alias("_any"))
    out = points.distinct().join(best, [*keys, *at], "left").join(any_, keys)
    return out.select(*points.columns, F.col("e.distance").alias("distance"), F.coalesce(F.col("e.edge_index").cast(edges.schema["edge_index"].dataType), "_any").alias("edge_index"))


def pair_split_bearings(lines: DataFrame, keys: list[str], reach: float = 250.0) -> DataFrame:
    """Joins a bearing and the nearest free bare distance under ``reach`` px into one line; bearings choose in order.

    ``lines``: keys, line_no, text, confidence, x1, y1, x2, y2.
    """
    bearing_only, bare = f"^\\s*{P.BEARING}\\s*$", P.BARE_DISTANCE

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_no", kind="stable").reset_index(drop=True)
        text = pdf["text"].fillna("").str.strip()
        b, d = (np.flatnonzero(text.str.match(p)) for p in (bearing_only, bare))
        cx, cy = (pdf["x1"] + pdf["x2"]).to_numpy() / 2, (pdf["y1"] + pdf["y2"]).to_numpy() / 2
        used, gone, new = set(), set(), []
        for i in b:
            free = [j for j in d if j not in used]
            gaps = [np.hypot(cx[i] - cx[j], cy[i] - cy[j]) for j in free]
            if gaps and min(gaps) < reach:
                j = free[int(np.argmin(gaps))]
                used.add(j)
                gone |= {i, j}
                row = pdf.iloc[i].copy()
                row["text"], row["confidence"] = f"{text[i]} {text[j]}", round(min(pdf["confidence"][i], pdf["confidence"][j]), 3)
                for c, f in (("x1", min), ("y1", min), ("x2", max), ("y2", max)):
                    row[c] = f(pdf[c][i], pdf[c][j])
                new.append(row)
        return pd.concat([pdf.drop(index=list(gone)), pd.DataFrame(new, columns=pdf.columns)], ignore_index=True)

    return lines.groupBy(*keys).applyInPandas(run, lines.schema)


def coordinate_pairs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Printed northing and easting pairs: an E line is read with the N line right above it.

    ``lines``: keys, line_no, text, x1, y1, x2, y2.  The E line's centre lies below the N line's by at most 2.5 line
    heights and within 8 heights sideways, the nearest below wins.  ``kind`` comes from the texts around; a pair within 2 ft of a
    monument is that monument.
    """
    own = lines.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "h": F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")), "t": F.trim("text")})
    number = lambda p: T.survey_number(T.group(F.col("t"), "^" + p.removeprefix(r"\b") + "$", 1))
    n = own.withColumn("northing", number(P.NORTHING)).filter("northing is not null").select(*keys, F.col("line_no").alias("n_line"), "northing", "cx", "cy", "h")
    e = own.withColumn("easting", number(P.EASTING)).filter("easting is not null").select(*keys, F.col("line_no").alias("e_line"), "easting", F.col("cx").alias("ex"), F.col("cy").alias("ey"))
    drop = F.col("ey") - F.col("cy")
    p = n.join(e, keys).filter((drop > 0) & (drop <= 2.5 * F.col("h")) & (F.abs(F.col("ex") - F.col("cx")) <= 8 * F.col("h")))
    p = p.groupBy(*keys, "n_line", "northing", "cx", "cy", "h").agg(F.min(F.struct(drop.alias("d"), "e_line", "easting")).alias("e")).select(*keys, "n_line", "northing", "cx", "cy", "h", "e.e_line", "e.easting")
    around = own.select(*keys, "line_no", "t", F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    up = F.col("ty") - F.col("cy")
    near = (F.col("line_no") != F.col("n_line")) & (F.col("line_no") != F.col("e_line")) & up.between(-6 * F.col("h"), 5 * F.col("h")) & (F.abs(F.col("tx") - F.col("cx")) <= 12 * F.col("h"))
    context = p.join(around, keys).filter(near).groupBy(*keys, "n_line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "t"))), lambda s: s["t"]), " | ").alias("context"))
    p = p.join(context, [*keys, "n_line"], "left").withColumn("context", F.coalesce("context", F.lit("")))
    p = p.withColumn("kind", F.when(F.col("context").rlike("(?i)" + P.MONUMENT), "monument").when(F.col("context").rlike("(?i)" + P.OWN_CORNER), "parcel_corner").otherwise("unknown"))
    mark = p.filter("kind = 'monument'").select(*keys, F.col("northing").alias("mn"), F.col("easting").alias("me"))
    close = p.join(mark, keys).filter(F.hypot(F.col("northing") - F.col("mn"), F.col("easting") - F.col("me")) <= 2.0).select(*keys, "n_line").distinct().withColumn("_m", F.lit(True))
    return p.join(close, [*keys, "n_line"], "left").withColumn("kind", F.when(F.col("_m"), "monument").otherwise(F.col("kind"))).drop("_m", "h")


def bind_vertices(pairs: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """Vertex of the page polygon (``ring``) that a label at (cx, cy) marks: nearest by half the shortest edge and by a factor of two."""
    ring = F.col("ring")
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    shortest = F.array_min(F.zip_with(ring, nxt, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"])))
    ranked = F.array_sort(F.transform(ring, lambda v, i: F.struct(F.hypot(v["x"] - F.col("cx"), v["y"] - F.col("cy")).alias("d"), i.alias("i"))))
    d = pairs.join(polygons, keys).withColumns({"_s": shortest, "_r": ranked})
    a, b = F.get("_r", 0), F.get("_r", 1)
    return d.withColumn("vertex", F.when((a["d"] <= 0.5 * F.col("_s")) & (b["d"] >= 2 * a["d"]), a["i"])).drop("_s", "_r")


def features_in_polygons(polygons: DataFrame, points: DataFrame, cell: float = 0.01) -> DataFrame:
    """Number of points (x, y) inside or on each polygon (polygon_id, ring); a grid cell is met first."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell))
    boxes = polygons.select("polygon_id", "ring", F.explode(span(xs)).alias("gx"), ys.alias("ys")).select("polygon_id", "ring", "gx", F.explode(span(F.col("ys"))).alias("gy"))
    at = points.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    hits = boxes.join(at, ["gx", "gy"]).filter(G.covers(F.col("ring"), F.col("x"), F.col("y")))
    return polygons.select("polygon_id").join(hits.groupBy("polygon_id").agg(F.count(F.lit(1)).alias("n")), "polygon_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def near_radius(centres: DataFrame, places: DataFrame, key: str, radius_m: float, most: int, cell: float = 0.05) -> DataFrame:
    """The ``most`` nearest places (lon, lat) within a radius of each centre (clon, clat), by distance, then key."""
    reach = radius_m / 100_000 + cell
    steps = int(np.ceil(reach / cell))
    around = F.sequence(F.lit(-steps), F.lit(steps))
    c = centres.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    c = c.withColumns({"_gx": F.floor(F.col("clon") / cell) + F.col("_dx"), "_gy": F.floor(F.col("clat") / cell) + F.col("_dy")}).drop("_dx", "_dy")
    p = places.withColumns({"_gx": F.floor(F.col("lon") / cell), "_gy": F.floor(F.col("lat") / cell)})
    d = c.join(p, ["_gx", "_gy"]).drop("_gx", "_gy").withColumn("distance_m", G.metres(F.col("clon"), F.col("clat"), F.col("lon"), F.col("lat"))).filter(F.col("distance_m") <= radius_m)
    w = Window.partitionBy(*centres.columns).orderBy("distance_m", key)
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def label_words(label: Column) -> Column:
    """Distinct words of a label in capitals: letters, digits and hyphens."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(F.coalesce(label, F.lit(""))), r"[^A-Z0-9\s-]", " "), r"\s+"), lambda x: x != ""))


def same_parcel(label_a: Column, label_b: Column, acres_a: Column, acres_b: Column) -> Column:
    """Label words contained in each other and, if both state one, areas within 8 %."""
    a, b = label_words(label_a), label_words(label_b)
    subset = (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
    return subset & F.coalesce(F.abs(acres_a - acres_b) <= 0.08 * F.greatest(acres_a, acres_b), F.lit(True))


def dedupe_copies(parcels: DataFrame) -> DataFrame:
    """Of copies of a parcel on several pages the one worth looking at: confirmed, with geometry, validated, first page.

    ``parcels``: document_id, pos, page_number, label, acres, human_confirmed, has_geometry, has_validation.
    """
    def words(label) -> frozenset:
        return frozenset("".join(c if c.isascii() and (c.isalnum() or c.isspace() or c == "-") else " " for c in str(label or "").upper()).split())

    def keep(pdf: pd.DataFrame) -> np.ndarray:
        rank = 4 * ~pdf["human_confirmed"].astype(bool) + 2 * ~pdf["has_geometry"].astype(bool) + 1 * ~pdf["has_validation"].astype(bool)
        out, kept, sets = np.zeros(len(pdf), bool), [], [words(x) for x in pdf["label"]]
        acres, page = pdf["acres"].to_numpy(float), pdf["page_number"].to_numpy()

        def same(i, j):
            a, b = sets[i], sets[j]
            alike = a and b and (a <= b or b <= a) and page[i] != page[j]
            return alike and (np.isnan(acres[i]) or np.isnan(acres[j]) or abs(acres[i] - acres[j]) <= 0.08 * max(acres[i], acres[j]))

        for i in np.lexsort((pdf["pos"], page, rank)):
            if not any(same(i, k) for k in kept):
                kept.append(i)
                out[i] = True
        return out

    return _per_group(parcels, ["document_id"], keep)


def ring_from_ways(ways: DataFrame) -> DataFrame:
    """Outer ring of each relation (relation_id, ways ordered by pos, points): chained at equal ends, turned as needed; null if open or in parts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = [[(p["x"], p["y"]) for p in w] for w in pdf.sort_values("pos")["points"]]
        ring = left.pop(0)
        while left and ring[0] != ring[-1]:
            k = next((i for i, w in enumerate(left) if ring[-1] in (w[0], w[-1])), None)
            if k is None:
                break
            w = left.pop(k)
            ring += (w if w[0] == ring[-1] else w[::-1])[1:]
        whole = not left and len(ring) >= 4 and ring[0] == ring[-1]
        return pd.DataFrame({"relation_id": pdf["relation_id"].iloc[:1], "ring": [[{"x": x, "y": y} for x, y in ring] if whole else None]})

    return ways.groupBy("relation_id").applyInPandas(run, "relation_id long, ring array<struct<x:double,y:double>>")
