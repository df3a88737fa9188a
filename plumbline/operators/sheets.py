"""Sheets, entities and groups: which drawing is the main one, which parcels count, which sheets repeat another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .matching import PAGE

NON_TARGET = ("adjoiner", "reference", "easement", "vicinity")
MOST_PARCELS = 12
WIDE = 16  # items of a set that answers by pairs


def build_sheets(regions: DataFrame) -> DataFrame:
    """One sheet a page with drawings: the largest (first on a tie) is main, those of a fifth of it or more are drawings, the rest insets."""
    w = Window.partitionBy(*PAGE)
    area = F.col("bbox.w") * F.col("bbox.h")
    m = regions.filter("class = 'ParcelMap'").withColumn("area", area)
    m = m.withColumns({"_top": F.max("area").over(w), "_r": F.row_number().over(w.orderBy(F.desc("area"), "region_index"))})
    pick = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("region_index"))))
    big = F.col("area") >= 0.2 * F.col("_top")
    return m.groupBy(*PAGE).agg(F.max(F.when(F.col("_r") == 1, F.col("region_index"))).alias("main_region"), pick(big).alias("regions"), pick(~big).alias("inset_regions"))


def sanitize_roster(items: DataFrame) -> DataFrame:
    """Rows (page, pos, label, printed_id, stated_area) as entities: blank labels go, the first of a token key stays, 12 a sheet,
    then encumbrances go if a real parcel remains, and empty remainders if several do."""
    i = items.filter(F.size(T.label_tokens("label")) > 0)
    i = i.withColumn("_k", F.array_join(T.label_tokens("label"), " "))
    i = i.withColumn("_r", F.row_number().over(Window.partitionBy(*PAGE, "_k").orderBy("pos"))).filter("_r = 1")
    i = i.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos"))).filter(F.col("_n") <= MOST_PARCELS)
    return drop_non_parcels(i.withColumn("printed_id", T.printed_id("printed_id")).drop("_k", "_r", "_n"))


def drop_non_parcels(entities: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE)
    e = entities.withColumn("_real", ~T.is_encumbrance("label")).withColumn("_n", F.count_if("_real").over(w))
    e = e.filter(F.col("_real") | (F.col("_n") == 0))
    empty = F.upper("label").contains("REMAINDER") & F.col("stated_area").isNull() & F.col("printed_id").isNull()
    return e.filter(~(empty & (F.col("_n") > 1))).drop("_real", "_n")


def entity_ids(new: DataFrame, existing: DataFrame, manual: bool = False) -> DataFrame:
    """Ids ``p<page>-x<n>`` (``m`` for manual ones), n going on from the largest of the page."""
    kind = "m" if manual else "x"
    last = existing.groupBy(*PAGE).agg(F.max(F.regexp_extract("id", rf"-{kind}(\d+)$", 1).try_cast("int")).alias("_last"))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos")) + F.coalesce("_last", F.lit(0))
    return new.join(last, PAGE, "left").withColumn("id", F.format_string(f"p%d-{kind}%d", "page_number", n)).drop("_last")


def target_parcels(parcels: DataFrame) -> DataFrame:
    return parcels.filter(F.col("role").isNull() | ~F.col("role").isin(*NON_TARGET))


def suppress_incomplete(regions: DataFrame) -> DataFrame:
    """Regions without geometry (``complete`` false) that come after one with geometry, in page and region order, are suppressed."""
    w = Window.partitionBy("document_id").orderBy("page_number", "region_index").rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("suppressed", F.coalesce(F.max("complete").over(w), F.lit(False)) & ~F.col("complete"))


def primary_sheet(role: Column) -> Column:
    return role.isNull() | (role == "target_parcel_map")


def group_candidates(refs: DataFrame) -> DataFrame:
    """Sheets with candidates, likely targets first, then larger drawings, then pages."""
    g = refs.filter("excluded_reason is null").groupBy("document_id", "page_number").agg(F.first("role").alias("role"), F.max("region_area").alias("area"), F.count(F.lit(1)).alias("n_refs"), F.bool_or("human_confirmed").alias("confirmed"))
    g = g.withColumn("primary", primary_sheet(F.col("role")))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("primary"), F.desc("area"), "page_number")))


def contained_sets(members: DataFrame, group: str, item: str) -> DataFrame:
    """Pairs (inner, outer) of groups where every item of the inner one is in the outer: relational division.

    Items are ordered, rare ones first.  A group asks by its two first items (its only one twice), and answers by all pairs of
    its items, each with the items after the pair; so a frequent item does not pair its groups, and what else an inner group
    has is looked up there.  Groups over ``WIDE`` items would have too many pairs: those answer item by item, and are compared
    whole.  A null item comes first and meets nothing, so its group is in no other; null groups don't count.
    """
    m = members.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g is not null")
    rare = m.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    s = m.join(rare, "i", "left").groupBy("g").agg(F.sort_array(F.collect_set(F.struct("n", "i")))["i"].alias("items"))
    size, after = F.size("items"), lambda k: F.slice("items", k, F.size("items"))
    asks = s.select(F.col("g").alias("inner_group"), "items", after(3).alias("rest"), F.get("items", F.lit(0)).alias("x"), F.get("items", F.least(size, F.lit(2)) - 1).alias("y"))
    first = s.select(F.col("g").alias("outer_group"), "items", F.posexplode("items").alias("a", "x"))
    pairs = first.select("outer_group", "items", "a", "x", F.posexplode(F.slice("items", F.col("a") + 1, F.when(size > WIDE, 1).otherwise(size))).alias("b", "y"))
    answers = pairs.select("outer_group", "x", "y", F.when(F.col("b") > 0, after(F.col("a") + F.col("b") + 2)).otherwise(F.slice("items", 1, 0)).alias("later"))
    other, lacks = F.col("inner_group") != F.col("outer_group"), lambda a, b: F.size(F.array_except(a, b)) > 0
    met = asks.drop("items").join(answers.hint("merge"), ["x", "y"]).filter(other & ((F.size("rest") == 0) | ~lacks("rest", "later")))
    wide = s.filter(size > WIDE).select(F.col("g").alias("outer_group"), F.explode("items").alias("x"))
    wide = asks.filter(size > 1).select("inner_group", "items", "x").join(wide.hint("merge"), "x").filter(other)
    wide = wide.join(s.select(F.col("g").alias("outer_group"), F.col("items").alias("outer_items")).hint("merge"), "outer_group").filter(~lacks("items", "outer_items"))
    return met.select("inner_group", "outer_group").union(wide.select("inner_group", "outer_group"))


def collapse_duplicate_sheets(groups: DataFrame, contained: DataFrame) -> DataFrame:
    """Folds sheets under the best kept sheet that holds all their parcels: rank by confirmed, primary, parcels, area, page.

    ``groups``: document_id, page_number, confirmed, primary, n_refs, area; ``contained``: document_id, inner_page, outer_page.
    Adds ``folded_under`` (null for kept sheets).
    """

    def run(key, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((g["page_number"], -g["area"].fillna(0), -g["n_refs"], ~g["primary"].astype(bool), ~g["confirmed"].fillna(False).astype(bool)))
        inside, kept, host = set(zip(c["inner_page"], c["outer_page"])), [], {}
        for page in g["page_number"].to_numpy()[order]:
            over = next((k for k in kept if (page, k) in inside), None)
            if over is None:
                kept.append(page)
            host[page] = over
        return g.assign(folded_under=[host[p] for p in g["page_number"]])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema.fields) + ", folded_under int"
    return groups.groupBy("document_id").cogroup(contained.groupBy("document_id")).applyInPandas(run, schema)


def route_page(has_text: Column, text_length: Column, image_count: Column, quality: Column) -> Column:
    """Ordered rules for how a page is read."""
    return F.when(quality == "DEGRADED", "REVIEW").when(has_text & (text_length > 50) & (image_count == 0), "OCR_NOT_NEEDED").when(quality == "VISUAL_COMPLEX", F.when(has_text, "VISION").otherwise("OCR_AND_VISION")).otherwise("OCR")


def tiles(pages: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Tile origins (tx, ty) of each page (width, height), step tile - overlap."""
    step = tile - overlap
    span = lambda c: F.sequence(F.lit(0), F.greatest(F.col(c) - 1, F.lit(0)).cast("int"), F.lit(step))
    return pages.withColumn("ty", F.explode(span("height"))).withColumn("tx", F.explode(span("width")))


def tiles_near(tiled: DataFrame, points: DataFrame, radius: float, tile: int) -> DataFrame:
    """Tiles of a page within ``radius`` of any of its points (px, py)."""
    near = F.col("px").between(F.col("tx") - radius, F.col("tx") + tile + radius) & F.col("py").between(F.col("ty") - radius, F.col("ty") + tile + radius)
    return tiled.join(points, PAGE).filter(near).select(*tiled.columns).distinct()


def bands(pages: DataFrame) -> DataFrame:
    """Horizontal strips (y0, y1) of each page (height, bands)."""
    b = pages.withColumn("band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    return b.withColumns({"y0": F.floor(F.col("height") * F.col("band") / F.col("bands")), "y1": F.floor(F.col("height") * (F.col("band") + 1) / F.col("bands"))})


def chunk_by_budget(items: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """In-order packing of items (pos, tokens) into chunks of at most ``budget``; a larger item stands alone."""
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("bigint").alias("used"), F.array().cast("array<struct<pos:bigint,chunk:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        new = (s["used"] > 0) & (s["used"] + x["tokens"] > budget)
        chunk = F.when(new, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["tokens"]).otherwise(s["used"] + x["tokens"]).alias("used"), F.concat(s["out"], F.array(F.struct(x["pos"].alias("pos"), chunk.alias("chunk")))).alias("out"))

    g = items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("bigint").alias("pos"), F.col("tokens").cast("bigint").alias("tokens")))).alias("x"))
    return g.select(*keys, F.explode(F.aggregate("x", start, step, lambda s: s["out"])).alias("o")).select(*keys, "o.pos", "o.chunk")


def coco_counts(annotations: DataFrame, images: DataFrame, validation: list[int]) -> DataFrame:
    """Annotations of each class in the train and val split; ``validation`` lists the image ids held out."""
    split = F.when(F.col("image_id").isin(*validation), "val").otherwise("train")
    return annotations.join(images.select(F.col("id").alias("image_id")), "image_id").groupBy(split.alias("split"), "category_id").count()


def pre_annotations(regions: DataFrame) -> DataFrame:
    """Class counts of a document and whether any page needs review."""
    return regions.groupBy("document_id", "class").agg(F.count(F.lit(1)).alias("n"), F.bool_or("needs_review").alias("needs_review"))
