"""Names that are nearly alike: an index of segments with a bound on edits, and codes found level by level.

A name within ``edits`` of another of length n has one of that one's ``edits + 1`` segments unchanged, at most ``edits`` places away: an
edit touches one segment only.  So names meet on (length, segment's number, segment), all of them equal keys, and only names that meet are
compared.  That misses none, whatever their lengths; names that are shorter than the number of segments have empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import trials

SCORE = 0.75  # fixed value: the least ratio of a match


def normal(name: Column) -> Column:
    """Without a leading number, blanks and punctuation."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"^\d+\s*", ""), r"[\s\-.,:()]", "")


def _start(n: Column, k: Column, parts: int) -> Column:
    """Where segment ``k`` of ``parts`` of a name of length ``n`` starts."""
    return F.floor(n * k / parts).cast("int")


def similar(left: DataFrame, right: DataFrame, keys: list[str], edits: int) -> DataFrame:
    """Pairs of ``left`` (keys, id, name) and ``right`` (keys, id, name) of equal keys whose names differ by ``edits`` insertions,
    deletions or replacements at most: keys, left_id, right_id, distance.

    Null names match nothing.  Names are taken distinct while they meet, so repeated ones cost one comparison.
    """
    parts = edits + 1
    one = left.filter("name is not null").select(*keys, F.col("name").alias("a")).distinct()
    two = right.filter("name is not null").select(*keys, F.col("name").alias("b")).distinct()
    n = F.length("b")
    numbers = F.sequence(F.lit(0), F.lit(parts - 1))
    filed = two.withColumns({"n": n, "k": F.explode(numbers)})
    at, to = _start(F.col("n"), F.col("k"), parts), _start(F.col("n"), F.col("k") + 1, parts)
    filed = filed.withColumn("segment", F.substring("b", at + 1, to - at))
    # all segments that a name of length n may have kept, as they stand in this one
    m = F.length("a")
    asked = one.withColumn("n", F.explode(F.sequence(F.greatest(m - edits, F.lit(0)), m + edits))).withColumn("k", F.explode(numbers))
    at, to = _start(F.col("n"), F.col("k"), parts), _start(F.col("n"), F.col("k") + 1, parts)
    size = to - at
    first, last = F.greatest(at - edits, F.lit(0)), F.least(at + edits, m - size)
    places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    asked = asked.withColumn("segment", F.explode(F.array_distinct(F.transform(places, lambda p: F.substring(F.col("a"), p + 1, size)))))
    met = asked.join(filed.hint("merge"), [*keys, "n", "k", "segment"]).select(*keys, "a", "b").distinct()
    close = met.withColumn("distance", F.levenshtein("a", "b", edits)).filter("distance >= 0")
    # lists of names look small in their files, so they would be sent through the driver to every task; sorted, they stay where they are
    named = lambda df, name, id_: df.select(*keys, F.col("name").alias(name), F.col("id").alias(id_)).hint("merge")
    out = close.join(named(left, "a", "left_id"), [*keys, "a"]).join(named(right, "b", "right_id"), [*keys, "b"])
    return out.select(*keys, "left_id", "right_id", "distance")


def _may_match(a: Column, b: Column) -> Column:
    """Whether the letters that two names have in common would do for ``SCORE``, in whatever order they stand."""
    a, b = F.lower(a), F.lower(b)  # as the ratio has it
    letters = F.array_distinct(F.split(a, ""))
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    common = F.aggregate(F.filter(letters, lambda c: c != ""), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))
    return 2 * common >= SCORE * (F.length(a) + F.length(b))


def resolve_codes(documents: DataFrame, options: DataFrame, levels: int = 4) -> DataFrame:
    """Codes of the printed names of each document, from the top level down: document_id, codes, failed (first level without a match, or null), trail.

    ``documents``: document_id, names (one for each level); ``options``: level (from 0), parent (codes above it, each with a comma behind;
    empty at the top), pos, code, value.  Of the options below what was chosen, the name that is equal or most alike (``SCORE`` or
    more; the first of equals) is taken; a single option needs no match.
    """
    state = documents.select("document_id", "names", F.lit("").alias("codes"), F.lit(None).cast("int").alias("failed"), F.array().cast("array<struct<printed:string,matched:string,code:string,score:double>>").alias("trail"))
    for level in range(levels):
        wanted = F.get("names", level)
        own = options.filter(F.col("level") == level).select(F.col("parent").alias("codes"), "pos", "code", "value")
        alone = own.groupBy("codes").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("pos", "code", "value")).alias("only"))
        open_ = state.filter("failed is null").select("document_id", "codes", normal(wanted).alias("name")).filter("name <> ''")
        met = open_.join(own, "codes").withColumn("option", normal(F.col("value")))
        equal = met.filter("option = name").groupBy("document_id").agg(F.min(F.struct("pos", "code", "value")).alias("e"))
        pairs = met.filter(_may_match(F.col("name"), F.col("option"))).select("document_id", "name", "option", "pos", "code", "value")
        scored = trials.name_ratios(pairs).filter(F.col("score") >= SCORE)
        best = scored.groupBy("document_id").agg(F.min(F.struct((-F.col("score")).alias("worse"), "pos", "code", "value")).alias("s"))
        j = state.join(alone, "codes", "left").join(equal, "document_id", "left").join(best, "document_id", "left")
        only = F.when(F.col("n") == 1, F.col("only"))
        code = F.coalesce(F.col("e.code"), F.col("s.code"), only["code"])
        value, score = F.coalesce(F.col("e.value"), F.col("s.value"), only["value"]), F.when(F.col("e").isNotNull(), 1.0).when(F.col("s").isNotNull(), -F.col("s.worse")).otherwise(1.0)
        going = F.col("failed").isNull()
        step = F.struct(wanted.alias("printed"), value.alias("matched"), code.alias("code"), F.bround(score, 2).alias("score"))
        state = j.select(
            "document_id",
            "names",
            F.when(going & code.isNotNull(), F.concat("codes", code, F.lit(","))).otherwise(F.col("codes")).alias("codes"),
            F.when(going & code.isNull(), level).otherwise(F.col("failed")).cast("int").alias("failed"),
            F.when(going & code.isNotNull(), F.array_append("trail", step)).otherwise(F.col("trail")).alias("trail"),
        )
    return state.select("document_id", "codes", "failed", "trail")
