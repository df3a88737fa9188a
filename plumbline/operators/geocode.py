"""The anchor of a document: its address candidates, tried against a geocoder's answers until one is consistent.

All tries of all documents are one ranked table: the best candidate, its coarser forms, then the other candidates.  Answers come
from a table of asked queries (with or without hits), joined by the query's text, so equal queries of many documents are asked
once.  A document is settled by its first try that has a consistent hit; what lies behind that is never needed, and
``open_queries`` names the one query each unsettled document needs next, for whoever asks the geocoder.  An accepted query that names
no state is held against the document's first candidate that does: if they disagree, the query is tried with that
state, and if that fails, the candidate's own place is taken.

``asked``: query, and hits (array of lat, lon, region, country, best first; empty or null if nothing was found or the call failed).
``candidates``: document_id, rank, query; blank queries are left out, of equal ranks the smaller query comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

DOC = "document_id"
HITS = "array<struct<lat:double,lon:double,region:string,country:string>>"
#: Names that a geocoder gives the country whose states are checked.
COUNTRY = ("united states", "united states of america", "usa")
#: Fixed patterns: a state's code behind a comma; what makes a query say which area it means.
STATE_CODE, LOCALITY = r",\s*([A-Z]{2})\b(?!\.)", r"(?i),\s*[A-Z]{2}\b|\b\d{5}(?:-\d{4})?\b"


def coarser(query: Column) -> Column:
    """Forms without the first parts between commas, down to two parts."""
    parts = F.filter(F.transform(F.split(query, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.array_join(F.slice(parts, k, n), ", "))).otherwise(F.array().cast("array<string>"))


def named_state(query: Column) -> Column:
    """Name of the last state whose code stands behind a comma."""
    names = F.create_map(*(F.lit(x) for name, code in P.STATES.items() for x in (code.upper(), name.lower())))
    known = F.filter(F.transform(F.regexp_extract_all(query, F.lit(STATE_CODE), 1), lambda c: F.try_element_at(names, c)), lambda c: c.isNotNull())
    return F.try_element_at(known, F.lit(-1))


def consistent(query: Column, hit: Column) -> Column:
    """Whether a hit agrees with the state that the query names; what isn't known passes."""
    state, country = named_state(query), F.nullif(hit["country"], F.lit(""))
    fits = F.lower(country).isin(*COUNTRY) & (F.nullif(hit["region"], F.lit("")).isNull() | (F.lower(hit["region"]) == state))
    return F.when(state.isNull() | country.isNull(), True).otherwise(fits)


def says_where(query: Column) -> Column:
    return query.rlike(LOCALITY)


def same_place(a: Column, b: Column) -> Column:
    """Same country, and same region where both name one."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    both = (low(a["region"]) != "") & (low(b["region"]) != "")
    return (low(a["country"]) == low(b["country"])) & (~both | (low(a["region"]) == low(b["region"])))


def _answers(asked: DataFrame) -> DataFrame:
    """One row a query: its hits of the row with most of them, if it was asked twice."""
    hits = F.coalesce(F.col("hits").cast(HITS), F.array().cast(HITS))
    return asked.filter("query is not null").groupBy("query").agg(F.max_by(hits, F.struct(F.size(hits), F.to_json(hits))).alias("hits"))


def _tries(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """document_id, queries (candidates, best first) and tries: place, query, asked, hits (consistent ones)."""
    own = candidates.filter(F.trim("query") != "").groupBy(DOC).agg(F.sort_array(F.collect_list(F.struct("rank", "query"))).alias("c"))
    own = own.select(DOC, F.transform("c", lambda c: c["query"]).alias("queries"))
    order = F.concat(F.slice("queries", 1, 1), coarser(F.get("queries", 0)), F.slice("queries", 2, F.size("queries")))
    each = own.select(DOC, "queries", F.posexplode(order).alias("place", "query")).join(answers, "query", "left")
    fit = F.filter("hits", lambda h: consistent(F.col("query"), h))
    each = each.withColumn("try", F.struct("place", "query", F.col("hits").isNotNull().alias("asked"), F.coalesce(fit, F.array().cast(HITS)).alias("hits")))
    return each.groupBy(DOC).agg(F.first("queries").alias("queries"), F.sort_array(F.collect_list("try")).alias("tries"))


def _settled(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """One row a document: the query to ask next (``need``) or how it is settled (``query``, ``found``; none if nothing was found)."""
    answers = _answers(asked)
    t = _tries(candidates, answers)
    t = t.withColumns({"won": F.get(F.filter("tries", lambda x: F.size(x["hits"]) > 0), 0), "gap": F.get(F.filter("tries", lambda x: ~x["asked"]), 0)})
    waits = F.col("gap").isNotNull() & (F.col("won").isNull() | (F.col("gap.place") < F.col("won.place")))
    t = t.withColumn("waits", waits)
    # the document's first candidate that says where, if the accepted query does not
    reference = F.when(~F.col("waits") & F.col("won").isNotNull() & ~says_where(F.col("won.query")), F.get(F.filter("queries", lambda q: (q != F.col("won.query")) & says_where(q)), 0))
    t = t.withColumn("reference", reference).join(answers.select(F.col("query").alias("reference"), F.col("hits").alias("ref_hits")), "reference", "left")
    here = F.get("ref_hits", 0)
    doubt = F.col("reference").isNotNull() & F.col("ref_hits").isNotNull() & here.isNotNull() & ~same_place(F.get(F.col("won.hits"), 0), here)
    again = F.when(doubt & (F.coalesce(here["region"], F.lit("")) != ""), F.concat(F.col("won.query"), F.lit(", "), here["region"]))
    t = t.withColumns({"doubt": F.coalesce(doubt, F.lit(False)), "again": again}).join(answers.select(F.col("query").alias("again"), F.col("hits").alias("again_hits")), "again", "left")
    fits = F.filter("again_hits", lambda h: same_place(h, here))
    need = F.when(F.col("waits"), F.col("gap.query")).when(F.col("reference").isNotNull() & F.col("ref_hits").isNull(), F.col("reference")).when(F.col("again").isNotNull() & F.col("again_hits").isNull(), F.col("again"))
    better = F.coalesce(F.size(fits) > 0, F.lit(False))
    query = F.when(~F.col("doubt"), F.col("won.query")).when(better, F.col("again")).otherwise(F.col("reference"))
    found = F.when(~F.col("doubt"), F.col("won.hits")).when(better, fits).otherwise(F.col("ref_hits"))
    return t.select(DOC, need.alias("need"), query.alias("query"), found.alias("found"))


def open_queries(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct queries (query, documents) that unsettled documents need next.  Asked level by level, no document asks more than the cascade does."""
    return _settled(candidates, asked).filter("need is not null").groupBy(F.col("need").alias("query")).agg(F.count(F.lit(1)).alias("documents"))


def anchors(candidates: DataFrame, asked: DataFrame, limit: int = 1) -> DataFrame:
    """document_id, query, place, lat, lon, region, country of settled documents: ``limit`` hits of the query that was accepted."""
    done = _settled(candidates, asked).filter("need is null and query is not null")
    return done.select(DOC, "query", F.posexplode(F.slice("found", 1, limit)).alias("place", "h")).select(DOC, "query", "place", "h.*")
