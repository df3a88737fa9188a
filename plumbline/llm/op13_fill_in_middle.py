"""Fill-in-middle transformation of texts.

A text is decoded to its code points (UTF-32) as a numpy array.  Units are runs of white space with the word behind them, and
white space at the end: a unit ends wherever a word's last code point stands, and at the end of the text, so comparing the classes
of neighbours finds all ends at once.  Two of them, ranked by hashes of the seed and the document's id, cut the text into prefix, middle
and suffix; the pieces are re-encoded and put together as psm (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or spm (``<S>`` suffix ``<P>`` prefix ``<M>``
middle).  Texts that are empty or hold a mark, and a share of all texts that the hash picks, stay as they are.  ``restored`` takes the
output apart again: a piece cannot hold a mark, nor can a mark arise where a piece and a mark meet, so the first of each is the right one.

Nulls: a null text is empty; a null doc_id hashes as the seed and a colon alone.  Whole texts count, however long.  Repeated rows stay
repeated (and equal).  Further columns pass through, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, fresh, load, slices

SEED, RATE, SPM = 42, 50, 80  # shares in percent: texts that are changed; of these, those with the suffix first
MARKS = ("<P>", "<S>", "<M>")
SPACES = np.zeros(33, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
ADDED = (("units", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))


def unit_ends(points: np.ndarray) -> np.ndarray:
    """Ends of the units of a text, ascending; the last is its length."""
    if not len(points):
        return np.empty(0, np.int64)
    space = SPACES[np.minimum(points, 32)] & (points <= 32)
    return np.r_[np.flatnonzero(~space[:-1] & space[1:]) + 1, len(points)]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers that depend on seed and id alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def transformed(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    ends = unit_ends(points)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return len(ends), "plain", None, None, text
    ends = np.r_[0, ends]
    a, b = sorted((h1 % len(ends), h2 % len(ends)))
    a, b = int(ends[a]), int(ends[b])
    prefix, middle, suffix = (points[x:y].tobytes().decode("utf-32-le") for x, y in ((0, a), (a, b), (b, len(points))))
    p, s, m = marks
    if h4 % 100 < spm:
        return len(ends) - 1, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return len(ends) - 1, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks: tuple[str, str, str] = MARKS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with units, form, prefix_chars, middle_chars and output."""
    kept = list(docs.columns if keep is None else keep)
    id_, text = fresh(docs.columns, "id"), fresh(docs.columns, "text")
    source = docs.select(*kept, F.col("doc_id").alias(id_), F.coalesce("text", F.lit("")).alias(text))
    names = [free(kept, name) for name, _ in ADDED]
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(n, kind) for n, (_, kind) in zip(names, ADDED))])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                made = [transformed(t, d, seed, rate, spm, marks) for d, t in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist())]
                columns = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *columns], [*part.schema.names[:-2], *names])

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, len(first) + 1, 2**31 - 1)
        head = F.substring_index(rest, second, 1)
        rest = F.substring(rest, F.length(head) + len(second) + 1, F.length(rest))
        body = F.substring_index(rest, m, 1)
        return head, body, F.substring(rest, F.length(body) + len(m) + 1, F.length(rest))

    (prefix, suffix, middle), (suffix2, prefix2, middle2) = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, digested, and as restored from it."""
    rows = fill_in_middle(load(spark, sf_dir, "documents"), keep=["doc_id"])
    return rows.select(
        "doc_id",
        F.col("units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


_SPACE = r"\x20\x09-\x0D"
OP13_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+') AS units, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), d AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || h[1:8] AS UBIGINT) % (len(units) + 1) AS r1, CAST('0x' || h[9:16] AS UBIGINT) % (len(units) + 1) AS r2,
    CASE WHEN text = '' OR contains(text, '{MARKS[0]}') OR contains(text, '{MARKS[1]}') OR contains(text, '{MARKS[2]}') OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= {RATE} THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:CAST(least(r1, r2) AS BIGINT)], '') AS prefix,
    array_to_string(units[CAST(least(r1, r2) AS BIGINT) + 1:CAST(greatest(r1, r2) AS BIGINT)], '') AS middle, array_to_string(units[CAST(greatest(r1, r2) AS BIGINT) + 1:], '') AS suffix
  FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '{MARKS[1]}' || suffix || '{MARKS[0]}' || prefix || '{MARKS[2]}' || middle
    ELSE '{MARKS[0]}' || prefix || '{MARKS[1]}' || suffix || '{MARKS[2]}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
