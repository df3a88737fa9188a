"""Language identification with a bit-sliced Bloom filter of n-grams.

Text is lower-cased and every ASCII character that is no letter becomes a blank; the n-grams are runs of four
UTF-8 bytes with one blank at most.  Training counts them for each language on labelled documents (about
``DOCS_PER_LANG`` of each, chosen by a hash of doc_id and text); a language *contains* an n-gram if its relative frequency there
is at least ``SHARE`` of the highest of any language, and all that it contains are stored.  The filter
is one table of bit masks, a bit for each language (64 to a word, as many words as it takes), with as many slots as keep the false
positives of the fullest language below ``MISTAKEN``: an n-gram sets its languages' bits in ``HASHES`` slots,
and the conjunction of those slots returns all languages that contain it at once.  A text's score for a language
is its popcount over all n-grams, less what false positives add: (hits - n f) / (1 - f), f being that language's
fill rate to the power of ``HASHES``.  The highest wins; ``score`` is its share of all corrected counts and
``coverage`` its share of all n-grams (1 for letters without any n-gram: nothing speaks against them).

Nulls: a null or letterless text gives ``und`` with score 0; rows without lang are not learned from; a null doc_id
is not held out.  Letters without any known n-gram give the commonest learned language with score 0.  Ties go to
the language met most in training.  Without labelled rows everything is ``und``.  Whole texts count, repeated rows
stay, an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import cut, load, slices, small_batches

DOCS_PER_LANG, SHARE = 3000, 0.3
HASHES, MISTAKEN = 3, 0.01
GRAIN = 1 << 20  # bytes of text whose n-grams are held at once: some 60 bytes for each
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
#: ASCII letters stay (capitals become small), other ASCII becomes a blank, the bytes of other characters stay.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of all texts as 32-bit numbers, and the index of the text of each."""
    raw = [b" " + t.lower().encode("utf-8", "replace").translate(_LETTERS) + b" \0\0\0" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    if len(data) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    wide = data.astype(np.uint32)
    value = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    blank = (data == 32).view(np.uint8)
    keep = (blank[:-3] + blank[1:-2] + blank[2:-1] + blank[3:] <= 1) & (data[3:] != 0) & (data[2:-1] != 0) & (data[1:-2] != 0) & (data[:-3] != 0)
    owner = np.repeat(np.arange(len(raw)), np.fromiter(map(len, raw), np.int64, len(raw)))[:-3]
    return value[keep], owner[keep]


def slots(values: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    shift = np.uint32(32 - (size.bit_length() - 1))
    mixed = values ^ (values >> np.uint32(15))
    return [((mixed * m) ^ ((mixed * m) >> np.uint32(13))) * np.uint32(0x2C1B3C6D) >> shift for m in _MULTIPLIERS[:hashes]]


@dataclass
class Model:
    languages: list[str]  # most documents first
    table: np.ndarray
    false_positive: np.ndarray
    hashes: int = HASHES

    def masks(self, values: np.ndarray) -> np.ndarray:
        """For each n-gram the set of languages that contain it, as bits: a row of words."""
        out = None
        for at in slots(values, self.hashes, len(self.table)):
            out = self.table[at] if out is None else out & self.table[at]
        return out

    def popcounts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hits of each text (row) for each language (column), and the number of n-grams of each text."""
        values, owner = grams(texts)
        masks, n, k = self.masks(values), len(texts), len(self.languages)
        if k <= 8:
            table = np.bincount(owner << 8 | masks[:, 0].astype(np.int64), minlength=n << 8).reshape(n, 256)
            bits = (np.arange(256)[:, None] >> np.arange(k)) & 1
            return table @ bits, table.sum(1)
        hits = [np.bincount(owner[masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1) == 1], minlength=n) for i in range(k)]
        return np.stack(hits, axis=1), np.bincount(owner, minlength=n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and coverage of each text."""
        texts = [t or "" for t in texts]
        letters = np.fromiter((any(map(str.isalpha, t)) for t in texts), bool, len(texts))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        hits, n = self.popcounts(texts)
        true = np.maximum(0, (hits - n[:, None] * self.false_positive) / (1 - self.false_positive))
        best, total = true.argmax(1), true.sum(1)
        top = true[np.arange(len(texts)), best] * letters
        score = np.minimum(1, top / np.maximum(total, 1e-9))
        return [self.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letters)], score, np.where(n > 0, np.minimum(1, top / np.maximum(n, 1)), letters)


def slots_for(most: int) -> int:
    """A power of two at which ``most`` n-grams of one language are mistaken for others in ``MISTAKEN`` of all cases, or less."""
    return 1 << max(10, math.ceil(math.log2(max(1, HASHES * most / -math.log(1 - MISTAKEN ** (1 / HASHES))))))


def build(held: dict[str, np.ndarray], docs: dict[str, int]) -> Model:
    """The filter for the n-grams that each language contains."""
    languages = sorted(held, key=lambda x: (-docs.get(x, 0), x))
    kind, width = (np.uint8, 8) if len(languages) <= 8 else (np.uint64, 64)
    size = slots_for(max(map(len, held.values()), default=0))
    table = np.zeros((size, max(1, -(-len(languages) // width))), kind)
    for i, lang in enumerate(languages):
        for at in slots(np.asarray(held[lang], np.uint32), HASHES, size):
            table[at, i // width] |= kind(1 << i % width)
    fill = np.array([((table[:, i // width] >> kind(i % width)) & kind(1)).mean() for i in range(len(languages))])
    return Model(languages, table, fill**HASHES)


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model:
    """Fit on labelled rows of ``docs`` (doc_id, text, lang): about ``docs_per_lang`` documents of each language, all of a smaller one.  Eager."""
    small_batches(docs.sparkSession)
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return build({}, {})
    part = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_lang / n))))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000)

    def count(batches):
        for batch in batches:
            for piece in slices(batch, "text", GRAIN):
                names, langs = np.unique(np.array(piece.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
                values, owner = grams(piece.column("text").to_pylist())
                keys, n = np.unique(langs[owner].astype(np.int64) << 32 | values, return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(names[keys >> 32].tolist(), pa.string()), "gram": pa.array(keys & 0xFFFFFFFF), "n": pa.array(n, pa.int64())})

    counted = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = cut(counted, "grams")
    totals = F.broadcast(counted.groupBy("lang").agg(F.sum("n").alias("total")))  # a row for each language
    rates = counted.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    highest = rates.groupBy("gram").agg(F.max("rate").alias("highest"))
    # what the sample of labelled rows holds, so bounded by its size
    found = rates.join(highest, "gram").filter(F.col("rate") >= SHARE * F.col("highest")).select("lang", "gram").toArrow()
    code = found.column("lang").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    lang, gram = np.asarray(code.indices), np.asarray(found.column("gram")).astype(np.uint32)
    held = {name: gram[lang == i] for i, name in enumerate(code.dictionary.to_pylist())}
    return build({k: held.get(k, np.zeros(0, np.uint32)) for k in sizes}, sizes)


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ("lang_pred", "score", "coverage")) -> DataFrame:
    """``docs`` (with text) and language, score, coverage under ``names``; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def predict(batches):
        for batch in batches:
            for part in slices(batch, "text", GRAIN):
                lang, score, coverage = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64())], [*part.schema.names, *names])

    docs = docs.drop(*names)
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(names, (StringType(), DoubleType(), DoubleType())))])
    return docs.mapInArrow(predict, schema)


def op1_language_masks(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fitted on the documents that are not held out."""
    docs = load(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "coverage")
