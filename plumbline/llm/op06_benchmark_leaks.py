"""Benchmark decontamination: a BM25 inverted index of test items, searched by block-max WAND.

Items are few against the corpus, so the index holds the items and every passage of every training document is a
query.  An item has two entries, the whole and its question (all but the last sentence) if that has five words.  Scores are normalised by the
entry's own score, so that 1 means "all of its words".  Items are searched by classes of lengths: a passage is ``2 * stride`` words, a new one
every ``stride`` words, where ``stride`` is the power of two from the item's length on (``STRIDE`` at least): any item lies whole within some
passage, and how long other items are changes nothing for it.

Search: a bound first.  Terms found in few entries are *rare*; what all other terms can add to entry i is a constant
``s_i`` of the index.  A passage whose rare terms reach ``threshold - s_i`` for no entry cannot hold a result and is
skipped; this is computed for all passages of a batch at once.  Each passage left is searched by block-max WAND:
cursors over postings sorted by entry, a pivot from the terms' maxima, then the maxima of the blocks at the pivot, and only
then scores; every entry at or above the threshold is retrieved, without a limit of results.

The threshold of an entry is the least that a passage which verification accepts can score: with a fifth of the shingles
missing, at most so many words are, and the heaviest of them are taken off.  So all pairs that stand are retrieved.

Verification, in the passage: overlap of the question, of the answer (the last sentence) and of the whole item, by 5-word
shingles; a part of fewer words is one shingle of its length.  A pair stands if the whole overlaps by 0.8 or more, or the
question does and either has five words or the answer does as well.  Of the passages of a pair the best is reported.

Statistics (document frequencies, mean length) are those of all distinct items, so results do not depend on the shards: the index is
built in shards of ``SHARD_BYTES`` bytes of distinct items, which lie in the shared folder.  The corpus is read once: a task
holds ``HELD`` bytes of texts and takes one shard after another through them (a single shard stays in the worker).

Nulls: null texts (documents or items) and items without words match nothing; a null doc_id or item_id is carried.
Repeated documents or items give repeated pairs; repeated items weigh as one.  ``passage`` counts strides of the item's own class.  Empty tables give an
empty result.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, load, scratch, shared_files, slices

K1, B, OVERLAP, SHINGLE, STRIDE, BLOCK, SHARD_BYTES, HELD = 1.2, 0.75, 0.8, 5, 32, 64, 4 << 20, 32 << 20
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return (text or "").lower().encode("utf-8", "replace").translate(_WORDS).split()


def shingles(parts: list[bytes], size: int = SHINGLE) -> Counter:
    """Runs of ``size`` words, and how often each stands."""
    return Counter(zip(*(parts[k:] for k in range(size))))


def part(text: str) -> tuple[int, Counter]:
    """Size and shingles of an item's part: of fewer words than a shingle has, all of them."""
    w = words(text)
    size = min(SHINGLE, len(w))
    return size, shingles(w, size) if w else Counter()


def question_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; one sentence alone is all question."""
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s|$)", text.rstrip())]
    cut = ends[-2] if len(ends) > 1 and ends[-1] == len(text.rstrip()) else ends[-1] if ends and ends[-1] < len(text.rstrip()) else len(text)
    return text[:cut], text[cut:]


@dataclass
class Stats:
    """Of all items, whatever shard they are in."""

    n: int
    mean: float  # words
    df: dict[bytes, int]  # items that hold a term


@dataclass
class Index:
    """Of items of one class of lengths."""

    ids: list  # item_id (or key) of each item
    entries: list[tuple[int, bool]]  # item of each entry, and whether it is its question
    terms: dict[bytes, int]
    items: list[list[int]]  # of each term: entries, ascending
    gains: list[list[float]]  # of each term: contribution to each of those entries; 1 is an entry's threshold
    top: list[float]  # of each term: largest contribution
    blocks: list[tuple[list[int], list[float]]]  # of each term: last entry and largest contribution of each block
    rare: np.ndarray
    common: np.ndarray  # of each entry: what its terms that aren't rare add up to
    stride: int
    flat: tuple[np.ndarray, np.ndarray]  # entries and contributions of all terms after each other
    parts: list[tuple]  # of each item: its whole, question and answer
    weights: list[dict[int, float]]  # of each item: normalised contribution of its terms


def statistics(rows: list[tuple[int | None, str | None]]) -> Stats:
    lists = [w for _, t in rows if (w := words(t))]
    return Stats(len(lists), sum(map(len, lists)) / len(lists) if lists else 1.0, Counter(chain.from_iterable(map(set, lists))))


def stride_of(n: int) -> int:
    """Words from one passage to the next for items of ``n`` words."""
    return max(STRIDE, 1 << (n - 1).bit_length())


def lowest(weights: dict[int, float], *parts: tuple[int, Counter]) -> float:
    """The least score of a passage that holds ``OVERLAP`` of the shingles of one of ``parts`` and all other words.

    Words that no shingle covers are at most as many as the places of the shingles that are missing.
    """
    missing = 0
    for _, own in parts:
        places = sorted(own.values(), reverse=True)
        missing = max(missing, sum(places[: int(len(places) * (1 - OVERLAP) + 1e-9)]))
    return 1 - sum(sorted(weights.values(), reverse=True)[:missing]) - 1e-9


def classes(rows: list[tuple], stats: Stats | None = None) -> list[Index]:
    """An index for each class of lengths; all of them number terms alike."""
    stats, own, terms = stats or statistics(rows), {}, {}
    for i, t in rows:
        if w := words(t):
            own.setdefault(stride_of(len(w)), []).append((i, t))
            for x in w:
                terms.setdefault(x, len(terms))
    return [build(own[s], stats, terms) for s in sorted(own)]


def build(rows: list[tuple], stats: Stats | None = None, terms: dict[bytes, int] | None = None) -> Index:
    """One index of ``rows``, with the stride of the longest."""
    stats, terms = stats or statistics(rows), {} if terms is None else terms
    rows = [(i, t) for i, t in rows if words(t)]
    stride = max((stride_of(len(words(t))) for _, t in rows), default=STRIDE)
    entries, entry_words, parts = [], [], []
    for i, (_, text) in enumerate(rows):
        question, answer = question_answer(text)
        parts.append((part(text), part(question), part(answer)))
        for kind, own in ((False, words(text)), (True, words(question))):
            # a shorter question stands with its answer only, and then all words but some of the answer's are there
            if not kind or SHINGLE <= len(own) < len(entry_words[-1]):
                entries.append((i, kind))
                entry_words.append(own)
    for w in entry_words:
        for x in w:
            terms.setdefault(x, len(terms))
    df = np.fromiter((stats.df[x] for x in terms), np.int64, len(terms))
    idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))
    posts: list[list[tuple[int, float]]] = [[] for _ in terms]
    weights: list[dict[int, float]] = []
    for e, ((i, question), w) in enumerate(zip(entries, entry_words)):
        gain = {terms[x]: idf[terms[x]] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / stats.mean)) for x, c in Counter(w).items()}
        total = sum(gain.values())
        own = {k: float(g / total) for k, g in gain.items()}
        whole, asked, answer = parts[i]
        least = max(1e-6, lowest(own, asked) if question else lowest(own, whole, *[answer] * (asked[0] < SHINGLE)))
        if not question:
            weights.append(own)
        for k, g in own.items():
            posts[k].append((e, g / least))
    items = [np.array([e for e, _ in p], np.int64) for p in posts]
    gains = [np.array([g for _, g in p]) for p in posts]
    top = [float(g.max()) if len(g) else 0.0 for g in gains]
    blocks = [(i[np.minimum(np.arange(BLOCK - 1, len(i) + BLOCK - 1, BLOCK), len(i) - 1)], np.maximum.reduceat(g, np.arange(0, len(g), BLOCK)) if len(g) else g) for i, g in zip(items, gains)]
    blocks = [(last.tolist(), most.tolist()) for last, most in blocks]
    # the most frequent terms are not rare as long as, together, they leave every entry well below the threshold
    rare, common = np.fromiter(map(len, items), np.int64, len(items)) > 0, np.zeros(len(entries))
    for k in np.argsort(-np.fromiter(map(len, items), np.int64, len(items)), kind="stable"):
        if len(items[k]) < 2 or (common[items[k]] + gains[k]).max() > 0.5:
            continue
        rare[k] = False
        common[items[k]] += gains[k]
    flat = (np.concatenate(items), np.concatenate(gains)) if items else (np.zeros(0, np.int64), np.zeros(0))
    return Index([i for i, _ in rows], entries, terms, [i.tolist() for i in items], [g.tolist() for g in gains], top, blocks, rare, common, stride, flat, parts, weights)


def wand(index: Index, query: list[int], threshold: float = 1.0) -> list[tuple[int, float]]:
    """Every entry whose score for the distinct terms of ``query`` reaches ``threshold``, by block-max WAND."""
    live = [[index.items[t], index.gains[t], 0, t] for t in query if index.items[t]]  # postings, contributions, cursor, term
    found, eps = [], 1e-9
    while live:
        live.sort(key=lambda c: c[0][c[2]])
        bound, pivot = 0.0, None
        for k, c in enumerate(live):
            bound += index.top[c[3]]
            if bound >= threshold - eps:
                pivot = k
                break
        if pivot is None:
            break
        item = live[pivot][0][live[pivot][2]]
        while pivot + 1 < len(live) and live[pivot + 1][0][live[pivot + 1][2]] == item:
            pivot += 1
        bound, skip = 0.0, None
        for c in live[: pivot + 1]:
            last, most = index.blocks[c[3]]
            k = bisect_left(last, item)
            if k < len(last):
                bound += most[k]
                skip = last[k] if skip is None else min(skip, last[k])
        if bound >= threshold - eps:
            if live[0][0][live[0][2]] == item:
                score = 0.0
                for c in live[: pivot + 1]:
                    score += c[1][c[2]]
                    c[2] += 1
                if score >= threshold - eps:
                    found.append((item, float(score)))
            else:  # bring the cursors before the pivot up to it
                for c in live[:pivot]:
                    c[2] = bisect_left(c[0], item, c[2])
        else:  # no item up to the end of these blocks, or before the next cursor, can reach it
            to = (skip if skip is not None else item) + 1
            if pivot + 1 < len(live):
                to = min(to, live[pivot + 1][0][live[pivot + 1][2]])
            to = max(to, item + 1)
            for c in live[: pivot + 1]:
                c[2] = bisect_left(c[0], to, c[2])
        live = [c for c in live if c[2] < len(c[0])]
    return found


def read(index: Index, pieces: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each text, and the terms (or -1) of all words after each other."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return lens, np.fromiter(map(index.terms.get, chain.from_iterable(pieces), repeat(-1)), np.int64, int(lens.sum()))


def search(index: Index, lens: np.ndarray, tokens: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(text, entry, passage, score) of every passage and entry at or above the threshold."""
    if not index.ids:
        return []
    s, starts = index.stride, np.cumsum(lens) - lens
    # stretches of `stride` words, numbered over all texts; passage p is stretches p and p + 1 of one text
    stretches = np.maximum(1, -(-lens // s))
    first = np.cumsum(stretches) - stretches
    hit = np.flatnonzero(tokens >= 0)
    hit = hit[index.rare[tokens[hit]]]
    text = np.searchsorted(starts, hit, "right") - 1
    stretch = first[text] + (hit - starts[text]) // s
    df = np.fromiter(map(len, index.items), np.int64, len(index.items))
    n = df[tokens[hit]]
    where, flat = np.repeat(stretch, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(df) - df
    all_items, all_gains = index.flat
    at = np.repeat(base[tokens[hit]], n) + flat
    width = len(index.entries)
    keys, inverse = np.unique(where * width + all_items[at], return_inverse=True)
    sums = np.bincount(inverse, all_gains[at], len(keys))
    # a stretch and the next one of the same text make a passage
    nxt = np.searchsorted(keys, keys + width)
    follows = (nxt < len(keys)) & (keys[np.minimum(nxt, len(keys) - 1)] == keys + width) if len(keys) else np.zeros(0, bool)
    owner = np.searchsorted(first, keys // width, "right") - 1
    last = keys // width == first[owner] + stretches[owner] - 1
    both = sums + np.where(follows & ~last, sums[np.minimum(nxt, max(len(keys) - 1, 0))] if len(keys) else 0, 0)
    need = 1 - index.common[keys % width] - 1e-9
    alone_next = np.flatnonzero((sums >= need) & (keys // width > first[owner]))  # reached in the second half of the passage before
    candidates = np.unique(np.r_[keys[both >= need] // width, keys[alone_next] // width - 1])
    out = []
    for p in candidates.tolist():
        t = int(np.searchsorted(first, p, "right") - 1)
        a = int(starts[t] + (p - first[t]) * s)
        query = np.unique(tokens[a : min(a + 2 * s, int(starts[t] + lens[t]))])
        out += [(t, item, int(p - first[t]), score) for item, score in wand(index, query[query >= 0].tolist())]
    return out


def verify(index: Index, item: int, passage: list[bytes]) -> tuple[float, float, float]:
    """Overlap of the item, its question and its answer with a passage."""
    runs: dict[int, Counter] = {}
    return tuple(len(own.keys() & runs.setdefault(size, shingles(passage, size)).keys()) / len(own) if own else 0.0 for size, own in index.parts[item])


def stands(index: Index, item: int, whole: float, question: float, answer: float) -> bool:
    return whole >= OVERLAP or question >= OVERLAP and (index.parts[item][1][0] == SHINGLE or answer >= OVERLAP)


def find(indexes: list[Index], texts: list[str | None]) -> list[tuple]:
    """(text, id, score, passage, overlaps, contaminated) of every pair retrieved, for its best passage."""
    pieces = [words(t) for t in texts]
    seen_terms = read(indexes[0], pieces) if indexes else ()
    return [row for index in indexes for row in _found(index, pieces, *seen_terms)]


def _found(index: Index, pieces: list[list[bytes]], lens: np.ndarray, tokens: np.ndarray) -> list[tuple]:
    best: dict[tuple[int, int], tuple] = {}
    seen = set()
    for t, entry, passage, _ in search(index, lens, tokens):
        item = index.entries[entry][0]
        if (t, item, passage) in seen:
            continue
        seen.add((t, item, passage))
        own = pieces[t][passage * index.stride : (passage + 2) * index.stride]
        score = sum(index.weights[item].get(index.terms.get(x), 0.0) for x in set(own))
        overlaps = verify(index, item, own)
        row = (stands(index, item, *overlaps), overlaps, score, -passage)
        best[t, item] = max(best.get((t, item), row), row)
    return [(t, index.ids[item], score, -passage, *overlaps, stand) for (t, item), (stand, overlaps, score, passage) in sorted(best.items())]


RESULT = "doc_id long, key string, score double, passage int, overlap double, question_overlap double, answer_overlap double, contaminated boolean"


def _keyed(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter(F.col("text").isNotNull()).select("item_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("key"))


def shards(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES):
    """The classes of all items, shard by shard: about ``shard_bytes`` of distinct texts are on the driver at once."""

    def split(batches):
        for batch in batches:
            lists = [words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, lists), pa.int32()), pa.array([list(set(w)) for w in lists], pa.list_(pa.binary()))], ["key", "text", "n", "terms"])

    own = _keyed(benchmark).groupBy("key").agg(F.min("text").alias("text"))
    items = cut(own.mapInArrow(split, "key string, text string, n int, terms array<binary>").filter("n > 0"), "items")
    total = items.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("mean"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not total["n"]:
        return
    several = -(-total["bytes"] // shard_bytes)
    df = cut(items.select(F.explode("terms").alias("term")).groupBy("term").count(), "df")
    for k in range(several):
        mine = items.filter(F.pmod(F.xxhash64("key"), F.lit(several)) == k)
        rows = sorted(map(tuple, mine.select("key", "text").collect()))
        counts = df.join(mine.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").collect()
        if rows:
            yield classes(rows, Stats(total["n"], total["mean"], {bytes(r["term"]): r["count"] for r in counts}))


def stored(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[str]:
    """Files of the shards in the shared folder."""
    paths = []
    for k, indexes in enumerate(shards(benchmark, shard_bytes)):
        fs, path = shared_files(uri := scratch(benchmark.sparkSession, f"index-{k}"))
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as f:
            pickle.dump(indexes, f, protocol=5)
        paths.append(uri)
    return paths


@lru_cache(maxsize=1)
def _loaded(uri: str) -> list[Index]:
    fs, path = shared_files(uri)
    with fs.open_input_stream(path) as f:
        return pickle.load(f)


def _judged(batches, paths: list[str], held: int):
    """Parts of ``batches``, each with what all shards find in it; about ``held`` bytes at a time."""

    def through(parts):
        texts = [p.column(p.schema.get_field_index("text")).to_pylist() for p in parts]
        found = [[] for _ in parts]
        for path in paths:
            for rows, t in zip(found, texts):
                rows += find(_loaded(path), t)
        return zip(parts, found)

    parts, size = [], 0
    for batch in batches:
        for part in slices(batch, "text"):
            parts.append(part)
            size += part.nbytes
            if size >= held or len(paths) == 1:
                yield from through(parts)
                parts, size = [], 0
    yield from through(parts)


def retrieve(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, held: int = HELD) -> DataFrame:
    """Best passage and overlaps of every (document, item) pair retrieved; ``contaminated`` if the pair stands."""
    paths = stored(benchmark, shard_bytes)

    def pairs(batches):
        for part, found in _judged(batches, paths, held):
            ids = part.column("doc_id").to_pylist()
            rows = [(ids[t], *rest) for t, *rest in found]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], [x.split()[0] for x in RESULT.split(", ")])

    found = docs.select("doc_id", "text").mapInArrow(pairs, RESULT)
    return found.join(_keyed(benchmark).select("item_id", "key"), "key").select("doc_id", "item_id", *found.columns[2:])


def decontaminated(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, held: int = HELD) -> DataFrame:
    """Rows of ``docs`` (text and others) that hold no item.  Rows are judged where they are: one scan, no shuffle, no key."""
    paths = stored(benchmark, shard_bytes)

    def clean(batches):
        for part, found in _judged(batches, paths, held):
            gone = {t for t, *_, stand in found if stand}
            yield part.filter(pa.array([t not in gone for t in range(part.num_rows)], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op6_block_max_wand(spark, sf_dir: str) -> DataFrame:
    """The pairs of documents and benchmark items that stand."""
    pairs = retrieve(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return pairs.filter("contaminated").drop("contaminated")
