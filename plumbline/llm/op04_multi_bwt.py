"""Exact repeated passages by column-wise construction of a collection's suffix order.

Every byte covered by a string of ``LENGTH`` bytes that also starts earlier (smaller doc_id, or earlier in the same
document) goes; all strings are judged on the input.

Anchors split the collection into parts that can be built apart.  Of the 40-byte grams inside a window of LENGTH
bytes, the leftmost with the smallest hash is its anchor, so equal windows have equal anchors.  Windows next to each
other that share an anchor position form a segment (160 bytes at most).  Segments with equal bytes need no search:
all but the first are covered.  That happens within each batch before anything is shuffled and once more for all, so
a passage in a third of all documents arrives as one row a batch.  An anchor with one distinct segment left is
unique and done.

The others are fetched and built into a multi-document suffix order, one collection for some thousands of segments
with whole anchors: a round inserts one symbol of each segment, from its end to its start.  The positions of the new
suffixes are ranks in the Burrows-Wheeler transform so far; their common prefixes with both neighbours are one more than the
smallest common prefix between the two occurrences of their symbol.  Transform and prefixes are sequential files: a
round reads both from front to end in blocks, with the counts, the smallest prefixes and the open neighbours of each symbol
carried from block to block, and writes them merged.  Files lie in memory up to ``SPOOL`` bytes, then below the shared
folder under names of their own.  Neighbours with LENGTH common bytes are equal windows; the earliest of each class stays.

Hot anchors: around a passage that very many documents hold, the same anchor has a segment of other bytes in each of
them.  Segments of an anchor that a sample of ``SAMPLE`` documents shows ``OFTEN`` times, or that has over ``CROWD``
distinct ones, are cut into their single windows, each dealt by its own hash; equal windows then meet as equal segments do.
Which anchors these are matters for speed only, and no task holds more than ``CROWD`` segments of one anchor.

Equal bytes mean equal 64-bit hashes of anchor and of segment (for single windows two hashes of all their bytes).

Nulls: a null text is empty; a null doc_id sorts before all others.  Texts under LENGTH bytes lose nothing.  A document is
a doc_id and a text: rows that repeat both are one document and get equal results; rows that share a doc_id, or have
none, with other texts are documents of their own, earlier ones first by the text's hash.  An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, load, partitions, scratch, shared_files, slices, texts_of

LENGTH, GRAM = 100, 40
BLOCK = 1 << 20  # windows of a document that are anchored at once
COLLECTION = 3000  # segments of one collection; with whole anchors up to CROWD more
CROWD = 500  # distinct segments of one anchor that are ordered together
SAMPLE, OFTEN = 10_000, 25
SPOOL, PIECE = 32 << 20, 1 << 18  # bytes of a file in memory, and of a block
END = 255  # no byte of UTF-8: what precedes a whole segment
NONE = -(2**63)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on."""
    n = len(data) - 7
    words = np.empty(n, np.uint64)
    for r in range(8):
        part = data[r : r + (len(data) - r) // 8 * 8].view("<u8")
        words[r::8] = part[: len(words[r::8])]
    out = None
    m = len(data) - GRAM + 1
    for k in range(0, GRAM, 8):
        w = words[k : k + m]
        out = w * np.uint64(0x9E3779B97F4A7C15) if out is None else (out ^ w) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out * np.uint64(0x2545F4914F6CDD1D)


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (width - size)], v[width - size :]) if width > size else v


def segments(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first byte and number of bytes of each segment of ``text``."""
    data, keys, starts, sizes = np.frombuffer(text, np.uint8), [], [], []
    for s0 in range(0, len(data) - length + 1, BLOCK):
        s1 = min(s0 + BLOCK, len(data) - length + 1)
        h = gram_hashes(data[s0 : s1 - 1 + length])
        place = np.arange(len(h), dtype=np.uint64)
        low = np.uint64((1 << 24) - 1)
        anchor = (_sliding_min((h & ~low) | place, length - GRAM + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], len(anchor)] - 1
        keys.append(h[anchor[first]])
        starts.append(first + s0)
        sizes.append(last - first + length)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(sizes)


def ranges(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the union of byte ranges."""
    if not len(doc):
        return doc, start, size
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + size)[order]
    # ranges of one document are of bounded size, so a running maximum of ends is taken within documents
    group = np.r_[0, np.cumsum(doc[1:] != doc[:-1])]
    span = int(end.max()) + 1
    far = np.maximum.accumulate(end + group * span) - group * span
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])]
    at = np.flatnonzero(new)
    return doc[at], start[at], far[np.r_[at[1:], len(doc)] - 1] - start[at]


class Column:
    """One sequential file of bytes: appended in blocks, then read in blocks of the same sizes from front to end."""

    def __init__(self, folder: str | None = None):
        self.folder, self.held, self.path, self.sizes, self.out = folder, [], None, [], None

    def append(self, values: np.ndarray) -> None:
        for part in np.array_split(values, max(1, len(values) // PIECE)):
            if self.sizes and self.sizes[-1] < PIECE and self.out is None and len(part) < PIECE:
                self.held[-1] = np.concatenate([self.held[-1], part])
                self.sizes[-1] += len(part)
            else:
                self.sizes.append(len(part))
                if self.out is None:
                    self.held.append(part)
                else:
                    self.out.write(part.tobytes())
        if self.out is None and self.folder and sum(self.sizes) > SPOOL:
            self._to_file()

    def _to_file(self) -> None:
        self.fs, root = shared_files(self.folder)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.path)
        for part in self.held:
            self.out.write(part.tobytes())
        self.held = []

    def blocks(self):
        if self.out is None:
            yield from self.held
            return
        self.out.close()
        with self.fs.open_input_stream(self.path) as f:
            for n in self.sizes:
                yield np.frombuffer(f.read(n), np.uint8)

    def drop(self) -> None:
        if self.path:
            self.fs.delete_file(self.path)

    def whole(self) -> np.ndarray:
        return np.concatenate(list(self.blocks()))


def _ranks(bwt: Column, lcp: Column, at: np.ndarray):
    """For the entries ``at`` (ascending) of the transform, by one pass over both files:

    symbol, how many of it come before, and the smallest common prefix up to its occurrence before (or -1) and after (or -1).
    """
    n = len(at)
    symbol, rank, own, follow = np.empty(n, np.int64), np.empty(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    seen = np.zeros(256, np.int64)  # of each symbol, how many so far,
    since = np.full(256, 255, np.uint8)  # the smallest prefix after the last,
    waits = np.full(256, -1, np.int64)  # and which of the entries that is
    base = q = 0
    last = len(bwt.sizes) - 1
    for number, (block, prefix) in enumerate(zip(bwt.blocks(), lcp.blocks())):
        order = np.argsort(block, kind="stable")
        count = np.bincount(block, minlength=256)
        edge = np.r_[0, np.cumsum(count)]
        place = np.empty(len(block), np.int64)
        place[order] = np.arange(len(block))
        to = q + int(np.searchsorted(at[q:], base + len(block)))
        here = at[q:to] - base
        c, j = block[here].astype(np.int64), place[here]
        symbol[q:to], rank[q:to] = c, seen[c] + j - edge[c]
        has, goes = j > edge[c], j + 1 < edge[c + 1]
        before, after = order[j[has] - 1], order[j[goes] + 1]
        least = _Least(prefix, int(max(np.max(here[has] - before, initial=1), np.max(after - here[goes], initial=1))))
        own[q:to][has] = least(before + 1, here[has])
        follow[q:to][goes] = least(here[goes] + 1, after)
        present = np.flatnonzero(count)
        if number:  # what the blocks before left open
            head, mine = np.minimum.accumulate(prefix), own[q:to]
            far = ~has & (seen[c] > 0)
            mine[far] = np.minimum(since[c[far]], head[here[far]])
            open_ = present[waits[present] >= 0]
            follow[waits[open_]] = np.minimum(since[open_], head[order[edge[open_]]])
        if number < last:
            tail = np.r_[np.minimum.accumulate(prefix[::-1])[::-1], np.uint8(255)]
            since = np.minimum(since, prefix.min())
            since[present] = tail[order[edge[present + 1] - 1] + 1]
            waits[present] = -1
            waits[c[~goes]] = np.arange(q, to)[~goes]
        seen += count
        base, q = base + len(block), to
    return symbol, rank, own, follow


def _merged(old: Column, places: np.ndarray, values: np.ndarray, changed: np.ndarray | None = None, to: np.ndarray | None = None) -> Column:
    """A file with ``values`` inserted before the old entries ``places`` (ascending), and the old entries ``changed`` set ``to``."""
    new, base, a, x = Column(old.folder), 0, 0, 0
    blocks = len(old.sizes)
    for i, block in enumerate(old.blocks(), 1):
        end = base + len(block)
        b = len(places) if i == blocks else a + int(np.searchsorted(places[a:], end))
        if changed is not None:
            y = x + int(np.searchsorted(changed[x:], end))
            block = block.copy()
            block[changed[x:y] - base] = to[x:y]
            x = y
        new.append(np.insert(block, places[a:b] - base, values[a:b]))
        base, a = end, b
    old.drop()
    return new


def build(texts: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform and common prefixes of the suffixes of ``texts`` (each under 255 bytes, not empty)."""
    n, lens = len(texts), np.fromiter(map(len, texts), np.int64, len(texts))
    most = int(lens.max())
    symbols = np.full((most + 1, n), END, np.uint8)  # row t: the symbol t places before the end
    for i, t in enumerate(texts):
        symbols[: len(t), i] = np.frombuffer(t, np.uint8)[::-1]
    bwt, lcp = Column(folder), Column(folder)
    bwt.append(symbols[0])
    lcp.append(np.zeros(n, np.uint8))
    live, at, totals = np.arange(n), np.arange(n), np.bincount(symbols[0], minlength=256)
    for t in range(1, most + 1):
        symbol, rank, own, follow = _ranks(bwt, lcp, at)
        # suffixes stand in the order of what they extend: smaller symbols, then earlier entries, after the n empty ones
        where = n + (np.cumsum(totals) - totals)[symbol] + rank
        order = np.argsort(where, kind="stable")
        live, where, own, follow = live[order], where[order], own[order], follow[order]
        added = symbols[t, live]
        places = where - np.arange(len(where))
        # the entry behind a new one: if it is new as well its own prefix says the same
        ahead = (follow >= 0) & np.r_[where[1:] != where[:-1] + 1, True]
        bwt = _merged(bwt, places, added)
        lcp = _merged(lcp, places, (own + 1).astype(np.uint8), places[ahead], (follow[ahead] + 1).astype(np.uint8))
        totals = totals + np.bincount(added, minlength=256)
        more = added != END
        live, at = live[more], where[more]
        if not len(live):
            break
    out = bwt.whole(), lcp.whole()
    bwt.drop()
    lcp.drop()
    return out


class _Least:
    """Smallest value of a range of ``values``, for ranges of up to ``longest``."""

    def __init__(self, values: np.ndarray, longest: int):
        levels = max(1, longest.bit_length())
        self.t = np.zeros((levels, len(values)), np.uint8)
        self.t[0] = values
        for j in range(1, levels):
            half = 1 << (j - 1)
            if len(values) > half:
                np.minimum(self.t[j - 1, :-half], self.t[j - 1, half:], out=self.t[j, :-half])

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        j = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        return np.minimum(self.t[j, low], self.t[j, high - (1 << j) + 1])


def repeated(texts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """doc and start of every window of ``texts`` that equals an earlier one."""
    n = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    bwt, lcp = build(texts, folder)
    rank = np.empty(len(bwt), np.int64)
    rank[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    group = np.cumsum(lcp < length)
    who, at, groups, docs, starts = np.arange(n), np.arange(n), [], [], []
    for t in range(1, int(lens.max()) + 1):  # from the empty suffixes to the whole segments
        live = lens[who] >= t
        who, at = who[live], n + rank[at[live]]
        if t >= length:
            groups.append(group[at])
            docs.append(doc[who])
            starts.append(start[who] + lens[who] - t)
    groups, docs, starts = np.concatenate(groups), np.concatenate(docs), np.concatenate(starts)
    order = np.lexsort((starts, docs, groups))
    groups, docs, starts = groups[order], docs[order], starts[order]
    first = np.r_[True, groups[1:] != groups[:-1]]
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (docs != docs[head]) | (starts != starts[head])
    return docs[later], starts[later]


_ROWS = ["key", "seg", "doc", "tie", "start", "size"]
_FOUND = "doc long, tie long, key long, start long, size int, many boolean"


def documents(docs: DataFrame) -> DataFrame:
    """doc, tie (what tells documents apart, in their order) and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def _long(column) -> np.ndarray:
    return np.asarray(column, dtype=np.int64)


def _numbered(doc: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each row's document, ascending in their order, and doc and tie of each number."""
    order = np.lexsort((tie, doc))
    d, t = doc[order], tie[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])] if len(d) else np.zeros(0, bool)
    number = np.empty(len(d), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, d[new], t[new]


def _first_of_equal(key, seg, doc, start):
    """Sort order by (key, seg, doc, start), and which rows equal an earlier one's bytes."""
    order = np.lexsort((start, doc, seg, key))
    k, s, d, a = key[order], seg[order], doc[order], start[order]
    first = np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])] if len(k) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return order, first, ~first & ((d != d[head]) | (a != a[head]))


def _windows(text: bytes, start: int, size: int) -> tuple[list[int], list[int], range]:
    """Two hashes and the start of every window of one segment."""
    at = range(start, start + size - LENGTH + 1)
    wide = [xxhash.xxh3_128_intdigest(text[a : a + LENGTH]) for a in at]
    return [w >> 64 for w in wide], [w & 0xFFFFFFFFFFFFFFFF for w in wide], at


def _anchored(batches, hot: np.ndarray):
    """Rows (key, seg, doc, tie, start, size); a covered range has seg null and a key that only spreads it."""
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for part in slices(batch, "text"):
            number, docs, ties = _numbered(_long(part.column("doc")), _long(part.column("tie")))
            texts = texts_of(part.column("text"))
            found = [segments(t) for t in texts]
            counts = np.fromiter((len(f[0]) for f in found), np.int64, len(found))
            if not counts.sum():
                continue
            key, start, size = (np.concatenate(x) for x in zip(*found))
            key, row = key.view(np.int64), np.repeat(np.arange(len(texts)), counts)
            crowd = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
            calm = np.flatnonzero(~crowd)
            seg = np.array([digest(texts[r][a : a + n]) for r, a, n in zip(row[calm].tolist(), start[calm].tolist(), size[calm].tolist())], np.uint64).view(np.int64)
            columns = [(key[calm], seg, row[calm], start[calm], size[calm])]
            for r, a, n in zip(row[crowd].tolist(), start[crowd].tolist(), size[crowd].tolist()):
                k, g, at = _windows(texts[r], a, n)
                columns.append((np.array(k, np.uint64).view(np.int64), np.array(g, np.uint64).view(np.int64), np.full(len(at), r), np.array(at, np.int64), np.full(len(at), LENGTH)))
            key, seg, row, start, size = (np.concatenate(c) for c in zip(*columns))
            doc = number[row]
            order, first, later = _first_of_equal(key, seg, doc, start)
            one, more = order[first], order[later]
            yield _rows(key[one], seg[one], docs[doc[one]], ties[doc[one]], start[one], size[one])
            d, a, n = ranges(doc[more], start[more], size[more])
            if len(d):
                yield _rows(ties[d] * np.int64(0x1E3779B97F4A7C15) + a, None, docs[d], ties[d], a, n)


def _rows(key, seg, doc, tie, start, size) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.nulls(len(key), pa.int64()) if seg is None else pa.array(seg), pa.array(doc), pa.array(tie), pa.array(start), pa.array(size, pa.int32())], _ROWS)


def _whole_keys(batches, weight: int):
    """Regroup batches sorted by ``key`` into tables of at least ``weight`` rows that end with a key."""
    held, rows, need = [], 0, weight
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= need:
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.asarray(table.column("key"))
            cut_at = int(np.searchsorted(key, key[-1]))
            if cut_at:
                yield table.slice(0, cut_at)
                held = table.slice(cut_at).to_batches()
                rows, need = rows - cut_at, weight
            else:  # one key so far: look again when there is twice as much
                held, need = table.to_batches(), 2 * rows
    if held:
        yield pa.Table.from_batches(held)


def _resolved(batches, crowd: int):
    """Covered ranges (key null), and the first segment of each content of anchors that have several."""
    for table in _whole_keys(batches, 200_000):
        table = table.combine_chunks()
        done = np.asarray(table.column("seg").is_null())
        doc, docs, ties = _numbered(_long(table.column("doc")), _long(table.column("tie")))
        key, start, size = (np.asarray(table.column(c)) for c in ("key", "start", "size"))
        at = np.flatnonzero(~done)
        seg = np.asarray(table.column("seg").filter(pa.array(~done)), dtype=np.int64)
        order, first, later = _first_of_equal(key[at], seg, doc[at], start[at])
        more = np.r_[np.flatnonzero(done), at[order[later]]]
        one = at[order[first]]
        _, inverse, count = np.unique(key[one], return_inverse=True, return_counts=True)
        several, many = count[inverse] > 1, count[inverse] > crowd
        one, many = one[several], many[several]
        d, a, n = ranges(doc[more], start[more], size[more].astype(np.int64))
        yield _found(docs[d], ties[d], a, n)
        yield _found(docs[doc[one]], ties[doc[one]], start[one], size[one], key[one], many)


def _found(doc, tie, start, size, key=None, many=None) -> pa.RecordBatch:
    n = len(doc)
    key, many = (pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_())) if key is None else (pa.array(key), pa.array(many))
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), key, pa.array(start, pa.int64()), pa.array(size, pa.int32()), many], ["doc", "tie", "key", "start", "size", "many"])


_BODIES = "key long, seg long, doc long, tie long, start long, body binary"


def _fetched(batches):
    """The bytes of the segments that a document is asked for; of a crowded anchor its windows' hashes (seg) instead."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows = []
            for doc, tie, text, wanted in zip(part.column("doc").to_pylist(), part.column("tie").to_pylist(), texts_of(part.column("text")), part.column("wanted").to_pylist()):
                for w in wanted:
                    if w["many"]:
                        k, g, at = _windows(text, w["start"], w["size"])
                        rows += [(x, y, doc, tie, a, None) for x, y, a in zip(np.array(k, np.uint64).view(np.int64).tolist(), np.array(g, np.uint64).view(np.int64).tolist(), at)]
                    else:
                        rows.append((w["key"], None, doc, tie, w["start"], text[w["start"] : w["start"] + w["size"]]))
            for k in range(0, len(rows), 50_000):
                kinds = (pa.int64(),) * 5 + (pa.binary(),)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 50_000]), kinds)], [x.split()[0] for x in _BODIES.split(", ")])


def _collections(batches, folder: str):
    for table in _whole_keys(batches, COLLECTION):
        table = table.combine_chunks()
        doc, docs, ties = _numbered(_long(table.column("doc")), _long(table.column("tie")))
        start, whole = np.asarray(table.column("start")), np.asarray(table.column("seg").is_null())
        at, d, a = np.flatnonzero(~whole), [], []
        if len(at):
            seg = np.asarray(table.column("seg").filter(pa.array(~whole)), dtype=np.int64)
            order, _, later = _first_of_equal(np.asarray(table.column("key"))[at], seg, doc[at], start[at])
            d.append(doc[at[order[later]]])
            a.append(start[at[order[later]]])
        at = np.flatnonzero(whole)
        if len(at):
            x, y = repeated(table.column("body").filter(pa.array(whole)).to_pylist(), doc[at], start[at], folder=folder)
            d.append(x)
            a.append(y)
        d, a = np.concatenate(d), np.concatenate(a)
        d, a, n = ranges(d, a, np.full(len(d), LENGTH, np.int64))
        yield _found(docs[d], ties[d], a, n)


def hot_anchors(docs: DataFrame, total: int, often: int = OFTEN) -> np.ndarray:
    """Anchors that ``often`` distinct segments of a sample have: at most a fixed share of the sample's segments."""
    part = docs.filter(F.pmod("tie", F.lit(max(1, total // SAMPLE))) == 0)
    none = np.zeros(0, np.int64)
    rows = part.mapInArrow(lambda batches: _anchored(batches, none), "key long, seg long, doc long, tie long, start long, size int")
    counts = rows.filter("seg is not null").groupBy("key").agg(F.approx_count_distinct("seg").alias("n"))
    return np.sort(np.asarray(counts.filter(F.col("n") >= often).select("key").toArrow().column("key"), dtype=np.int64))


def removed_ranges(docs: DataFrame, crowd: int = CROWD, often: int = OFTEN) -> DataFrame:
    """doc, tie (as in ``documents``) and the byte ranges (start, size) of ``docs`` (doc_id, text) that repeat an earlier string.  Eager."""
    spark = docs.sparkSession
    n, own, folder = partitions(spark), documents(docs), scratch(spark, "columns")
    hot = spark.sparkContext.broadcast(hot_anchors(own, docs.count(), often))
    anchors = own.mapInArrow(lambda batches: _anchored(batches, hot.value), "key long, seg long, doc long, tie long, start long, size int")
    found = cut(anchors.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda batches: _resolved(batches, crowd), _FOUND), "anchors")
    wanted = found.filter("key is not null").groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "start", "size", "many")).alias("wanted"))
    bodies = own.join(wanted, ["doc", "tie"]).mapInArrow(_fetched, _BODIES)
    searched = bodies.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lambda batches: _collections(batches, folder), _FOUND)
    return found.filter("key is null").unionByName(searched).groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "size")).alias("gone"))


def _mask(n: int, gone: list[dict] | None) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for g in gone or ():
        edges[g["start"]] += 1
        edges[g["start"] + g["size"]] -= 1
    return np.cumsum(edges[:-1]) > 0


def cleaned(docs: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, text, and of the bytes that stay: kept (binary), n_bytes, n_removed, n_spans.  Eager up to the last join."""
    own = documents(docs.select("doc_id", "text"))
    joined = own.join(removed_ranges(docs, **bounds), ["doc", "tie"], "left").select(F.nullif("doc", F.lit(NONE)).alias("doc_id"), "text", "gone")

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                kept, sizes, removed, spans = [], [], [], []
                for text, own in zip(texts_of(part.column("text")), part.column("gone").to_pylist()):
                    mask = _mask(len(text), own)
                    kept.append(np.frombuffer(text, np.uint8)[~mask].tobytes() if own else text)
                    sizes.append(len(text))
                    removed.append(int(mask.sum()))
                    spans.append(int((mask & ~np.r_[False, mask[:-1]]).sum()) if len(mask) else 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(apply, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def without_ranges(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with texts that lack the byte ranges ``gone`` (doc, tie, gone), ``n_chars`` renewed if there is one.

    Parts of characters that a range cuts through go with it.
    """
    doc, tie, ranges_ = (fresh(docs.columns, c) for c in ("doc", "tie", "gone"))
    marked = docs.withColumns({doc: F.coalesce("doc_id", F.lit(NONE)), tie: F.xxhash64(F.coalesce("text", F.lit("")))})
    held = marked.join(gone.select(F.col("doc").alias(doc), F.col("tie").alias(tie), F.col("gone").alias(ranges_)), [doc, tie], "left").select(*docs.columns, ranges_)

    def apply(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts, at = part.column("text").to_pylist(), part.schema.get_field_index("text")
                for i, own in enumerate(part.column(ranges_).to_pylist()):
                    if own:
                        data = np.frombuffer(texts[i].encode(), np.uint8)
                        texts[i] = data[~_mask(len(data), own)].tobytes().decode("utf-8", "ignore")
                yield part.set_column(at, "text", pa.array(texts, pa.string())).drop_columns([ranges_])

    out = held.mapInArrow(apply, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_multi_bwt(spark, sf_dir: str) -> DataFrame:
    """What is left of every document, as digests."""
    out = cleaned(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
