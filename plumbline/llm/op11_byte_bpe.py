"""Byte-level BPE encoding and decoding by a file of ranks.

A text is split by the vocabulary's pattern; each match is encoded on its own.  A match that is a token as it stands becomes that
token.  The others are laid out as rows of numpy matrices, one matrix for each class of lengths, a token of one byte per cell
and cells to the right empty.  Every round looks at all rows at once: the pairs of neighbouring tokens have a rank (that
of their bytes put together, found in an open-addressed hash table of pairs), each row merges its leftmost pair of least rank, and the
cells right of it move one to the left.  Rows without a pair that has a rank are done and leave the matrix.  Matches over
``LONG`` bytes merge in the same order, but keep the least rank of each block of cells and close gaps now and then, so that
a round does not cost the whole row.

Distinct matches are encoded once per worker while a memo of ``MEMO`` entries lasts (it starts anew when full); results
do not depend on it.

Nulls: a null text is empty and has no ids; a null id counts as absent when decoding; a null array of ids decodes to no bytes.
Texts of any length are encoded whole.  Repeated rows stay repeated.  Further columns pass through, whatever their names.  An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, fresh, load, slices
from .vocab import vocabulary_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MEMO = 400_000  # distinct matches kept by one Python worker
CELLS = 1 << 20  # of one matrix
LONG, BLOCK = 2048, 256
NEVER = np.int32(2**31 - 1)  # rank of what cannot merge


class PairTable:
    """(left id, right id) to rank, by open addressing with linear probing; absent pairs have ``NEVER``."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        key = (left.astype(np.int64) << 32) | right
        todo = np.arange(len(key))
        slot = self._home(key)
        while todo.size:
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = key[todo[free]]  # of those that want one slot the last has it
            settled = self.keys[slot[todo]] == key[todo]
            self.ranks[slot[todo[settled]]] = rank[todo[settled]]
            todo = todo[~settled]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a negative id stands for an empty cell."""
        key = (left.astype(np.int64) << 32) | right
        out = np.full(key.shape, NEVER, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        key = key.reshape(-1)[at]
        slot = self._home(key)
        while at.size:
            there = self.keys[slot]
            hit = there == key
            out.reshape(-1)[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there >= 0)
            at, key, slot = at[on], key[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


class ByteBpe:
    """Encoder and decoder of one file of ranks (``base64 rank`` lines) and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    left.append(a), right.append(b), rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int32))
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, r in self.ranks.items():
            self.size[r] = len(token)
        self.bytes = np.zeros(int(self.size.sum()), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        for token, r in self.ranks.items():
            self.bytes[self.start[r] : self.start[r] + len(token)] = np.frombuffer(token, np.uint8)
        self.memo: dict[str, np.ndarray] = {}

    def _matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """ids of pieces of similar lengths: rows of one matrix."""
        n = np.array([len(p) for p in pieces])
        cells = np.full((len(pieces), int(n.max())), -1, np.int32)
        cells[np.arange(cells.shape[1]) < n[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.find(cells[:, :-1], cells[:, 1:])
        row, out = np.arange(len(pieces)), [np.empty(0, np.int32)] * len(pieces)
        while True:
            at = rank.argmin(1)  # the first of equal ranks
            least = rank[np.arange(len(row)), at]
            over = np.flatnonzero(least == NEVER)
            for r in over.tolist():
                out[row[r]] = cells[r, : n[r]].copy()
            if over.size:
                going = least != NEVER
                if not going.any():
                    return out
                row, n, at, least, width = row[going], n[going], at[going], least[going], int(n[going].max())
                cells, rank = cells[going, :width], rank[going, : width - 1]
            here = np.arange(len(row))
            # the right one of the pair goes: cells from there on, and their ranks, come from one place further right
            place = np.arange(cells.shape[1])
            moved = np.minimum(place + (place > at[:, None]), cells.shape[1] - 1)
            cells = np.take_along_axis(cells, moved, 1)
            cells[here, at] = least
            n = n - 1
            cells[here, n] = -1
            rank = np.take_along_axis(rank, np.minimum(moved[:, :-1], rank.shape[1] - 1), 1)
            rank[here, n - 1] = NEVER
            rank[here, at] = self.pairs.find(cells[here, at], np.where(at + 1 < n, cells[here, np.minimum(at + 1, cells.shape[1] - 1)], -1))
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.find(cells[left, at[left] - 1], cells[left, at[left]])

    def _long(self, piece: bytes) -> np.ndarray:
        """ids of one long piece: as in ``_matrix``, but a merged cell stays as a gap until half of the cells are gaps."""
        cells = self.single[np.frombuffer(piece, np.uint8)]
        while True:
            n = len(cells)
            rank = np.full(-(-n // BLOCK) * BLOCK, NEVER, np.int32)
            rank[: n - 1] = self.pairs.find(cells[:-1], cells[1:])
            blocks = rank.reshape(-1, BLOCK)
            least, next_, prev = blocks.min(1), np.arange(1, n + 1), np.arange(-1, n - 1)
            for _ in range(max(1, n // 2)):
                b = int(least.argmin())
                if least[b] == NEVER:
                    return cells[cells >= 0]
                at = b * BLOCK + int(blocks[b].argmin())
                gone, before = int(next_[at]), int(prev[at])
                after = int(next_[gone])
                cells[at], cells[gone], next_[at] = rank[at], -1, after
                if after < n:
                    prev[after] = at
                rank[gone] = NEVER
                left, right = np.array([cells[before] if before >= 0 else -1, cells[at]]), np.array([cells[at], cells[after] if after < n else -1])
                found = self.pairs.find(left, right)
                rank[at] = found[1]
                if before >= 0:
                    rank[before] = found[0]
                for k in {b, gone // BLOCK, max(before, 0) // BLOCK}:
                    least[k] = blocks[k].min()
            cells = cells[cells >= 0]

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """ids of each piece."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        classes: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[k] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[k] = self._long(p)
            elif p:
                classes.setdefault(-(-len(p) // 4) if len(p) <= 32 else 32 + len(p).bit_length(), []).append(k)
        for rows in classes.values():
            step = max(1, CELLS // max(len(pieces[k]) for k in rows))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for k, ids in zip(part, self._matrix([pieces[k] for k in part])):
                    out[k] = ids
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in order, and the number of each text's."""
        split = [self.split(t) for t in texts]
        memo = self.memo
        new = list(dict.fromkeys(p for p in chain.from_iterable(split) if p not in memo))
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(dict.fromkeys(chain.from_iterable(split)))
        memo.update(zip(new, self.merge([p.encode("utf-8") for p in new])))
        found = [memo[p] for p in chain.from_iterable(split)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends, bounds = np.r_[0, np.cumsum(sizes)], np.cumsum([0, *map(len, split)])
        return np.concatenate(found) if found else np.empty(0, np.int32), ends[bounds[1:]] - ends[bounds[:-1]]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences in order, and the number of each one's."""
        size = self.size[ids]
        ends = np.r_[0, np.cumsum(size)]
        out = self.bytes[np.arange(ends[-1]) + np.repeat(self.start[ids] - ends[:-1], size)]
        bounds = np.r_[0, np.cumsum(lengths)]
        return out, ends[bounds[1:]] - ends[bounds[:-1]]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> ByteBpe:
    """One per Python worker, file and pattern."""
    return ByteBpe(path, pattern)


def splitting_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def with_column(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """``schema`` with one field more; names that differ in case only stay apart, as columns go by position."""
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def encoded(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with the ids of ``text`` in a further column."""
    kept = list(docs.columns if keep is None else keep)
    own = fresh(docs.columns, "text")
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(own))
    ids = free(source.columns, ids)

    def run(batches):
        code = codec(vocabulary, pattern)
        for batch in batches:
            for part in slices(batch, own):
                flat, lengths = code.encode(part.column(part.num_columns - 1).to_pylist())
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], [*part.schema.names[:-1], ids])

    return source.mapInArrow(run, with_column(docs.select(*kept).schema, ids, T.ArrayType(T.IntegerType())))


def decoded(rows: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``rows`` with the bytes that ``ids`` stand for in a further column."""
    at = rows.columns.index(ids)
    to = free(rows.columns, to)

    def run(batches):
        code = codec(vocabulary, pattern)
        for batch in batches:
            lists = batch.column(at)
            flat = lists.flatten().cast(pa.int32())
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            if flat.null_count:
                kept = np.asarray(flat.is_valid())
                lengths = np.diff(np.r_[0, np.cumsum(kept)][np.r_[0, np.cumsum(lengths)]])
                flat = flat.drop_null()
            out, sizes = code.decode(np.asarray(flat), lengths)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, binary], [*batch.schema.names, to])

    return rows.mapInArrow(run, with_column(rows.schema, to, T.BinaryType()))


def op11_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """ids of all documents by ``byte_bpe_multi_50k.tiktoken``, and the bytes that the ids give back."""
    where, pattern = vocabulary_path(VOCABULARY), splitting_pattern()
    rows = decoded(encoded(load(spark, sf_dir, "documents"), where, pattern, keep=["doc_id"]), where, pattern)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
