"""Tokenizers of the public vocabulary files, with a bounded memo of white-space separated chunks.

Both vocabularies split their input into words before merging bytes, so the ids of a text are those of its
chunks in order.  A chunk the memo lacks is encoded by the library; the memo only saves repeated work and
stops growing at ``MEMO`` entries, so memory is bounded and results never depend on it.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MEMO = 700_000  # chunks kept by one Python worker
_TROUBLE = re.compile(r" \s")
_TAILED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")  # letters, then ASCII punctuation: two words for either vocabulary


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunked:
    """ids of texts by one ``tokenizers`` JSON file, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_word = "Lowercase" in str(self.tok.normalizer)  # white space is dropped, words stand alone
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.at: dict[str, int] = {}  # chunk -> row of the tables below
        self.n = np.zeros(1024, np.int32)
        self.start = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)
        self.hits = np.zeros(1024, np.int32)
        self.rows = self.used = 0

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def _split(self, word: str) -> tuple[str, str] | None:
        """Two chunks whose ids make those of ``word``, if it is letters and punctuation."""
        if not (m := _TAILED.fullmatch(word)):
            return None
        base, tail = m.groups()
        if self.by_word and base.isascii():
            base = base.lower()
        elif self.by_word:
            low = base.lower()
            if not low.isalpha():
                return None  # a letter that becomes a letter and a mark, which joins what follows
            base = low if max(base) < "\u0250" else base
        return None if base == word else (base, tail)

    def _store(self, words: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        r, total = self.rows + len(words), len(ids)
        while r > len(self.n):
            self.n, self.start, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.n, self.start, self.hits))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.n[self.rows : r] = lens
        self.start[self.rows : r] = self.used + np.cumsum(lens) - lens
        self.flat[self.used : self.used + total] = ids
        self.hits[self.rows : r] = 0
        self.at.update(zip(words, range(self.rows, r)))
        self.rows, self.used = r, self.used + total

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.n[rows]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total, dtype=np.int64) + np.repeat(self.start[rows] - (ends - n), n)], n

    def _add(self, words: list[str]) -> None:
        """Put the ids of ``words`` into the tables."""
        halves = [self._split(w) for w in words]
        tail = lambda t: t if self.by_word else "\0" + t  # noqa: E731  no blank stands before a tail
        whole = [w for w, h in zip(words, halves) if h is None]
        need = chain.from_iterable((h[0], tail(h[1])) for h in halves if h)
        todo = [w for w in dict.fromkeys(chain(whole, need)) if w not in self.at]
        for k in range(0, len(todo), 20_000):
            part = todo[k : k + 20_000]
            ids = self._encode(part if self.by_word else [w[1:] if w[:1] == "\0" else " " + w for w in part])
            lens = np.fromiter(map(len, ids), np.int32, len(ids))
            self._store(part, lens, np.fromiter(chain.from_iterable(ids), np.int32, int(lens.sum())))
        if both := [(w, h) for w, h in zip(words, halves) if h]:
            rows = np.fromiter((self.at[x] for _, (base, t) in both for x in (base, tail(t))), np.int64, 2 * len(both))
            ids, n = self._gather(rows)
            self._store([w for w, _ in both], n.reshape(-1, 2).sum(1), ids)

    def _forget(self) -> None:
        """Keep only the chunks met twice or more since the last time."""
        keep = np.flatnonzero(self.hits[: self.rows] >= 2)
        if keep.size > MEMO // 2:
            keep = keep[np.argsort(-self.hits[keep], kind="stable")[: MEMO // 2]]
        words = list(self.at)
        words = [words[i] for i in keep]
        ids, n = self._gather(keep)
        self.at.clear()
        self.rows = self.used = 0
        self._store(words, n, ids)

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all chunks of all texts, and the number of chunks of each text."""
        if self.rows > MEMO:
            self._forget()
        pieces = [t.replace("\n", " ").split(" ") if self.by_word else t.split(" ") for t in texts]
        counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
        words = list(chain.from_iterable(pieces))
        rows = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if (missing := np.flatnonzero(rows < 0)).size:
            self._add(list(dict.fromkeys([words[i] for i in missing])))
            rows[missing] = np.fromiter((self.at[words[i]] for i in missing), np.int64, missing.size)
        self.hits += np.bincount(rows, minlength=len(self.hits)).astype(np.int32)
        return rows, counts

    def _plain(self, texts: list[str]) -> np.ndarray:
        """Byte-level texts whose chunks can't be told apart safely: the library gets them whole."""
        return np.fromiter((_TROUBLE.search(t) is not None or any(s in t for s in self.special) for t in texts), bool, len(texts))

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        if self.by_word:
            rows, chunks = self._rows(texts)
            return _sums(self.n[rows], chunks)
        whole = self._plain(texts)
        # the first chunk has no blank before it, so it isn't in the tables
        split = [t if not w else "" for t, w in zip(texts, whole)]
        cut = [t.partition(" ") for t in split]
        out = _sums_of_rest(self, cut)
        heads = list(dict.fromkeys(c[0] for c in cut))
        head = dict(zip(heads, map(len, self._encode(heads))))
        out += np.fromiter((head[c[0]] for c in cut), np.int64, len(cut))
        if whole.any():
            out[whole] = [len(i) for i in self._encode([t for t, w in zip(texts, whole) if w])]
        return out

    def ids(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of each text's; ``end`` is appended to every text.  Word vocabularies only."""
        if not self.by_word:
            lists = self._encode(texts)
            lists = [i + [end] for i in lists] if end is not None else lists
            lens = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter(chain.from_iterable(lists), np.uint32, int(lens.sum())), lens
        rows, chunks = self._rows(texts)
        flat, n = self._gather(rows)
        flat, lens = flat.astype(np.uint32), _sums(n, chunks)
        if end is not None:
            flat = np.insert(flat, np.cumsum(lens), end).astype(np.uint32)
            lens = lens + 1
        return flat, lens


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.r_[0, np.cumsum(values, dtype=np.int64)]
    bounds = np.r_[0, np.cumsum(counts)]
    return ends[bounds[1:]] - ends[bounds[:-1]]


def _sums_of_rest(coder: Chunked, cut: list[tuple[str, str, str]]) -> np.ndarray:
    has = [bool(c[1]) for c in cut]
    out = np.zeros(len(cut), np.int64)
    if any(has):
        rows, chunks = coder._rows([c[2] for c, h in zip(cut, has) if h])
        out[np.array(has)] = _sums(coder.n[rows], chunks)
    return out


@lru_cache(maxsize=4)
def coder(path: str) -> Chunked:
    """One per Python worker and file."""
    return Chunked(path)
