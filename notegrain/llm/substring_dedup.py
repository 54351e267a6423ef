"""Exact substring dedup over words, by difference-cover anchors.

A window of ``window`` words that occurs in two documents at word positions i and j need not start
at multiples of anything, but with a difference cover D modulo ``period`` there is a shift below
``period`` that brings *both* positions onto the cover.  So hashing the ``window - period + 1`` words
at cover positions only (5 of 21 positions here) is enough: every equal pair of windows shares an
aligned anchor.  Trip 1 finds anchors that two documents share; trip 2 extends them: every window
around a shared anchor is hashed in full (128 bits) and asks whether a smaller document has it.

Defined results: null or empty text has no words; a null ``doc_id`` is never smaller nor larger than
another, so its row is kept whole and removes nothing; rows with equal ``doc_id`` don't remove each
other's words; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B, text as T

RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def difference_cover(period: int) -> tuple[int, ...]:
    """Residues so that any two positions reach the cover with one common shift below period."""
    k = 1
    while k * (k - 1) + 1 < period:
        k += 1
    if k * (k - 1) + 1 == period and period <= 31:  # a perfect difference set may exist
        for rest in combinations(range(2, period), max(0, k - 2)):
            d = (0, 1, *rest)[:k]
            if len({(a - b) % period for a in d for b in d}) == period:
                return d
    r = int(np.ceil(np.sqrt(period)))
    return tuple(sorted({*range(r), *(i % period for i in range(r, period + r, r))}))


class _Block:
    """The words of a block's documents and their anchors."""

    def __init__(self, docs: pa.Table, window: int, period: int):
        self.window, self.period = window, period
        ids = docs["doc_id"].combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        self.ids, self.null = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null())
        self.buf, offsets = T.texts(docs["text"])
        self.starts, self.ends, self.words = T.word_spans(self.buf, offsets)
        self.n = np.diff(self.words)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.number, self.distinct = T.numbered(self.buf, self.starts, self.ends)
        self.codes = self.coded(0)
        able = (self.n >= window) & ~self.null  # documents with windows
        self.last = np.where(able, self.words[1:] - window, -1)  # last window start by document
        q = window - period + 1
        residues = np.zeros(period, bool)
        residues[list(difference_cover(period))] = True
        at = np.arange(len(self.doc))
        rank = at - self.words[self.doc]
        self.at = at[able[self.doc] & residues[rank % period] & (rank + q <= self.n[self.doc])]  # anchors
        h = T.mix(T.windows(self.codes, q)[self.at])
        self.order, self.begin = T.classes(h)
        self.keys = h[self.order[self.begin]] if len(h) else h
        size = np.diff(np.append(self.begin, len(h)))
        self.key_of = np.zeros(len(h), np.int64)
        self.key_of[self.order] = np.repeat(np.arange(len(self.begin)), size)
        d = self.ids[self.doc[self.at]][self.order]
        self.many = (np.minimum.reduceat(d, self.begin) != np.maximum.reduceat(d, self.begin)).astype(np.uint8) if len(h) else np.zeros(0, np.uint8)

    def coded(self, salt: int) -> np.ndarray:
        """The code of each word, found once for each distinct one."""
        buf, at = T.texts(self.distinct)
        return T.word_codes(buf, at[:-1], at[1:], salt)[self.number]

    def candidates(self, shared: np.ndarray) -> None:
        """Windows around shared anchors, grouped by their full hash; smallest document of each group."""
        at = self.at[shared[self.key_of].astype(bool)] if len(self.at) else self.at
        doc = self.doc[at]
        low = np.maximum(self.words[doc], at - self.period + 1)
        high = np.minimum(self.last[doc], at)
        ok = high >= low
        self.at2 = np.flatnonzero(T.cover(len(self.doc), low[ok], (high - low + 1)[ok]))
        h1 = T.mix(T.windows(self.codes, self.window)[self.at2], 1)
        # the second 64 bits come from other random numbers for the words' bytes and other steps
        h2 = T.mix(T.windows(self.coded(7), self.window, 7)[self.at2], 2)
        self.order2, self.begin2 = T.classes(h1, h2)
        self.key1, self.key2 = h1[self.order2[self.begin2]], h2[self.order2[self.begin2]]
        self.d2 = self.ids[self.doc[self.at2]]
        self.least = np.minimum.reduceat(self.d2[self.order2], self.begin2) if len(self.at2) else np.zeros(0, np.int64)

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Which words a removed window covers. smaller: whether another block has a smaller document, by group."""
        if not len(self.at2):
            return np.zeros(len(self.doc), bool)
        size = np.diff(np.append(self.begin2, len(self.at2)))
        gone = np.zeros(len(self.at2), bool)
        gone[self.order2] = np.repeat(smaller.astype(bool), size) | (self.d2[self.order2] > np.repeat(self.least, size))
        return T.cover(len(self.doc), self.at2[gone], self.window)

    def kept(self, removed: np.ndarray) -> list[bytes]:
        """The kept words of each document, joined by one space."""
        word = np.flatnonzero(~removed)
        return T.joined(self.buf, self.starts[word], self.ends[word], self.doc[word], len(self.n))


def substring_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 50, period: int = 21, keep_text: bool = True, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Remove words covered by a window that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept_text.
    """
    if not 1 <= period <= window:
        raise ValueError("period must lie between 1 and window")
    n = B.block_count(docs, text, block_bytes)
    m = B.bucket_count(n)
    rows = B.in_blocks(docs, doc_id, text, n)

    def first(block: int, table: pa.Table) -> pa.Table:
        b = _Block(table, window, period)
        return B.ask(b.keys, m, block, 1, lambda s: b.keys[s].astype(np.uint32).tobytes() + np.packbits(b.many[s]).tobytes())

    def shared(datas: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        keys = [np.frombuffer(x, np.uint32, k) for x, k in zip(datas, sizes, strict=True)]
        many = [np.unpackbits(np.frombuffer(x, np.uint8, offset=4 * k), count=k) for x, k in zip(datas, sizes, strict=True)]
        order, begin = T.classes(np.concatenate(keys))
        size = np.diff(np.append(begin, len(order)))
        yes = np.zeros(len(order), np.uint8)
        yes[order] = np.repeat((size > 1) | (np.maximum.reduceat(np.concatenate(many)[order], begin) > 0), size)
        return np.split(yes, np.cumsum(sizes)[:-1])

    def second(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(table, window, period)
        b.candidates(B.answered(answers, 1))
        return B.ask(b.key1, m, block, 2, lambda s: b.key1[s].tobytes() + b.key2[s].tobytes() + b.least[s].tobytes())

    def smaller(datas: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        parts = [np.frombuffer(x, np.uint64, 3 * k).reshape(3, k) for x, k in zip(datas, sizes, strict=True)]
        k1, k2, d = np.concatenate(parts, axis=1)
        d = d.view(np.int64)
        order, begin = T.classes(k1, k2)
        least = np.repeat(np.minimum.reduceat(d[order], begin), np.diff(np.append(begin, len(order))))
        yes = np.zeros(len(order), np.uint8)
        yes[order] = least < d[order]
        return np.split(yes, np.cumsum(sizes)[:-1])

    def result(block: int, table: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(table, window, period)
        b.candidates(B.answered(answers, 1))
        removed = b.removed(B.answered(answers, 2))
        kept = b.kept(removed)
        gone = np.bincount(b.doc[removed], minlength=len(b.n))
        columns = [table["doc_id"].combine_chunks(), pa.array(b.n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        schema = _RESULT if keep_text else _RESULT.remove(4)
        return pa.Table.from_arrays(columns + ([pa.array(kept, pa.binary()).cast(pa.string())] if keep_text else []), schema=schema)

    one = B.trip(B.asks(rows, first), shared, 1)
    two = B.trip(B.asks(rows, second, one), smaller, 2)
    return B.finish(rows, result, one.unionByName(two), RESULT + ", kept_text string" * keep_text)
