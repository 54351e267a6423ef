"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket for each merge rank; a bucket holds positions of a linked list of tokens,
and a bitmap of three levels of 64-bit words says which buckets hold any, so the next rank is three
find-first-set steps away however long the text is.  Entries aren't deleted when a neighbour merges:
a popped position counts only if the pair there still has the bucket's rank.

``encode_piece`` runs the queue over one pre-token.  ``Encoder.encode_batch`` runs one queue over the linked
lists of all distinct pre-tokens of a batch at once: a popped bucket is merged everywhere in a few
numpy operations.  Equal ranks that overlap are taken from the left.  Merging one rank in several places at once
is only the same as one by one if no merge creates a lower rank; pre-tokens where that happens are
encoded again, alone.

Defined results: null text is the empty text, with no ids; every text decodes to its own bytes; other columns are ignored,
whatever their names, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import text as T

NONE = np.iinfo(np.int32).max


class RankQueue:
    """Buckets of positions by rank, with find-first-set over three bitmap levels."""

    def __init__(self, ranks: int):
        n0 = -(-ranks // 64)
        n1 = -(-n0 // 64)
        self.level0, self.level1, self.level2 = [0] * n0, [0] * n1, [0] * -(-n1 // 64)
        self.bucket: dict[int, list] = {}

    def push(self, rank: int, item) -> None:
        have = self.bucket.get(rank)
        if have is not None:
            have.append(item)
            return
        self.bucket[rank] = [item]
        a, b, c = rank >> 6, rank >> 12, rank >> 18
        self.level0[a] |= 1 << (rank & 63)
        self.level1[b] |= 1 << (a & 63)
        self.level2[c] |= 1 << (b & 63)

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank and all that was pushed under it."""
        for c, word in enumerate(self.level2):
            if word:
                b = c << 6 | (word & -word).bit_length() - 1
                word = self.level1[b]
                a = b << 6 | (word & -word).bit_length() - 1
                word = self.level0[a]
                rank = a << 6 | (word & -word).bit_length() - 1
                self.level0[a] &= self.level0[a] - 1
                if not self.level0[a]:
                    self.level1[b] &= self.level1[b] - 1
                    if not self.level1[b]:
                        self.level2[c] &= self.level2[c] - 1
                return rank, self.bucket.pop(rank)
        return None


class Encoder:
    """Ranks of a tiktoken file, and the pair table that the merges use."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # \s as Unicode's White_Space: some libraries add the separators U+001C to U+001F
        self.pattern = regex.compile(pattern)
        self.size = max(self.ranks.values()) + 1
        self.tokens = [b""] * self.size
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(self.ranks[t[:k]], self.ranks[t[k:]]): r for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.pairs = pairs
        key = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.token_start, self.token_length = np.cumsum(lengths) - lengths, lengths
        self.token_bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token, by the queue alone."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        token, after, before = [int(self.byte[b]) for b in piece], [*range(1, n), -1], [*range(-1, n - 1)]
        pairs, queue, rank = self.pairs, RankQueue(self.size), [NONE] * n

        def see(i: int) -> None:
            rank[i] = pairs.get((token[i], token[after[i]]), NONE) if after[i] >= 0 else NONE
            if rank[i] != NONE:
                queue.push(rank[i], i)

        for i in range(n):
            see(i)
        while got := queue.pop():
            r, places = got
            places.sort()
            for k, i in enumerate(places):
                if token[i] < 0 or rank[i] != r:
                    continue  # stale
                j = after[i]
                token[i], token[j], after[i] = r, -1, after[j]
                if after[i] >= 0:
                    before[after[i]] = i
                see(i)
                if before[i] >= 0:
                    see(before[i])
                if rank[i] < r or before[i] >= 0 and rank[before[i]] < r:
                    for rest in places[k + 1 :]:  # a lower rank goes first
                        queue.push(r, rest)
                    break
        return [t for t in token if t >= 0]

    def encode_batch(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens, one after the other, and how many each has."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        todo = np.flatnonzero(whole < 0)
        lengths = np.array([len(pieces[k]) for k in todo], np.int64)
        flat = np.frombuffer(b"".join([pieces[k] for k in todo]), np.uint8)
        n = len(flat)
        token = self.byte[flat].copy()
        owner = np.repeat(np.arange(len(todo)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        begin = (np.cumsum(lengths) - lengths)[lengths > 0]
        after[begin[1:] - 1], before[begin] = -1, -1
        if n:
            after[-1] = -1
        rank = np.full(n, NONE, np.int32)
        queue, again = RankQueue(self.size), np.zeros(len(todo), bool)

        def push(places: np.ndarray, ranks: np.ndarray) -> None:
            if len(places) == 1:
                if ranks[0] != NONE:
                    queue.push(int(ranks[0]), places)
                return
            order = np.argsort(ranks, kind="stable")
            order = order[: np.searchsorted(ranks[order], NONE)]
            if len(order):
                places, ranks = places[order], ranks[order]
                cut = np.concatenate([[0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, [len(ranks)]])
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    queue.push(int(ranks[a]), places[a:b])

        first = np.flatnonzero(after >= 0)
        rank[first] = self.rank_of(token[first], token[after[first]])
        push(first, rank[first])
        while got := queue.pop():
            r, chunks = got
            at = np.concatenate(chunks) if len(chunks) > 1 else chunks[0]
            at = at[rank[at] == r]  # the others are stale
            if len(at) > 1:
                at = np.sort(at)
                if len(chunks) > 1:
                    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if not len(at):
                continue
            if len(at) > 1:
                linked = after[at[:-1]] == at[1:]  # overlaps the one before
                if linked.any():
                    k = np.arange(len(at))
                    fresh = np.concatenate([[True], ~linked])
                    at = at[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
            j = after[at]
            far = after[j]
            token[at], token[j], rank[j], after[at] = r, -1, NONE, far
            before[far[far >= 0]] = at[far >= 0]
            near = before[at]
            see = np.concatenate([at, near[near >= 0]])
            if len(at) > 1:
                see.sort()
                see = see[np.concatenate([[True], see[1:] != see[:-1]])]
            right = after[see]
            ok = right >= 0
            found = np.full(len(see), NONE, np.int32)
            found[ok] = self.rank_of(token[see[ok]], token[right[ok]])
            rank[see] = found
            if len(at) > 1 and (found < r).any():
                many = np.bincount(owner[at], minlength=1)
                low = owner[see[found < r]]
                again[low[many[low] > 1]] = True
            push(see, found)
        alive = token >= 0
        count = np.bincount(owner[alive], minlength=len(todo)) if n else np.zeros(len(todo), np.int64)
        sizes = np.ones(len(pieces), np.int64)
        sizes[todo] = count
        parts, ids = token[alive], np.empty(int(sizes.sum()), np.int64)
        start = np.cumsum(sizes) - sizes
        ids[start[whole >= 0]] = whole[whole >= 0]
        ids[T.ragged(start[todo], count)] = parts
        if again.any():
            split = np.split(ids, start[1:])
            for k in todo[again]:
                split[k] = np.array(self.encode_piece(pieces[k]), np.int64)
            sizes, ids = np.array([len(x) for x in split]), np.concatenate(split)
        return ids, sizes

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        ids = np.asarray(ids, np.int64)
        return self.token_bytes[T.ragged(self.token_start[ids], self.token_length[ids])]


class _Index(dict):
    """Numbers new keys as they are looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


#: Last bytes of white space beyond ASCII, in UTF-8: fixed values of Unicode's White_Space.
_WIDE_SPACE = {(0xC2, None), (0xE1, 0x9A), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)}


def _chunk_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut without changing their pre-tokens.

    That is before a space that follows no white space: no pre-token holds a space after another kind of
    character. What might end in white space beyond ASCII isn't cut.
    """
    space = buf == 32
    solid = np.ones(len(buf), bool)
    solid[(buf <= 32) | ((buf >= 127) & (buf < 128))] = False
    cut = np.zeros(len(buf), bool)
    cut[1:] = space[1:] & solid[:-1]
    high = np.flatnonzero(cut[3:] & (buf[2:-1] >= 128)) + 3
    two, three = buf[high - 2], buf[high - 3]
    doubt = np.zeros(len(high), bool)
    for lead, second in _WIDE_SPACE:
        doubt |= (two == lead) if second is None else (three == lead) & (two == second)
    cut[high[doubt & ((buf[high - 1] == 0x85) | (buf[high - 1] == 0xA0) | (two != 0xC2))]] = False
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


class Batch:
    """The ids of many texts: each distinct chunk is split and each distinct pre-token encoded once."""

    def __init__(self, encoder: Encoder, buf: np.ndarray, offsets: np.ndarray):
        start = _chunk_starts(buf, offsets)
        end = np.append(start[1:], len(buf)) if len(start) else start
        number, distinct = T.numbered(buf, start, end)
        self.chunk = number.astype(np.int32)  # the number of each chunk
        self.cut = np.searchsorted(start, offsets)
        index, find = _Index(), encoder.pattern.findall
        pieces = [find(x.decode()) for x in distinct.to_pylist()]
        del number, distinct
        piece = np.fromiter(map(index.__getitem__, chain.from_iterable(pieces)), np.int64)
        ids, sizes = encoder.encode_batch([p.encode() for p in index])
        own = np.cumsum(sizes) - sizes
        self.ids = ids[T.ragged(own[piece], sizes[piece])].astype(np.int32)
        per = np.concatenate([[0], np.cumsum(sizes[piece])])
        at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        self.start, self.size = per[at[:-1]], np.diff(per[at])

    def ids_of(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts first to last - 1, one after the other, and how many each has."""
        seen = self.chunk[self.cut[first] : self.cut[last]]
        sizes = self.size[seen]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[T.ragged(self.start[seen], sizes)], np.diff(ends[self.cut[first : last + 1] - self.cut[first]])


def encode_texts(encoder: Encoder, texts: list[str]) -> list[list[int]]:
    """Ids of each text."""
    buf, offsets = T.texts(pa.array(texts, pa.string()))
    ids, count = Batch(encoder, buf, offsets).ids_of(0, len(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] if len(texts) else []


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``most`` bytes of text, and one row at least."""
    rows, size = [], 0
    for batch in batches:
        lengths = np.diff(T.texts(batch["text"])[1])
        at = 0
        for k, n in enumerate(lengths.tolist()):
            size += n
            if size >= most:
                rows.append(batch.slice(at, k + 1 - at))
                yield pa.Table.from_batches(rows)
                rows, size, at = [], 0, k + 1
        if at < batch.num_rows:
            rows.append(batch.slice(at))
    if rows:
        yield pa.Table.from_batches(rows)


def bpe_encode(docs: DataFrame, path: Callable[[], str], pattern: str, *, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True, batch_bytes: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids. path() gives the vocabulary's place on any machine."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path(), pattern)
        for table in _pieces(batches, batch_bytes):
            buf, offsets = T.texts(table["text"])
            batch, doc_ids = Batch(e, buf, offsets), table["doc_id"].combine_chunks()
            group = offsets[1:] // 2_000_000  # so many bytes are laid out as ids at once
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ids, count = batch.ids_of(a, b)
                back = e.decode(ids)
                if not np.array_equal(back, buf[offsets[a] : offsets[b]]):
                    raise ValueError("the ids of a text decode to another text")
                yield rows(e, doc_ids.slice(a, b - a), ids, count, back)

    def rows(e: Encoder, doc_ids: pa.Array, ids: np.ndarray, count: np.ndarray, back: np.ndarray) -> pa.RecordBatch:
        cut = np.concatenate([[0], np.cumsum(count)])
        size = np.concatenate([[0], np.cumsum(e.token_length[ids])])[cut].tolist()
        raw, back = ids.astype("<u4").tobytes(), back.tobytes()
        at = (4 * cut).tolist()
        columns = [
            doc_ids,
            pa.array(count, pa.int64()),
            pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
            pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(size[:-1], size[1:], strict=True)], pa.string()),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(T.released(encode), schema)


def bpe_decode(encoded: DataFrame, path: Callable[[], str], pattern: str, *, ids: str = "ids") -> DataFrame:
    """doc_id and text, from the ids (null ids: null text)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path(), pattern)
        for batch in batches:
            found = [None if x is None else e.decode(x).tobytes().decode() for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.selectExpr("doc_id", f"`{ids}` ids").mapInArrow(decode, "doc_id bigint, text string")
