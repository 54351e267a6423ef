"""Vectorised text primitives shared by the operators (numpy over Arrow buffers).

A batch of texts is one ``uint8`` buffer with document offsets.  No hash here is a polynomial modulo 2**64, whose
collisions can be written down (Thue-Morse words).  A word's code is the sum of one random 64-bit number for each of
its bytes *and places*, so two different words meet by chance alone; wider windows join the hashes of their halves by
steps that are bijective in either half and linear in neither.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: White space of the word definition ``[^\x20\x09-\x0D]+``.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_PLACES = 64  # places in a word whose numbers are drawn beforehand
_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**k`` and ``base**-k`` modulo 2**64 for k < n (kept, grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 2**64)
        out = []
        for b in (base, inverse):
            a = np.full(size, b, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _powers[base] = have = (out[0], out[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a polynomial hash are usable."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of ``codes[k] * B**k``; one longer than the input. For slices of a few codes only."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], dtype=np.uint64, out=out[1:])
    return out


def slice_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the short slices [start, end), from the prefix sums of ``prefix``."""
    inverse = powers(len(p))[1]
    return (p[end] - p[start]) * inverse[start]


def join(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """One hash for each pair of hashes: a bijection in either, linear in neither."""
    x = a * np.uint64(((2 * salt + 1) * 0xD6E8FEB86659FD93) % 2**64)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def windows(codes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of all ``width`` consecutive codes, by doubling; the last two halves may overlap."""
    if len(codes) < width:
        return np.zeros(0, np.uint64)
    h, have = codes, 1
    while 2 * have <= width:
        h = join(h[: len(h) - have], h[have:], salt)
        have *= 2
    rest = width - have
    return join(h[: len(h) - rest], h[rest:], salt + 1) if rest else h


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, first byte highest; zeros beyond the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray(len(buf), ">u8", padded.data, strides=(1,)).astype(np.uint64)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.cast(pa.large_binary()).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    else:
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and word offsets by document."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]  # a word never crosses documents
    first[edge] = solid[edge]
    edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edge] = solid[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes unchanged."""
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit code for each word; codes of different salts are independent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if salt not in _tables:
        _tables[salt] = np.random.default_rng([20240229, salt]).integers(0, 2**64, _PLACES * 256, dtype=np.uint64)
    n = ends - starts
    begin = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(begin, n)
    at = (place << 8) | buf[ragged(starts, n)]
    code = _tables[salt][np.minimum(at, _PLACES * 256 - 1)]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        code[far] = mix(mix(at[far].astype(np.uint64), salt), salt + 77)
    return mix(np.add.reduceat(code, begin), salt)


def slices(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The slices as an Arrow array."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(buf[ragged(starts, n)])])


def numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """A number for each slice, equal where the bytes are, and the distinct slices by number. No hash decides."""
    found = slices(buf, starts, ends).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def release() -> None:
    """Give memory that is free back to the machine: a worker that waits shouldn't hold what its largest batch took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that gives memory back at its task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, documents: int) -> list[bytes]:
    """The given words of each document, joined by one space."""
    final = np.ones(len(doc), bool)
    final[:-1] = doc[1:] != doc[:-1]
    mark = np.zeros(len(buf) + 1, np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    keep = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    out, gap = buf.copy(), ends[~final]  # a later word follows, so white space does
    out[gap] = 32
    keep[gap] = True
    size = np.zeros(documents + 1, np.int64)
    np.add.at(size, doc + 1, ends - starts + ~final)
    cut, flat = np.cumsum(size), out[keep].tobytes()
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of many slices, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    keep = lengths > 0
    first, s, n = begin[keep], starts[keep], lengths[keep]
    out[first[0]] = s[0]
    out[first[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows by the keys (first key first), and where each group begins."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    if not len(order):
        return order, np.zeros(0, np.int64)
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def classes(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As groups, where the order within a group doesn't matter: one quick sort by the first key, unless rows agree in it alone."""
    order = np.argsort(keys[0])
    if not len(order):
        return order, np.zeros(0, np.int64)
    first = keys[0][order]
    new = np.ones(len(order), bool)
    new[1:] = first[1:] != first[:-1]
    for k in keys[1:]:
        other = k[order]
        if (~new[1:] & (other[1:] != other[:-1])).any():
            return groups(*keys)
    return order, np.flatnonzero(new)


def cover(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in one of the slices."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(d[:-1]) > 0
