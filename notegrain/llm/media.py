"""Media columns: payloads kept as baseline JPEG, read back by their DC coefficients.

The decoder parses markers, Huffman-decodes the scan and rebuilds a luminance thumbnail with one
pixel for each 8 x 8 block from the DC coefficients alone; AC coefficients are skipped over.  All
restart segments of a batch are decoded in lockstep: step k reads the k-th block of every segment in a few
numpy operations.  The encoder writes one block for each payload byte, with a DC quantiser of 8,
so that the thumbnail pixel of a block is exactly its byte, and a restart marker after each row of 192.

Defined results: null text is the empty payload (all padding); a payload beyond one frame (65,528
lines) goes on in further frames of the same value; bytes that aren't a baseline JPEG give null
dimensions and thumbnail; other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

ROW = 192  # blocks of a row, which is a restart interval
FRAME_ROWS = 65_535 // 8

# Huffman tables of the encoder, fixed values: counts of codes by length 1 to 16, symbols by code.
_DC_COUNTS, _DC_SYMBOLS = (0, 2, 1, 2, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0), (6, 7, 5, 0, 4, 3, 2, 1, 8)
_AC_COUNTS, _AC_SYMBOLS = (1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0,)


def _codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """By the next 16 bits: length of the code * 256 + symbol; 0 if no code fits."""
    table = np.zeros(65_536, np.int64)
    for symbol, (code, length) in _codes(counts, symbols).items():
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
        + _segment(0xC0, b"\x08" + (8 * rows).to_bytes(2, "big") + (8 * ROW).to_bytes(2, "big") + b"\1\1\x11\0")
        + _segment(0xC4, b"\0" + bytes(_DC_COUNTS) + bytes(_DC_SYMBOLS))
        + _segment(0xC4, b"\x10" + bytes(_AC_COUNTS) + bytes(_AC_SYMBOLS))
        + _segment(0xDD, ROW.to_bytes(2, "big"))
        + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )


def pad(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads: each text with bytes 32 up to a positive multiple of 192."""
    n = np.diff(offsets)
    size = np.maximum(1, -(-n // ROW)) * ROW
    cut = np.concatenate([[0], np.cumsum(size)])
    out = np.full(cut[-1], 32, np.uint8)
    out[T.ragged(cut[:-1], n)] = buf
    return out, cut


def encode(payload: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """One JPEG stream for each payload (of whole rows)."""
    rows = payload.reshape(-1, ROW).astype(np.int32) - 128
    diff = np.diff(rows, axis=1, prepend=0)
    size = np.frexp(np.abs(diff).astype(np.float32))[1].astype(np.int32)  # bits of the magnitude
    table = _codes(_DC_COUNTS, _DC_SYMBOLS)
    code, length = np.array([table[k] for k in range(9)], np.int32).T
    bits = np.where(diff < 0, diff + (1 << size) - 1, diff)
    word = (code[size] << size | bits) << 1  # the code, the difference, and 0: end of block
    width = length[size] + size + 1
    end = np.cumsum(width, axis=1)
    begin = end - width
    n = -(-end[:, -1] // 8)
    most = int(n.max(initial=0)) + 4
    out = np.zeros((len(rows), most), np.uint8)
    flat, base = out.ravel(), np.arange(len(rows)) * most
    for k in range(ROW):
        at = base + (begin[:, k] >> 3)
        w = word[:, k] << (24 - (begin[:, k] & 7) - width[:, k])
        flat[at] |= (w >> 16).astype(np.uint8)
        flat[at + 1] |= (w >> 8 & 255).astype(np.uint8)
        flat[at + 2] |= (w & 255).astype(np.uint8)
    spare = 8 * n - end[:, -1]
    flat[base + n - 1] |= ((1 << spare) - 1).astype(np.uint8)  # filled up with ones
    data = out[np.arange(most) < n[:, None]]
    full = data == 255
    row = np.repeat(np.arange(len(rows)), n)
    stuffed = n + np.bincount(row[full], minlength=len(rows))  # 255 is followed by 0
    wide = np.zeros(len(data) + int(full.sum()), np.uint8)
    wide[np.arange(len(data)) + np.cumsum(full) - full] = data
    at = np.concatenate([[0], np.cumsum(stuffed)])
    files, raw = [], wide.tobytes()
    for a, b in zip((cut[:-1] // ROW).tolist(), (cut[1:] // ROW).tolist(), strict=True):
        parts = []
        for f in range(a, b, FRAME_ROWS):
            g = min(b, f + FRAME_ROWS)
            parts.append(_header(g - f))
            for r in range(f, g):
                parts.append(raw[at[r] : at[r + 1]])
                if r < g - 1:
                    parts.append(bytes([0xFF, 0xD0 + (r - f) % 8]))
            parts.append(b"\xff\xd9")
        files.append(b"".join(parts))
    return files


@dataclass
class Frame:
    """What the markers of one image say, and where its scan lies."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    begin: int = 0
    end: int = 0


def parse(data: bytes) -> list[Frame] | None:
    """The frames of a stream; None if it isn't baseline JPEG."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            return None
        frame, at = Frame(), at + 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                return None
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if len(body) != size - 2:
                return None
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    frame.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while len(body) >= 17:
                    n = sum(body[1:17])
                    frame.tables[body[0]] = body[1:17], body[17 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xC0:
                if len(body) < 6 or body[0] != 8:
                    return None
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                frame.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3) if k + 2 < len(body)]
            elif 0xC1 <= marker <= 0xCF and marker != 0xCC and marker != 0xC8:
                return None  # extended, progressive, lossless or arithmetic
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                frame.scan = [(body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
                break
        known = {c[0] for c in frame.components}
        if not (frame.width and frame.height and frame.components) or [s[0] for s in frame.scan] != [c[0] for c in frame.components] or len(known) != len(frame.components):
            return None  # one scan with all components is expected
        if any(t not in frame.tables or 16 + u not in frame.tables for _, t, u in frame.scan) or any(not c[1] or not c[2] or c[3] not in frame.quantisers for c in frame.components):
            return None
        frame.begin = at
        while True:  # up to a marker that isn't a restart
            at = data.find(b"\xff", at)
            if at < 0 or at + 1 >= len(data):
                return None
            if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7 or data[at + 1] == 0xFF:
                at += 2 if data[at + 1] != 0xFF else 1
                continue
            break
        if data[at + 1] != 0xD9:
            return None
        frame.end, at = at, at + 2
        frames.append(frame)
    return frames or None


def _scan_end(data: bytes, frame: Frame) -> tuple[np.ndarray, np.ndarray]:
    """The scan without stuffing and restart markers, and the bounds of its segments."""
    raw = np.frombuffer(data, np.uint8)[frame.begin : frame.end]
    mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)) if len(raw) > 1 else np.zeros(0, np.int64)
    drop = np.zeros(len(raw), bool)
    drop[1:] = (raw[1:] == 0) & (raw[:-1] == 255)
    drop[mark] = drop[mark + 1] = True
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return raw[~drop], np.concatenate([[0], kept[mark], [kept[-1]]])


def thumbnails(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]] | None]:
    """Width, height and the DC-only luminance thumbnail of each frame; None for what can't be decoded."""
    parsed = [parse(f) for f in files]
    alike = defaultdict(list)  # frames that can be decoded in lockstep
    for k, frames in enumerate(parsed):
        for i, f in enumerate(frames or ()):
            alike[tuple(c[1:3] for c in f.components), f.restart, tuple((f.tables[t], f.tables[16 + u]) for _, t, u in f.scan)].append((k, i))
    out: list = [None if p is None else [None] * len(p) for p in parsed]
    for (sampling, restart, tables), members in alike.items():
        dc = [_lookup(tuple(t[0][0]), tuple(t[0][1])) for t in tables]
        ac = [_lookup(tuple(t[1][0]), tuple(t[1][1])) for t in tables]
        alone = len(sampling) == 1
        hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
        pattern = [0] if alone else [c for c, (h, v) in enumerate(sampling) for _ in range(h * v)]
        streams, bounds, units, owners, base, bad = [], [], [], [], 0, set()
        grid = {}
        for k, i in members:
            f = parsed[k][i]
            data, cut = _scan_end(files[k], f)
            wide = -(-f.width // 8) if alone else -(-f.width // (8 * hmax))
            high = -(-f.height // 8) if alone else -(-f.height // (8 * vmax))
            grid[k, i] = wide, high
            n = np.full(len(cut) - 1, restart or wide * high)
            n[-1] = wide * high - int(n[:-1].sum())
            if n[-1] <= 0 or restart and n[-1] > restart or not restart and len(n) > 1:
                bad.add((k, i))
                n = np.minimum(np.maximum(n, 0), wide * high)
            streams.append(data)
            bounds.append(cut[:-1] + base)
            units.append(n)
            owners += [(k, i)] * len(n)
            base += len(data)
        data = np.concatenate([*streams, np.zeros(8, np.uint8)]).astype(np.int64)
        window = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        last = len(window) - 1
        position, count = np.concatenate(bounds) * 8, np.concatenate(units)
        luma = np.zeros((int(count.max()), sum(c == 0 for c in pattern), len(count)), np.int32)
        before = np.zeros((len(sampling), len(count)), np.int64)
        wrong = np.zeros(len(count), bool)
        order = np.argsort(-count, kind="stable")  # so that those still running are a prefix
        position, count = position[order], count[order]

        def peek(at: np.ndarray) -> np.ndarray:
            return window[np.minimum(at >> 3, last)] >> (8 - (at & 7)) & 0xFFFF

        for step in range(int(count.max())):
            live = int(np.searchsorted(-count, -step, "left"))
            at, y = position[:live], 0
            for c in pattern:
                got = dc[c][peek(at)]
                wrong[:live] |= got == 0
                at = at + (got >> 8)
                size = got & 255
                value = peek(at) >> (16 - np.minimum(size, 16))
                value = np.where(size > 0, np.where(value < 1 << np.maximum(size - 1, 0), value - (1 << size) + 1, value), 0)
                at = at + size
                before[c, :live] += value
                if c == 0:
                    luma[step, y, :live] = before[0, :live]
                    y += 1
                going, seen = np.arange(live), np.zeros(live, np.int64)
                while len(going):  # skip AC coefficients
                    got = ac[c][peek(at[going])]
                    wrong[going[got == 0]] = True
                    symbol = got & 255
                    at[going] += (got >> 8) + (symbol & 15)
                    seen[going] += (symbol >> 4) + 1
                    going = going[(got != 0) & ((symbol & 15 != 0) | (symbol == 0xF0)) & (seen[going] < 63)]
            position[:live] = at
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        first = defaultdict(list)
        for s, o in enumerate(owners):
            first[o].append(int(back[s]))
        for (k, i), segments in first.items():
            f = parsed[k][i]
            if (k, i) in bad or wrong[segments].any():
                out[k] = None
                continue
            values = np.concatenate([luma[: count[s], :, s] for s in segments]) if restart == 0 or len(segments) == 1 else luma[:, :, segments].transpose(2, 0, 1).reshape(-1, luma.shape[1])[: grid[k, i][0] * grid[k, i][1]]
            wide, high = grid[k, i]
            h, v = (1, 1) if alone else sampling[0]
            pixel = values.reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
            pixel = np.clip((pixel * f.quantisers[f.components[0][3]] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
            scale_h, scale_v = (1, 1) if alone else (hmax // h, vmax // v)
            if out[k] is not None:
                out[k][i] = f.width, f.height, pixel[: -(-f.height // (8 * scale_v)), : -(-f.width // (8 * scale_h))]
    return out


def average_hash(thumb: np.ndarray) -> int:
    """64 bits: which cells of an 8 x 8 grid are brighter than the thumbnail's mean."""
    h, w = thumb.shape
    y, x = np.arange(8) * h // 8, np.arange(8) * w // 8
    total = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), y, axis=0), x, axis=1)
    cells = np.maximum(1, np.diff(np.append(y, h)))[:, None] * np.maximum(1, np.diff(np.append(x, w)))[None]
    return int.from_bytes(np.packbits(total * thumb.size > cells * int(thumb.sum(dtype=np.int64))).tobytes(), "big")


def feature(frames: list[tuple[int, int, np.ndarray]]) -> str:
    """Dimensions and thumbnail hash of each frame."""
    return ",".join(f"{w}x{h}:{average_hash(t):016x}" for w, h, t in frames)


def _groups(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes, one row at least."""
    for batch in batches:
        size = np.cumsum(np.diff(T.texts(batch[column])[1]) + ROW) // most
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def media_columns(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep_media: bool = True, batch_bytes: int = 3_000_000) -> DataFrame:
    """Store each text as JPEG, read it back, and describe both.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature
    and, with keep_media, media.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, "text", batch_bytes):
            buf, offsets = T.texts(batch["text"])
            files = encode(*pad(buf, offsets))
            rows = defaultdict(list)
            for file, frames in zip(files, thumbnails(files), strict=True):
                back = b"".join(t.tobytes() for _, _, t in frames)
                rows["payload_bytes"].append(len(back))
                rows["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(back[-16:]))
                rows["media_bytes"].append(len(file))
                rows["media_sha256"].append(hashlib.sha256(file).hexdigest())
                rows["feature"].append(feature(frames))
            columns = {"doc_id": batch["doc_id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), **{k: pa.array(v) for k, v in rows.items()}}
            if keep_media:
                columns["media"] = pa.array(files, pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text").mapInArrow(T.released(store), schema + ", media binary" * keep_media)


def read_media(media: DataFrame, *, key: str = "doc_id", column: str = "media", batch_bytes: int = 3_000_000) -> DataFrame:
    """key, width, height, thumbnail (bytes by row) and thumbnail_hash of the first frame; null if it can't be decoded."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, "media", batch_bytes):
            found = [x[0] if x else None for x in thumbnails([x or b"" for x in batch["media"].to_pylist()])]
            columns = [
                batch[key],
                pa.array([x and x[0] for x in found], pa.int32()),
                pa.array([x and x[1] for x in found], pa.int32()),
                pa.array([x and x[2].tobytes() for x in found], pa.binary()),
                pa.array([x and f"{average_hash(x[2]):016x}" for x in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [key, "width", "height", "thumbnail", "thumbnail_hash"])

    kind = dict(media.dtypes)[key]
    return media.selectExpr(f"`{key}`", f"`{column}` media").mapInArrow(T.released(read), f"`{key}` {kind}, width int, height int, thumbnail binary, thumbnail_hash string")
