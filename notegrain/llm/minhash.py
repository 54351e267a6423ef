"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

*Sketch.*  Round i hashes every shingle to one of t bins with a value in [i, i + 1); a bin keeps its
smallest.  Rounds go on until every bin is filled, and from round t on a round fills one bin with all
shingles, so that even a set of one shingle fills every coordinate; t coordinates cost about
max(n, t log t) hashes rather than n t, and their agreement concentrates about the similarity like that of
independent ones.  A coordinate is stored as 8 bits; a band is ``rows`` of them, packed without hashing.

*Candidates.*  Texts with equal word sequences (SHA-256) are one class first, so groups of exact copies cost one
aggregation.  Class representatives that share a band are candidates.

*Verification*, on full shingle sets, compared by the words themselves, in two steps:

1. Every member meets the best hub of its bands, a hub being a band's member with the most shared bands: the original of
   a family of edited copies shares a band with each of them.  One pair for each document.
2. In bands whose members aren't connected yet, members of different components are compared by their sketches, in blocks of
   bounded size; blocks within a band's largest component are left out.  A pair that agrees well enough is the business
   of its first common band only.  A block gives one row for each member that has such a partner, with a bitmap of
   its partners; the texts are brought to these rows and all marked pairs are verified there.  A block then returns a
   spanning forest of its links: fewer rows than members, whatever the number of links.

So every pair that shares a band is connected, verified, or rejected by a sketch that agrees in under ``percent`` - 14 of a
hundred coordinates (4.9 standard deviations of 240, under 1e-6 for a pair at the limit).  With 48 bands of 5 coordinates a
pair at similarity 0.75 shares no band with probability 2e-6, and one at 0.8 with 5e-9.

Defined results: null or empty text, and text of white space, has the empty set and links with nothing;
rows that share a ``doc_id`` are one document; a row without ``doc_id`` links nothing and is kept unless a
document with an id has the same words; other columns are ignored, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .storage import discard, written

SIGNED = "doc_id bigint, n_shingles bigint, content binary, bands array<bigint>, sketch binary"
_EMPTY = np.uint64(2**64 - 1)
#: Members of one half of a block of a band's comparison.
_CHUNK = 1000
#: Shingles whose texts meet in one verification, but for single longer texts.
_TILE = 300_000
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(buf: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingle hashes by document, their offsets, and a digest of each document's words."""
    buf = T.lower_ascii(buf)
    starts, ends, at = T.word_spans(buf, offsets)
    n = np.diff(at)
    codes = T.word_codes(buf, starts, ends)
    count = np.maximum(0, n - words + 1)
    h, doc = T.windows(codes, words)[T.ragged(at[:-1], count)] if len(codes) >= words else np.zeros(0, np.uint64), np.repeat(np.arange(len(n)), count)
    for k in range(1, words):  # fewer words: the whole sequence is the one shingle
        own = np.flatnonzero(n == k)
        h, doc = np.concatenate([h, T.join(T.windows(codes, k)[at[own]], np.uint64(k), 5)]), np.concatenate([doc, own])
    order, begin = T.groups(doc, T.mix(h, 1))
    one = order[begin]
    digests = [hashlib.sha256(x).digest() for x in T.joined(buf, starts, ends, np.repeat(np.arange(len(n)), n), len(n))]
    return T.mix(h, 1)[one], np.searchsorted(doc[one], np.arange(len(n) + 1)), digests


def exact_shingles(column: pa.Array | pa.ChunkedArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle numbers by document, and their offsets: two are equal if and only if their words are."""
    buf, offsets = T.texts(column)
    buf = T.lower_ascii(buf)
    starts, ends, at = T.word_spans(buf, offsets)
    n = np.diff(at)
    h, have = T.numbered(buf, starts, ends)[0].astype(np.uint64), 1

    def pairs(step: int) -> np.ndarray:
        return np.unique(h[: len(h) - step] << np.uint64(32) | h[step:], return_inverse=True)[1].astype(np.uint64)

    count = np.maximum(0, n - words + 1)
    if count.any():
        while 2 * have <= words:
            h, have = pairs(have), 2 * have
        if have < words:
            h = pairs(words - have)
        h = h[T.ragged(at[:-1], count)].astype(np.int64)
    else:
        h = np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < words))  # representatives of classes differ, so these are alone
    h, doc = np.concatenate([h, -1 - few]), np.concatenate([np.repeat(np.arange(len(n)), count), few])
    order, begin = T.groups(doc, h)
    one = order[begin]
    return h[one], np.searchsorted(doc[one], np.arange(len(n) + 1))


def sketch(h: np.ndarray, offsets: np.ndarray, t: int) -> np.ndarray:
    """t coordinates for each non-empty set of hashes; equal coordinates mean the same element."""
    n = np.diff(offsets)
    out = np.full((len(n), t), _EMPTY, np.uint64)
    flat = out.ravel()
    live = np.flatnonzero(n > 0)
    for i in range(2 * t):
        if not len(live):
            break
        if i == 0 or changed:
            x, own = h[T.ragged(offsets[live], n[live])], np.repeat(live, n[live])
        v = T.mix(x, 100 + i)
        value = np.uint64(i << 48) | v & np.uint64(2**48 - 1)
        if i < t:
            bins = ((v >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64)
            np.minimum.at(flat, own * t + bins, value)
        else:
            np.minimum.at(flat, own * t + (i - t), value)  # only bins still empty hold a higher value
        done = (out[live] != _EMPTY).all(axis=1)
        changed = bool(done.any())
        live = live[~done]
    return out


def _signed(batch: pa.RecordBatch, words: int, bands: int, rows: int) -> pa.RecordBatch:
    h, at, digests = shingles(*T.texts(batch["text"]), words)
    n = np.diff(at)
    s = (T.mix(sketch(h, at, bands * rows), 60) & np.uint64(255)).astype(np.uint8)
    key = np.repeat(np.arange(bands, dtype=np.int64)[None], len(n), axis=0)
    for r in range(rows):
        key = key << 8 | s[:, r::rows]
    some = np.flatnonzero(n > 0)
    ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
    columns = [
        batch["doc_id"], pa.array(n, pa.int64()), pa.array([x[:16] for x in digests], pa.binary()),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[some].ravel())),
        pa.array([x.tobytes() for x in s], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "content", "bands", "sketch"])


def _are_stars(edges: DataFrame, files: int | None) -> bool:
    """Does every edge (a, b), a > b, lead to the end, and each node to one?"""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to"), F.lit(False).alias("end")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("to"), F.lit(True).alias("end")))
    seen = ends.groupBy("node").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.max("end").alias("end")).where("least < most or (least is not null and end)").select("node")
    return not (seen if files is None else seen.coalesce(files)).agg(F.count("*")).first()[0]


def components(links: DataFrame, files: int | None = None) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link (a, b).

    Alternating large-star and small-star rounds, each half written to the shared folder, until all are stars. Neither half makes more rows than it
    reads, so repeats are only dropped from the result.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", files)
    while not _are_stars(now, files):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large", files)
        discard(now)
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        now = written(down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))), "links", files)
        discard(down)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def intersections(ids: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the common parts of pairs of sets."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    _, code, times = np.unique(ids, return_inverse=True, return_counts=True)
    common = times[code] > 1
    column = np.cumsum(times > 1) - 1
    wide = int((times > 1).sum())
    if wide and len(left) * 2.0 * n.mean() * 400 > len(n) ** 2 * float(wide):  # many pairs of few shingles: a product of matrices
        row, col = doc[common], column[code[common]]
        total = np.zeros((len(n), len(n)), np.float32)
        for k in range(0, wide, 2048):
            part = np.zeros((len(n), min(2048, wide - k)), np.float32)
            here = (col >= k) & (col < k + 2048)
            part[row[here], col[here] - k] = 1
            total += part @ part.T
        return total[left, right].astype(np.int64)
    out = np.zeros(len(left), np.int64)
    cost = np.cumsum(n[left] + n[right])
    cuts = np.flatnonzero(np.diff(cost // 1_000_000)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(left)], strict=True):
        x, y = left[a:b], right[a:b]
        own = np.concatenate([np.repeat(np.arange(b - a), n[x]), np.repeat(np.arange(b - a), n[y])])
        code_ = np.concatenate([code[T.ragged(at[:-1][x], n[x])], code[T.ragged(at[:-1][y], n[y])]])
        both = np.sort(own * (len(times) + 1) + code_)
        out[a:b] = np.bincount(both[1:][both[1:] == both[:-1]] // (len(times) + 1), minlength=b - a)
    return out


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among n nodes."""
    order = np.argsort(np.concatenate([left, right]), kind="stable")
    other = np.concatenate([right, left])[order]
    at = np.searchsorted(np.concatenate([left, right])[order], np.arange(n + 1))
    new, out = np.ones(n, bool), []
    for top in range(n):
        if not new[top]:
            continue
        new[top], stack = False, [top]
        while stack:
            x = stack.pop()
            found = np.unique(other[at[x] : at[x + 1]])
            found = found[new[found]]
            new[found] = False
            out += [(x, y) for y in found.tolist()]
            stack += found.tolist()
    return out


def _linked(texts: pa.ChunkedArray, nodes: np.ndarray, left: np.ndarray, right: np.ndarray, words: int, percent: int) -> pa.Table:
    """A forest of those pairs of texts that are similar enough."""
    ids, at = exact_shingles(texts, words)
    n, both = np.diff(at), intersections(ids, at, left, right) if len(left) else np.zeros(0, np.int64)
    yes = (both > 0) & (100 * both >= percent * (n[left] + n[right] - both))
    found = spanning(len(n), left[yes], right[yes])
    a, b = (nodes[[x[k] for x in found]] if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=_LINKS)


def _stars(table: pa.Table, words: int, percent: int) -> pa.Table:
    """Links between a hub's texts and those of its members."""
    hub = table["is_hub"].to_numpy()
    left, right = np.flatnonzero(hub), np.flatnonzero(~hub)
    return _linked(table["text"], table["node"].to_numpy(), np.repeat(left, len(right)), np.tile(right, len(left)), words, percent)


def _marked(key: tuple, table: pa.Table, rows: int, likely: float, percent: int) -> pa.Table:
    """Members of a block with likely partners in other components: one row each, with a bitmap of the partners."""
    band, low, high = (k.as_py() for k in key)
    table = table.sort_by("node")
    s = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(table.num_rows, -1)
    node, part, n, half = (table[k].to_numpy() for k in ("node", "component", "n", "half"))
    left, right = np.flatnonzero(half == low), np.flatnonzero(half == high)
    this, pairs = band >> (8 * rows), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in left:
        r = right if low != high else right[right > i]
        r = r[(part[r] != part[i]) & (100 * np.minimum(n[r], n[i]) >= percent * np.maximum(n[r], n[i]))]
        if len(r):
            same = s[r] == s[i]
            good = same.mean(axis=1) >= likely
            r, same = r[good], same[good]
            r = r[same.reshape(len(r), s.shape[1] // rows, rows).all(axis=2).argmax(axis=1) == this]  # another band's business
            pairs.append((np.full(len(r), i), r))
    a, b = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
    tile = (np.cumsum(n) - n) // _TILE  # by size of the texts
    out: dict[str, list] = {k: [] for k in ("tile", "node", "place", "partners")}
    number = tile[a] * (tile[-1] + 1 if len(tile) else 1) + tile[b]
    for t in np.unique(number).tolist():
        x, y = a[number == t], b[number == t]
        members, back = np.unique(np.concatenate([x, y]), return_inverse=True)
        bits = np.zeros((len(members), len(members)), bool)
        bits[back[: len(x)], back[len(x) :]] = True
        out["tile"] += [t] * len(members)
        out["node"] += node[members].tolist()
        out["place"] += list(range(len(members)))
        out["partners"] += [x.tobytes() for x in np.packbits(bits, axis=1)]
    m = len(out["node"])
    return pa.table({"band": pa.array([band] * m, pa.int64()), "low": pa.array([low] * m, pa.int32()), "high": pa.array([high] * m, pa.int32()), "tile": pa.array(out["tile"], pa.int64()), "node": pa.array(out["node"], pa.int64()), "place": pa.array(out["place"], pa.int32()), "partners": pa.array(out["partners"], pa.binary())})


def _marked_links(table: pa.Table, words: int, percent: int) -> pa.Table:
    """Links among a tile's marked pairs; rows with one doc_id each stand for it."""
    place, size = table["place"].to_numpy(), 0
    size = int(place.max()) + 1
    rows = [np.flatnonzero(place == k) for k in range(size)] if len(place) != size else np.argsort(place).reshape(-1, 1)
    bits = np.zeros((size, size), bool)
    partners = table["partners"].to_pylist()
    for k in range(size):
        bits[k] = np.unpackbits(np.frombuffer(partners[int(rows[k][0])], np.uint8), count=size)
    a, b = np.nonzero(bits)
    if len(place) == size:
        left, right = rows[a, 0], rows[b, 0]
    else:
        both = [(x, y) for p, q in zip(a.tolist(), b.tolist(), strict=True) for x in rows[p] for y in rows[q]]
        left, right = (np.array([x[k] for x in both], np.int64) for k in (0, 1))
    return _linked(table["text"], table["node"].to_numpy(), left, right, words, percent)


def _hub_links(members: DataFrame, texts: DataFrame, words: int, percent: int, files: int) -> DataFrame:
    """Verified links between members and the best hub of their bands."""
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", (-F.col("node")).alias("hub"))).alias("h")).select("band", F.col("h.degree").alias("degree"), F.col("h.hub").alias("hub"))
    best = members.join(hubs, "band").where("node <> -hub").groupBy("node").agg(F.max(F.struct("degree", "hub")).alias("h"), F.max("n").alias("n"))
    stars = written(best.select("node", (-F.col("h.hub")).alias("hub"), "n"), "stars", files)
    # a hub's members are dealt to tiles by the size of their texts, and the hub goes to each tile
    sizes = stars.groupBy("hub").agg(F.ceil(F.sum("n") / _TILE).cast("int").alias("tiles"))
    dealt = stars.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("tile"), "node", F.lit(False).alias("is_hub"))
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.col("hub").alias("node"), F.lit(True).alias("is_hub"))
    both = dealt.unionByName(heads).hint("merge").join(texts, "node")
    links = written(both.groupBy("hub", "tile").applyInArrow(lambda t: _stars(t, words, percent), "a bigint, b bigint"), "verified", 5 * files)
    discard(stars)
    return links


def _open_links(members: DataFrame, found: DataFrame, sketches: DataFrame, texts: DataFrame, words: int, rows: int, percent: int, files: int) -> DataFrame:
    """Verified links, a spanning forest by block, between members of a band that are in different components."""
    label = written(members.join(found, "node", "left").select("band", "node", "n", F.coalesce("component", "node").alias("component")), "labels", 10 * files)
    parts = label.groupBy("band", "component").agg(F.count("*").alias("size"))
    open_bands = parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("h")).where("parts > 1")
    open_bands = open_bands.select("band", F.col("h.component").alias("main"), F.ceil(F.col("h.size") / _CHUNK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("h.size")) / _CHUNK).cast("int").alias("others"))
    own = F.col("component") == F.col("main")
    left = label.join(open_bands, "band").withColumn("half", F.when(own, F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others"))).cast("int"))
    # the main component's chunks meet the others' only
    dealt = left.withColumn("other", F.explode(F.sequence(F.when(own, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    dealt = dealt.select("band", F.least("half", "other").cast("int").alias("low"), F.greatest("half", "other").cast("int").alias("high"), "node", "component", "n", "half").hint("merge").join(sketches, "node")
    schema = "band bigint, low int, high int, tile bigint, node bigint, place int, partners binary"
    marked = written(dealt.groupBy("band", "low", "high").applyInArrow(lambda key, t: _marked(key, t, rows, percent / 100 - 0.14, percent), schema), "marked", 5 * files)
    discard(label)
    links = written(marked.hint("merge").join(texts, "node").groupBy("band", "low", "high", "tile").applyInArrow(lambda t: _marked_links(t, words, percent), "a bigint, b bigint"), "verified", 5 * files)
    discard(marked)
    return links


def content(text: str = "text") -> Column:
    """The ``content`` of a text as an expression: its words, A-Z lower-cased, joined by one space."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.substring(F.sha2(F.array_join(F.regexp_extract_all(low, F.lit(T.WORD_PATTERN), F.lit(0)), " "), 256), 1, 32))


def distinct_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    Of rows that repeat an id and its text one stays, the first by the other columns. Rows without an id go if a document with an id has their words; of
    those that are left, one of each sequence of words stays, and all without words do.
    """
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = [c for c in docs.columns if c not in (doc_id, text)]

    def least(rows: DataFrame, *keys: str) -> DataFrame:
        """One row of each key, the first by the other columns: combined before the exchange, so a key that many rows share is no burden."""
        row = F.struct(F.col(f"`{text}`"), *(F.col(f"`{c}`") for c in others), F.col(f"`{doc_id}`"))
        return rows.groupBy(*keys).agg(F.min(row).alias("__row")).select(*(F.col("__row")[c].alias(c) for c in docs.columns))

    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    named = docs.where(F.col(doc_id).isNotNull())
    named = named.join(gone, named[doc_id].cast("long") == gone["__gone"], "left_anti").select(*columns)
    nameless = docs.where(F.col(doc_id).isNull()).withColumn("__content", content(text))
    taken = found.where("doc_id is not null and n_shingles > 0").select(F.col("content").alias("__taken")).distinct()
    nameless = nameless.join(taken, nameless["__content"] == taken["__taken"], "left_anti")
    words = F.col("__content") != F.unhex(F.sha2(F.lit(""), 256).substr(1, 32))
    return least(named, f"`{doc_id}`", f"`{text}`").unionByName(least(nameless.where(words), "__content")).unionByName(nameless.where(~words).drop("__content"))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75, bands: int = 48, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, content (16 bytes of the SHA-256 of its words), component_id (smallest doc_id reachable by links) and kept (it is the document's own)."""
    if rows > 6 or bands > 127:
        raise ValueError("a band's number and its rows of 8 bits must fit in 63 bits")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(np.diff(T.texts(batch["text"])[1]) + 4000) // 2_000_000
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    yield _signed(batch.slice(a, b - a), words, bands, rows)

    signed = written(docs.mapInArrow(T.released(sign), SIGNED), "signed")
    files = max(4, signed.count() // 100_000)  # of tables with a few numbers for each document
    classes = signed.where("n_shingles > 0").groupBy("content").agg(F.min("doc_id").alias("node")).where("node is not null")
    own = signed.where("n_shingles > 0 and doc_id is not null")
    reps = own.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "content"], "left_semi")
    members = reps.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    members = written(members.join(shared.select("band"), "band").select("band", "node", "n"), "members", 10 * files)
    # the texts that any comparison needs, brought together once; a merge join at every size, as it must be at the largest
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("node"), "text")
    texts = written(texts.join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "texts")

    first = _hub_links(members, texts, words, percent, files)
    found = components(first, files)
    sketches = own.select(F.col("doc_id").alias("node"), "sketch").dropDuplicates(["node"])
    second = _open_links(members, found, sketches, texts, words, rows, percent, files)
    discard(members, texts)
    if not second.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second), files)
    discard(first, second)

    named = classes.join(found, "node", "left").select("content", F.coalesce("component", "node").alias("component_id"))
    linked = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "content").join(named, "content", "left").select("doc_id", "n_shingles", "content", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", "content", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
