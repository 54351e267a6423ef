"""Block exchange: many documents ask one distributed question about hashed keys.

Documents are dealt into *blocks* of about ``BLOCK_BYTES`` by a hash, so no key of the data decides
where a row goes.  A block asks by sending its distinct keys, packed by key range (*bucket*); a
bucket answers every block with a few bits for each of its keys, in the order asked.  A key that
occurs in a third of all rows thus costs its bucket at most one entry for each block, and what goes
back is bits.  Blocks recompute their keys when the answer arrives instead of storing them; all
trips share one exchange of the documents, and a lost executor only costs a recomputation.

A question is a row for each pair of block and bucket, so rows per byte grow until each key is a row of its own; on executors with
memory to spare, larger blocks (a block takes about 80 times its bytes) put that off.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as T

BLOCK_BYTES = 3_000_000
ASK = "bucket int, block int, trip int, n int, data binary"
ANSWER = "block int, bucket int, trip int, n int, bits binary"
_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("trip", pa.int32()), ("n", pa.int32()), ("data", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("trip", pa.int32()), ("n", pa.int32()), ("bits", pa.binary())])


def block_count(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for these documents: by bytes of text, and one for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // block_bytes))


def bucket_count(blocks: int) -> int:
    """Buckets that answer so many blocks; questions are an order smaller than texts, and each pair of block and bucket is a row."""
    return max(1, -(-2 * blocks // 3))


def in_blocks(docs: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(block, doc_id, text): the input of all trips."""
    key = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(n)).cast("int")
    return docs.select(key.alias("block"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def ask(keys: np.ndarray, buckets: int, block: int, trip: int, pack: Callable[[slice], bytes]) -> pa.Table:
    """One row for each bucket that has keys; keys are sorted 64-bit hashes, pack gives the bytes of a slice."""
    at = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    rows = [(int(at[a]), block, trip, int(b - a), pack(slice(int(a), int(b)))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, _ASK.types, strict=True)], schema=_ASK)


def answered(answers: pa.Table, trip: int, width: int = 1) -> np.ndarray:
    """The answers to one block's keys of a trip, in the order of the keys; width bits each."""
    rows = sorted((r for r in answers.to_pylist() if r["trip"] == trip), key=lambda r: r["bucket"])
    parts = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"] * width) for r in rows]
    bits = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if width == 1:
        return bits
    return bits.reshape(-1, width) @ (1 << np.arange(width))[::-1]


def trip(asked: DataFrame, answer: Callable[[list[bytes], np.ndarray], list[np.ndarray]], no: int, width: int = 1) -> DataFrame:
    """Bring the questions of a trip to their buckets. answer(datas, sizes) gives one array for each question."""

    def bucket(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("trip", "ascending")])
        n = table["n"].to_numpy()
        found = answer([x.as_py() for x in table["data"]], n)
        if width > 1:
            found = [((x[:, None] >> np.arange(width)[::-1]) & 1).astype(np.uint8).ravel() for x in found]
        bits = [np.packbits(x).tobytes() for x in found]
        T.release()
        return pa.Table.from_arrays([table["block"].combine_chunks(), table["bucket"].combine_chunks(), pa.array([no] * len(n), pa.int32()), pa.array([len(x) // width for x in found], pa.int32()), pa.array(bits, pa.binary())], schema=_ANSWER)

    return asked.groupBy("bucket").applyInArrow(bucket, ANSWER)


def asks(blocks: DataFrame, f: Callable[[int, pa.Table], pa.Table], answers: DataFrame | None = None) -> DataFrame:
    """Questions of every block: f(block, documents) or, with earlier answers, f(block, documents, answers)."""
    return _each(blocks, f, ASK, answers)


def _each(blocks: DataFrame, f: Callable, schema: str, answers: DataFrame | None = None) -> DataFrame:
    def run(key: tuple, *tables: pa.Table) -> pa.Table:
        out = f(key[0].as_py(), *tables)
        T.release()
        return out

    if answers is None:
        return blocks.groupBy("block").applyInArrow(lambda key, docs: run(key, docs), schema)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda key, docs, found: run(key, docs, found), schema)


def finish(blocks: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], answers: DataFrame, schema: str) -> DataFrame:
    """The result rows of every block, from its documents and all answers."""
    return _each(blocks, f, schema, answers)
