"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order weigh ``weights`` in turn and share all words; no source may exceed ``most`` times its own size, and what
it can't take is shared by the others by weight.  That is one water level: target = min(cap, level * weight), found by
a running sum over the sources.

A document then gets the whole part of target / size copies, and its fraction is rounded dependently:
two fractional documents of a source meet, and mass (words) moves from one to the other, up or down with the probabilities that
keep both expectations, until one is a whole copy or none.  The words of a source never change until its very last
document is rounded, to the nearer side; what that misses is settled among all documents of the source: largest first, they change
sides where that lowers the miss.  Only their counts by size meet in one task.  Large documents are rounded first.  Documents meet
in leaves; each leaf passes its one undecided document up a tree of arity ``arity``, so no task sees a whole source.  All draws are hashes of
ids and of the seed: reruns agree.

Defined results: null text and text of white space have size 0, get no words, and decide nothing; a null source is one source, the
last; equal rows are separate documents; without words all targets are 0; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import text as T
from .storage import written

_STATE = "doc_id bigint, mark bigint, source string, size bigint, source_size bigint, target double, base bigint, p double, leaf bigint, copies bigint"


def sized(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, mark (a hash of the text), source and size in words of every document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                _, _, at = T.word_spans(*T.texts(batch["text"]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["mark"], batch["source"], pa.array(np.diff(at), pa.int64())], ["doc_id", "mark", "source", "size"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("mark"), F.col(source).alias("source"), F.col(text).alias("text"))
    return rows.mapInArrow(T.released(count), "doc_id bigint, mark bigint, source string, size bigint")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """source, source_size, documents and target of every source; one row each goes through the windows."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1
    by = by.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn)).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by = by.withColumn("fills", F.col("cap") / F.col("weight"))  # the level at which it is full
    up = Window.orderBy("fills", F.col("source").asc_nulls_last())
    all_ = Window.partitionBy(F.lit(1))
    full, open_ = F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(full, F.lit(0.0))) / open_)
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "level"))).over(all_)["level"])
    return by.select("source", "source_size", "documents", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def pivot(p: np.ndarray, mass: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities so that sum(p * mass) stays; at most one (its index, else -1) stays fractional."""
    p = p.astype(float).tolist()
    mass, draw, held = mass.tolist(), draw.tolist(), -1
    for i, x in enumerate(p):
        if not 0 < x < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = p[held] * mass[held], x * mass[i]  # words that each holds
        up, down = min(mass[held] - a, b), min(a, mass[i] - b)  # to the held one, from it
        if draw[i] * (up + down) < down:
            p[held], p[i] = (1.0 if mass[held] - a <= b else (a + up) / mass[held]), (0.0 if b <= mass[held] - a else (b - up) / mass[i])
        else:
            p[held], p[i] = (0.0 if a <= mass[i] - b else (a - down) / mass[held]), (1.0 if mass[i] - b <= a else (b + down) / mass[i])
        if not 0 < p[held] < 1:
            held = i if 0 < p[i] < 1 else -1
    return np.array(p), held


def settle(size: np.ndarray, one: np.ndarray, documents: np.ndarray, miss: float) -> np.ndarray:
    """How many documents of each size and side (taken or not) change sides, largest first, where that lowers what is missed."""
    flips = np.zeros(len(size), np.int64)
    for i in np.argsort(-size, kind="stable").tolist():
        if one[i] == (miss > 0):  # words beyond the target
            flips[i] = max(0, min(int(documents[i]), int(np.ceil(abs(miss) / size[i] - 0.5))))
            miss -= float(flips[i] * size[i]) * (1 if one[i] else -1)
    return flips


def _settle(table: pa.Table) -> pa.Table:
    flips = settle(table["size"].to_numpy(), table["one"].to_numpy(), table["documents"].to_numpy(), table["miss"][0].as_py())
    return table.select(["source", "one", "size"]).append_column("flips", pa.array(flips)).filter(pa.array(flips > 0))


def _settled(rounded: DataFrame, seed: int, files: int) -> DataFrame:
    """The rounded documents, as many on the other side as settle() wants: the first by a hash, in each partition and then of these."""
    rounded = rounded.select("*", (F.col("copies") > F.col("base")).alias("one"), F.spark_partition_id().alias("part"))
    missed = written(rounded.groupBy("source").agg((F.sum(F.col("copies") * F.col("size")) - F.first("target")).alias("miss")).select(F.col("source").alias("of"), "miss"), "missed", 1)
    sizes = rounded.join(missed, rounded["source"].eqNullSafe(missed["of"])).where("size < 2 * abs(miss)").groupBy("source", "one", "size").agg(F.count("*").alias("documents"), F.first("miss").alias("miss"))
    flips = written(sizes.groupBy("source").applyInArrow(_settle, "source string, one boolean, size bigint, flips bigint"), "flips", 1)
    flips = flips.select(*(F.col(c).alias(f"{c}_f") for c in ("source", "one", "size")), "flips")
    tagged = rounded.join(flips, rounded["source"].eqNullSafe(flips["source_f"]) & (rounded["one"] == flips["one_f"]) & (rounded["size"] == flips["size_f"]), "left")
    order = (F.xxhash64("doc_id", "mark", F.lit(seed)), "doc_id", "mark")
    ranked = written(tagged.where("flips is not null").withColumn("place", F.row_number().over(Window.partitionBy("source", "one", "size", "part").orderBy(*order))), "ranked", files)
    first = ranked.where("place <= flips").withColumn("place", F.row_number().over(Window.partitionBy("source", "one", "size").orderBy(*order)))
    first = first.withColumn("copies", F.col("copies") + F.when(F.col("place") > F.col("flips"), 0).when(F.col("one"), -1).otherwise(1))
    columns = [c.split()[0] for c in _STATE.split(", ")]
    return tagged.where("flips is null").select(columns).unionByName(ranked.where("place > flips").select(columns)).unionByName(first.select(columns))


def _round(table: pa.Table, seed: int, level: int, last: bool) -> pa.Table:
    table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("mark", "ascending")])
    key = table["doc_id"].fill_null(0).to_numpy().view(np.uint64) ^ table["mark"].fill_null(0).to_numpy().view(np.uint64)
    draw = T.mix(key + T.mix(np.arange(len(key), dtype=np.uint64), level), seed).astype(np.float64) / 2.0**64
    p, held = pivot(table["p"].to_numpy(), table["size"].to_numpy(), draw)
    if last and held >= 0:
        p[held], held = float(p[held] >= 0.5), -1
    copies = [None if k == held else int(round(x)) for k, x in enumerate(p)]
    base = table["base"].to_numpy()
    table = table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))
    return table.set_column(table.schema.get_field_index("copies"), "copies", pa.array([None if c is None else c + int(b) for c, b in zip(copies, base, strict=True)], pa.int64()))


def _rounding(seed: int, level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    return lambda table: _round(table, seed, level, last)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3, leaf: int = 500, arity: int = 64, seed: int = 1) -> DataFrame:
    """doc_id, mark, source, size, source_size, target, copies and taken (words) of every document."""
    sizes = written(sized(docs, doc_id=doc_id, text=text, source=source), "sizes")
    files = max(4, sizes.count() // 100_000)  # of tables with a few numbers for each document
    goal = written(targets(sizes, weights=weights, most=most), "targets", 1)
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    goal = goal.select(F.col("source").alias("of"), "source_size", "target", F.floor(ratio).alias("base"), (ratio - F.floor(ratio)).alias("p"), F.ceil(F.col("documents") / leaf).alias("leaves"))
    state = sizes.join(goal, sizes["source"].eqNullSafe(goal["of"])).withColumn("leaf", F.pmod(F.xxhash64("doc_id", "mark", "size"), F.col("leaves")))
    state = state.withColumn("copies", F.when((F.col("size") == 0) | (F.col("p") == 0), F.col("base"))).selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in _STATE.split(", ")))
    leaves = goal.agg(F.max("leaves")).first()[0] or 1
    whole, rounded = state.where("copies is not null"), None
    level = 0
    state = state.where("copies is null")
    while True:
        last = leaves <= 1
        state = written(state.groupBy("source", "leaf").applyInArrow(_rounding(seed, level, last), _STATE), "mix", files)
        decided = state.where("copies is not null")
        rounded = decided if rounded is None else rounded.unionByName(decided)
        if last:
            break
        state = state.where("copies is null").withColumn("leaf", F.expr(f"leaf div {arity}"))
        leaves, level = -(-leaves // arity), level + 1
    out = whole.unionByName(_settled(rounded, seed, files))
    return out.select("doc_id", "mark", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, mixed: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    keys = ("__id", "__mark", "__source")
    alike = Window.partitionBy(*keys).orderBy(F.lit(1))
    left = docs.select("*", F.col(doc_id).cast("long").alias("__id"), F.xxhash64(F.col(text)).alias("__mark"), F.col(source).alias("__source")).withColumn("__n", F.row_number().over(alike))
    right = mixed.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("source").alias("__source"), "copies").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("copies")))
    right = right.where("copies > 0").select(*(F.col(k).alias(f"{k}_r") for k in (*keys, "__n")), F.col("copies").alias("__copies"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in (*keys, "__n")]
    return left.join(right, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
