"""Secret scans over an incremental blob ledger, in DataFrame and SQL functions only.

Every historical version of a document is content-addressed: a *blob* is the SHA-256 of its text.
The ledger is a folder with three tables: ``versions`` (path, version, blob), a path's texts in the order in which scans met
them; ``seen`` (blob, rule, version of the rule); and ``findings`` (blob, rule, kind, start, end).  A scan adds the versions it
hasn't met, takes the distinct blobs, leaves out every pair of blob and rule version that ``seen`` holds, scans the rest,
appends to the tables, and joins findings back to all paths that carry the blob.  So a copy or a text that comes
back costs nothing, and a new rule version rescans each blob for that rule alone.

Offsets come from the pieces between matches: a match begins after the lengths of the pieces before it and of the matches between
them, in code points; a window sums them by blob and kind, so a text with many matches costs no more than their number.

Defined results: null text is the empty blob, without findings; rows may repeat; a column of the input named ``spans`` is replaced, all others
stay, whatever their names; a null path has no versions; of versions that one scan meets, the blob orders them; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .storage import exists, shared_folder


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches whose group has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds, in the order in which spans at one place are listed.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    # all of a run is one match, so a bound in the pattern is the same as a filter after it
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Kinds that come on top of them.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)


def _sizes(place: int) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(place).alias("place"), i.alias("i"), F.char_length(x["p"]).alias("gap"), F.char_length(x["m"]).alias("size"), F.char_length(x["g"]).alias("value"))


def _findings(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, kind, start, end) of the blobs (blob, text, todo: the keys of rules to run)."""
    wanted = [F.array_contains("todo", r.key) & F.col("text").rlike(r.pattern) for r in rules]
    hit = blobs.select("blob", "text", *(w.alias(f"h{k}") for k, w in enumerate(wanted))).where(reduce(lambda a, b: a | b, [F.col(f"h{k}") for k in range(len(rules))]))
    parts = []
    for k, r in enumerate(rules):
        # the last piece follows the last match, so its row of the zip has no match
        pieces, whole, value = F.split("text", r.pattern, -1), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))
        rows = F.transform(F.arrays_zip(pieces.alias("p"), whole.alias("m"), value.alias("g")), _sizes(k))
        parts.append(F.when(F.col(f"h{k}"), rows).otherwise(F.array().cast("array<struct<place:int,i:int,gap:int,size:int,value:int>>")))
    found = hit.select("blob", F.inline(F.concat(*parts)))
    up_to = Window.partitionBy("blob", "place").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(up_to).cast("int")).withColumn("start", F.col("end") - F.col("size"))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("place") + 1)
    return found.where(F.col("value") >= least).select("blob", F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("place") + 1).alias("kind"), "start", "end")


class Ledger:
    """What has been scanned and found, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark).rstrip('/')}/notegrain/ledger-{uuid.uuid4().hex}"

    def _table(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.folder}/{name}"):
            return self.spark.range(0).selectExpr(*(f"cast(null as {kind}) `{column}`" for column, kind in (c.split() for c in schema.split(", "))))
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.folder}/{name}")

    def seen(self) -> DataFrame:
        return self._table("seen", "blob binary, rule string")

    def findings(self) -> DataFrame:
        return self._table("findings", "blob binary, rule string, kind string, start int, end int")

    def versions(self) -> DataFrame:
        return self._table("versions", "path string, version int, blob binary")

    def history(self) -> DataFrame:
        """(path, version, rule, kind, start, end): findings of every version of every path, also of texts that no document has any more."""
        return self.versions().join(self.findings().distinct(), "blob").select("path", "version", "rule", "kind", "start", "end")

    def scan(self, docs: DataFrame, rules: Sequence[Rule], text: str, path: str | None = None) -> DataFrame:
        """Scan what is new, and return the pairs (blob, rule) that were. Findings are written before ``seen``: a scan cut short is done again, and reading drops repeats."""
        blobs = _blobs(docs, text).groupBy("blob").agg(F.any_value("text").alias("text"))
        keys = F.array(*(F.lit(r.key) for r in rules))
        known = self.seen()
        if known.isEmpty():
            todo = blobs.select("blob", "text", keys.alias("todo"))
        else:
            known = known.join(blobs.select("blob"), "blob", "left_semi").groupBy("blob").agg(F.collect_set("rule").alias("rules"))
            todo = blobs.join(known, "blob", "left").select("blob", "text", F.array_except(keys, F.coalesce("rules", F.array().cast("array<string>"))).alias("todo")).where("size(todo) > 0")
        files = max(4, docs.count() // 100_000)  # rows here are a few numbers: not a file for each partition of the texts
        rule = F.element_at(F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.key))), F.col("kind"))
        _findings(todo, rules).select("blob", rule.alias("rule"), "kind", "start", "end").repartition(files).write.mode("append").parquet(f"{self.folder}/findings")
        if path is not None:
            self._add_versions(_blobs(docs, text, F.col(path).cast("string").alias("path")).where("path is not null").select("path", "blob").distinct(), files)
        before = self.seen()
        new = _blobs(docs, text).select("blob").distinct().select("blob", F.explode(keys).alias("rule"))
        new = new if before.isEmpty() else new.join(before, ["blob", "rule"], "left_anti")
        place = f"{self.folder}/seen/scan={uuid.uuid4().hex}"
        new.coalesce(files).write.parquet(place)
        return self.spark.read.schema("blob binary, rule string").parquet(place)

    def _add_versions(self, now: DataFrame, files: int) -> None:
        """Append the (path, blob) pairs that are new, numbered on from the path's last version."""
        before = self.versions()
        if not before.isEmpty():
            last = before.groupBy("path").agg(F.max("version").alias("last"))
            now = now.join(before, ["path", "blob"], "left_anti").join(last, "path", "left")
        else:
            now = now.withColumn("last", F.lit(0))
        number = F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("path").orderBy("blob"))
        now.select("path", number.alias("version"), "blob").coalesce(files).write.mode("append").parquet(f"{self.folder}/versions")


def _blobs(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.unhex(F.sha2(whole, 256)).alias("blob"), whole.alias("text"), *more)


def scan_secrets(docs: DataFrame, *, text: str = "text", path: str | None = None, rules: Sequence[Rule] = BASE + ADDED, ledger: Ledger | None = None) -> DataFrame:
    """The documents with ``spans``: array of (start, place, kind, end, after), by start, then by the order of the rules.

    after: where the spans before it end, or 0. path: the column that names a document through its versions; None records no versions.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    ledger.scan(docs, rules, text, path)
    place = F.element_at(F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k))), F.col("kind"))
    found = ledger.findings().where(F.col("rule").isin([r.key for r in rules])).distinct().withColumn("place", place)
    before = Window.partitionBy("blob").orderBy("start", "place", "end").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("after", F.coalesce(F.max("end").over(before), F.lit(0)))
    found = found.groupBy(F.col("blob").alias("__found")).agg(F.array_sort(F.collect_list(F.struct("start", "place", "kind", "end", "after"))).alias("__spans"))
    nothing = F.array().cast(dict(found.dtypes)["__spans"])
    own = docs.withColumn("__blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))
    return own.join(found, own["__blob"] == found["__found"], "left").select(*(F.col(f"`{c}`") for c in docs.columns if c != "spans"), F.coalesce("__spans", nothing).alias("spans"))


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with each span replaced by its kind in brackets; what overlaps an earlier span goes with it."""
    mark = "if(x.start < x.after, '', concat(substring({0}, x.after + 1, x.start - x.after), '[', x.kind, ']'))".format(text)
    return F.expr(f"if(size({spans}) = 0, {text}, concat(array_join(transform({spans}, x -> {mark}), ''), substring({text}, array_max(transform({spans}, x -> x.end)) + 1)))")


def digests(scanned: DataFrame, *, doc_id: str = "doc_id", spans: str = "spans") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and spans as text."""
    names = ", ".join(f"'{r.kind}'" for r in BASE)
    joined = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = [f"cast(size(filter({spans}, x -> x.kind = '{r.kind}')) as bigint) n_{r.kind}" for r in BASE]
    return scanned.selectExpr(f"cast({doc_id} as bigint) doc_id", *counts, f"sha2({joined.format(f'filter({spans}, x -> x.kind in ({names}))')}, 256) base_sha256", f"{joined.format(spans)} spans")


def oracle_sql(rules: Sequence[Rule] = BASE + ADDED) -> str:
    """The digests in DuckDB's SQL, from the whole texts and without a ledger."""
    quoted = [r.pattern.replace("'", "''") for r in rules]
    pieces = ", ".join(f"string_split_regex(t, '{p}') p{k}, regexp_extract_all(t, '{p}', 0) m{k}, regexp_extract_all(t, '{p}', {r.group}) g{k}" for k, (r, p) in enumerate(zip(rules, quoted, strict=True)))
    spans = [
        f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'start': list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i - 1], lambda x: length(x))), 0), "
        f"'place': {k}, 'kind': '{r.kind}', 'size': length(m{k}[i]), 'value': length(g{k}[i])}}), lambda x: x.value >= {r.least})"
        for k, r in enumerate(rules)
    ]
    names = ", ".join(f"'{r.kind}'" for r in BASE)
    joined = "array_to_string(list_transform({}, lambda x: x.kind || ':' || cast(x.start as bigint) || ':' || cast(x.start + x.size as bigint)), ',')"
    counts = ", ".join(f"cast(len(list_filter(s, lambda x: x.kind = '{r.kind}')) as bigint) n_{r.kind}" for r in BASE)
    base = joined.format(f"list_filter(s, lambda x: x.kind in ({names}))")
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') t FROM documents),
pieces AS (SELECT doc_id, {pieces} FROM texts),
found AS (SELECT doc_id, list_sort(list_concat({", ".join(spans)})) s FROM pieces)
SELECT doc_id, {counts}, sha256(coalesce({base}, '')) base_sha256, coalesce({joined.format("s")}, '') spans FROM found
"""
