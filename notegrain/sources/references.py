"""Reference annotations in three formats, as one mention table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..model import ASSERTIONS

_OWN = "doc_id string, text string, source string, guidelines string, mentions array<struct<start:int,end:int,text:string,cui:string,`group`:string,tuis:array<string>,assertions:struct<" + ",".join(f"{c}:{k}" for c, k in ASSERTIONS.items()) + ">,note:string>>"
_SILVER = "source_file string, text string, mentions array<struct<begin:int,`end`:int,negated:boolean,subject:string,history_of:boolean,uncertain:boolean,conditional:boolean,generic:boolean,concepts:array<struct<cui:string,tui:string>>>>"
_MATCHER = "array<struct<start:int,length:int,evlist:array<struct<conceptinfo:struct<cui:string,semantictypes:array<string>>>>>>"


def own(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, mentions) of the project's own JSON lines."""
    rows = spark.read.schema(_OWN).json(path).withColumn("doc_seq", F.monotonically_increasing_id())
    m = rows.select("doc_seq", "doc_id", "source", F.posexplode("mentions").alias("ord", "m"))
    return rows.select("doc_seq", "doc_id", "text", "source"), m.select("doc_seq", "doc_id", "ord", "m.start", "m.end", "m.text", "m.cui", F.col("m.group").alias("semantic_group"), F.col("m.tuis").alias("semantic_types"), "m.assertions.*", F.coalesce(F.lower("source").contains("human"), F.lit(False)).alias("is_human"))


def silver(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, mentions) of another system's JSON lines: one mention for each of an annotation's concepts, with the union of its types."""
    rows = spark.read.schema(_SILVER).json(path).withColumn("doc_seq", F.monotonically_increasing_id())
    spans = rows.select("doc_seq", F.col("source_file").alias("doc_id"), "text", F.posexplode("mentions").alias("place", "m"))
    flat = spans.select("doc_seq", "doc_id", "place", "text", "m", F.explode("m.concepts").alias("c"))
    flags = [c for c in ASSERTIONS if c != "temporality"]
    per = flat.groupBy("doc_seq", "doc_id", "place", F.col("m.begin").alias("start"), F.col("m.end").alias("end"), F.col("c.cui").alias("cui"), *(F.col(f"m.{c}").alias(c) for c in flags)).agg(F.array_sort(F.collect_set("c.tui")).alias("semantic_types"))
    order = Window.partitionBy("doc_seq").orderBy("place", "cui")
    mentions = per.withColumn("ord", F.row_number().over(order) - 1).drop("place").withColumn("temporality", F.lit(None).cast("string"))
    return rows.select("doc_seq", F.col("source_file").alias("doc_id"), "text"), mentions


def matcher(spark: SparkSession, folder: str, corpus: str) -> tuple[DataFrame, DataFrame]:
    """(documents, mentions) of JSON files beside .txt files of the same name; the first of each (span, concept)."""
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]+$", 1).alias("doc_id")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(stem, F.from_json(F.col("content").cast("string"), _MATCHER).alias("found"))
    notes = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(corpus).select(stem, F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    docs = notes.join(files, "doc_id").withColumn("doc_seq", F.monotonically_increasing_id())
    spans = docs.select("doc_seq", "doc_id", F.posexplode("found").alias("i", "e"))
    rows = spans.select("doc_seq", "doc_id", "i", F.col("e.start").alias("start"), (F.col("e.start") + F.col("e.length")).alias("end"), F.posexplode("e.evlist").alias("j", "v"))
    rows = rows.select("doc_seq", "doc_id", "i", "j", "start", "end", F.col("v.conceptinfo.cui").alias("cui"), F.col("v.conceptinfo.semantictypes").alias("semantic_types"))
    first = rows.groupBy("doc_seq", "doc_id", "start", "end", "cui").agg(F.min_by("semantic_types", F.struct("i", "j")).alias("semantic_types"), F.min(F.struct("i", "j")).alias("at"))
    order = Window.partitionBy("doc_seq").orderBy("at")
    return docs.select("doc_seq", "doc_id", "text"), first.withColumn("ord", F.row_number().over(order) - 1).drop("at")


def load(spark: SparkSession, path: str, fmt: str, corpus: str | None = None) -> tuple[DataFrame, DataFrame]:
    if fmt == "own":
        return own(spark, path)
    if fmt == "silver":
        return silver(spark, path)
    if fmt == "matcher" and corpus:
        return matcher(spark, path, corpus)
    raise ValueError(f"unknown reference format: {fmt}" if corpus or fmt != "matcher" else "the matcher format needs the folder of its texts")


def scope(mentions: DataFrame, groups: list[str] | None, type_groups: DataFrame | None = None) -> DataFrame:
    """Mentions of these groups: their own, else the group of their first type in (tui, semantic_group)."""
    if not groups:
        return mentions
    if type_groups is not None and "semantic_types" in mentions.columns:
        own_types = mentions.select("doc_seq", "ord", F.explode("semantic_types").alias("tui")).join(type_groups.select("tui", F.col("semantic_group").alias("by_type")), "tui").groupBy("doc_seq", "ord").agg(F.min("by_type").alias("by_type"))
        mentions = mentions.join(own_types, ["doc_seq", "ord"], "left").withColumn("semantic_group", F.coalesce("semantic_group", "by_type")).drop("by_type")
    return mentions.where(F.upper("semantic_group").isin(*(g.upper() for g in groups)))


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result lines; a torn line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
