"""Vocabulary release files: pipe-separated rows without header, and tab-separated concept tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the release formats: column places and marks.
CONCEPT = {"cui": 0, "lat": 1, "aui": 7, "sab": 11, "tty": 12, "code": 13, "str": 14, "suppress": 16}
RELATION = {"cui1": 0, "aui1": 1, "rel": 3, "cui2": 4, "aui2": 5, "rela": 7, "sab": 10, "suppress": 14}
SUPPRESSED = ("O", "E", "Y")
BREAKDOWN = ("has_ingredient", "consists_of", "tradename_of")


def _rows(spark: SparkSession, path: str, columns: dict[str, int], least: int) -> DataFrame:
    """The named columns of every line with enough fields, and its place in the file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    order = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    fields = lines.select(F.split(F.regexp_replace(F.make_valid_utf8("value"), r"\r+\z", ""), r"\|", -1).alias("f"), order.alias("file_order")).where(F.size("f") >= least)
    return fields.select(*(F.col("f")[k].alias(c) for c, k in columns.items()), "file_order")


def _kept(include_suppressed: bool) -> Column:
    return F.lit(True) if include_suppressed else ~F.col("suppress").isin(*SUPPRESSED)


def concepts(spark: SparkSession, path: str, sources: tuple[str, ...], include_suppressed: bool = False) -> DataFrame:
    """cui, sab, code, aui, tty, str, file_order of English, unsuppressed atoms of these sources."""
    rows = _rows(spark, path, CONCEPT, 18).where(F.col("sab").isin(*sources) & (F.col("lat") == "ENG") & _kept(include_suppressed))
    return rows.select("cui", "sab", "code", "aui", "tty", "str", "file_order")


def ranks(spark: SparkSession, path: str, sources: tuple[str, ...]) -> DataFrame:
    """sab, tty, rank (higher is preferred)."""
    rows = _rows(spark, path, {"rank": 0, "sab": 1, "tty": 2}, 3).where(F.col("sab").isin(*sources))
    return rows.groupBy("sab", "tty").agg(F.max(F.col("rank").cast("int")).alias("rank"))


def relations(spark: SparkSession, path: str, hierarchy: tuple[str, ...], include_suppressed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Edges (sab, child, parent) between atoms, and RxNorm breakdown edges (coarser, finer) between concepts."""
    rows = _rows(spark, path, RELATION, 15).where(_kept(include_suppressed))
    up = rows.where(F.col("sab").isin(*hierarchy) & (F.col("rel") == "CHD") & (F.col("aui1") != "") & (F.col("aui2") != "") & (F.col("aui1") != F.col("aui2")))
    down = rows.where((F.col("sab") == "RXNORM") & F.col("rela").isin(*BREAKDOWN) & (F.col("cui1") != F.col("cui2")))
    return up.select("sab", F.col("aui2").alias("child"), F.col("aui1").alias("parent")).distinct(), down.select(F.col("cui2").alias("coarser"), F.col("cui1").alias("finer")).distinct()


def members(spark: SparkSession, path: str, cuis: DataFrame) -> DataFrame:
    """Rows of a concept file whose concept (field 0) is wanted."""
    lines = spark.read.option("lineSep", "\n").text(path).withColumn("cui", F.split("value", r"\|", 2)[0])
    return lines.join(cuis.select("cui").distinct(), "cui", "left_semi").select("cui", F.split("value", r"\|", -1).alias("fields"))


def tab_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header and no quoting; empty is NULL."""
    return spark.read.csv(path, sep="\t", header=True, quote="", escape="", multiLine=False)
