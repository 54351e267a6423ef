"""Cohorts, document-by-concept matrices and summaries over mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import mention_status
from ..scratch import written
from .omop import sequential_ids
from .terminology import SUMMARY_ORDER

STATUSES = ("affirmed", "negated", "other_subject", "hedged")
#: What a reader asks of a mention, and the attributes that answer; unanswered if none was assessed.
QUESTIONS = {"negation": ("negated",), "subject": ("subject",), "hedging": ("uncertain", "conditional", "generic"), "history": ("history_of", "temporality")}


def with_status(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("status", mention_status())


def unassessed(question: str) -> Column:
    out = F.lit(True)
    for c in QUESTIONS[question]:
        out = out & F.col(c).isNull()
    return out


def classify(docs: DataFrame, mentions: DataFrame, targets: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """doc_seq, doc_id, a count by status of target concepts, status and the questions no affirmed mention answers; every document is a row.

    errors: (doc_id) that failed; one with a result isn't an error.
    """
    rows = with_status(mentions.join(targets.select("cui").distinct(), "cui", "left_semi"))
    affirmed = F.col("status") == "affirmed"
    open_ = F.array_compact(F.array(*(F.when(F.bool_or(affirmed & unassessed(q)), F.lit(q)) for q in QUESTIONS)))
    counts = rows.groupBy("doc_seq").agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES), open_.alias("unassessed"))
    out = docs.select("doc_seq", "doc_id").join(counts, "doc_seq", "left").fillna(0, [f"n_{s}" for s in STATUSES])
    out = out.withColumn("unassessed", F.coalesce("unassessed", F.array().cast("array<string>")))
    excluded = F.col("n_negated") + F.col("n_other_subject") + F.col("n_hedged") > 0
    out = out.withColumn("status", F.when(F.col("n_affirmed") > 0, "affirmed").when(excluded, "excluded").otherwise("absent"))
    if errors is None:
        return out
    failed = errors.select("doc_id").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_anti")
    zero = [F.lit(0).cast("bigint").alias(f"n_{s}") for s in STATUSES]
    return out.unionByName(failed.select(F.lit(None).cast(dict(docs.dtypes)["doc_seq"]).alias("doc_seq"), "doc_id", *zero, F.array().cast("array<string>").alias("unassessed"), F.lit("error").alias("status")))


def cohort_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count("*").alias("documents"))


def unique_keys(docs: DataFrame) -> DataFrame:
    """``row_key``: a repeated doc_id gets #N, where N counts all repeats in document order.

    Only repeats are numbered together: sorted by range, and numbered from the counts of the ranges.
    """
    nth = docs.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_seq")))
    again = sequential_ids(nth.where("nth > 1").select("doc_seq"), ["doc_seq"]).withColumnRenamed("note_nlp_id", "n")
    return nth.drop("nth").join(again, "doc_seq", "left").withColumn("row_key", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.concat("doc_id", F.lit("#"), "n"))).drop("n")


def cells(mentions: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """(doc_seq, cui, cell): 1 if any mention is affirmed, else -1."""
    rows = mentions.where(F.upper("semantic_group").isin(*(g.upper() for g in groups))) if groups else mentions
    return with_status(rows).groupBy("doc_seq", "cui").agg(F.max(F.when(F.col("status") == "affirmed", 1).otherwise(-1)).alias("cell"))


def concept_stats(mentions: DataFrame, min_docs: int = 1, groups: list[str] | None = None) -> DataFrame:
    """cui, n_affirmed and n_not_affirmed documents of concepts affirmed in at least min_docs."""
    out = cells(mentions, groups).groupBy("cui").agg(F.count_if(F.col("cell") == 1).alias("n_affirmed"), F.count_if(F.col("cell") == -1).alias("n_not_affirmed"))
    return out.where(F.col("n_affirmed") >= min_docs)


def matrix(docs: DataFrame, mentions: DataFrame, min_docs: int = 1, groups: list[str] | None = None, most: int = 2000) -> DataFrame:
    """row_key and a column for each concept: 1, -1 or 0. Columns are an answer's shape, so there may be ``most`` at most (an error otherwise)."""
    marked = written(cells(mentions, groups), "cells")  # read for the columns, and again for the rows
    affirmed = marked.groupBy("cui").agg(F.count_if(F.col("cell") == 1).alias("n_affirmed")).where(F.col("n_affirmed") >= min_docs)
    columns = [r["cui"] for r in affirmed.orderBy(F.col("n_affirmed").desc(), "cui").limit(most + 1).collect()]
    if len(columns) > most:
        raise ValueError(f"more than {most} concepts: raise min_docs or most")
    keys = unique_keys(docs).select("doc_seq", "row_key")
    if not columns:
        return keys.select("row_key")
    wide = marked.groupBy("doc_seq").pivot("cui", columns).agg(F.max("cell"))
    return keys.join(wide, "doc_seq", "left").fillna(0, columns).select("row_key", *columns)


def display_name(codes: str = "codes", fallback: str = "preferred_name") -> Column:
    """The display of a preferred code, by source order, else the engine's name."""
    of = lambda s: F.try_element_at(F.filter(codes, lambda c: c["is_preferred"] & (c["system"] == s)), F.lit(1))["display"]
    return F.coalesce(*(of(s) for s in SUMMARY_ORDER), F.col(fallback))


def note_summary(mentions: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """One row for each document and concept, in order of first mention: name, group, counts by status, surface forms as first seen, status."""
    rows = mentions.where(F.upper("semantic_group").isin(*(g.upper() for g in groups))) if groups else mentions
    rows = with_status(rows)
    name = display_name() if "codes" in mentions.columns else F.col("preferred_name")
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])).alias("texts")
    out = rows.groupBy("doc_seq", "cui").agg(F.min_by(name, "ord").alias("name"), F.min_by("semantic_group", "ord").alias("semantic_group"), F.min("ord").alias("first_ord"), F.count("*").alias("mentions"), *counts, seen)
    other = F.array_max(F.array(*(F.struct(F.col(f"n_{s}").alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(STATUSES[1:]))))["s"]
    return out.withColumn("status", F.when(F.col("n_affirmed") > 0, "affirmed").otherwise(other))


def concept_summary(mentions: DataFrame, most: int | None = 50) -> DataFrame:
    """A document's concepts by mentions, then name, ``most`` at most (total_concepts and truncated tell; None: all), with assertion combinations by count."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not assessed"))
    answers = ("negated", "subject", "history_of", "uncertain")
    combos = mentions.groupBy("doc_seq", "cui", *(shown(c).alias(c) for c in answers)).agg(F.count("*").alias("n"), F.min("ord").alias("o"))
    listed = combos.groupBy("doc_seq", "cui").agg(F.sum("n").alias("mentions"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), "o", *answers, "n"))).alias("a"))
    names = mentions.groupBy("doc_seq", "cui").agg(F.min_by("preferred_name", "ord").alias("name"), F.min_by("semantic_group", "ord").alias("semantic_group"))
    rows = listed.join(names, ["doc_seq", "cui"]).withColumn("assertions", F.transform("a", lambda x: x.dropFields("rank", "o"))).drop("a")
    by = Window.partitionBy("doc_seq")
    rows = rows.withColumn("total_concepts", F.count("*").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.col("mentions").desc(), "name", "cui")))
    if most is None:
        return rows.withColumn("truncated", F.lit(False))
    return rows.withColumn("truncated", F.col("total_concepts") > most).where(F.col("place") <= most)


def resolve_phrase(mentions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets and dropped concepts of a phrase's mentions: those of the longest spans, and the rest. wanted: mentions after longest_spans."""
    targets = wanted.select("cui", "preferred_name").distinct()
    return targets, mentions.select("cui", "preferred_name").distinct().join(targets.select("cui"), "cui", "left_anti")


def run_counters(docs: DataFrame, mentions: DataFrame, errors: DataFrame) -> DataFrame:
    """documents, duplicates, invalid_utf8, mentions and errors of a run, with up to five duplicate keys as examples."""
    nth = docs.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_seq")))
    d = nth.agg(F.count("*").alias("documents"), F.count_if(F.col("nth") > 1).alias("duplicates"), F.count_if(F.col("replaced") > 0).alias("invalid_utf8"))
    again = nth.where("nth = 2").orderBy("doc_id").limit(5).agg(F.array_sort(F.collect_list("doc_id")).alias("duplicate_examples"))
    return d.crossJoin(mentions.agg(F.count("*").alias("mentions"))).crossJoin(errors.agg(F.count("*").alias("errors"))).crossJoin(again)
