"""Reports over mentions, as tables: note summaries, concept dictionary, search history, agreement, blind review, histograms.

Every report is a DataFrame (or a few); writing one file of it is the sinks' affair. Only ``Searches`` keeps state, in tables that grow by appending.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .functions.expressions import context, slice_text
from .model import ASSERTIONS
from .operators import cohort, evaluate
from .operators.spans import group_filter
from .scratch import exists

# What a summary calls the semantic groups, in reading order, and the statuses.
GROUP_TITLES = {"DISORDER": "Problems", "FINDING": "Findings", "DRUG": "Medications", "PROCEDURE": "Procedures", "LAB": "Labs", "ANATOMY": "Anatomy"}
STATUS_LABELS = {"affirmed": "affirmed", "negated": "negated", "other_subject": "someone else's", "hedged": "hedged"}
#: Upper bounds of histogram buckets: fixed values. Seconds and characters.
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.2, 0.35, 0.5, 1, 2, 5, 10, 30)
CHARACTERS = (500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000, 200_000)
#: What a reviewer is asked about an attribute.
REVIEW_QUESTIONS = {
    "negated": "Does the note say that it is absent?",
    "uncertain": "Does the note leave it open?",
    "history_of": "Is it of the past?",
    "subject": "Is it about someone other than the patient?",
    "conditional": "Is it conditional?",
    "generic": "Is it about no one in particular?",
}


def group_rank(group: str = "semantic_group") -> Column:
    """Place of a group in a summary; groups without a title follow, by name."""
    places = F.create_map(*(F.lit(x) for k, g in enumerate(GROUP_TITLES) for x in (g, k)))
    return F.coalesce(F.try_element_at(places, F.col(group)), F.lit(len(GROUP_TITLES)))


def _lookup(table: dict[str, str], key: str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(key))


def unassessed_by_document(mentions: DataFrame) -> DataFrame:
    """(doc_seq, unassessed): the questions that some affirmed mention leaves open, by name."""
    affirmed = cohort.with_status(mentions).where("status = 'affirmed'")
    open_ = F.array_sort(F.array_compact(F.array(*(F.when(F.bool_or(cohort.unassessed(q)), F.lit(q)) for q in cohort.QUESTIONS))))
    return affirmed.groupBy("doc_seq").agg(open_.alias("unassessed"))


def summary_lines(docs: DataFrame, mentions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(doc_seq, doc_id, line_no, line): each note's concepts by group and status, as text. errors: (doc_id, error_type) of notes without a result."""
    concepts = cohort.note_summary(mentions)
    counts = concepts.groupBy("doc_seq").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("concepts"))
    heads = docs.select("doc_seq", "doc_id").join(counts, "doc_seq", "left")
    n, k = F.coalesce("mentions", F.lit(0)), F.coalesce("concepts", F.lit(0))
    at = lambda *parts: F.array(*(F.lit(p) if isinstance(p, int) else p.cast("int") for p in parts)).alias("at")
    no_name = F.lit("").alias("grp")
    lines = heads.select("doc_seq", at(0, 0, 0, 0), no_name, F.format_string("== %s  (%d mentions, %d concepts)", "doc_id", n, k).alias("line"))
    lines = lines.unionByName(heads.where("concepts is null").select("doc_seq", at(1, 0, 0, 0), no_name, F.lit("   no concepts found").alias("line")))
    titled = F.concat(F.lit("   "), F.coalesce(_lookup(GROUP_TITLES, "semantic_group"), F.initcap("semantic_group")), F.lit(" ("), "semantic_group", F.lit(")"))
    lines = lines.unionByName(concepts.select("doc_seq", "semantic_group").distinct().select("doc_seq", at(2, group_rank(), 0, 0), F.col("semantic_group").alias("grp"), titled.alias("line")))
    statuses = list(STATUS_LABELS)
    rank = F.array_position(F.array(*map(F.lit, statuses)), F.col("status")).cast("int")
    listed = concepts.withColumn("rank", rank).withColumn("nth", F.row_number().over(Window.partitionBy("doc_seq", "semantic_group", "status").orderBy("first_ord", "cui")))
    label = F.when(F.col("nth") == 1, F.concat(_lookup(STATUS_LABELS, "status"), F.lit(":"))).otherwise("")
    times = F.when(F.col("mentions") > 1, F.concat(F.lit(" x"), "mentions")).otherwise("")
    others = F.array_compact(F.array(*(F.when((F.col("status") != s) & (F.col(f"n_{s}") > 0), F.concat(F.lit(STATUS_LABELS[s] + " "), f"n_{s}")) for s in statuses)))
    also = F.when(F.size(others) > 0, F.concat(F.lit("  (also "), F.array_join(others, ", "), F.lit(")"))).otherwise("")
    lines = lines.unionByName(listed.select("doc_seq", at(2, group_rank(), F.col("rank"), F.col("nth")), F.col("semantic_group").alias("grp"), F.concat(F.lit("     "), F.rpad(label, 16, " "), F.lit(" "), "name", times, also).alias("line")))
    note = unassessed_by_document(mentions).where("size(unassessed) > 0").select("doc_seq", at(3, 0, 0, 0), no_name, F.concat(F.lit("   note: "), F.array_join("unassessed", ", "), F.lit(" not assessed on some affirmed concepts")).alias("line"))
    lines = lines.unionByName(note).unionByName(heads.select("doc_seq", at(4, 0, 0, 0), no_name, F.lit("").alias("line")))
    order = Window.partitionBy("doc_seq").orderBy(F.col("at")[0], F.col("at")[1], "grp", F.col("at")[2], F.col("at")[3])
    out = lines.withColumn("line_no", F.row_number().over(order)).join(docs.select("doc_seq", "doc_id"), "doc_seq").select("doc_seq", "doc_id", "line_no", "line")
    if errors is None:
        return out
    failed = errors.join(docs.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.posexplode(F.array(F.concat(F.lit("== "), "doc_id"), F.concat(F.lit("   could not be processed: "), "error_type"), F.lit(""))).alias("n", "line"))
    return out.unionByName(failed.select(F.lit(None).cast(dict(docs.dtypes)["doc_seq"]).alias("doc_seq"), "doc_id", (F.col("n") + 1).alias("line_no"), "line"))


def summary_records(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row for each note: doc_id, n_mentions, unassessed and its concepts in order of first mention, for JSON lines."""
    concepts = cohort.note_summary(mentions)
    counts = F.struct(*(F.col(f"n_{s}").alias(s) for s in STATUS_LABELS))
    row = F.struct("first_ord", "cui", "name", F.col("semantic_group").alias("group"), "status", counts.alias("counts"), "texts")
    listed = concepts.groupBy("doc_seq").agg(F.sum("mentions").alias("n_mentions"), F.array_sort(F.collect_list(row)).alias("rows"))
    out = docs.select("doc_seq", "doc_id").join(listed, "doc_seq", "left").join(unassessed_by_document(mentions), "doc_seq", "left")
    empty = F.array().cast("array<string>")
    return out.select("doc_seq", "doc_id", F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"), F.coalesce("unassessed", empty).alias("unassessed"), F.transform("rows", lambda r: r.dropFields("first_ord")).alias("concepts"))


def concept_dictionary(mentions: DataFrame, min_docs: int = 1, groups: list[str] | None = None) -> DataFrame:
    """cui, preferred_name, semantic_group, n_affirmed and n_not_affirmed of a matrix's columns."""
    rows = group_filter(mentions, groups) if groups else mentions
    names = rows.groupBy("cui").agg(F.min_by("preferred_name", F.struct("doc_seq", "ord")).alias("preferred_name"), F.min_by("semantic_group", F.struct("doc_seq", "ord")).alias("semantic_group"))
    return cohort.concept_stats(mentions, min_docs, groups).join(names, "cui").select("cui", "preferred_name", "semantic_group", "n_affirmed", "n_not_affirmed")


class Searches:
    """The history of cohort searches: four tables in a folder that grow by appending, one file set for each search."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def save(self, classified: DataFrame, targets: DataFrame, *, query: str, sources: Sequence[str], mode: str | None = None, console: Sequence[str] = (), errors: DataFrame | None = None) -> str:
        """Append one search: its documents (as classify gives them), target concepts and transcript. Returns its id."""
        key = uuid.uuid4().hex
        tag = lambda df: df.select(F.lit(key).alias("search_id"), *df.columns)
        counts = ("n_affirmed", "n_negated", "n_other_subject", "n_hedged")
        documents = classified.select("doc_id", "status", *counts)
        if errors is not None:
            documents = documents.join(errors.groupBy("doc_id").agg(F.min("error_type").alias("error_type")), "doc_id", "left").withColumn("error_type", F.when(F.col("status") == "error", F.col("error_type")))
        else:
            documents = documents.withColumn("error_type", F.lit(None).cast("string"))
        tag(documents).write.mode("append").parquet(f"{self.folder}/documents")
        names = targets.groupBy("cui").agg(F.min("preferred_name").alias("preferred_name"))
        tag(names).write.mode("append").parquet(f"{self.folder}/concepts")
        lines = self.spark.createDataFrame([(k, x) for k, x in enumerate(console, 1)], "line_no int, line string")
        tag(lines).write.mode("append").parquet(f"{self.folder}/console")
        n = lambda s: F.count_if(F.col("status") == s)
        totals = classified.agg(F.count("*").alias("n_documents"), n("affirmed").alias("n_affirmed"), n("excluded").alias("n_excluded"), n("absent").alias("n_absent"), n("error").alias("n_errors"))
        totals = totals.crossJoin(names.agg(F.array_join(F.array_sort(F.collect_list("cui")), ",").alias("cuis")))
        said = {"ran_at": datetime.now(UTC).isoformat(timespec="seconds"), "query": query, "sources": ";".join(sources), "mode": mode}
        # the search itself comes last: a search cut short is no search
        tag(totals.select(*(F.lit(v).cast("string").alias(k) for k, v in said.items()), *totals.columns)).write.mode("append").parquet(f"{self.folder}/search")
        return key

    def history(self) -> DataFrame:
        """All searches that were saved whole, oldest first."""
        if not exists(self.spark, f"{self.folder}/search"):
            return self.spark.createDataFrame([], "search_id string, ran_at string, query string")
        return self.table("search").orderBy("ran_at")


def disagreements(docs: DataFrame, a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), attributes: Sequence[str] = tuple(ASSERTIONS)) -> DataFrame:
    """Spans on which two annotations differ: doc_id, start, end, text, kind (labels or only one), differs, and each side's concept and labels."""
    key = ["doc_seq", "start", "end"]
    side = lambda df, name: df.select(*key, F.struct("cui", *attributes).alias(name))
    both = side(a, "x").join(side(b, "y"), key, "full")
    parts = [F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in ("cui", *attributes)]
    shared = F.col("x").isNotNull() & F.col("y").isNotNull()
    rows = both.withColumn("differs", F.when(shared, F.array_join(F.array_compact(F.array(*parts)), " ")).otherwise("")).where(~shared | (F.col("differs") != ""))
    kind = F.when(shared, "labels").when(F.col("x").isNotNull(), f"only {names[0]}").otherwise(f"only {names[1]}")
    labels = lambda s: F.coalesce(F.to_json(F.struct(*(F.col(f"{s}.{c}").alias(c) for c in attributes)), {"ignoreNullFields": "false"}), F.lit(""))
    rows = rows.join(docs.select("doc_seq", "doc_id", F.col("text").alias("note")), "doc_seq")
    told = [F.when(F.col(s).isNotNull(), labels(s)).otherwise("").alias(f"labels_{name}") for s, name in zip("xy", names, strict=True)]
    return rows.select("doc_id", "start", "end", slice_text("note", "start", "end").alias("text"), kind.alias("kind"), "differs", *(F.coalesce(F.col(f"{s}.cui"), F.lit("")).alias(f"cui_{name}") for s, name in zip("xy", names, strict=True)), *told)


def agreement_report(docs: DataFrame, a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b"), attributes: Sequence[str] = ("negated", "subject", "history_of", "uncertain")) -> str:
    """Agreement of two annotations as Markdown: counts, F1s, and for each attribute agreement, kappa and positives on shared spans."""
    f1 = evaluate.agreement_f1(a, b).first()
    shared = evaluate.span_agreement(a, b).agg(F.count_if(F.col("kind") == "both").alias("spans"), F.count_if(F.col("cui_a") != F.col("cui_b")).alias("differ")).first()
    key = ["doc_seq", "start", "end"]
    pairs = a.select(*key, F.struct(*attributes).alias("x")).join(b.select(*key, F.struct(*attributes).alias("y")), key)
    out = [f"# Agreement: {names[0]} / {names[1]}", "", f"{docs.count()} notes; spans match exactly unless stated.", "", "| mentions | exact F1 | overlap F1 | shared spans | other concept |", "|---:|---:|---:|---:|---:|"]
    out += [f"| {f1['n_a']} / {f1['n_b']} | {f1['exact_f1']:.3f} | {f1['overlap_f1']:.3f} | {shared['spans']} | {shared['differ']} |", "", "| attribute | agree | kappa | positives |", "|---|---:|---:|---|"]
    for c in attributes:
        both = pairs.select(F.col(f"x.{c}").alias("a"), F.col(f"y.{c}").alias("b")).where("a is not null and b is not null")
        n = both.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(evaluate.positive(c, F.col("a"))).alias("a"), F.count_if(evaluate.positive(c, F.col("b"))).alias("b")).first()
        k = evaluate.kappa(both, "a", "b").first()["kappa"]
        out.append(f"| {c} | {n['same']}/{n['n']} | {'n/a' if k is None else f'{k:.3f}'} | {n['a']} / {n['b']} |")
    return "\n".join(out) + "\n"


def review_strata(labelled: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(mode, attribute, engine_positive, doc_seq, doc_id, start, end, cui): every assessed label of a span once. labelled: mentions with ``mode``."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.col(c).isNotNull().alias("assessed"), F.coalesce(evaluate.positive(c, F.col(c)), F.lit(False)).alias("engine_positive")) for c in attributes)))
    long = labelled.select("mode", "doc_seq", "doc_id", "start", "end", "cui", values.alias("v")).where("v.assessed").select("mode", "v.attribute", "v.engine_positive", "doc_seq", "doc_id", "start", "end", "cui")
    return long.groupBy("mode", "attribute", "engine_positive", "doc_seq", "doc_id", "start", "end").agg(F.max("cui").alias("cui"))


def blind_review(docs: DataFrame, labelled: DataFrame, attributes: Sequence[str] = ("negated", "uncertain", "history_of", "subject"), per_cell: int = 50, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(worksheet, key, totals) of a review that hides what the engines said: ``per_cell`` labels of each mode, attribute and side, drawn by a hash.

    An item is a span and an attribute, however many modes drew it; its number comes from a hash, so neither order nor number tells a side.
    """
    strata = review_strata(labelled, attributes)
    cell = ["mode", "attribute", "engine_positive"]
    totals = strata.groupBy(*cell).agg(F.count("*").alias("total"))
    key = evaluate.stratified(strata, cell, ["doc_seq", "start", "end"], per_cell, seed)
    item = ["doc_seq", "start", "end", "attribute"]
    items = key.select(*item).distinct()  # as many as cells and their size allow
    items = items.withColumn("item", F.concat(F.lit("R"), F.lpad(F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), F.lit("item"), *item), *item)).cast("string"), 4, "0")))
    sheet = items.join(docs.select("doc_seq", F.col("text").alias("note")), "doc_seq")
    sheet = sheet.select("item", "attribute", _lookup(REVIEW_QUESTIONS, "attribute").alias("question"), slice_text("note", "start", "end").alias("mention"), context("note", "start", "end").alias("context"), F.lit("").alias("judgement"), F.lit("").alias("comment"))
    return sheet, key.join(items, item).select("item", *cell, "doc_id", "start", "end", "cui"), totals


def judged_key(key: DataFrame, worksheet: DataFrame) -> DataFrame:
    """The key with the judgements of a filled worksheet; an item without yes, no or unclear is an error."""
    said = worksheet.select("item", F.lower(F.trim(F.coalesce("judgement", F.lit("")))).alias("judgement"))
    if bad := said.where(~F.col("judgement").isin("yes", "no", "unclear")).select("item").orderBy("item").first():
        raise ValueError(f"no yes, no or unclear for item {bad['item']}")
    return key.join(said, "item")


def histogram(rows: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, le, n): how many values reach each bound at most, and all of them (le: infinity), with their sum in the last row."""
    counts = rows.groupBy(*by).agg(F.sum(value).alias("total"), *(F.count_if(F.col(value) <= F.lit(float(b))).alias(f"n{k}") for k, b in enumerate((*bounds, float("inf")))))
    pairs = F.explode(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"n{k}").alias("n")) for k, b in enumerate((*bounds, float("inf"))))))
    return counts.select(*by, pairs.alias("p"), "total").select(*by, "p.le", "p.n", F.when(F.col("p.le") == float("inf"), F.col("total")).alias("total"))
