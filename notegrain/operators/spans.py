"""Span operators: headings, longest spans, group and guideline filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.expressions import running_offsets, slice_text, strip

# Fixed values of the annotation guidelines: semantic types that are never clinical content.
OUT_OF_SCOPE_TYPES = (
    "T028", "T034", "T059", "T077", "T078", "T079", "T080", "T081", "T082", "T089",
    "T090", "T097", "T098", "T099", "T100", "T101", "T169", "T170", "T185", "T201",
)
# Fixed values of the annotation guidelines: whole spans that are excluded, lower-cased.
STOP_TEXTS = (
    "patient", "patients", "patient reports", "man", "woman", "male", "female",
    "mild", "moderate", "severe", "left", "right", "bilateral", "acute", "chronic",
    "year", "years", "day", "days", "week", "weeks", "month", "months", "today",
    "worse", "better", "unchanged", "stable", "improved", "normal", "abnormal", "soft",
    "present", "active", "positive", "negative",
    "history", "history of", "denies", "no", "possible", "with", "for",
    "chief complaint", "complaint", "illness", "history of present illness",
    "medical history", "past medical history", "family history", "social history",
    "assessment", "plan", "assessment and plan", "medications", "medication",
    "disease", "diagnosis", "discharge", "admission", "consultation", "visit",
)
# Labels that are headings whatever follows the colon, lower-cased.
SECTION_LABELS = (
    "chief complaint", "hpi", "history of present illness", "past medical history", "pmh",
    "past surgical history", "psh", "family history", "social history", "medications",
    "allergies", "review of systems", "ros", "physical exam", "physical examination",
    "exam", "examination", "vitals", "vital signs", "labs", "laboratory", "imaging",
    "assessment", "plan", "assessment and plan", "a/p", "impression", "diagnosis",
    "diagnoses", "hospital course", "disposition", "follow-up", "follow up",
    "general", "constitutional", "heent", "head", "eyes", "ears", "nose", "throat", "neck",
    "chest", "lungs", "pulmonary", "respiratory", "heart", "cardiac", "cardiovascular",
    "cardiopulmonary", "abdomen", "abdominal", "gi", "gu", "genitourinary", "rectal",
    "back", "spine", "extremities", "musculoskeletal", "msk", "skin", "integumentary",
    "neuro", "neurologic", "neurological", "psych", "psychiatric", "lymph nodes",
    "lymphatic", "breast", "pelvic",
)
# Fixed value: the shape of a line-leading label, and what follows its colon.
LABEL = r"^[ \t]*([A-Za-z][A-Za-z0-9 /&()',.-]{0,48}?)[ \t]*:([^\n]*)"


def headings(docs: DataFrame) -> DataFrame:
    """(doc_seq, start, end) of line-leading labels that head a section.

    Lines are split at ``\\n`` only; a label has at most four words that each begin upper-case or with no letter, and is a heading
    if nothing follows its colon, if it is in capitals, or if it is a known section name.
    """
    lines = docs.where(F.col("text").contains(":")).select("doc_seq", F.split("text", "\n", -1).alias("lines")).withColumn("at", F.expr(running_offsets("lines", 1)))
    lines = lines.select("doc_seq", F.expr("inline(filter(arrays_zip(lines, at), x -> x.lines rlike '^[ \\\\t]*[A-Za-z]' and contains(x.lines, ':')))"))
    label, rest = F.regexp_extract("lines", LABEL, 1), F.regexp_extract("lines", LABEL, 2)
    found = lines.select("doc_seq", "lines", "at", label.alias("label"), rest.alias("rest")).where("label <> ''")
    lead = F.char_length(F.regexp_extract("lines", r"^[ \t]*", 0))
    words = F.expr("filter(split(label, ' +'), w -> w <> '')")
    # every code point but a lower-case letter may begin a word: labels are ASCII
    titled = F.forall(words, lambda w: ~w.rlike("^[a-z]"))
    head = (strip(F.col("rest")) == "") | (F.upper("label") == F.col("label")) | F.lower("label").isin(*SECTION_LABELS)
    begin = (F.col("at") + lead).cast("int")
    return found.where((F.size(words) <= 4) & titled & head).select("doc_seq", begin.alias("start"), (begin + F.char_length("label")).cast("int").alias("end"))


def in_headings(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """The mentions with ``in_heading``: whether a heading covers them. A document's headings come as one array, so no pairs are made."""
    heads = headings(docs).groupBy("doc_seq").agg(F.collect_list(F.struct("start", "end")).alias("__heads"))
    out = mentions.join(heads, "doc_seq", "left")
    inside = F.exists(F.col("__heads"), lambda h: (h["start"] <= F.col("start")) & (F.col("end") <= h["end"]))
    return out.withColumn("in_heading", F.coalesce(inside, F.lit(False))).drop("__heads")


def unassess_heading_history(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """``history_of`` is not assessed inside a heading; the mention stays."""
    out = in_headings(mentions, docs)
    return out.withColumn("history_of", F.when(~F.col("in_heading"), F.col("history_of"))).drop("in_heading")


def group_filter(mentions: DataFrame, groups: list[str]) -> DataFrame:
    """Mentions of these semantic groups, in any case of letters."""
    return mentions.where(F.upper("semantic_group").isin(*(g.upper() for g in groups)))


def in_scope(types: str = "semantic_types") -> Column:
    """Not all of its types are out of scope; no types at all is in scope."""
    return (F.size(types) == 0) | ~F.forall(F.col(types), lambda t: t.isin(*OUT_OF_SCOPE_TYPES))


def one_concept_per_span(mentions: DataFrame, standard: str | None = None) -> DataFrame:
    """For each span, the concept with a standard code first, then the engine's order, then the concept.

    standard: a boolean column, or None where no store tells.
    """
    first = [F.when(F.col(standard), 0).otherwise(1)] if standard else []
    best = Window.partitionBy("doc_seq", "start", "end").orderBy(*first, "ord", "cui")
    return mentions.withColumn("__rank", F.row_number().over(best)).where("__rank = 1").drop("__rank")


def outermost(mentions: DataFrame) -> DataFrame:
    """Without spans inside another; spans must be distinct. In order of start, longest first, a span lies in another if an earlier one reaches as far."""
    earlier = Window.partitionBy("doc_seq").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return mentions.withColumn("__reach", F.max("end").over(earlier)).where("__reach is null or __reach < end").drop("__reach")


def longest_spans(mentions: DataFrame) -> DataFrame:
    """Of overlapping spans the longest, then the first; equal spans are all kept.

    Greedy, so an overlap with a span that was itself dropped doesn't count: a fold over the document's distinct spans. A document's mentions come
    together once, and those on kept spans leave as they came.
    """
    rows = mentions.groupBy("doc_seq").agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in mentions.columns))).alias("rows"))
    spans = rows.withColumn("s", F.expr("array_sort(array_distinct(transform(rows, x -> named_struct('size', x.start - x.end, 'start', x.start, 'end', x.end))))"))
    fold = "aggregate(s, cast(array() as array<struct<start:int,end:int>>), (a, x) -> if(exists(a, k -> x.start < k.end and k.start < x.end), a, array_append(a, named_struct('start', int(x.start), 'end', int(x.end)))))"
    kept = spans.withColumn("k", F.expr(f"map_from_entries(transform({fold}, x -> struct(concat(x.start, ':', x.end), true)))"))
    return kept.select(F.expr("inline(filter(rows, x -> map_contains_key(k, concat(x.start, ':', x.end))))"))


def guideline_filter(mentions: DataFrame, docs: DataFrame, standard: str | None = None) -> DataFrame:
    """Headings, out-of-scope types and stop texts go, then one concept per span, then outermost spans: in this order."""
    note = docs.select("doc_seq", F.col("text").alias("__note"))
    rows = in_headings(mentions, docs).where(~F.col("in_heading")).drop("in_heading").join(note, "doc_seq")
    rows = rows.where(in_scope() & ~F.lower(strip(slice_text("__note", "start", "end"))).isin(*STOP_TEXTS)).drop("__note")
    return outermost(one_concept_per_span(rows, standard))


def adjacent_overlaps(mentions: DataFrame) -> DataFrame:
    """Mentions that begin before the one before them (by start, longest first) ends."""
    w = Window.partitionBy("doc_seq").orderBy("start", F.col("end").desc())
    return mentions.withColumn("previous_end", F.lag("end").over(w)).where("previous_end > start")


def segments(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """The text cut at every span's bounds: (doc_seq, start, end, covering concepts, longest first)."""
    bounds = docs.select("doc_seq", F.explode(F.array(F.lit(0), F.char_length("text"))).alias("cut"))
    cuts = bounds.unionByName(mentions.select("doc_seq", F.explode(F.array("start", "end")).alias("cut"))).distinct()
    parts = cuts.withColumn("until", F.lead("cut").over(Window.partitionBy("doc_seq").orderBy("cut"))).where("until is not null")
    m = mentions.groupBy("doc_seq").agg(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("size"), "start", "end", "cui")).alias("__m"))
    over = "transform(array_sort(filter(__m, m -> m.start <= cut and until <= m.end)), m -> m.cui)"
    return parts.join(m, "doc_seq", "left").select("doc_seq", F.col("cut").alias("start"), F.col("until").alias("end"), F.coalesce(F.expr(over), F.array().cast("array<string>")).alias("cuis"))
