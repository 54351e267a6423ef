"""The mention table and its keys.

One row per mention: span and concept, seven nullable assertion columns (NULL: not assessed, never
false) and provenance.  ``doc_seq`` tells documents apart, since keys may repeat; ``ord`` is a mention's place in its engine's own
order.  Offsets are code points, half-open, into the verbatim text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Assertion columns in their fixed order, with types.
ASSERTIONS = {"negated": "boolean", "subject": "string", "history_of": "boolean", "uncertain": "boolean", "conditional": "boolean", "generic": "boolean", "temporality": "string"}
SUBJECTS = ("patient", "family_member", "other")
SCHEMA_VERSION = "1"
UNIT = "\x1f"

MENTION_COLUMNS = ("doc_seq", "doc_id", "mention_id", "start", "end", "text", "cui", "preferred_name", "semantic_group", *ASSERTIONS)


def mention_id(doc_id: Column | str, start: Column | str, end: Column | str, cui: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the four parts, joined by the unit separator."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (doc_id, start, end, cui)]
    return F.substring(F.sha2(F.concat_ws(UNIT, *(p.cast("string") for p in parts)), 256), 1, 16)


def hash63(text: Column) -> Column:
    """The first eight bytes of the SHA-256 as a number without sign."""
    digest = F.sha2(text, 256)
    top = F.conv(F.substring(digest, 1, 1), 16, 10).cast("int").bitwiseAND(F.lit(7))
    return F.conv(F.concat(top.cast("string"), F.substring(digest, 2, 15)), 16, 10).cast("bigint")


def with_defaults(mentions: DataFrame) -> DataFrame:
    """The mentions with every column of the model; what is missing is NULL (types: an empty array)."""
    have, out = set(mentions.columns), mentions
    for c, kind in ASSERTIONS.items():
        if c not in have:
            out = out.withColumn(c, F.lit(None).cast(kind))
    for c in ("section", "matched_term", "assessed_by"):
        if c not in have:
            out = out.withColumn(c, F.lit(None).cast("string"))
    if "semantic_types" not in have:
        out = out.withColumn("semantic_types", F.array().cast("array<string>"))
    if "found_by" not in have:
        out = out.withColumn("found_by", F.array("engine") if "engine" in have else F.array().cast("array<string>"))
    if "assertion_conflict" not in have:
        out = out.withColumn("assertion_conflict", F.lit(False))
    if "mention_id" not in have:
        out = out.withColumn("mention_id", mention_id("doc_id", "start", "end", "cui"))
    return out


def assertions_struct() -> Column:
    return F.struct(*ASSERTIONS)


def assessed() -> Column:
    """Names of the attributes that some engine assessed."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in ASSERTIONS)))


def documents_with_results(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row per document with its mentions in order; documents without mentions stay."""
    m = with_defaults(mentions)
    provenance = F.struct("found_by", "semantic_types", "matched_term", "assertion_conflict", "assessed_by")
    codes = [F.col("codes")] if "codes" in m.columns else []
    row = F.struct("start", "end", "cui", "mention_id", "text", "preferred_name", "semantic_group", "section", assertions_struct().alias("assertions"), *codes, provenance.alias("provenance"))
    lists = m.groupBy("doc_seq").agg(F.array_sort(F.collect_list(row)).alias("mentions"))
    return docs.join(lists, "doc_seq", "left")


def result_metadata(mode: str, profile: str | None = None, text: str = "text") -> list[Column]:
    """What a result says about its run; timings are left to the manifest."""
    return [F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(mode).alias("mode"), F.lit(profile).cast("string").alias("profile"), F.sha2(F.col(text), 256).alias("content_sha256")]
