"""The four questions a service asks, as functions: limits are checked here, answers are small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .extractor import Extractor
from .operators import cohort, lexicon as lex
from .operators.terminology import TerminologyStore, system

MAX_TEXT = 200_000
MAX_CONCEPTS = 500
MAX_RESULTS = 100


def _within(name: str, value: int, most: int) -> int:
    if not 1 <= value <= most:
        raise ValueError(f"{name} must lie between 1 and {most}: {value}")
    return value


def extract_concepts(spark: SparkSession, extractor: Extractor, text: str, max_concepts: int = 50) -> DataFrame:
    """A text's concepts with their assertion combinations, most mentions first."""
    if not text or len(text) > MAX_TEXT:
        raise ValueError(f"text must have 1 to {MAX_TEXT} characters")
    docs = spark.createDataFrame([(0, "request", text)], "doc_seq bigint, doc_id string, text string")
    return cohort.concept_summary(extractor.mentions(docs), _within("max_concepts", max_concepts, MAX_CONCEPTS)).orderBy("place")


def lookup_concept(store: TerminologyStore, cui: str) -> DataFrame:
    """A concept's preferred codes by source, and its display name."""
    rows = store.codes.where((F.col("cui") == cui.strip().upper()) & F.col("is_preferred"))
    return rows.join(store.preferred_display(), "cui").select("cui", "display", "sab", "code", "tty", F.col("str").alias("name")).orderBy("sab", "code", "tty")


def crosswalk_code(store: TerminologyStore, source: str, code: str, target: str) -> DataFrame:
    """Codes of another source for the concepts of a code."""
    return store.crosswalk(system(source), system(target), code.strip()).orderBy("cui", "target_code")


def search_terms(lexicon: DataFrame, term: str, max_results: int = 20) -> DataFrame:
    """Concepts of a term."""
    if not term.strip():
        raise ValueError("term is empty")
    return lex.lookup_term(lexicon, term, _within("max_results", max_results, MAX_RESULTS))
