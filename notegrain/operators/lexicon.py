"""Dictionary matching: documents and a lexicon (term, cui, preferred_name, semantic_group, semantic_types) to mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.expressions import running_offsets, slice_text
from ..model import mention_id


def first_hits(docs: DataFrame, lexicon: DataFrame, engine: str = "first_hit") -> DataFrame:
    """The first case-insensitive hit of every term in every document, word bounds or not.

    Negated if "no " stands between the last full stop and the hit.  Every term is looked for in every document, so
    the lexicon must be small: it is put into one array that travels with the plan.
    """
    terms = lexicon.agg(F.array_sort(F.collect_list(F.struct("term", "cui", "preferred_name", "semantic_group"))).alias("terms"))
    found = docs.crossJoin(terms).withColumn("t", F.explode(F.expr("filter(terms, t -> locate(t.term, lower(text)) > 0)")))
    found = found.select("doc_seq", "doc_id", F.col("text").alias("note"), "t.*").withColumn("start", F.expr("cast(locate(term, lower(note)) - 1 as int)"))
    found = found.withColumn("end", (F.col("start") + F.char_length("term")).cast("int"))
    before = F.expr("substring_index(substring(lower(note), 1, start), '.', -1)")
    return found.select(
        "doc_seq", "doc_id", mention_id("doc_id", "start", "end", "cui").alias("mention_id"), "start", "end",
        slice_text("note", "start", "end").alias("text"), "cui", "preferred_name", "semantic_group",
        before.contains("no ").alias("negated"), F.lit(engine).alias("engine"),
    )


def match_terms(docs: DataFrame, lexicon: DataFrame, engine: str = "broad", longest: int = 4) -> DataFrame:
    """Every occurrence of every term at word bounds, one mention for each distinct concept of a span.

    Word n-grams of up to ``longest`` words are joined to the lexicon on the lower-cased term; the words of a
    term are separated by one character, as written in the term.  ``ord`` numbers a document's mentions by span, then concept.
    """
    pieces = docs.select("doc_seq", "doc_id", F.regexp_extract_all("text", F.lit(r"(?U)\w+|\W+"), F.lit(0)).alias("pieces"))
    # words and what stands between them alternate, so every second piece is a word: no gram needs a look at its ends
    pieces = pieces.where("size(pieces) > 0").select("*", F.expr(running_offsets("pieces")).alias("at"), F.expr("if(pieces[0] rlike r'(?U)^\\w', 1, 2)").alias("first"))
    spans = ", ".join(
        f"if(size(pieces) >= first + {2 * n - 2}, transform(sequence(first, size(pieces) - {2 * n - 2}, 2), i -> named_struct('start', at[i - 1], 'surface', array_join(slice(pieces, i, {2 * n - 1}), ''))), array())" for n in range(1, longest + 1)
    )
    grams = pieces.select("doc_seq", "doc_id", F.expr(f"inline(concat({spans}))")).withColumn("key", F.lower("surface"))
    types = [F.array_sort("semantic_types").alias("semantic_types")] if "semantic_types" in lexicon.columns else []
    terms = lexicon.groupBy(F.col("term").alias("matched_term"), "cui").agg(*(F.min(c).alias(c) for c in lexicon.columns if c not in ("term", "cui")))
    hit = grams.join(terms, F.col("key") == F.col("matched_term"))
    hit = hit.select("doc_seq", "doc_id", "start", (F.col("start") + F.char_length("surface")).cast("int").alias("end"), F.col("surface").alias("text"), "cui", "preferred_name", "semantic_group", "matched_term", *types, F.lit(engine).alias("engine"))
    return hit.withColumn("ord", F.row_number().over(Window.partitionBy("doc_seq").orderBy("start", "end", "cui")) - 1).withColumn("mention_id", mention_id("doc_id", "start", "end", "cui"))


def lookup_term(lexicon: DataFrame, term: str, most: int | None = None) -> DataFrame:
    """(cui, preferred_name) of a term, one name for each concept; most: at most so many, by concept."""
    found = lexicon.where(F.col("term") == F.lower(F.trim(F.lit(term)))).groupBy("cui").agg(F.min("preferred_name").alias("preferred_name"))
    return found.orderBy("cui").limit(most) if most is not None else found
