"""From raw documents to token counts: five stages, each one operator of ``notegrain.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Every stage takes an empty table (and gives one), null in any column, repeated rows, texts of any length, and columns beside
those of ``documents``, which it leaves out.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from notegrain.llm import langid, minhash, mixing, secrets
from notegrain.llm.bpe import bpe_encode
from notegrain.llm.queries import vocabulary
from notegrain.llm.storage import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the prediction replaces a missing label.

    A document goes if its text is null, has no letter, or costs more than the stated rate of its predicted language's documents do; where no
    row has a label, nothing is learned and nothing is recognised. Rows are judged one by one, so repeats stay together.
    """
    known = langid.identify(docs, langid.learn(docs), keep=("text", "lang", "source", "n_chars"))
    return known.where("accepted").select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Texts without words (null, empty, white space) are in no group and stay. Of rows that repeat an id and a text one stays; a row without an
    id goes if a document has its words, and one of each sequence of words stays among the rest.
    """
    return minhash.distinct_documents(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; ``n_chars`` follows where the text changed. A null text stays null."""
    found = secrets.scan_secrets(docs.select(*COLUMNS)).withColumn("text", secrets.redacted())
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none more than three times; a null source is one source. A text without words is taken as often as the whole part of its source's share."""
    return mixing.take(docs.select(*COLUMNS), mixing.mix(docs)).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes, one row for each document taken; null text is empty."""
    return bpe_encode(docs, vocabulary, public_tokenizers.PATTERN, keep_ids=False)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mix", source_mix), ("bpe", bpe)]

#: SQL can express neither the language models nor the sketches. The tests hold every stage against an independent version: plain Kneser-Ney models,
#: links between all pairs of full sets, patterns of the standard library, targets by a loop, and another tokenizer library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
