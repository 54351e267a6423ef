"""Documents to mentions: engines, combination, and the fixed order of what follows."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable, Iterator
from multiprocessing.connection import Connection

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .config import Config
from .model import documents_with_results, result_metadata, with_defaults
from .operators import assertions, ensemble, lexicon as lex, spans
from .operators.terminology import TerminologyStore

Engine = Callable[[DataFrame], DataFrame]
#: Given another engine's mentions and the documents, the mentions with their assertions; NULL where a span can't be assessed.
Assessor = Callable[[DataFrame, DataFrame], DataFrame]
#: Groups of the clinical engine.
CLINICAL_GROUPS = ("ANATOMY", "DISORDER", "DRUG", "FINDING", "PROCEDURE")


def broad_engine(lexicon: DataFrame, negation: str = "negex") -> Engine:
    """All lexicon hits with their types; negation, and with "context" also subject and temporality."""

    def run(docs: DataFrame) -> DataFrame:
        return assertions.assess(with_defaults(lex.match_terms(docs, lexicon, ensemble.BROAD)), docs, ("negated", "subject", "temporality") if negation == "context" else ("negated",))

    return run


def clinical_engine(lexicon: DataFrame) -> Engine:
    """Hits of the clinical groups, with negation, subject, history and uncertainty; no types."""

    def run(docs: DataFrame) -> DataFrame:
        found = lex.match_terms(docs, lexicon.where(F.upper("semantic_group").isin(*CLINICAL_GROUPS)).drop("semantic_types"), ensemble.CLINICAL)
        return assertions.assess(with_defaults(found), docs, ("negated", "subject", "history_of", "uncertain"))

    return run


class _Matcher:
    """A third-party matcher in a process of its own, begun anew after a timeout or its death."""

    def __init__(self, make: Callable[[], Callable[[str, str], list[dict]]], timeout: float | None):
        self.make, self.timeout, self.child, self.pipe = make, timeout, None, None

    def __call__(self, text: str, key: str) -> list[dict]:
        if self.child is None or not self.child.is_alive():
            context = multiprocessing.get_context("fork")
            self.pipe, theirs = context.Pipe()
            self.child = context.Process(target=_serve, args=(self.make, theirs), daemon=True)
            self.child.start()
            theirs.close()
        try:
            self.pipe.send((text, key))
            if not self.pipe.poll(self.timeout):
                raise TimeoutError
            found, error = self.pipe.recv()
        except (TimeoutError, EOFError, OSError) as e:
            self.close()
            raise _Failed("Timeout" if isinstance(e, TimeoutError) else "WorkerDied") from None
        if error is not None:
            raise _Failed(error)
        return found

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.pipe.close()
            self.child = None


class _Failed(Exception):
    """args: the type of what went wrong."""


def _serve(make: Callable[[], Callable[[str, str], list[dict]]], pipe: Connection) -> None:
    engine = make()
    while True:
        try:
            text, key = pipe.recv()
        except EOFError:
            return
        try:
            answer = engine(text, key), None
        except Exception as e:
            answer = None, type(e).__name__
        pipe.send(answer)


def python_engine(make: Callable[[], Callable[[str, str], list[dict]]], schema: str, *, timeout: float | None = None) -> Engine:
    """A third-party matcher, in a process of its own beside each task; a document that fails becomes a row with ``error_type`` and nothing else.

    The function made takes (text, doc_id) and returns mentions as dicts of the schema's columns. error_type: the type of the exception, Timeout
    after so many seconds for one document, or WorkerDied where the matcher took its process down; the documents after it go to a new one.
    """

    def run(docs: DataFrame) -> DataFrame:
        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            engine, names = _Matcher(make, timeout), [c.strip().split(" ")[0] for c in schema.split(",")]
            try:
                for batch in batches:
                    rows: list[dict] = []
                    for seq, key, text in zip(*(batch[c].to_pylist() for c in ("doc_seq", "doc_id", "text")), strict=True):
                        try:
                            found = [{"doc_seq": seq, "doc_id": key, "error_type": None} | m for m in engine(text or "", key)]
                        except _Failed as e:  # data of the run: its type only, never its text
                            found = [{"doc_seq": seq, "doc_id": key, "error_type": e.args[0]}]
                        rows += [{"ord": k} | m for k, m in enumerate(found)]
                    columns = ["doc_seq", "doc_id", "ord", "error_type", *names]
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kinds.field(c).type) for c in columns], columns)
            finally:
                engine.close()

        out = f"doc_seq bigint, doc_id string, ord int, error_type string, {schema}"
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(docs.sparkSession.createDataFrame([], out).schema)
        return docs.select("doc_seq", "doc_id", "text").mapInArrow(extract, out)

    return run


class Extractor:
    """Applies a configuration to documents (doc_seq, doc_id, text)."""

    def __init__(self, config: Config, lexicon: DataFrame | None = None, *, engines: dict[str, Engine] | None = None, store: TerminologyStore | None = None, assessor: Assessor | None = None):
        self.config = config
        if engines is None:
            if lexicon is None:
                raise ValueError("a lexicon or engines are needed")
            engines = {ensemble.BROAD: broad_engine(lexicon, config.negation), ensemble.CLINICAL: clinical_engine(lexicon)}
        self.engines, self.store = engines, store
        self.assessor = assessor or (lambda found, docs: assertions.assess_spans(found, docs, ("negated", "subject", "history_of", "uncertain")))
        if config.code_systems:
            if store is None:
                raise ValueError("code_systems need a terminology store")
            store.require(hierarchy=config.ancestor_depth > 0, ingredients=config.include_ingredients)

    def _found(self, docs: DataFrame) -> DataFrame:
        mode, kind = self.config.mode.split(":")
        if mode == "single":
            return with_defaults(self.engines[kind](docs))
        if kind == "hybrid":
            concepts = with_defaults(self.engines[ensemble.BROAD](docs))
            return ensemble.hybrid(concepts, self.assessor(concepts, docs))
        both = [with_defaults(self.engines[e](docs)) for e in (ensemble.CLINICAL, ensemble.BROAD)]
        combine = ensemble.union if kind == "union" else ensemble.consensus
        return _ordered(combine(*both, self.config.conflict_policy))

    def mentions(self, docs: DataFrame) -> DataFrame:
        """Longest spans, headings' history, groups, guidelines, codes: in this order, since each changes what the next sees."""
        c, found = self.config, self._found(docs)
        if c.overlaps == "longest":
            found = spans.longest_spans(found)
        found = spans.unassess_heading_history(found, docs)
        if c.semantic_groups:
            found = spans.group_filter(found, list(c.semantic_groups))
        if c.mention_filter == "guidelines":
            standard = None
            if self.store is not None:
                found = found.join(self.store.standard().withColumn("__standard", F.lit(True)), "cui", "left").fillna(False, ["__standard"])
                standard = "__standard"
            found = spans.guideline_filter(found, docs, standard).drop("__standard")
        if c.code_systems:
            found = self.store.attach(found, systems=c.code_systems, ancestor_depth=c.ancestor_depth, ingredients=c.include_ingredients)
        return found

    def results(self, docs: DataFrame) -> DataFrame:
        """One row for each document with its mentions and how they were made."""
        out = documents_with_results(docs.select("doc_seq", "doc_id", "text"), self.mentions(docs))
        tie = F.lit("standard_code" if self.store is not None else "engine_order") if self.config.mention_filter == "guidelines" else F.lit(None).cast("string")
        out = out.select("*", *result_metadata(self.config.mode, self.config.profile), tie.alias("guideline_tie_break"))
        return out if self.config.include_text else out.drop("text")

    def process(self, spark: SparkSession, text: str, doc_id: str = "doc") -> DataFrame:
        return self.results(spark.createDataFrame([(0, doc_id, text)], "doc_seq bigint, doc_id string, text string"))


def _ordered(mentions: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return mentions.withColumn("ord", F.row_number().over(Window.partitionBy("doc_seq").orderBy("start", "end", "cui")) - 1)
