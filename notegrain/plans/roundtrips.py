"""Registered queries that write with the sinks and read with the sources, each with SQL over the original tables.

Files are made from the driver's tables, in a folder that all executors share; one file for each row is made of the tables of fixed size only.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import reports, run as runs
from ..config import Config
from ..extractor import Extractor, python_engine
from ..model import with_defaults
from ..operators import assertions, cohort, ensemble, evaluate, gold, lexicon as lex, matching, omop, spans, terminology as term
from ..scratch import shared_folder
from ..sinks import writers
from ..sources import readers, references
from ..streaming import resume
from . import notes as N
from .catalog import _ID, _NLP, _STATUS, _codes, _lookup, _query, _store


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/notegrain/io-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).create(target)
    out.write(bytearray(content))
    out.close()


def one_file(lines: DataFrame, order: list[str], path: str, **options: str) -> str:
    """The column ``value`` as one text file in this order."""
    lines.orderBy(*order).select("value").coalesce(1).write.options(**options).text(path)
    return path


def mod(column: str, n: int) -> Column:
    return F.pmod(F.col(column), F.lit(n))


# --- documents -------------------------------------------------------------------------------------------------------

_RECORDS = """WITH n AS (SELECT doc_id, text, doc_id % 10 k, row_number() OVER (ORDER BY doc_id) line_no FROM documents),
r AS (SELECT line_no, k, CASE WHEN k = 0 THEN 'JSONDecodeError' WHEN k IN (1, 3) THEN 'TypeError' WHEN k = 2 OR k IN (5, 8, 9) AND text IS NULL THEN 'KeyError' END error_type,
  CASE k WHEN 5 THEN 'k' || doc_id WHEN 6 THEN '0' WHEN 7 THEN 'file:' || line_no ELSE 'd' || doc_id END key, CASE k WHEN 6 THEN 'zero' WHEN 7 THEN 'bare' ELSE text END t FROM n WHERE k <> 4)
SELECT line_no, error_type, CASE WHEN error_type IS NULL THEN key END key, CASE WHEN error_type IS NULL THEN sha256(t) END sha FROM r"""


def _records(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    docs, k = N.read(spark, sf_dir, "documents"), mod("doc_id", 10)
    named = F.to_json(F.struct(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))
    keyed = F.to_json(F.struct(F.lit("").alias("id"), F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text"))
    fixed = {0: "not json", 1: "[1]", 2: '{"id":"x"}', 3: '{"text":5}', 4: "  ", 6: '{"id":0,"text":"zero"}', 7: '{"text":"bare"}'}
    value = reduce(lambda out, kv: out.when(k == kv[0], F.lit(kv[1])), fixed.items(), F.when(k == 5, keyed)).otherwise(named)
    place = one_file(docs.select("doc_id", value.alias("value")), ["doc_id"], folder(spark), **options)
    good, bad = readers.read_lines(spark, place)
    none = F.lit(None).cast("string")
    good = good.select("line_no", none.alias("error_type"), F.regexp_replace("doc_id", "^part-[^:]*:", "file:").alias("key"), F.sha2("text", 256).alias("sha"))
    return good.unionByName(bad.select(F.substring_index("doc_key", ":", -1).cast("bigint").alias("line_no"), "error_type", none.alias("key"), none.alias("sha")))


@_query(_RECORDS)
def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir)


@_query(_RECORDS)
def read_gzip_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir, compression="gzip")


_ENDS = ("txt", "TEXT", "md", "csv")


def _nation_folder(spark: SparkSession, sf_dir: str) -> str:
    """Nations as files of several suffixes: with a byte-order mark, with an invalid byte, with a carriage return, or plain."""
    place = folder(spark)
    for r in N.read(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        k, text = r["n_nationkey"], r["n_name"].encode()
        content = b"\xef\xbb\xbf" + text if k % 5 == 0 else text + b"\xff" if k % 5 == 1 else text + b"\r\n" if k % 5 == 2 else text
        put(spark, f"{place}/part{k % 3}/n{k:02d}.{_ENDS[k % 4]}", content)
    return place


_NATION_TEXT = "n_name || CASE n_nationkey % 5 WHEN 1 THEN chr(65533) WHEN 2 THEN chr(13) || chr(10) ELSE '' END"
_STEM = "'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"


@_query(f"""WITH f AS (SELECT n_nationkey k, {_STEM} stem, sha256({_NATION_TEXT}) sha, CASE WHEN n_nationkey % 5 = 1 THEN 1 ELSE 0 END replaced, n_nationkey % 4 < 2 inside FROM nation WHERE n_nationkey % 4 < 2 OR n_nationkey = 2)
SELECT stem, sha, replaced, row_number() OVER (ORDER BY inside, k % 3, stem) place FROM f""")
def read_text_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file named first, whatever its suffix, then the folder's texts at any depth."""
    place = _nation_folder(spark, sf_dir)
    docs, _ = readers.read_documents(spark, [f"{place}/part2/n02.md", place])
    return docs.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("stem"), F.sha2("text", 256).alias("sha"), "replaced", F.row_number().over(Window.orderBy("doc_seq")).cast("bigint").alias("place"))


@_query(f"SELECT {_STEM} stem FROM nation WHERE n_nationkey % 4 >= 2")
def skipped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.skipped_in_folders(spark, [_nation_folder(spark, sf_dir)]).select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("stem"))


@_query(f"""SELECT {_STEM} stem, CAST(octet_length(encode(n_name)) + CASE n_nationkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS BIGINT) length, n_nationkey % 5 > 2 AS plain,
CASE WHEN n_nationkey % 5 > 2 THEN sha256(n_name) END sha FROM nation""")
def input_file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _nation_folder(spark, sf_dir)
    now = readers.input_files(spark, [place])
    again = readers.reused_hashes(now.drop("sha256"), now)
    key = F.regexp_extract("path", r"n(\d+)\.", 1).cast("int")
    return again.select(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1).alias("stem"), "length", (F.pmod(key, F.lit(5)) > 2).alias("plain"), F.when(F.pmod(key, F.lit(5)) > 2, F.col("sha256")).alias("sha"))


@_query(f"SELECT {_STEM} doc_id, sha256(n_name) sha FROM nation")
def export_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("doc_id"), F.col("n_name").alias("text"))
    place = tempfile.mkdtemp() + "/texts"
    writers.export_texts(rows, place)
    found = [(p.stem, p.read_bytes().decode()) for p in sorted(Path(place).iterdir())]
    return spark.createDataFrame(found, "doc_id string, text string").select("doc_id", F.sha2("text", 256).alias("sha"))


@_query("SELECT event_id doc_seq, CASE WHEN user_id % 3 = 0 THEN 'doc-' || CASE WHEN n < 1000000 THEN lpad(CAST(n AS VARCHAR), 6, '0') ELSE CAST(n AS VARCHAR) END ELSE CAST(user_id AS VARCHAR) END doc_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) n FROM events)")
def numbered_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = N.read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_seq"), F.when(mod("user_id", 3) != 0, F.col("user_id").cast("string")).alias("doc_id"))
    return readers.auto_ids(docs).select("doc_seq", "doc_id")


@_query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10")
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is what is asked for."""
    return readers.limited(N.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_seq"), "doc_id"), 10).select("doc_id")


@_query("SELECT 'note-' || o_orderkey doc_id, o_custkey note_id FROM orders")
def note_id_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark)
    rows = N.read(spark, sf_dir, "orders").select(F.concat(F.lit("note-"), "o_orderkey").alias("doc_id"), F.concat(F.lit(" "), "o_custkey").alias("note_id"))
    rows.unionByName(rows.limit(3)).write.option("header", True).csv(place)  # a row that says the same again is no error
    return readers.load_note_ids(spark, place)


@_query("SELECT CASE o_orderkey % 3 WHEN 1 THEN ' ' || o_orderkey || chr(9) ELSE CAST(o_orderkey AS VARCHAR) END doc_id, o_orderkey note_id FROM orders WHERE o_orderkey % 3 < 2")
def note_ids_from_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(mod("o_orderkey", 3) == 1, F.concat(F.lit(" "), "o_orderkey", F.lit("\t"))).when(mod("o_orderkey", 3) == 2, F.concat(F.lit("n"), "o_orderkey")).otherwise(F.col("o_orderkey").cast("string"))
    return omop.note_id_from_key(N.read(spark, sf_dir, "orders").select(key.alias("doc_id")))


@_query("SELECT 'note-' || o_orderkey doc_id FROM orders WHERE o_orderkey % 4 = 0")
def notes_without_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = N.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_seq"), F.concat(F.lit("note-"), "o_orderkey").alias("doc_id"))
    return omop.missing_note_ids(orders, orders.where(mod("doc_seq", 4) != 0).select("doc_id", F.col("doc_seq").alias("note_id"))).select("doc_id")


@_query("SELECT DISTINCT CAST(user_id AS VARCHAR) doc_key, 'Timeout' error_type FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'click' AND x.user_id % 2 = 0)")
def outstanding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = N.read(spark, sf_dir, "events").withColumn("key", F.col("user_id").cast("string"))
    errors = events.where("event_type = 'error'").select(F.col("key").alias("doc_key"), F.lit("Timeout").alias("error_type")).distinct()
    return runs.outstanding_errors(errors, events.where("event_type = 'click' and user_id % 2 = 0").select(F.col("key").alias("doc_id")))


@_query("SELECT CASE n_nationkey % 4 WHEN 0 THEN 'Timeout' WHEN 1 THEN 'KeyError' WHEN 2 THEN 'WorkerDied' END error_type, CASE WHEN n_nationkey % 4 = 3 THEN n_name END cui FROM nation WHERE n_nationkey < 4 OR n_nationkey % 4 = 3")
def matcher_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matcher that hangs, raises or dies on some texts: each is one error row, and the others have their mentions."""
    docs = N.read(spark, sf_dir, "nation").where("n_nationkey < 4 or n_nationkey % 4 = 3").select(F.col("n_nationkey").alias("doc_seq"), F.concat(F.col("n_nationkey").cast("string")).alias("doc_id"), F.col("n_name").alias("text"))

    def make():
        import os
        import time

        def engine(text: str, key: str) -> list[dict]:
            kind = int(key) % 4
            if kind == 0:
                time.sleep(30)
            if kind == 1:
                raise KeyError(key)
            if kind == 2:
                os._exit(3)
            return [{"start": 0, "end": len(text), "cui": text}]

        return engine

    return python_engine(make, "start int, end int, cui string", timeout=2.0)(docs).select("error_type", "cui")


@_query("SELECT 1 AS session, 13 AS processed, 0 AS skipped, 13 AS documents UNION ALL SELECT 2, 12, 13, 25")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run folder that is given more documents: what is finished is passed over."""
    docs = N.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_seq"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("doc_id"), F.col("n_name").alias("text"), F.lit(0).alias("replaced"))
    ex, none, place = Extractor(Config(), N.lexicon(spark, sf_dir)), spark.createDataFrame([], "doc_key string, stage string, error_type string"), tempfile.mkdtemp() + "/run"
    runs.run(spark, ex, docs.where("doc_seq < 13"), none, place, inputs=["a"])
    manifest = runs.run(spark, ex, docs, none, place, inputs=["a", "b"])
    return spark.createDataFrame([(s["session"], s["processed"], s["skipped"], s["documents"]) for s in manifest["sessions"]], "session int, processed int, skipped int, documents int")


@_query("SELECT n_nationkey % 2 AS batch, CAST(sum(length(n_name)) AS BIGINT) chars FROM nation GROUP BY 1")
def stream_only_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream started twice on one checkpoint: the second time it takes the new files only."""
    source, out, mark = (folder(spark) for _ in range(3))
    rows = N.read(spark, sf_dir, "nation").collect()  # 25 rows at any scale
    for turn in range(2):
        for r in rows:
            if r["n_nationkey"] % 2 == turn:
                put(spark, f"{source}/n{r['n_nationkey']}.txt", r["n_name"].encode())
        resume.process_new(resume.text_stream(spark, source), lambda docs: docs.select(F.char_length("text").alias("n")), out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("batch").agg(F.sum("n").alias("chars")).select("batch", "chars")


# --- results ---------------------------------------------------------------------------------------------------------


@_query(f"WITH {N.MENTIONS} SELECT doc_id, start, \"end\", text, cui, negated, 'broad' found_by, tui FROM broad")
def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark)
    writers.write_parquet(N.broad(spark, sf_dir), place)
    m = spark.read.parquet(place)
    return m.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "text", "cui", "assertions.negated", F.array_join("provenance.found_by", ",").alias("found_by"), F.array_join("provenance.semantic_types", ",").alias("tui"))


@_query(f"WITH {N.MENTIONS} SELECT cui, count(*) mentions, CAST(count(*) FILTER (negated) AS BIGINT) negated, count(DISTINCT doc_seq) documents FROM broad GROUP BY 1")
def export_sqlite(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = tempfile.mkdtemp() + "/m.sqlite"
    writers.write_sqlite(N.notes(spark, sf_dir), N.broad(spark, sf_dir), place)
    n = min(8, os.cpu_count() or 1)
    with ThreadPoolExecutor(n) as pool:
        parts = list(pool.map(lambda k: _counted(place, k, n), range(n)))
    rows = spark.createDataFrame([r for part in parts for r in part], "cui string, mentions long, negated long, documents long")
    return rows.groupBy("cui").agg(*(F.sum(c).alias(c) for c in rows.columns[1:]))


def _counted(place: str, k: int, n: int) -> list[tuple]:
    """Each concept's mentions, negated ones and documents, of every n-th document. The sign keeps the scan off the index on concepts, by which rows lie scattered."""
    of = f"abs(doc_seq) % {n} = {k}"
    with contextlib.closing(sqlite3.connect(place)) as db:
        return db.execute(f"SELECT cui, count(*), sum(negated), count(DISTINCT doc_seq) FROM annotations WHERE {of} AND doc_seq IN (SELECT doc_seq FROM documents WHERE {of}) GROUP BY +cui").fetchall()


_RESULT = "doc_id string, text string, schema_version string, mode string, content_sha256 string, mentions array<struct<start:int,`end`:int,cui:string,mention_id:string>>"


@_query(f"WITH {N.MENTIONS} SELECT n.doc_id, sha256(n.text) content_sha256, n.text = n.text AS has_text, '1' schema_version, 'single:broad' AS mode, count(b.cui) mentions, coalesce(string_agg({_ID.replace('doc_id', 'b.doc_id')}, ' ' ORDER BY b.start, b.\"end\", b.cui), '') ids FROM notes n LEFT JOIN broad b ON b.doc_seq = n.doc_seq GROUP BY n.doc_id, n.text")
def export_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON lines, with the text, and read again."""
    place = folder(spark)
    ex = Extractor(Config(mode="single:broad", include_text=True), N.lexicon(spark, sf_dir))
    writers.write_jsonl(ex.results(N.notes(spark, sf_dir)).drop("doc_seq"), place, "gzip")
    r = references.read_results(spark, place, _RESULT)
    ids = F.array_join(F.transform("mentions", lambda m: m["mention_id"]), " ")
    return r.select("doc_id", "content_sha256", F.col("text").isNotNull().alias("has_text"), "schema_version", "mode", F.coalesce(F.size("mentions"), F.lit(0)).cast("bigint").alias("mentions"), F.coalesce(ids, F.lit("")).alias("ids"))


@_query(f"WITH {_NLP} SELECT CAST(doc_seq AS VARCHAR) note_id, CAST(start AS VARCHAR) \"offset\", text lexical_variant, CAST(coalesce(concept_id, 0) AS VARCHAR) note_nlp_concept_id, CASE WHEN negated OR subject <> 'patient' OR uncertain THEN 'N' ELSE 'Y' END term_exists, '\"cui\":\"' || cui || '\"' cui FROM snip LEFT JOIN choice USING (cui)")
def export_note_nlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOTE_NLP as CSV, with ids by hash, and read again."""
    docs, place = N.notes(spark, sf_dir), folder(spark)
    note_ids, codes = docs.select("doc_id", F.col("doc_seq").alias("note_id")), _store(spark, sf_dir).nested_codes()
    rows = omop.note_nlp(N.clinical(spark, sf_dir), docs, note_ids, _lookup(spark, sf_dir), started=datetime(2026, 1, 2, tzinfo=UTC), ids="hash63", codes=codes)
    writers.write_note_nlp(rows, place)
    back = spark.read.csv(place, header=True, multiLine=True, escape='"')
    return back.select("note_id", "offset", "lexical_variant", "note_nlp_concept_id", "term_exists", F.regexp_extract("term_modifiers", r'"cui":"[^"]*"', 0).alias("cui"))


# --- vocabularies ----------------------------------------------------------------------------------------------------


def _pipes(order: Column | str, *fields: Column | str) -> tuple[Column, Column]:
    return (F.lit(order) if isinstance(order, int) else F.col(order) if isinstance(order, str) else order).alias("o"), F.concat_ws("|", *(F.lit(f) if isinstance(f, str) else f for f in fields)).alias("value")


def _release(spark: SparkSession, sf_dir: str) -> str:
    """Release files: every code twice with another name the second time, suppressed and foreign rows, brands that break down to ingredients, a tree over ICD10CM codes."""
    place = folder(spark) + "/2026AA"
    c, codes = F.col, N.part_codes(spark, sf_dir)
    atom = lambda order, lat, name, flag: codes.select(*_pipes(order, c("cui"), lat, "P", "L", "PF", "S", "Y", c("aui"), "", "", "", c("sab"), c("tty"), c("code"), name, "0", flag, "", ""))
    rows = atom("file_order", "ENG", c("str"), "N").unionByName(atom(c("file_order") + 10**7, "ENG", F.concat("str", F.lit(" again")), "N"))
    rows = rows.unionByName(atom(c("file_order") - 10**7, "ENG", F.lit("suppressed"), "O")).unionByName(atom(c("file_order") - 10**7, "FRE", F.lit("foreign"), "N"))
    part = N.read(spark, sf_dir, "part")
    brand = part.select("p_brand").distinct()
    rows = rows.unionByName(brand.select(*_pipes(10**8, c("p_brand"), "ENG", "P", "L", "PF", "S", "Y", F.concat(F.lit("B"), "p_brand"), "", "", "", "RXNORM", "BN", F.concat(F.lit("RX"), "p_brand"), c("p_brand"), "0", "N", "", "")))
    one_file(rows, ["o", "value"], f"{place}/MRCONSO.RRF")
    one_file(N.part_ranks(spark).select(*_pipes(1, c("rank").cast("string"), c("sab"), c("tty"), "N", "")), ["o", "value"], f"{place}/MRRANK.RRF")
    icd = part.where(mod("p_partkey", 4) == 3).select("p_partkey", F.expr("p_partkey div 4").alias("i")).where("i > 0").select("p_partkey", (F.expr("i div 3") * 4 + 3).alias("up"))
    rel = lambda df, cui1, aui1, kind, cui2, aui2, more, sab: df.select(*_pipes(1, cui1, aui1, "AUI", kind, cui2, aui2, "AUI", more, "R", "", sab, sab, "", "", "N", "", ""))
    edges = rel(icd, "", F.concat(F.lit("A"), "up"), "CHD", "", F.concat(F.lit("A"), "p_partkey"), "", "ICD10CM")
    edges = edges.unionByName(rel(icd, "", F.concat(F.lit("A"), "p_partkey"), "PAR", "", F.concat(F.lit("A"), "up"), "", "ICD10CM"))
    made = part.where(mod("p_partkey", 4) == 1).join(N.lexicon(spark, sf_dir).where("semantic_group = 'DISORDER'"), c("p_name") == c("term"))
    edges = edges.unionByName(rel(made.select("cui", "p_brand").distinct(), c("cui"), "", "RO", c("p_brand"), "", "has_ingredient", "RXNORM"))
    one_file(edges, ["o", "value"], f"{place}/MRREL.RRF")
    return place


_stores: dict[tuple[str, str], str] = {}  # built once in an application for each set of tables


def _built(spark: SparkSession, sf_dir: str) -> term.TerminologyStore:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        place = _release(spark, sf_dir)
        term.build(spark, f"{place}/MRCONSO.RRF", f"{place}/MRRANK.RRF", f"{place}/store", mrrel=f"{place}/MRREL.RRF")
        _stores[key] = f"{place}/store"
    return term.TerminologyStore.open(spark, _stores[key])


_TREE = """icd AS (SELECT p_partkey p, p_partkey // 4 i FROM part WHERE p_partkey % 4 = 3), up AS (SELECT p child, i // 3 * 4 + 3 parent FROM icd WHERE i > 0),
walk AS (SELECT child, parent, 1 d FROM up UNION ALL SELECT w.child, u.parent, d + 1 FROM walk w JOIN up u ON u.child = w.parent),
tree AS (SELECT 'P' || child code, 'P' || parent ancestor_code, min(d) distance FROM walk WHERE child <> parent AND parent IN (SELECT p FROM icd) GROUP BY 1, 2)"""
_PARTS = """good AS (SELECT cui, arg_min(code, rk) rx, arg_min(str, rk) nm FROM (SELECT cui, code, str, row_number() OVER (PARTITION BY cui ORDER BY is_preferred DESC, tty, code) rk FROM codes WHERE sab = 'RXNORM' AND tty IN ('IN', 'PIN')) GROUP BY 1),
down AS (SELECT DISTINCT p_brand brand, cui FROM part JOIN lexicon ON p_name = term WHERE p_partkey % 4 = 1),
found AS (SELECT cui product_cui, cui ingredient_cui, 0 hops FROM good UNION ALL SELECT brand, cui, 1 FROM down WHERE cui IN (SELECT cui FROM good))"""


@_query(f"WITH {N.CODES} SELECT cui, sab, code, tty, str, is_preferred FROM codes UNION ALL SELECT DISTINCT p_brand, 'RXNORM', 'RX' || p_brand, 'BN', p_brand, TRUE FROM part")
def release_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).codes.select("cui", "sab", "code", "tty", "str", "is_preferred")


@_query(f"WITH RECURSIVE {_TREE} SELECT 'ICD10CM' sab, code, ancestor_code, CAST(distance AS INTEGER) distance FROM tree")
def release_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).ancestors().select("sab", "code", "ancestor_code", "distance")


@_query(f"WITH {N.CODES}, {_PARTS} SELECT product_cui, ingredient_cui, rx ingredient_rxcui, nm ingredient_name, CAST(hops AS INTEGER) hops FROM found JOIN good ON good.cui = ingredient_cui")
def release_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).ingredients()


@_query(f"""WITH RECURSIVE {N.CODES}, {_TREE}, {_PARTS}, anc AS (SELECT code, string_agg(ancestor_code, ',' ORDER BY distance, ancestor_code) a FROM tree WHERE distance <= 2 GROUP BY 1),
ing AS (SELECT product_cui cui, string_agg(rx, ',' ORDER BY hops, nm, rx) g FROM found JOIN good ON good.cui = ingredient_cui GROUP BY 1)
SELECT cui, sab, code, CASE WHEN sab = 'ICD10CM' THEN coalesce(a, '') ELSE '' END ancestors, CASE WHEN sab = 'RXNORM' THEN coalesce(g, '') ELSE '' END ingredients FROM (SELECT * FROM codes WHERE is_preferred AND sab IN ('ICD10CM', 'RXNORM')) LEFT JOIN anc USING (code) LEFT JOIN ing USING (cui)
UNION ALL SELECT DISTINCT p_brand, 'RXNORM', 'RX' || p_brand, '', coalesce(g, '') FROM part LEFT JOIN ing ON cui = p_brand""")
def nested_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferred codes of a concept, with ancestors to depth 2 and ingredients."""
    nested = _built(spark, sf_dir).nested_codes(("ICD10CM", "RXNORM"), preferred_only=True, ancestor_depth=2, ingredients=True)
    return nested.select("cui", F.explode("codes").alias("c")).select("cui", F.col("c.system").alias("sab"), "c.code", F.array_join("c.ancestors", ",").alias("ancestors"), F.array_join("c.ingredients", ",").alias("ingredients"))


@_query("SELECT '2026AA' umls_release, 'ICD10CM,LNC,RXNORM,SNOMEDCT_US' sources, 'ICD10CM,SNOMEDCT_US' hierarchy_sources, TRUE has_ingredients")
def release_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = _built(spark, sf_dir).build_info
    return spark.createDataFrame([tuple(info[k] for k in ("umls_release", "sources", "hierarchy_sources", "has_ingredients"))], "umls_release string, sources string, hierarchy_sources string, has_ingredients boolean")


@_query(f"WITH {N.LEXICON} SELECT cui, count(*) atoms FROM (SELECT cui FROM part JOIN lexicon ON p_name = term WHERE cui IN (SELECT cui FROM lexicon WHERE term LIKE 'red %')) GROUP BY 1".replace("count(*) atoms", "4 * count(*) atoms"))
def concept_file_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import rrf

    wanted = N.lexicon(spark, sf_dir).where("term like 'red %'").select("cui")
    return rrf.members(spark, f"{_release(spark, sf_dir)}/MRCONSO.RRF", wanted).groupBy("cui").agg(F.count("*").alias("atoms"))


_CONCEPTS = "SELECT sab, CASE sab WHEN 'SNOMEDCT_US' THEN 'SNOMED' WHEN 'RXNORM' THEN 'RxNorm' WHEN 'LNC' THEN 'LOINC' ELSE 'ICD10CM' END v, code, CAST(substring(code, 2) AS INTEGER) n FROM part_codes"


@_query(f"""WITH {N.CODES}, k AS ({_CONCEPTS}) SELECT sab, code, n + 1000 source_concept_id, CASE WHEN n % 3 = 0 THEN n + 1000 WHEN n % 5 <> 0 THEN n + 7 ELSE 0 END concept_id FROM k""")
def build_omop_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary files with repeated codes, other vocabularies, other relations and invalid ones."""
    place, n = folder(spark), F.expr("cast(substring(code, 2) as int)")
    names = F.create_map(*(F.lit(x) for kv in omop.VOCABULARIES.items() for x in kv))
    k = N.part_codes(spark, sf_dir).select(names[F.col("sab")].alias("vocabulary_id"), F.col("code").alias("concept_code"), n.alias("n"))
    row = lambda ident, vocabulary=F.col("vocabulary_id"): k.select(ident.alias("concept_id"), F.lit('a "name"').alias("concept_name"), vocabulary.alias("vocabulary_id"), F.when(F.col("n") % 3 == 0, "S").alias("standard_concept"), "concept_code", F.lit(None).cast("string").alias("invalid_reason"))
    tab = lambda df, name: df.write.options(sep="\t", header=True, quote="", emptyValue="", nullValue="").csv(f"{place}/{name}.csv")
    tab(row(F.col("n") + 1000).unionByName(row(F.col("n") + 50_000_000)).unionByName(row(F.col("n") + 1, F.lit("Other"))), "CONCEPT")
    to = lambda shift, kind, invalid: k.where("n % 3 <> 0 and n % 5 <> 0").select((F.col("n") + 1000).alias("concept_id_1"), (F.col("n") + shift).alias("concept_id_2"), F.lit(kind).alias("relationship_id"), F.lit(invalid).cast("string").alias("invalid_reason"))
    tab(to(9, "Maps to", None).unionByName(to(7, "Maps to", None)).unionByName(to(1, "Is a", None)).unionByName(to(2, "Maps to", "D")), "CONCEPT_RELATIONSHIP")
    return omop.build(spark, place, folder(spark)).select("sab", "code", "source_concept_id", "concept_id")


@_query("SELECT 'SNOMED=v0;RxNorm=v1' versions")
def vocabulary_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = folder(spark)
    rows = spark.createDataFrame([(k, f"v{i}") for i, k in enumerate(("SNOMED", "RxNorm", "Other"))], "vocabulary_id string, vocabulary_version string").coalesce(1)
    rows.write.options(sep="\t", header=True).csv(f"{place}/VOCABULARY.csv")
    return spark.createDataFrame([(omop.versions(spark, place),)], "versions string")


@_query(f"WITH {N.CODES} SELECT DISTINCT cui FROM codes WHERE sab IN ('SNOMEDCT_US', 'RXNORM')")
def concepts_with_standard_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).standard()


@_query(f"WITH {N.CODES} SELECT cui FROM codes WHERE sab = 'LNC' AND code = 'P2'")
def concepts_of_a_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).cuis_for_code("LNC", "p2")


@_query(f"""WITH {N.CODES}, s AS (SELECT cui, str, row_number() OVER (PARTITION BY cui ORDER BY CASE sab WHEN 'SNOMEDCT_US' THEN 0 WHEN 'RXNORM' THEN 1 WHEN 'ICD10CM' THEN 2 ELSE 3 END, code, tty) n FROM codes WHERE is_preferred)
SELECT cui, str AS name FROM s WHERE n = 1""")
def summary_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a note summary calls each concept."""
    concepts = _codes(spark, sf_dir).select("cui").distinct().withColumn("preferred_name", F.lit("none"))
    return _store(spark, sf_dir).attach(concepts).select("cui", cohort.display_name().alias("name"))


# --- references ------------------------------------------------------------------------------------------------------

_SEGMENT = "c_name || ' ' || c_mktsegment || ' or ' || c_mktsegment"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat(F.lit("c"), "c_custkey").alias("doc_id"), F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" or "), "c_mktsegment").alias("text"), F.char_length("c_name").alias("n"))


@_query("""WITH c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 1 AS "row", 'c' || c_custkey doc_id, length(c_name) n, c_mktsegment s, c_custkey % 6 k FROM customer),
p AS (SELECT *, CASE k WHEN 1 THEN 'no such note' WHEN 2 THEN 'no such occurrence' WHEN 3 THEN 'text at start and end differs' WHEN 4 THEN 'an answer is neither yes nor no' END problem FROM c)
SELECT CAST("row" AS INTEGER) AS "row", problem, CASE WHEN problem IS NULL THEN CAST(n + 1 + CASE WHEN k = 5 THEN length(s) + 4 ELSE 0 END AS INTEGER) END AS start, CASE WHEN problem IS NULL THEN s END AS text, CASE WHEN problem IS NULL THEN k = 5 END negated FROM p""")
def worksheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worksheet rows placed by occurrence or by span, and what is wrong with the others."""
    place, c = folder(spark), _customers(spark, sf_dir)
    k, col = mod("c_custkey", 6), F.col
    start = F.when(k == 0, col("n") + 1).when(k == 3, F.lit(1))
    sheet = c.select(
        "c_custkey", F.when(k == 1, "none").otherwise(col("doc_id")).alias("doc_id"), col("c_mktsegment").alias("mention_text"), F.when(k == 2, "3").when(k == 5, "2").alias("occurrence"),
        start.alias("start"), (start + F.char_length("c_mktsegment")).alias("end"), F.when(k == 4, "perhaps").when(k == 5, " YES").otherwise("no").alias("negated"), F.lit("c0000001").alias("cui"), F.lit("finding").alias("group"),
    )
    sheet.orderBy("c_custkey").drop("c_custkey").coalesce(1).write.option("header", True).csv(place)
    rows = gold.place_rows(readers.read_worksheet(spark, place), c.select("doc_id", "text"))
    ok = F.col("problem").isNull()
    return rows.select("row", "problem", F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("text")).alias("text"), F.when(ok, F.col("negated")).alias("negated"))


@_query(f"SELECT 'c' || c_custkey doc_id, sha256({_SEGMENT}) sha, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END mentions, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END text FROM customer")
def worksheet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference records of all notes, also of those without a row."""
    c = _customers(spark, sf_dir)
    sheet = c.where(mod("c_custkey", 2) == 0).select(F.col("c_custkey").cast("int").alias("row"), "doc_id", F.col("c_mktsegment").alias("mention_text"))
    records, _ = gold.convert(sheet, c.select("doc_id", "text"))
    return records.select("doc_id", F.sha2("text", 256).alias("sha"), F.coalesce(F.size("mentions"), F.lit(0)).alias("mentions"), F.try_element_at("mentions", F.lit(1))["text"].alias("text"))


@_query("SELECT 'c' || c_custkey doc_id, m ord, CAST(length(c_name) + 1 + m * (length(c_mktsegment) + 4) AS INTEGER) AS start, 'C000000' || m cui, c_custkey % 3 = 0 negated, CASE WHEN m = 0 THEN 'patient' ELSE 'other' END subject, c_custkey % 2 = 0 is_human FROM customer, (VALUES (0), (1)) v(m)")
def read_own_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, c = folder(spark), _customers(spark, sf_dir)
    mention = lambda m: F.struct((F.col("n") + 1 + m * (F.char_length("c_mktsegment") + 4)).alias("start"), F.lit(f"C000000{m}").alias("cui"), F.lit("FINDING").alias("group"), F.struct((mod("c_custkey", 3) == 0).alias("negated"), F.lit("patient" if m == 0 else "other").alias("subject")).alias("assertions"))
    records = c.select("doc_id", "text", F.when(mod("c_custkey", 2) == 0, "Human:a").otherwise("engine").alias("source"), F.array(mention(0), mention(1)).alias("mentions"))
    writers.write_jsonl(records, place)
    _, found = references.load(spark, place, "own")
    return found.select("doc_id", F.col("ord").cast("int").alias("ord"), "start", "cui", "negated", "subject", "is_human")


@_query("SELECT 'c' || c_custkey || '.txt' doc_id, CAST(length(c_name) + 1 AS INTEGER) AS start, 'C' || m cui, CASE WHEN m = 1 THEN 'T1,T2' ELSE 'T3' END types, c_custkey % 3 = 0 negated, m - 1 AS ord FROM customer, (VALUES (1), (2)) v(m)")
def read_silver_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention for each concept of a span, with the union of the concept's types."""
    place, c = folder(spark), _customers(spark, sf_dir)
    concept = lambda cui, tui: F.struct(F.lit(cui).alias("cui"), F.lit(tui).alias("tui"))
    mention = F.struct((F.col("n") + 1).alias("begin"), (F.col("n") + 1 + F.char_length("c_mktsegment")).alias("end"), (mod("c_custkey", 3) == 0).alias("negated"), F.array(concept("C2", "T3"), concept("C1", "T2"), concept("C1", "T1"), concept("C1", "T1")).alias("concepts"))
    writers.write_jsonl(c.select(F.concat("doc_id", F.lit(".txt")).alias("source_file"), "text", F.array(mention).alias("mentions")), place)
    _, found = references.load(spark, place, "silver")
    return found.select("doc_id", "start", "cui", F.array_join("semantic_types", ",").alias("types"), "negated", F.col("ord").cast("int").alias("ord"))


@_query(f"SELECT {_STEM} doc_id, n_name AS text, 0 AS start, CAST(length(n_name) AS INTEGER) AS \"end\", 'C1' cui, 'T1' types FROM nation WHERE n_nationkey % 3 <> 2")
def read_matcher_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files of another matcher beside their texts; the first of each span and concept."""
    import json

    place, texts = folder(spark), folder(spark)
    for r in N.read(spark, sf_dir, "nation").collect():  # 25 rows at any scale
        k, name = r["n_nationkey"], r["n_name"]
        hit = lambda tui, n=len(name): {"start": 0, "length": n, "evlist": [{"conceptinfo": {"cui": "C1", "semantictypes": [tui]}}]}
        put(spark, f"{texts}/n{k:02d}.txt", name.encode())
        if k % 3 != 2:
            put(spark, f"{place}/n{k:02d}.json", json.dumps([hit("T1"), hit("T2")]).encode())
    docs, found = references.load(spark, place, "matcher", texts)
    return found.join(docs.select("doc_seq", "text"), "doc_seq").select("doc_id", "text", "start", "end", "cui", F.array_join("semantic_types", ",").alias("types"))


@_query(f"WITH {N.MENTIONS} SELECT attribute FROM (VALUES ('negated'), ('subject'), ('history_of'), ('uncertain')) v(attribute)")
def reference_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.assessed_attributes(N.clinical(spark, sf_dir))


@_query(f"WITH {N.MENTIONS} SELECT doc_seq, start, cui FROM broad WHERE tui = 'T033'")
def evaluation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions without a group are in scope by their first type's."""
    m = N.broad(spark, sf_dir).withColumn("semantic_group", F.lit(None).cast("string"))
    types = spark.createDataFrame([("T033", "FINDING"), ("T047", "DISORDER")], "tui string, semantic_group string")
    return references.scope(m, ["finding"], types).select("doc_seq", "start", "cui")


@_query(f"WITH {N.MENTIONS} SELECT doc_seq, start, \"end\", cui, negated FROM broad")
def large_lexicon_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notes against a lexicon of a million more terms, as a release has them."""
    more = spark.range(1_000_000).select(F.concat(F.lit("zz"), F.conv("id", 10, 36), F.when(F.col("id") % 2 == 0, " syndrome").otherwise("")).alias("term"), F.concat(F.lit("C9"), "id").alias("cui"), F.lit("X").alias("preferred_name"), F.lit("DISORDER").alias("semantic_group"), F.array(F.lit("T047")).alias("semantic_types"))
    docs = N.notes(spark, sf_dir)
    found = with_defaults(lex.match_terms(docs, N.lexicon(spark, sf_dir).unionByName(more), "broad", 2)).drop("negated")
    return assertions.simple_negation(docs, found).select("doc_seq", "start", "end", "cui", "negated")


# --- mentions --------------------------------------------------------------------------------------------------------


@_query(f"""WITH {N.MENTIONS} SELECT b.doc_seq, b.start, b.cui, b.negated AS broad_negated, c.negated AS clinical_negated, c.history_of AS clinical_history FROM clinical c JOIN broad b ON c.doc_seq = b.doc_seq AND c.cui = b.cui AND c.start = b.start AND c.te = b."end" WHERE c.negated <> b.negated""")
def recorded_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where engines differ, what each of them said."""
    out = ensemble.union(N.clinical(spark, sf_dir), N.broad(spark, sf_dir)).where("assertion_conflict")
    said = lambda engine, c: F.col("engine_assertions")[engine][c]
    return out.select("doc_seq", "start", "cui", said("broad", "negated").alias("broad_negated"), said("clinical", "negated").alias("clinical_negated"), said("clinical", "history_of").alias("clinical_history"))


@_query(f"WITH {N.MENTIONS} SELECT doc_seq, start, cui, CASE WHEN tui = 'T047' THEN 'T000,T047' ELSE tui END types FROM broad")
def merged_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of two engines' types, where both have the span."""
    b = N.broad(spark, sf_dir)
    c = b.where("semantic_group = 'DISORDER'").withColumn("semantic_types", F.array(F.lit("T000")))
    return ensemble.union(c, b).select("doc_seq", "start", "cui", F.array_join("semantic_types", ",").alias("types"))


@_query(f"WITH {N.MENTIONS} SELECT doc_seq, start, cui FROM (SELECT *, row_number() OVER (PARTITION BY doc_seq, left(text, 3), cui ORDER BY ord) n FROM broad) WHERE n = 1")
def concepts_of_an_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.distinct_concepts(N.broad(spark, sf_dir).withColumn("entity", F.left("text", F.lit(3))), "entity").select("doc_seq", "start", "cui")


@_query(f"WITH {N.MENTIONS}, a AS (SELECT doc_seq, {_STATUS} status FROM clinical) SELECT doc_seq, 'hedging,history' unassessed FROM a WHERE status = 'affirmed' GROUP BY 1")
def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no attribute of some affirmed mention answers."""
    m = N.clinical(spark, sf_dir)
    status = cohort.with_status(m).where("status = 'affirmed'").drop("status")
    blank = status.withColumn("uncertain", F.lit(None).cast("boolean")).withColumn("history_of", F.lit(None).cast("boolean"))
    return reports.unassessed_by_document(blank).select("doc_seq", F.array_join("unassessed", ",").alias("unassessed"))


@_query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'patient' WHEN 1 THEN 'other' END subject FROM orders")
def known_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.read(spark, sf_dir, "orders").select("o_orderkey", assertions.checked_subject(F.when(mod("o_orderkey", 3) == 0, "patient").when(mod("o_orderkey", 3) == 1, "other")).alias("subject"))


@_query(f"WITH {N.LEXICON} SELECT l.cui, l.preferred_name, l.semantic_group = 'DISORDER' OR NOT EXISTS (SELECT 1 FROM lexicon x WHERE x.term IN ('red plate', 'blue gear') AND split_part(x.term, ' ', 2) = l.term) AS target FROM lexicon l WHERE term IN ('red plate', 'blue gear', 'plate', 'gear')")
def phrase_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a phrase's concepts those of the longest spans are targets; the others are dropped."""
    phrase = spark.createDataFrame([(0, "phrase", "red plate and blue gear")], "doc_seq long, doc_id string, text string")
    found = with_defaults(lex.match_terms(phrase, N.lexicon(spark, sf_dir), "broad", 2))
    targets, dropped = cohort.resolve_phrase(found, spans.longest_spans(found))
    return targets.withColumn("target", F.lit(True)).unionByName(dropped.withColumn("target", F.lit(False)))


_MORE = N.LEXICON.rstrip().removesuffix(")") + """  UNION ALL SELECT * FROM (VALUES ('stable', 'C2000001', 'STABLE', 'FINDING', 'T033'), ('today', 'C2000002', 'TODAY', 'FINDING', 'T033'), ('physical exam', 'C2000003', 'EXAM', 'FINDING', 'T033'), ('gear', 'C0999999', 'GEAR', 'FINDING', 'T033')) v
)"""


@_query(f"""WITH {N.MENTIONS.replace(N.LEXICON, _MORE)},
noteslines AS (SELECT doc_seq, strpos(note, 'Assessment and plan:') - 1 a FROM (SELECT DISTINCT doc_seq, note FROM broad)),
kept AS (SELECT b.* FROM broad b JOIN noteslines USING (doc_seq) WHERE tui <> 'T079' AND lower(text) NOT IN ('stable', 'today', 'physical exam')),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_seq, start, "end" ORDER BY CASE WHEN cui LIKE 'C0%' THEN 0 ELSE 1 END, ord, cui) n FROM kept) WHERE n = 1),
reach AS (SELECT *, max("end") OVER (PARTITION BY doc_seq ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM one)
SELECT doc_seq, start, "end", cui FROM reach WHERE r IS NULL OR r < "end" """)
def guideline_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop texts, headings, out-of-scope types, and of two concepts of a span the one with a standard code."""
    more = [("stable", "C2000001", "STABLE"), ("today", "C2000002", "TODAY"), ("physical exam", "C2000003", "EXAM"), ("gear", "C0999999", "GEAR")]
    lexicon = N.lexicon(spark, sf_dir).unionByName(spark.createDataFrame([(*r, "FINDING", ["T033"]) for r in more], "term string, cui string, preferred_name string, semantic_group string, semantic_types array<string>"))
    docs = N.notes(spark, sf_dir)
    found = with_defaults(lex.match_terms(docs, lexicon, "broad", 2)).withColumn("standard", F.col("cui").startswith("C0"))
    return spans.guideline_filter(found, docs, "standard").select("doc_seq", "start", "end", "cui")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as mentions of one concept: those of flag N on the left, the others on the right; all of an order overlap."""
    lines = N.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("n")).distinct().select(F.col("l_orderkey").alias("doc_seq"), F.lit("C1").alias("cui"), F.col("l_linenumber").alias("ord"), F.col("l_linenumber").cast("int").alias("ts"), F.lit(20).alias("te"), "n")
    return lines.where("n").drop("n"), lines.where("not n").drop("n")


@_query("SELECT * FROM (SELECT l_orderkey doc_seq, least(count(DISTINCT l_linenumber) FILTER (l_returnflag = 'N'), count(DISTINCT l_linenumber) FILTER (l_returnflag <> 'N')) pairs FROM lineitem GROUP BY 1) WHERE pairs > 0")
def contested_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every left mention overlaps every right one: as many pairs as the smaller side has."""
    found = matching.match_concepts(*_sides(spark, sf_dir))
    return found.groupBy("doc_seq").agg(F.countDistinct("a").alias("pairs"))


@_query("SELECT l_orderkey doc_seq, max(l_linenumber) - 1 AS pairs FROM lineitem GROUP BY 1 HAVING max(l_linenumber) > 1")
def chained_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left k overlaps right k exactly but for the last, and right k + 1: keeping all exact pairs is the most, though a greedy choice of the second may block it."""
    n = N.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_seq")).agg(F.max("l_linenumber").cast("int").alias("n")).where("n > 1")
    k = n.select("doc_seq", "n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    left = k.select("doc_seq", F.lit("C1").alias("cui"), F.col("k").alias("ord"), (F.col("k") * 10).alias("ts"), (F.col("k") * 10 + 11).alias("te"))
    right = k.select("doc_seq", F.lit("C1").alias("cui"), (F.lit(100) - F.col("k")).alias("ord"), (F.col("k") * 10 - 5).alias("ts"), (F.col("k") * 10 + 1).alias("te"))
    found = matching.match_concepts(left, right)
    return found.groupBy("doc_seq").agg(F.countDistinct("b").cast("int").alias("pairs"))


@_query("""WITH f AS (SELECT DISTINCT l_orderkey doc_seq, l_linenumber n, l_returnflag = 'N' AS l FROM lineitem), a AS (SELECT doc_seq, n, row_number() OVER (PARTITION BY doc_seq ORDER BY n) k FROM f WHERE l), b AS (SELECT doc_seq, n, row_number() OVER (PARTITION BY doc_seq ORDER BY n) k FROM f WHERE NOT l)
SELECT a.doc_seq, a.n a, b.n b FROM a JOIN b ON a.doc_seq = b.doc_seq AND a.k = b.k""")
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order, each left span takes the first right one that is free."""
    left, right = (df.select("doc_seq", F.col("ts").alias("start"), F.col("te").alias("end"), "ord") for df in _sides(spark, sf_dir))
    return matching.greedy_overlaps(left, right)


@_query("""WITH s AS (SELECT l_orderkey doc_seq, l_linenumber n, max(CAST(floor(l_quantity) AS INTEGER)) + 1 len FROM lineitem GROUP BY ALL), p AS (SELECT *, n * 1000 AS start, n * 1000 + len AS "end", n * 1000 + len // 2 AS mid FROM s)
SELECT doc_seq, start, "end" FROM p UNION ALL SELECT doc_seq, "end", "end" + 1 FROM p""")
def longest_of_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains a - b - c, where b is shorter than a and overlaps it, and c is shorter than b and overlaps only b: b goes, so c stays."""
    s = N.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_seq"), (F.col("l_linenumber") * 1000).cast("int").alias("start")).agg((F.max(F.floor("l_quantity").cast("int")) + 1).alias("len"))
    a = s.select("doc_seq", "start", (F.col("start") + F.col("len")).alias("end"))
    b = s.where("len > 2").select("doc_seq", (F.col("start") + F.col("len") - F.expr("len div 2")).alias("start"), (F.col("start") + F.col("len") + 1).alias("end")).where("end - start < 1000")
    b = b.join(a.select("doc_seq", F.col("start").alias("s"), F.col("end").alias("e")), "doc_seq").where("start < e and s < start and end - start < e - s").select("doc_seq", "start", "end")
    c = a.select("doc_seq", F.col("end").alias("start"), (F.col("end") + 1).alias("end"))
    m = a.unionByName(b).unionByName(c).distinct()
    return spans.longest_spans(m).select("doc_seq", "start", "end")


# --- reports ---------------------------------------------------------------------------------------------------------


@_query(f"""WITH {N.MENTIONS}, s AS (SELECT doc_seq, cui, max(CASE WHEN {_STATUS} = 'affirmed' THEN 1 ELSE -1 END) cell FROM clinical GROUP BY 1, 2)
SELECT cui, min(l.preferred_name) preferred_name, 'DISORDER' semantic_group, count(*) FILTER (cell = 1) n_affirmed, count(*) FILTER (cell = -1) n_not_affirmed FROM s JOIN lexicon l USING (cui) GROUP BY 1 HAVING count(*) FILTER (cell = 1) >= 2""")
def concept_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.concept_dictionary(N.clinical(spark, sf_dir), 2)


@_query(f"""WITH {N.MENTIONS}, t AS (SELECT cui FROM lexicon WHERE term LIKE 'red %'), st AS (SELECT doc_seq, bool_or({_STATUS} = 'affirmed') a FROM clinical WHERE cui IN (SELECT cui FROM t) GROUP BY 1)
SELECT 'term:red' query, (SELECT string_agg(cui, ',' ORDER BY cui) FROM t) cuis, 'notes' sources, count(*) n_documents, count(*) FILTER (a) n_affirmed, count(*) FILTER (NOT a) n_excluded, count(*) FILTER (a IS NULL) n_absent, 0 AS n_errors, 2 AS lines, count(*) AS documents FROM notes LEFT JOIN st USING (doc_seq)""")
def search_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = N.lexicon(spark, sf_dir).where("term like 'red %'")
    history = reports.Searches(spark, folder(spark))
    key = history.save(cohort.classify(N.notes(spark, sf_dir), N.clinical(spark, sf_dir), targets), targets, query="term:red", sources=["notes"], console=["one", "two"])
    saved = lambda name, alias: history.table(name).where(F.col("search_id") == key).agg(F.count("*").alias(alias))
    return history.history().drop("search_id", "ran_at", "mode").crossJoin(saved("console", "lines")).crossJoin(saved("documents", "documents"))  # one row each


@_query(f"""WITH {N.MENTIONS}, b AS (SELECT * FROM clinical WHERE NOT history_of) SELECT c.doc_id, c.start, c."end", c.text, CASE WHEN b.cui IS NULL THEN 'only a' ELSE 'labels' END kind, CASE WHEN b.cui IS NULL THEN '' ELSE 'negated' END differs, c.cui cui_a, coalesce(b.cui, '') cui_b FROM clinical c LEFT JOIN b ON b.doc_seq = c.doc_seq AND b.start = c.start AND b."end" = c."end" WHERE b.cui IS NULL OR c.uncertain""")
def annotator_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = N.clinical(spark, sf_dir)
    b = a.where("not history_of").withColumn("negated", F.when(F.col("uncertain"), ~F.col("negated")).otherwise(F.col("negated")))
    return reports.disagreements(N.notes(spark, sf_dir), a, b).select("doc_id", "start", "end", "text", "kind", "differs", "cui_a", "cui_b")


@_query(f"""WITH {N.MENTIONS}, v AS (SELECT doc_seq, start, "end", 'negated' AS attribute, negated p FROM clinical UNION ALL SELECT doc_seq, start, "end", 'subject', subject <> 'patient' FROM clinical)
SELECT attribute, p engine_positive, count(*) total FROM (SELECT DISTINCT * FROM v) GROUP BY 1, 2""")
def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, totals = reports.blind_review(N.notes(spark, sf_dir), N.clinical(spark, sf_dir).withColumn("mode", F.lit("m")), ("negated", "subject"))
    return totals.drop("mode")


@_query("""WITH b(le) AS (VALUES (500.0), (1000.0), (2500.0), (5000.0), (10000.0), (25000.0), (50000.0), (100000.0), (200000.0)), d AS (SELECT lang, length(text) n FROM documents)
SELECT lang, le, count(*) FILTER (n <= le) n FROM d, b GROUP BY 1, 2""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = N.read(spark, sf_dir, "documents").select("lang", F.char_length("text").alias("chars"))
    return reports.histogram(docs, "chars", reports.CHARACTERS, ["lang"]).where("le < double('infinity')").select("lang", "le", "n")


@_query("SELECT 'parquet' format, 'out' AS output, 25 AS documents, 1 AS exports")
def export_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export did, beside it and in its run's manifest."""
    import json

    place = Path(tempfile.mkdtemp())
    writers.write_json({"run_id": "r"}, place / "run_manifest.json")
    n = N.read(spark, sf_dir, "nation").count()
    writers.write_sidecar(str(place / "out"), {"format": "parquet", "output": "out", "documents": n}, str(place))
    said, manifest = json.loads((place / "out.export.json").read_text()), json.loads((place / "run_manifest.json").read_text())
    return spark.createDataFrame([(said["format"], said["output"], said["documents"], len(manifest["exports"]))], "format string, output string, documents int, exports int")
