from __future__ import annotations

import csv
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from notegrain import __main__ as cli, reports, run as runs
from notegrain.extractor import python_engine
from notegrain.model import with_defaults
from notegrain.operators import assertions, cohort, evaluate


def docs_of(spark, *texts):
    return spark.createDataFrame([(k, f"d{k}", t) for k, t in enumerate(texts)], "doc_seq long, doc_id string, text string")


def mentions_of(spark, *rows):
    """rows: (doc_seq, start, end, text, cui, group, negated, subject)"""
    full = [(r[0], f"d{r[0]}", k, *r[1:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_seq long, doc_id string, ord long, start int, end int, text string, cui string, semantic_group string, negated boolean, subject string")
    return with_defaults(df.withColumn("preferred_name", F.concat(F.lit("name of "), "cui")).withColumn("engine", F.lit("x")))


@pytest.fixture(scope="module")
def found(spark):
    rows = [(0, 0, 4, "pain", "C1", "FINDING", False, "patient"), (0, 9, 13, "Pain", "C1", "FINDING", True, "patient"), (0, 20, 24, "gout", "C2", "DISORDER", True, None), (1, 0, 4, "cord", "C3", "DEVICE", None, "family_member")]
    return docs_of(spark, "pain, no Pain, and no gout", "cord", "nothing"), mentions_of(spark, *rows)


def test_summary_lines(spark, found):
    docs, mentions = found
    errors = spark.createDataFrame([("lost", "Timeout"), ("d0", "KeyError")], "doc_id string, error_type string")
    lines = [r.line for r in reports.summary_lines(docs, mentions, errors).orderBy(F.col("doc_seq").asc_nulls_last(), "line_no").collect()]
    assert lines == [
        "== d0  (3 mentions, 2 concepts)", "   Problems (DISORDER)", "     negated:         name of C2", "   Findings (FINDING)", "     affirmed:        name of C1 x2  (also negated 1)",
        "   note: hedging, history not assessed on some affirmed concepts", "",
        "== d1  (1 mentions, 1 concepts)", "   Device (DEVICE)", "     someone else's:  name of C3", "",
        "== d2  (0 mentions, 0 concepts)", "   no concepts found", "",
        "== lost", "   could not be processed: Timeout", "",
    ]
    records = {r.doc_id: r for r in reports.summary_records(docs, mentions).collect()}
    assert [(c.cui, c.status, c.texts) for c in records["d0"].concepts] == [("C1", "affirmed", ["pain", "Pain"]), ("C2", "negated", ["gout"])]
    assert records["d2"].n_mentions == 0 and records["d0"].unassessed == ["hedging", "history"]


def test_dictionary_and_histogram(spark, found):
    _, mentions = found
    assert [tuple(r) for r in reports.concept_dictionary(mentions, 0).orderBy("cui").collect()] == [("C1", "name of C1", "FINDING", 1, 0), ("C2", "name of C2", "DISORDER", 0, 1), ("C3", "name of C3", "DEVICE", 0, 1)]
    rows = spark.createDataFrame([(0.005,), (0.3,), (31.0,)], "v double")
    got = {r.le: r.n for r in reports.histogram(rows, "v", reports.SECONDS).collect()}
    assert (got[0.005], got[0.2], got[0.35], got[30.0], got[float("inf")]) == (1, 1, 2, 2, 3)


def test_search_history_grows(spark, found, tmp_path):
    docs, mentions = found
    history = reports.Searches(spark, str(tmp_path / "h"))
    assert history.history().count() == 0
    targets = spark.createDataFrame([("C2", "Gout"), ("C1", "Pain")], "cui string, preferred_name string")
    errors = spark.createDataFrame([("lost", "Timeout")], "doc_id string, error_type string")
    classified = cohort.classify(docs, mentions, targets, errors.select("doc_id"))
    first = history.save(classified, targets, query="term:gout", sources=["a", "b"], console=["one", "two"], errors=errors)
    second = history.save(classified.where("status = 'affirmed'"), targets.where("cui = 'C1'"), query="cui:C1", sources=["a"], mode="single:broad")
    rows = {r.search_id: r for r in history.history().collect()}
    assert (rows[first].n_documents, rows[first].n_affirmed, rows[first].n_absent, rows[first].n_errors, rows[first].cuis, rows[first].sources, rows[first].mode) == (4, 1, 2, 1, "C1,C2", "a;b", None)
    assert (rows[second].n_documents, rows[second].cuis, rows[second].mode) == (1, "C1", "single:broad")
    assert [r.line for r in history.table("console").where(F.col("search_id") == first).orderBy("line_no").collect()] == ["one", "two"]
    assert {(r.doc_id, r.error_type) for r in history.table("documents").where(F.col("search_id") == first).where("status = 'error'").collect()} == {("lost", "Timeout")}


def test_agreement_and_disagreements(spark, found):
    docs, a = found
    b = a.where("ord <> 1").withColumn("negated", F.when(F.col("ord") == 0, True).otherwise(F.col("negated"))).withColumn("cui", F.when(F.col("ord") == 2, "C9").otherwise(F.col("cui")))
    rows = {(r.start, r.kind): r for r in reports.disagreements(docs, a, b).collect()}
    assert {k: (r.differs, r.cui_a, r.cui_b, r.text) for k, r in rows.items()} == {(0, "labels"): ("negated", "C1", "C1", "pain"), (9, "only a"): ("", "C1", "", "Pain"), (20, "labels"): ("cui", "C2", "C9", "o go")}
    report = reports.agreement_report(docs, a, b)
    assert "| 4 / 3 | 0.857 |" in report and "| negated | 1/2 |" in report and "| uncertain | 0/0 | n/a | 0 / 0 |" in report


def test_blind_review(spark, found):
    docs, mentions = found
    labelled = mentions.withColumn("mode", F.lit("m")).unionByName(mentions.where("ord < 2").withColumn("mode", F.lit("n")))
    sheet, key, totals = reports.blind_review(docs, labelled, per_cell=1, seed=3)
    assert sheet.columns == ["item", "attribute", "question", "mention", "context", "judgement", "comment"]
    assert {(r.mode, r.attribute, r.engine_positive): r.total for r in totals.collect()} == {("m", "negated", True): 2, ("m", "negated", False): 1, ("m", "subject", True): 1, ("m", "subject", False): 2, ("n", "negated", True): 1, ("n", "negated", False): 1, ("n", "subject", False): 2}
    assert key.groupBy("mode", "attribute", "engine_positive").count().where("count > 1").count() == 0
    assert sorted(r.item for r in sheet.collect()) == [f"R{k:04d}" for k in range(1, sheet.count() + 1)]
    assert sorted(map(tuple, key.collect())) == sorted(map(tuple, reports.blind_review(docs, labelled, per_cell=1, seed=3)[1].collect()))
    with pytest.raises(ValueError, match="R0001"):
        reports.judged_key(key, sheet)
    judged = reports.judged_key(key, sheet.withColumn("judgement", F.lit(" Yes ")))
    assert {r.ppv for r in evaluate.review(judged.where("engine_positive")).collect()} == {1.0}


def test_matcher_that_hangs_or_dies(spark):
    def make():
        def engine(text, key):
            if text == "hang":
                time.sleep(60)
            if text == "die":
                os._exit(9)
            if text == "boom":
                raise KeyError("SECRET")
            return [{"start": 0, "end": len(text), "cui": key}]

        return engine

    docs = docs_of(spark, "ok", "hang", "ok", "die", "boom", "ok").coalesce(1)
    began = time.monotonic()
    rows = python_engine(make, "start int, end int, cui string", timeout=1.5)(docs).orderBy("doc_seq").collect()
    assert [(r.error_type, r.cui) for r in rows] == [(None, "d0"), ("Timeout", None), (None, "d2"), ("WorkerDied", None), ("KeyError", None), (None, "d5")]
    assert time.monotonic() - began < 30


def test_spans_beyond_a_sentence_are_not_assessed(spark):
    docs = docs_of(spark, "no pain. fever and 3.5 mg\nrash --")
    spans = [(0, 3, 7), (0, 3, 14), (0, 9, 25), (0, 19, 30), (0, 31, 33)]
    rows = mentions_of(spark, *((d, s, e, "", f"C{s}{e}", "FINDING", None, None) for d, s, e in spans))
    got = {(r.start, r.end): (r.negated, r.subject) for r in assertions.assess_spans(rows, docs, ("negated", "subject")).collect()}
    assert got == {(3, 7): (True, "patient"), (3, 14): (None, None), (9, 25): (False, "patient"), (19, 30): (None, None), (31, 33): (None, None)}


def test_what_is_at_a_path(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "run").mkdir()
    (tmp_path / "run/run_manifest.json").write_text("{}")
    (tmp_path / "r.jsonl").write_text('\n{"doc_id": "a", "mentions": []}\n')
    (tmp_path / "n.jsonl").write_text('{"id": "a", "text": "x"}\n')
    (tmp_path / "bad.jsonl").write_text("{\n")
    (tmp_path / "t.txt").write_text("x")
    assert [runs.kind_of(spark, str(tmp_path / p)) for p in ("notes", "run", "r.jsonl", "n.jsonl", "bad.jsonl", "t.txt")] == ["notes", "run", "results", "notes", "notes", "notes"]
    with pytest.raises(FileNotFoundError):
        runs.kind_of(spark, str(tmp_path / "none"))


def test_input_hashes_are_kept(spark, tmp_path):
    from notegrain.sources import readers

    (tmp_path / "a.txt").write_text("x")
    listed = lambda: readers.input_files(spark, [str(tmp_path / "a.txt")]).drop("sha256")
    first = runs.recorded_inputs(listed(), str(tmp_path / "run")).collect()
    assert len(first) == 1 and runs.recorded_inputs(listed(), str(tmp_path / "run")).collect() == first
    time.sleep(1.1)
    (tmp_path / "a.txt").write_text("yy")
    assert runs.recorded_inputs(listed(), str(tmp_path / "run")).count() == 2


def test_report_commands(spark, tmp_path, capsys):
    terms = [("chest pain", "C0008031", "Chest Pain", "FINDING", ["T184"]), ("diabetes", "C0011849", "Diabetes", "DISORDER", ["T047"])]
    spark.createDataFrame(terms, "term string, cui string, preferred_name string, semantic_group string, semantic_types array<string>").write.parquet(str(tmp_path / "lex"))
    (tmp_path / "n").mkdir()
    (tmp_path / "n/a.txt").write_text("No chest pain. Diabetes.")
    (tmp_path / "n/b.txt").write_text("Mother with diabetes.")
    run = lambda *a: cli.main([*a, "--lexicon", str(tmp_path / "lex"), "--out", str(tmp_path / f"out-{a[0]}")])
    assert run("summarize", str(tmp_path / "n")) == 0
    assert "     negated:         Chest Pain" in (tmp_path / "out-summarize").read_text().split("\n")
    assert run("matrix", str(tmp_path / "n")) == 0
    assert list(csv.reader((tmp_path / "out-matrix").open()))[0] == ["row_key", "C0011849"]
    assert list(csv.reader((tmp_path / "out-matrix.concepts.csv").open()))[1] == ["C0011849", "Diabetes", "DISORDER", "1", "1"]
    assert run("search", str(tmp_path / "n"), "--term", "Diabetes") == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["affirmed: 1", "excluded: 1", "absent: 0"]
    assert run("review", str(tmp_path / "n"), "--per-cell", "5") == 0
    assert json.loads((tmp_path / "out-review/strata.json").read_text())["notes"] == 2
    note = lambda cui: json.dumps({"doc_id": "a", "text": "No chest pain.", "source": "human", "mentions": [{"start": 3, "end": 13, "cui": cui, "group": "FINDING", "assertions": {"negated": True}}]}) + "\n"
    (tmp_path / "one.jsonl").write_text(note("C1"))
    (tmp_path / "two.jsonl").write_text(note("C2"))
    assert cli.main(["agreement", str(tmp_path / "one.jsonl"), str(tmp_path / "two.jsonl"), "--out", str(tmp_path / "agree.md"), "--disagreements", str(tmp_path / "d.csv")]) == 0
    assert "| 1 / 1 | 1.000 | 1.000 | 1 | 1 |" in (tmp_path / "agree.md").read_text()
    assert list(csv.DictReader((tmp_path / "d.csv").open()))[0]["differs"] == "cui"
    assert cli.main(["export", str(tmp_path / "n"), "--lexicon", str(tmp_path / "lex"), "--out", str(tmp_path / "o.parquet")]) == 0
    assert json.loads((tmp_path / "o.parquet.export.json").read_text())["documents"] == 2


def test_hooks(spark, tmp_path):
    """An assessor of one's own, a writer of one's own, and progress."""
    from notegrain.config import Config
    from notegrain.extractor import Extractor
    from notegrain.sinks import writers

    lexicon = spark.createDataFrame([("pain", "C1", "Pain", "FINDING", ["T184"])], "term string, cui string, preferred_name string, semantic_group string, semantic_types array<string>")
    docs = docs_of(spark, "no pain").withColumn("replaced", F.lit(0))
    ex = Extractor(Config(mode="ensemble:hybrid"), lexicon, assessor=lambda found, _: found.withColumn("negated", F.lit(False)).withColumn("generic", F.lit(True)))
    (m,) = ex.mentions(docs).collect()
    assert (m.negated, m.generic, m.engine_assertions["broad"].negated) == (False, True, True)
    try:
        writers.register("tsv", lambda docs, mentions, path: mentions.select("cui").write.csv(path, sep="\t"), ".tsv")
        assert writers.format_for("x.tsv") == "tsv"
        writers.WRITERS["tsv"](docs, ex.mentions(docs), str(tmp_path / "x.tsv"))
        assert [r._c0 for r in spark.read.csv(str(tmp_path / "x.tsv")).collect()] == ["C1"]
    finally:
        writers.WRITERS.pop("tsv")
        writers.SUFFIXES.pop(".tsv")
    steps = []
    errors = spark.createDataFrame([("k", "read", "KeyError"), ("l", "read", "KeyError")], "doc_key string, stage string, error_type string")
    manifest = runs.run(spark, Extractor(Config(), lexicon), docs, errors, str(tmp_path / "run"), progress=lambda step, counts: steps.append(step))
    assert steps == ["extracted", "counted"] and manifest["sessions"][0]["error_types"] == {"KeyError": 2} and "open_session" not in json.loads((tmp_path / "run/run_manifest.json").read_text())
