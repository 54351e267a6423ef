from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from notegrain.functions import expressions as E
from notegrain.model import with_defaults
from notegrain.operators import assertions, cohort, gold

SCHEMA = "doc_seq long, ord long, start int, end int, text string, cui string, negated boolean, subject string, uncertain boolean, generic boolean, temporality string, history_of boolean"


def mentions(spark, rows):
    """rows: (doc_seq, cui, flags)"""
    full = [(seq, k, k, k + 1, f.get("text", cui.lower()), cui, f.get("negated"), f.get("subject"), f.get("uncertain"), f.get("generic"), f.get("temporality"), f.get("history_of")) for k, (seq, cui, f) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA).withColumn("doc_id", F.concat(F.lit("d"), "doc_seq"))
    return with_defaults(df.withColumn("preferred_name", F.col("cui")).withColumn("semantic_group", F.lit("FINDING")))


def documents(spark, *keys):
    return spark.createDataFrame(list(enumerate(keys)), "doc_seq long, doc_id string")


def targets(spark):
    return spark.createDataFrame([("T",)], "cui string")


def test_status_takes_the_first_bucket_and_null_excludes_nothing(spark):
    flags = [{"negated": True, "subject": "family_member"}, {"subject": "family_member"}, {"uncertain": True}, {"temporality": "hypothetical"}, {"generic": True}, {"history_of": True}]
    row = cohort.classify(documents(spark, "a"), mentions(spark, [(0, "T", f) for f in flags]), targets(spark)).first()
    assert (row.n_negated, row.n_other_subject, row.n_hedged, row.n_affirmed, row.status) == (1, 1, 3, 1, "affirmed")
    assert row.unassessed == ["negation", "subject", "hedging"]


def test_every_document_is_a_row_and_a_finished_one_no_error(spark):
    errors = spark.createDataFrame([("a",), ("broken",)], "doc_id string")
    out = {r.doc_id: r.status for r in cohort.classify(documents(spark, "a", "b"), mentions(spark, [(0, "T", {"negated": True})]), targets(spark), errors).collect()}
    assert out == {"a": "excluded", "b": "absent", "broken": "error"}


def test_matrix_with_repeated_keys_and_empty_rows(spark):
    docs = documents(spark, "same", "same", "x", "same")
    m = mentions(spark, [(0, "A", {}), (0, "A", {"negated": True}), (1, "A", {"negated": True}), (1, "B", {})])
    out = {r.row_key: (r.A, r.B) for r in cohort.matrix(docs, m).collect()}
    assert out == {"same": (1, 0), "same#1": (-1, 1), "x": (0, 0), "same#2": (0, 0)}
    assert cohort.matrix(docs, m, min_docs=2).columns == ["row_key"]
    with pytest.raises(ValueError, match="more than 1"):
        cohort.matrix(docs, m, most=1)


def test_summary(spark):
    m = mentions(spark, [(0, "A", {"negated": True, "text": "x"}), (0, "B", {"text": "b"}), (0, "A", {"uncertain": True, "text": "y"}), (0, "A", {"negated": True, "text": "x"})])
    out = {r.cui: r for r in cohort.note_summary(m).collect()}
    assert (out["A"].status, out["A"].mentions, out["A"].texts, out["A"].first_ord) == ("negated", 3, ["x", "y"], 0) and out["B"].status == "affirmed"
    tied = cohort.note_summary(mentions(spark, [(0, "A", {"uncertain": True}), (0, "A", {"negated": True})])).first()
    assert tied.status == "negated"
    top = cohort.concept_summary(m, 1).collect()
    assert [(r.cui, r.total_concepts, r.truncated) for r in top] == [("A", 2, True)] and top[0].assertions[0].history_of == "not assessed" and top[0].assertions[0].n == 2


def test_display_name_prefers_codes_by_source(spark):
    codes = F.array(*(F.struct(F.lit(s).alias("system"), F.lit(d).alias("display"), F.lit(p).alias("is_preferred")) for s, d, p in (("ICD10CM", "icd", True), ("SNOMEDCT_US", "old", False), ("RXNORM", "rx", True))))
    assert mentions(spark, [(0, "A", {})]).withColumn("codes", codes).select(cohort.display_name()).first()[0] == "rx"


def test_cues(spark):
    text = "Denies fever but has chest pain. Mother with diabetes. History of asthma, possible gout\nReturn for bleeding."
    docs = spark.createDataFrame([(0, "d", text)], "doc_seq long, doc_id string, text string")
    terms = ("fever", "chest pain", "diabetes", "asthma", "gout", "bleeding")
    spans = spark.createDataFrame([(0, text.index(t), t) for t in terms], "doc_seq long, start int, cui string")
    out = {r.cui: r for r in assertions.assess(spans, docs).collect()}
    assert [t for t in terms if out[t].negated] == ["fever"] and [t for t in terms if out[t].subject == "family_member"] == ["diabetes"]
    assert [t for t in terms if out[t].history_of] == ["asthma", "gout"] and [t for t in terms if out[t].uncertain] == ["gout"]
    assert out["bleeding"].temporality == "hypothetical" and out["fever"].temporality == "recent"


def test_label_maps(spark):
    df = spark.createDataFrame([("Patient",), ("Other",), ("Family",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(assertions.mapped(F.col("x"), assertions.EXPERIENCERS)).collect()] == ["patient", "other", "family_member", None, None]
    with pytest.raises(Exception, match="unknown subject"):
        df.where("x = 'Other'").select(assertions.checked_subject(F.col("x"))).collect()


def test_term_exists_is_three_valued(spark):
    m = mentions(spark, [(0, "A", {}), (0, "B", {"negated": False}), (0, "C", {"subject": "other"}), (0, "D", {"negated": False, "history_of": False}), (0, "E", {"temporality": "historical"})])
    got = {r.cui: (r.e, r.t) for r in m.select("cui", E.term_exists().alias("e"), E.term_temporal().alias("t")).collect()}
    assert got == {"A": (None, None), "B": ("Y", None), "C": ("N", None), "D": ("Y", "present"), "E": (None, "past")}


NOTE = "No chest pain.\nChest pain again; chest pain."


def test_worksheet(spark):
    notes = spark.createDataFrame([("n", NOTE), ("empty", "x")], "doc_id string, text string")
    columns = "row int, doc_id string, mention_text string, occurrence string, start string, end string, group string, cui string, negated string, subject string, history_of string, uncertain string"
    good = [(2, "n", "chest pain", "", "", "", "finding", "c1", "yes", "Family Member", "no", ""), (3, "n", "chest pain", "2", "", "", "", "", "no", "", "", ""), (4, "n", "Chest pain", "", "15", "25", "", "", "", "", "", "")]
    records, problems = gold.convert(spark.createDataFrame(good, columns), notes)
    got = {r.doc_id: r.mentions for r in records.collect()}
    assert [(m.start, m.end) for m in got["n"]] == [(3, 13), (15, 25), (33, 43)] and got["empty"] is None and problems.count() == 0
    assert (got["n"][0].negated, got["n"][0].subject, got["n"][0].uncertain, got["n"][0].cui, got["n"][0].group) == (True, "family_member", None, "C1", "FINDING")
    bad = [(2, "n", " ", *[""] * 9), (3, "n", " x", *[""] * 9), (4, "n", "pain", "", "1", "", *[""] * 6), (5, "n", "pain", "", "1", "5", *[""] * 6), (6, "n", "pain", "many", *[""] * 8), (7, "n", "pain", "9", *[""] * 8), (8, "n", "pain", "", "", "", "", "", "perhaps", "", "", ""), (9, "gone", "pain", *[""] * 9)]
    _, problems = gold.convert(spark.createDataFrame(bad, columns), notes)
    assert [r.row for r in problems.orderBy("row").collect()] == [2, 3, 4, 5, 6, 7, 8, 9]


def test_carry_over(spark):
    rows = spark.createDataFrame([("n", 3, 13, "A"), ("n", 33, 43, "B"), ("n", 26, 31, "C")], "doc_id string, start int, end int, cui string")
    old = spark.createDataFrame([("n", NOTE)], "doc_id string, text string")
    out = {r.cui: r for r in gold.carry_over(rows, old, old.withColumn("text", F.replace("text", F.lit("again; chest"), F.lit("today, and chest")))).collect()}
    assert (out["A"].start, out["A"].needs_review) == (3, False) and out["B"].text == "chest pain" and not out["B"].needs_review
    assert out["C"].needs_review


def test_adjudication(spark):
    spans = spark.createDataFrame([(0, 0, 4, "agree", "C1", "C1"), (1, 0, 4, "differ", "C1", None), (2, 5, 9, "differ", "C1", "C2"), (3, 5, 9, "differ", "C1", "C2")], "idx int, start int, end int, status string, a_cui string, b_cui string")
    decisions = spark.createDataFrame([(1, "second", ""), (2, "first", "cui=C5;span=6-8")], "idx int, action string, overrides string")
    rules = spark.createDataFrame([("C5", "C55")], "from_cui string, to_cui string")
    out = {r.idx: (r.outcome, r.cui, r.new_start, r.new_end) for r in gold.adjudicate(spans, decisions, rules).collect()}
    assert out == {0: ("keep", "C1", 0, 4), 1: ("error: not marked", None, 0, 4), 2: ("keep", "C55", 6, 8), 3: ("error: no decision", None, 5, 9)}
    pair = spark.createDataFrame([(0, 0, 4, "C1"), (0, 5, 9, "C2")], "doc_seq long, start int, end int, cui string")
    other = spark.createDataFrame([(0, 0, 4, "C1"), (0, 5, 9, "C3")], "doc_seq long, start int, end int, cui string")
    d = spark.createDataFrame([(0, 5, 9, "second", ""), (0, 20, 21, "first", "")], "doc_seq long, start int, end int, take string, overrides string")
    assert {(r.start, r.outcome, r.cui) for r in gold.adjudicate_pair(pair, other, d).collect()} == {(0, "keep", "C1"), (5, "keep", "C3"), (20, "error: neither annotation has it", None)}


def test_assertion_combos_keep_all_concepts_of_a_document(spark, monkeypatch):
    from notegrain.plans import catalog

    rows = spark.range(1200).selectExpr("1L doc_seq", "concat('C', id) cui", "false negated", "'patient' subject", "false history_of", "cast(null as boolean) uncertain", "id ord", "'n' preferred_name", "'g' semantic_group")
    monkeypatch.setattr(catalog.N, "clinical", lambda spark, sf_dir: rows)
    assert catalog.assertion_combos(spark, "").count() == 1200
