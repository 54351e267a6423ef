from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from notegrain.functions import expressions as E
from notegrain.model import with_defaults
from notegrain.operators import ensemble, lexicon, spans

TEXT = "CHIEF COMPLAINT: Chest pain.\nPhysical Exam: patient well, chest pain worse today.\n2. Hypertension: stable.\nHe describes the pain as follows: dull.\n"
PROBLEMS = "ASSESSMENT/PLAN:\r\nHypertension: continue.\r\nDiabetes Mellitus: A1c 7.2.\r\nPast Medical History: asthma.\r\nAbdomen: soft.\r\nMusculoskeletal Examination:\r\n"


def docs(spark, *texts):
    return spark.createDataFrame([(k, f"d{k}", t) for k, t in enumerate(texts)], "doc_seq long, doc_id string, text string")


def mentions(spark, rows):
    """rows: (doc_seq, start, end, cui[, types])"""
    full = [(r[0], f"d{r[0]}", r[1], r[2], r[3], list(r[4]) if len(r) > 4 else [], k) for k, r in enumerate(rows)]
    return with_defaults(spark.createDataFrame(full, "doc_seq long, doc_id string, start int, end int, cui string, semantic_types array<string>, ord long").withColumn("engine", F.lit("x")))


def test_headings(spark):
    found = {(r.doc_seq, (TEXT, PROBLEMS)[r.doc_seq][r.start : r.end]) for r in spans.headings(docs(spark, TEXT, PROBLEMS)).collect()}
    assert found == {(0, "CHIEF COMPLAINT"), (0, "Physical Exam"), (1, "ASSESSMENT/PLAN"), (1, "Past Medical History"), (1, "Abdomen"), (1, "Musculoskeletal Examination")}


def test_heading_history_is_unassessed_but_false_elsewhere_stays(spark):
    m = mentions(spark, [(0, 0, 5, "A"), (0, 17, 27, "B")]).withColumn("history_of", F.lit(False))
    out = {r.cui: r.history_of for r in spans.unassess_heading_history(m, docs(spark, TEXT)).collect()}
    assert out == {"A": None, "B": False}


def at(needle, n=1):
    k = -1
    for _ in range(n):
        k = TEXT.index(needle, k + 1)
    return k, k + len(needle)


def test_guideline_filter(spark):
    rows = [
        (0, *at("COMPLAINT"), "C1"), (0, *at("Chest pain"), "C2"), (0, *at("Exam"), "C3"), (0, *at("patient"), "C4"), (0, *at("chest pain"), "C2"), (0, *at("pain", 2), "C5"),
        (0, *at("worse"), "C6", ("T033",)), (0, *at("today"), "C7", ("T079",)), (0, *at("Hypertension"), "C8"), (0, *at("Chest pain"), "C9"),
    ]
    m = mentions(spark, rows)
    out = sorted((r.start, r.cui) for r in spans.guideline_filter(m, docs(spark, TEXT)).collect())
    assert out == sorted([(at("Chest pain")[0], "C2"), (at("chest pain")[0], "C2"), (at("Hypertension")[0], "C8")])
    standard = m.withColumn("standard", F.col("cui") == "C9")
    assert (at("Chest pain")[0], "C9") in {(r.start, r.cui) for r in spans.guideline_filter(standard, docs(spark, TEXT), "standard").collect()}


def test_longest_is_greedy_and_keeps_equal_spans(spark):
    m = mentions(spark, [(0, 0, 10, "A"), (0, 0, 10, "B"), (0, 6, 10, "C"), (0, 8, 16, "D"), (0, 14, 20, "E")])
    assert sorted(r.cui for r in spans.longest_spans(m).collect()) == ["A", "B", "E"]


@pytest.mark.parametrize(("span", "expected"), [((3, 15), (4, 14)), ((14, 16), (14, 16)), ((4, 9), (4, 9))])
def test_trimmed(spark, span, expected):
    text = "no (chest pain), today"
    row = spark.createDataFrame([(text[slice(*span)], *span)], "text string, start int, end int").select(*E.trimmed_span()).first()
    assert tuple(row) == expected


def test_segments(spark):
    m = mentions(spark, [(0, 0, 10, "A"), (0, 6, 10, "B")])
    out = [(r.start, r.end, r.cuis) for r in spans.segments(docs(spark, "x" * 14), m).orderBy("start").collect()]
    assert out == [(0, 6, ["A"]), (6, 10, ["A", "B"]), (10, 14, [])]


def test_adjacent_overlaps(spark):
    assert [r.cui for r in spans.adjacent_overlaps(mentions(spark, [(0, 0, 4, "A"), (0, 3, 6, "B"), (0, 6, 8, "C")])).collect()] == ["B"]


def lexicon_rows(spark):
    return spark.createDataFrame([("chest pain", "C1", "Chest Pain", "FINDING", ["T184"]), ("pain", "C2", "Pain", "FINDING", ["T184"]), ("diabetes", "C3", "Diabetes", "DISORDER", ["T047"]), ("ödem", "C4", "Ödem", "FINDING", ["T184"])], "term string, cui string, preferred_name string, semantic_group string, semantic_types array<string>")


def test_first_hits(spark):
    out = {(r.cui, r.start, r.end, r.negated) for r in lexicon.first_hits(docs(spark, "No pain. Denies no chest pain; DIABETES"), lexicon_rows(spark)).collect()}
    assert out == {("C1", 19, 29, True), ("C2", 3, 7, True), ("C3", 31, 39, True)}


def test_match_terms_at_word_bounds_with_offsets_beyond_the_basic_plane(spark):
    text = "𝄞 Chest pain, painful\nÖdem. chest  pain"
    out = sorted((r.cui, r.start, r.end, r.text) for r in lexicon.match_terms(docs(spark, text, None, ""), lexicon_rows(spark)).collect())
    assert out == [("C1", 2, 12, "Chest pain"), ("C2", 8, 12, "pain"), ("C2", 35, 39, "pain"), ("C4", 22, 26, "Ödem")]
    assert all(text[s:e] == t for _, s, e, t in out)


def test_lookup_term(spark):
    assert [tuple(r) for r in lexicon.lookup_term(lexicon_rows(spark), " PAIN ", 5).collect()] == [("C2", "Pain")]


def test_group_filter_comes_before_the_choice_of_a_concept(spark):
    m = mentions(spark, [(0, 0, 4, "A"), (0, 0, 4, "B")]).withColumn("semantic_group", F.when(F.col("cui") == "A", "DRUG").otherwise("Finding"))
    assert [r.cui for r in spans.one_concept_per_span(spans.group_filter(m, ["finding"])).collect()] == ["B"]


def test_distinct_concepts_of_an_entity(spark):
    m = mentions(spark, [(0, 0, 4, "A"), (0, 0, 4, "A"), (0, 0, 4, "B")]).withColumn("entity", F.lit(1))
    assert sorted((r.cui, r.ord) for r in ensemble.distinct_concepts(m, "entity").collect()) == [("A", 0), ("B", 2)]


def test_nth_occurrence_may_overlap(spark):
    df = spark.createDataFrame([("aaa", "aa", 1), ("aaa", "aa", 2), ("aaa", "aa", 3), ("abc", "x", 1)], "t string, x string, n int")
    assert [r[0] for r in df.select(E.nth_occurrence("t", "x", "n")).collect()] == [0, 1, None, None]


def test_snippet(spark):
    text = "".join(chr(97 + k % 26) for k in range(100))

    def want(s, e, w):
        if e - s >= w:
            return text[s : s + w]
        low = max(0, s - (w - (e - s)) // 2)
        return text[max(0, min(len(text), low + w) - w) : min(len(text), low + w)]

    rows = [(text, s, s + n) for s, n in ((0, 3), (50, 7), (97, 3), (40, 30), (10, 1))]
    df = spark.createDataFrame(rows, "t string, start int, end int")
    assert [r[0] for r in df.select(E.snippet("t", "start", "end", 20)).collect()] == [want(s, e, 20) for _, s, e in rows]


def test_headings_far_from_their_colon(spark):
    text = "HPI" + " " * 70 + ":\nnot a heading here: x\nPLAN:"
    got = {text[r.start : r.end] for r in spans.headings(docs(spark, text)).collect()}
    assert got == {"HPI", "PLAN"}


def test_offsets_of_many_pieces(spark):
    """Beyond one chunk, with characters of several bytes, and the empty array."""
    from notegrain.functions.expressions import running_offsets

    pieces = [["é" * (k % 4) for k in range(2500)], [], ["ab"]]
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pieces)], "k int, pieces array<string>")
    for gap in (0, 1):
        got = {r.k: r.at for r in df.select("k", F.expr(running_offsets("pieces", gap)).alias("at")).collect()}
        for k, p in enumerate(pieces):
            want, at = [], 0
            for x in p:
                want.append(at)
                at += len(x) + gap
            assert got[k] == want


def test_terms_of_a_long_text(spark):
    from notegrain.operators import lexicon as lex

    words = [f"w{k % 977}" for k in range(60_000)]
    words[30_000:30_002] = ["red", "gear"]
    text = "é " + " ".join(words)
    terms = spark.createDataFrame([("red gear", "C1", "n", "g"), ("gear", "C2", "n", "g"), ("red gear", "C1", "m", "g")], "term string, cui string, preferred_name string, semantic_group string")
    found = lex.match_terms(docs(spark, text, "", "gear"), terms, "x", 2).orderBy("doc_seq", "ord").collect()
    assert [(r.doc_seq, r.ord, text[r.start : r.end] if r.doc_seq == 0 else r.text, r.cui) for r in found] == [(0, 0, "red gear", "C1"), (0, 1, "gear", "C2"), (2, 0, "gear", "C2")]
