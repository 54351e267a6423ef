from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from notegrain.operators import graph, omop, terminology as term


def concept(cui, sab, tty, code, name, aui, lat="ENG", suppress="N"):
    return f"{cui}|{lat}|P|L|PF|S|Y|{aui}||||{sab}|{tty}|{code}|{name}|9|{suppress}||\n"


def relation(cui1, aui1, rel, cui2, aui2, rela, sab, suppress="N"):
    return f"{cui1}|{aui1}|X|{rel}|{cui2}|{aui2}|X|{rela}|R||{sab}|{sab}|||{suppress}||\n"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    meta = tmp_path_factory.mktemp("release") / "2031AB"
    meta.mkdir()
    rows = [
        concept("C1", "ICD10CM", "HT", "A", "top", "a1"), concept("C2", "ICD10CM", "PT", "A.1", "middle", "a2"), concept("C3", "ICD10CM", "PT", "A.11", "leaf", "a3"),
        concept("C4", "ICD10CM", "HT", "B", "other top", "a4"), concept("C2", "ICD10CM", "PT", "A.19", "middle, unspecified", "a5"),
        concept("C3", "SNOMEDCT_US", "SY", "77", "leaf synonym", "s1"), concept("C3", "SNOMEDCT_US", "PT", "77", "Leaf", "s2"), concept("C3", "SNOMEDCT_US", "PT", "77", "Leaf again", "s3"),
        concept("D1", "RXNORM", "IN", "11", "drug", "x1"), concept("D2", "RXNORM", "SCD", "22", "drug 10 MG", "x2"), concept("D3", "RXNORM", "SBD", "33", "Brand 10 MG", "x3"), concept("D4", "RXNORM", "BN", "44", "Brand", "x4"),
        concept("C9", "ICD10CM", "PT", "Z", "gone", "z1", suppress="O"), concept("C9", "ICD10CM", "PT", "Z", "parti", "z2", lat="FRE"), concept("C9", "MSH", "MH", "Z", "unwanted", "z3"), "too|short\n",
    ]
    edges = [
        relation("C1", "a1", "CHD", "C2", "a2", "", "ICD10CM"), relation("C2", "a2", "CHD", "C3", "a3", "", "ICD10CM"), relation("C4", "a4", "CHD", "C3", "a3", "", "ICD10CM"), relation("C2", "a2", "CHD", "C2", "a5", "", "ICD10CM"),
        relation("C4", "a4", "CHD", "C1", "a1", "", "ICD10CM", suppress="O"), relation("C1", "a1", "CHD", "C1", "a1", "", "ICD10CM"),
        relation("D1", "x1", "RO", "D2", "x2", "has_ingredient", "RXNORM"), relation("D2", "x2", "RN", "D3", "x3", "tradename_of", "RXNORM"), relation("D3", "x3", "RO", "D2", "x2", "has_tradename", "RXNORM"),
    ]
    (meta / "CON").write_text("".join(rows))
    (meta / "REL").write_text("".join(edges))
    (meta / "RANK").write_text("0400|RXNORM|IN|N|\n0440|ICD10CM|HT|N|\n0500|SNOMEDCT_US|PT|N|\n")
    return term.build(spark, str(meta / "CON"), str(meta / "RANK"), str(meta / "store"), mrrel=str(meta / "REL"))


def test_build_info_and_refusals(spark, store, tmp_path):
    info = store.build_info
    assert (info["umls_release"], info["hierarchy_sources"], info["has_ingredients"]) == ("2031AB", "ICD10CM,SNOMEDCT_US", True)
    with pytest.raises(ValueError, match="no code hierarchy"):
        term.TerminologyStore(store.codes).require(hierarchy=True)
    with pytest.raises(ValueError, match="did you mean ICD10CM"):
        term.system("icd-10")


def test_preferred_and_first_rows(store):
    got = {(r.cui, r.sab, r.code, r.tty): (r.is_preferred, r.str) for r in store.codes.collect()}
    assert got["C3", "SNOMEDCT_US", "77", "PT"] == (True, "Leaf") and got["C3", "SNOMEDCT_US", "77", "SY"][0] is False
    assert got["D2", "RXNORM", "22", "SCD"][0] is True and not any(k[0] == "C9" for k in got)


def test_ancestors_and_descendants(store):
    up = {(r.code, r.ancestor_code): r.distance for r in store.ancestors().collect()}
    assert up == {("A.1", "A"): 1, ("A.11", "A.1"): 1, ("A.11", "A"): 2, ("A.11", "B"): 1, ("A.19", "A.1"): 1, ("A.19", "A"): 2}
    assert [tuple(r) for r in store.descendants("icd10cm", "a").collect()] == [("A.1", 1), ("A.11", 2), ("A.19", 2)]


def test_ingredients(store):
    assert {(r.product_cui, r.ingredient_cui, r.hops, r.ingredient_rxcui) for r in store.ingredients().collect()} == {("D1", "D1", 0, "11"), ("D2", "D1", 1, "11"), ("D3", "D1", 2, "11")}


def test_nested_codes_display_crosswalk_and_codes_below(spark, store):
    nested = {r.cui: r.codes for r in store.nested_codes(ancestor_depth=1, ingredients=True).collect()}
    assert [(c.system, c.code, c.ancestors) for c in nested["C3"]] == [("ICD10CM", "A.11", ["A.1", "B"]), ("SNOMEDCT_US", "77", []), ("SNOMEDCT_US", "77", [])]
    assert [c.tty for c in nested["C3"]][1:] == ["PT", "SY"] and nested["D3"][0].ingredients == ["11"]
    assert {r.cui: r.display for r in store.preferred_display().collect()}["C3"] == "Leaf"
    assert [tuple(r) for r in store.crosswalk("ICD10CM", "snomedct-us", "a.11").collect()] == [("A.11", "C3", "77", "Leaf")]
    below = store.resolve_codes(spark.createDataFrame([("ICD10CM", "a.1")], "sab string, code string"))
    assert {r.cui: r.via for r in below.collect()} == {"C2": ["A.1", "A.19"], "C3": ["A.11"]}
    assert [r.cui for r in store.cuis_for_code("ICD10CM", "a.1").collect()] == ["C2"]


def test_reach_on_random_graphs_with_cycles(spark):
    rng = random.Random(2)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(20)}
    df = spark.createDataFrame([("s", str(a), str(b)) for a, b in edges], "sab string, node string, next string")
    starts = spark.createDataFrame([("s", str(k), str(k)) for k in range(12)], "sab string, origin string, node string")
    want = set()
    for k in range(12):
        seen, front = {k: 0}, [k]
        for hop in range(1, 4):
            front = sorted({b for a, b in edges if a in front and b not in seen})
            seen |= dict.fromkeys(front, hop)
        want |= {(str(k), str(n), h) for n, h in seen.items()}
    assert {(r.origin, r.node, r.hops) for r in graph.reach(starts, df, 3).collect()} == want
    with pytest.raises(ValueError, match="max_depth"):
        graph.reach(starts, df, 0)


def test_omop_lookup(spark, tmp_path):
    (tmp_path / "CONCEPT.csv").write_text('concept_id\tconcept_name\tvocabulary_id\tconcept_code\tstandard_concept\tinvalid_reason\n1\tA "bare\tSNOMED\t77\tS\t\n2\tB\tICD10CM\tA.11\t\t\n3\tC\tICD10CM\tX\t\t\n4\tD\tOther\tY\tS\t\n')
    (tmp_path / "CONCEPT_RELATIONSHIP.csv").write_text("concept_id_1\tconcept_id_2\trelationship_id\tinvalid_reason\n2\t9\tMaps to\t\n2\t1\tMaps to\t\n3\t1\tMaps to\tD\n4\t1\tMaps to\t\n")
    (tmp_path / "VOCABULARY.csv").write_text("vocabulary_id\tvocabulary_version\nSNOMED\tv1\nOther\tv2\n")
    got = {(r.sab, r.code): (r.source_concept_id, r.concept_id) for r in omop.build(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert got == {("SNOMEDCT_US", "77"): (1, 1), ("ICD10CM", "A.11"): (2, 1), ("ICD10CM", "X"): (3, 0)}
    assert omop.versions(spark, str(tmp_path)) == "SNOMED=v1"


def test_note_ids_from_keys(spark):
    docs = spark.createDataFrame([(" 12 ",), ("x1",), ("٣",), ("99999999999999999999",)], "doc_id string")
    assert [tuple(r) for r in omop.note_id_from_key(docs).collect()] == [(" 12 ", 12)]


def test_columns_made_of_codes_once_for_each_concept(spark):
    codes = spark.createDataFrame([("C1", "ICD10CM", "a", "PT", "x", True), ("C1", "LNC", "b", "PT", "y", False)], "cui string, sab string, code string, tty string, str string, is_preferred boolean")
    mentions = spark.createDataFrame([(1, "C1"), (2, "C1"), (3, "C2")], "doc_seq long, cui string")
    out = term.TerminologyStore(codes).attach(mentions, of_codes=lambda c: {"listed": F.array_join(F.transform(c, lambda x: x["code"]), " "), "n": F.size(c)})
    assert sorted(map(tuple, out.select("doc_seq", "cui", "listed", "n").collect())) == [(1, "C1", "a b", 2), (2, "C1", "a b", 2), (3, "C2", "", 0)]
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()  # made before the join, not for each mention


def test_long_strings_of_codes_once_in_a_file(spark, tmp_path):
    conf, name = spark.sparkContext._jsc.hadoopConfiguration(), "parquet.dictionary.page.size"
    conf.setInt(name, 1 << 14)
    try:
        # 40 concepts with some 2,600 characters of codes, 100 with 130, one with more than a dictionary holds, and some without
        codes = spark.range(40 * 40 + 100 * 2 + 400).selectExpr("case when id < 1600 then concat('L', id % 40) when id < 1800 then concat('S', id % 100) else 'X' end cui", "'LNC' sab", "sha2(cast(id as string), 256) code", "'PT' tty", "'x' str", "true is_preferred")
        mentions = spark.range(15000).selectExpr("id doc_seq", "case when id % 50 < 20 then concat('L', id % 7 * id % 40) when id % 50 < 40 then concat('S', id % 100) when id = 49 then 'X' when id % 50 = 41 then null else 'N' end cui")
        out = term.TerminologyStore(codes).attach(mentions, of_codes=lambda c: {"listed": F.array_join(F.transform(c, lambda x: x["code"]), " "), "n": F.size(c)})
        out.write.option("compression", "none").parquet(str(tmp_path / "out"))
        back = spark.read.parquet(str(tmp_path / "out"))
        want = codes.groupBy("cui").agg(F.array_join(F.array_sort(F.collect_list("code")), " ").alias("listed"), F.count("*").alias("n"))
        want = mentions.join(want, "cui", "left").select("doc_seq", "cui", F.coalesce("listed", F.lit("")).alias("listed"), F.coalesce("n", F.lit(0)).alias("n"))
        assert sorted(map(tuple, back.select("doc_seq", F.coalesce("cui", F.lit("")), F.md5("listed"), "n").collect())) == sorted(map(tuple, want.select("doc_seq", F.coalesce("cui", F.lit("")), F.md5("listed"), "n").collect()))
        # the rows hold 15 million characters of codes, their concepts some 140,000
        assert back.agg(F.sum(F.length("listed"))).first()[0] > 10_000_000
        assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 1_000_000
    finally:
        conf.unset(name)


def test_strings_that_fit_one_dictionary_move_no_mention(spark):
    codes = spark.createDataFrame([("C1", "LNC", "a", "PT", "x", True)], "cui string, sab string, code string, tty string, str string, is_preferred boolean")
    mentions = spark.createDataFrame([(1, "C1")], "doc_seq long, cui string")
    assert term.dealt_by_strings(mentions, codes.select("cui", "code")) is mentions
    assert term.dealt_by_strings(mentions, codes.select("cui", "code").where("false")) is mentions
