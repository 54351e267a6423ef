from __future__ import annotations

import pytest

from notegrain import service
from notegrain.config import Config
from notegrain.extractor import Extractor
from notegrain.operators.terminology import TerminologyStore


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [("chest pain", "C1", "Chest Pain", "FINDING", ["T184"]), ("pain", "C2", "Pain", "FINDING", ["T184"])]
    return spark.createDataFrame(rows, "term string, cui string, preferred_name string, semantic_group string, semantic_types array<string>")


def test_concepts_of_a_text(spark, lexicon):
    ex = Extractor(Config(overlaps="longest"), lexicon)
    out = service.extract_concepts(spark, ex, "No chest pain. Chest pain again, and pain.", 1).collect()
    assert [(r.cui, r.mentions, r.total_concepts, r.truncated) for r in out] == [("C1", 2, 2, True)]
    assert {(a.negated, a.n) for a in out[0].assertions} == {("true", 1), ("false", 1)}
    for text, n in (("", 1), ("x" * (service.MAX_TEXT + 1), 1), ("x", 0)):
        with pytest.raises(ValueError):
            service.extract_concepts(spark, ex, text, n)


def test_lookups(spark, lexicon):
    rows = [("C1", "ICD10CM", "R07.9", "PT", "Chest pain, unspecified", True), ("C1", "SNOMEDCT_US", "29857009", "PT", "Chest pain", True), ("C1", "SNOMEDCT_US", "29857009", "SY", "Pain in chest", False)]
    store = TerminologyStore(spark.createDataFrame(rows, "cui string, sab string, code string, tty string, str string, is_preferred boolean"))
    assert [(r.display, r.sab, r.code) for r in service.lookup_concept(store, " c1 ").collect()] == [("Chest pain", "ICD10CM", "R07.9"), ("Chest pain", "SNOMEDCT_US", "29857009")]
    assert [r.target_code for r in service.crosswalk_code(store, "icd10cm", " r07.9", "SNOMEDCT_US").collect()] == ["29857009"]
    assert [r.cui for r in service.search_terms(lexicon, "Pain").collect()] == ["C2"]
    with pytest.raises(ValueError, match="max_results"):
        service.search_terms(lexicon, "pain", 1000)
