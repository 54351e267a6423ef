"""Stages on small tables, each held against what its operator must keep."""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from notegrain import scratch
from notegrain.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plain_links(texts: dict) -> dict:
    """The smallest id that each document reaches, by comparing all pairs of full sets of words in fives."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in sets}

    def top(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            least[y] = x
    return {d: top(d) for d in sets}


SECRETS = [re.compile(p, re.I if k == 0 else 0) for k, p in enumerate((r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}""", r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"))]


def plain_targets(sizes: dict) -> dict:
    """Targets of sources by sharing what is left again and again."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    target, open_, left = dict.fromkeys(sizes, 0.0), {s for s in sizes if sizes[s]}, float(sum(sizes.values()))
    while left > 1e-6 and open_:
        share, total, over = left, sum(weight[s] for s in open_), 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weight[s] / total
        for s in sorted(open_, key=str):
            if target[s] >= 3 * sizes[s]:
                over += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
        left = over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_and_run(spark, tmp_path):
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "bpe":
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    text = {r.doc_id: r.text for r in seen["documents"]}
    # clean documents stay: all have a language and letters
    assert {r.doc_id for r in seen["language_id"]} == set(text)
    least = plain_links(text)
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted({*least.values()}) and len({*least.values()}) < len(text)
    safe = {r.doc_id: r for r in seen["secret_scan"]}
    assert safe.keys() == {*least.values()}
    for d, r in safe.items():
        if any(p.search(text[d]) for p in SECRETS):
            assert "[" in r.text and r.n_chars == len(r.text) and not any(p.search(r.text) for p in SECRETS)
        else:
            assert r.text == text[d] or "[pem]" in r.text or "[bearer]" in r.text
    sizes, taken = Counter(), Counter()
    for r in seen["secret_scan"]:
        sizes[r.source] += words(r.text)
    for r in seen["source_mix"]:
        taken[r.source] += words(r.text)
    longest = max(words(r.text) for r in seen["secret_scan"])
    assert all(abs(taken[s] - t) <= longest for s, t in plain_targets(sizes).items())
    assert max(Counter(r.doc_id for r in seen["source_mix"]).values()) <= 3 and all(safe[r.doc_id].text == r.text for r in seen["source_mix"])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.vocabulary(), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, len(library.encode_ordinary(r.text))) for r in seen["source_mix"])
    assert Counter((r.doc_id, r.n_tokens) for r in seen["bpe"]) == want
    assert Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, FOLDER).collect()) == want


def test_odd_rows_in_every_stage(spark, corpus):
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars", "block", "node")
    odd = spark.createDataFrame([(None, "alone words here", None, None, 3), (None, "Alone words  here", None, "a", 3), (None, None, None, None, None), (50, "twice the same row", "yy", "a", 1), (50, "twice the same row", "yy", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd.selectExpr("*", "'x' block", "1 node")).cache()
    rows = lambda df: df.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = rows(stage(spark, docs, ""))
        assert stage(spark, docs.where("false"), "").count() == 0
        if name == "language_id":  # what has no letter goes
            assert Counter(r.doc_id for r in out if r.doc_id in (6, 7, 8, 17, 50)) == {17: 1, 50: 2}
        if name == "near_duplicates":
            ids = Counter(r.doc_id for r in out)
            assert ids[50] == 1 and ids[6] == ids[7] == ids[8] == 1 and ids[3] == 0 and ids[9] == 1 and ids[10] == 0
            # of the rows without id: the passage of document 1 goes, one of two equal ones stays, the null text stays
            assert sorted(r.text or "" for r in out if r.doc_id is None) in (["", "Alone words  here"], ["", "alone words here"])
        if name == "secret_scan":
            assert len(out) == docs.count() and {r.doc_id: r.text for r in out}[19] == "[assign]' [access] [hex]" and {r.doc_id: r.n_chars for r in out}[19] == 24
        if name == "source_mix":
            assert set(Counter((r.doc_id, r.text, r.source) for r in out).values()) <= {1, 2, 3, 4, 6} and all(r.source != "" for r in out)
        if name == "bpe":
            assert len(out) == docs.count() and {r.doc_id: r.n_tokens for r in out}[6] == 0


def test_queries_run_on_the_small_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, f in queries.QUERIES.items():
        df = f(spark, FOLDER)
        rows = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)
        assert len(rows) == db.sql(f"SELECT count(*) FROM {'pages' if 'html' in name else 'documents'}").fetchall()[0][0]
        if name in queries.ORACLES:
            want = db.sql(queries.ORACLES[name])
            assert rows == sorted(want.select(*sorted(want.columns)).fetchall(), key=repr)


def test_written_tables_give_the_drivers_free_memory_back(spark, monkeypatch):
    """The driver's JVM has the command, each written table calls it, and without it nothing fails."""
    given = []
    monkeypatch.setattr(scratch, "release", lambda s, f=scratch.release: given.append(f(s)))
    assert scratch.written(spark.range(5), "few").count() == 5
    version = int(spark._jvm.java.lang.System.getProperty("java.specification.version"))
    assert len(given) == 1 and (given[0] or version < 17)
    monkeypatch.setattr(scratch, "COMMAND", "noSuchCommand")
    assert scratch.written(spark.range(5), "few").count() == 5
    assert given[1:] == [False]
