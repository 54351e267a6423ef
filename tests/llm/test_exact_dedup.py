"""Both exact dedups against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from notegrain.llm import blocks, minhash, substring_dedup as words, suffix_dedup as suffixes


def brute(items: dict[int, list], length: int):
    first: dict = {}
    for d in sorted(items):
        for i in range(len(items[d]) - length + 1):
            first.setdefault(tuple(items[d][i : i + length]), d)
    out = {}
    for d, x in items.items():
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if first[tuple(x[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out[d] = gone
    return out


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("period", [21, 13, 8, 1])
def test_words(corpus, rows, period):
    items = {r.doc_id: split(r.text) for r in rows}
    gone = brute(items, 50)
    found = {r.doc_id: r for r in words.substring_dedup(corpus, period=period).collect()}
    assert len(found) == len(items) + 1 and found[None].n_removed == 0 and found[None].n_words == 70
    for d, w in items.items():
        kept = " ".join(x for x, g in zip(w, gone[d], strict=True) if not g)
        r = found[d]
        assert (r.n_words, r.n_removed, r.kept_text, r.kept_sha256) == (len(w), sum(gone[d]), kept, hashlib.sha256(kept.encode()).hexdigest())
    assert found[3].n_removed == 70 and found[1].n_removed == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_bytes(corpus, rows, hot):
    items = {r.doc_id: list((r.text or "").encode()) for r in rows}
    gone = brute(items, 50)
    found = {r.doc_id: r for r in suffixes.suffix_dedup(corpus, hot=hot).collect()}
    assert len(found) == len(items) + 1 and found[None].n_removed == 0
    for d, x in items.items():
        kept = bytes(c for c, g in zip(x, gone[d], strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[d][i - 1]) for i, g in enumerate(gone[d]))
        r = found[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(x), sum(gone[d]), runs, kept)


def thue_morse(n, a, b):
    """Words whose polynomial hashes modulo 2**64 are equal for any base: the first n letters, and the same with a and b exchanged."""
    return "".join((a, b)[k.bit_count() % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_polynomial_hashes_confuse(spark, n):
    one, two = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    docs = spark.createDataFrame([(1, " ".join([one] * 60)), (2, " ".join([two] * 60)), (3, one), (4, two)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in words.substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    items = {r.doc_id: list(r.text.encode()) for r in docs.collect()}
    gone = brute(items, 50)
    for hot in (2000, 1):
        found = {r.doc_id: bytes(r.kept) for r in suffixes.suffix_dedup(docs, hot=hot).collect()}
        assert found == {d: bytes(c for c, g in zip(x, gone[d], strict=True) if not g) for d, x in items.items()}


def test_empty_table_and_repeated_ids(spark, corpus):
    for f in (words.substring_dedup, suffixes.suffix_dedup):
        assert f(corpus.where("false")).count() == 0
        twice = corpus.where("doc_id = 1").unionByName(corpus.where("doc_id = 1"))
        assert [r.n_removed for r in f(twice).collect()] == [0, 0]
    with pytest.raises(ValueError):
        words.substring_dedup(corpus, period=51)
    with pytest.raises(ValueError):
        suffixes.suffix_dedup(corpus, length=1)


@pytest.mark.parametrize("period", range(1, 60))
def test_any_two_positions_reach_the_cover_together(period):
    cover = set(words.difference_cover(period))
    assert all(any((i + s) % period in cover and (j + s) % period in cover for s in range(period)) for i in range(period) for j in range(period))
    assert period < 9 or len(cover) < period


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=5), st.integers(2, 20))
def test_refinement_numbers_equal_strings_alike(texts, length):
    strings = [t[i : i + length] for t in texts for i in range(len(t) - length + 1)]
    number = suffixes.refine(np.frombuffer("".join(texts).encode(), np.uint8), np.array([len(t) for t in texts]), length)
    assert len(number) == len(strings)
    assert len(set(zip(number.tolist(), strings, strict=True))) == len(set(number.tolist())) == len(set(strings))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("a\0", max_size=150), min_size=1, max_size=6), st.sampled_from([7, 8, 9, 16, 50, 56, 57]))
def test_refinement_of_repeats_and_zero_bytes(texts, length):
    test_refinement_numbers_equal_strings_alike.hypothesis.inner_test(texts, length)


@pytest.mark.parametrize("size", range(20))
def test_a_block_of_few_bytes(size):
    block = suffixes._Block(pa.table({"doc_id": pa.array([1], pa.int64()), "text": ["x" * size]}), 50, 26)
    assert len(block.keys) == 0


def test_documents_of_a_block_in_another_order(spark, monkeypatch):
    """Every reading of a block's documents may meet them in another order; the answers must reach the same windows."""
    one = " ".join(f"{k * k} quick brown foxes" for k in range(12))
    texts = [one, one[:130] + "#" + one[131:], "? " + one[40:190], one[:70] + one[90:], "a" * 80 + one[:60], "b" + "a" * 90, one[100:] + one[:100]]
    docs = spark.createDataFrame([(d + 1, x) for d, x in enumerate(texts)], "doc_id long, text string")
    gone = brute({d + 1: list(x.encode()) for d, x in enumerate(texts)}, 50)
    asks, finish = blocks.asks, blocks.finish
    turned = lambda f: lambda block, table, *answers: f(block, table.take(list(range(len(table)))[::-1]), *answers)
    for hot in (2000, 1):
        turns = iter([False, True, False])
        monkeypatch.setattr(blocks, "block_count", lambda *_: 1)
        monkeypatch.setattr(blocks, "asks", lambda rows, f, answers=None: asks(rows, turned(f) if next(turns) else f, answers))
        monkeypatch.setattr(blocks, "finish", lambda rows, f, answers, schema: finish(rows, turned(f), answers, schema))
        found = {r.doc_id: bytes(r.kept) for r in suffixes.suffix_dedup(docs, hot=hot).collect()}
        assert found == {d + 1: bytes(c for c, g in zip(x.encode(), gone[d + 1], strict=True) if not g) for d, x in enumerate(texts)}
