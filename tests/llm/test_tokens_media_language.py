from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from notegrain.llm import bpe, langid, media, text as T
from notegrain.llm.queries import vocabulary

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(), "rb"))}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(vocabulary(), tokenizers.PATTERN)


def test_ids_and_round_trip(spark, corpus, library):
    encoded = bpe.bpe_encode(corpus, vocabulary, tokenizers.PATTERN)
    back = {(r.doc_id, r.text) for r in bpe.bpe_decode(encoded, vocabulary, tokenizers.PATTERN).collect()}
    found = defaultdict(list)
    for r in encoded.collect():
        found[r.doc_id].append(r)
    for r in corpus.collect():
        want = library.encode_ordinary(r.text or "")
        (got,) = found[r.doc_id]
        assert (list(got.ids), got.n_tokens) == (want, len(want)) and (r.doc_id, r.text or "") in back
        assert got.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.bpe_encode(corpus.where("false"), vocabulary, tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text("etaoin 's.\n\té1", max_size=80), st.text(st.characters(max_codepoint=0x24F), max_size=30), st.text("ab", max_size=200))))
def test_batches_equal_the_library(library, encoder, texts):
    assert bpe.encode_texts(encoder, texts) == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("piece", ["a" * 5001, "ab" * 2000 + "a", "".join("abc"[k * k % 3] for k in range(4000))])
def test_one_long_piece(library, encoder, piece):
    assert encoder.encode_piece(piece.encode()) == library.encode_ordinary(piece)


def test_rank_queue_pops_in_order():
    q, ranks = bpe.RankQueue(50_000), [49_999, 0, 64, 63, 4096, 64, 4095]
    for r in ranks:
        q.push(r, r)
    assert [q.pop() for _ in range(7)] == [(r, [r] * ranks.count(r)) for r in sorted(set(ranks))] + [None]


def test_media_rows(corpus):
    found = {r.doc_id: r for r in media.media_columns(corpus).collect()}
    for r in corpus.collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        got = found[r.doc_id]
        assert (got.n_bytes, got.payload_bytes, got.payload_sha256, got.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (got.media_bytes, got.media_sha256) == (len(got.media), hashlib.sha256(bytes(got.media)).hexdigest())
    thumb = {r.doc_id: r for r in media.read_media(media.media_columns(corpus)).collect()}
    assert thumb[1].width == 1536 and f"{thumb[1].width}x{thumb[1].height}:{thumb[1].thumbnail_hash}" == found[1].feature
    assert media.media_columns(corpus.where("false")).count() == 0


def test_a_payload_of_several_frames_and_all_bytes():
    payload = np.resize(np.arange(256, dtype=np.uint8), 192 * (media.FRAME_ROWS + 3))
    (file,) = media.encode(payload, np.array([0, len(payload)]))
    (frames,) = media.thumbnails([file])
    assert len(frames) == 2 and b"".join(t.tobytes() for _, _, t in frames) == payload.tobytes()


def test_what_is_no_baseline_jpeg_is_none():
    (file,) = media.encode(np.full(384, 65, np.uint8), np.array([0, 384]))
    assert media.thumbnails([b"", b"text", file[:40], file[:-2], file.replace(b"\xff\xc0", b"\xff\xc2", 1), file])[:5] == [None] * 5


def color(width, height, restart):
    """A 4:2:0 image with AC coefficients, written bit by bit."""
    dc = ((0, 2, 3, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0), (0, 1, 2, 3, 4, 5, 6, 7, 8, 9))
    ac = ((0, 2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0x00, 0x11, 0xF0))
    dcc, acc = media._codes(*dc), media._codes(*ac)
    rng, bits, out, want = np.random.default_rng(3), "", b"", {}
    wide, high = -(-width // 16), -(-height // 16)
    put = lambda code: format(code[0], f"0{code[1]}b")

    def flush(s):
        s += "1" * (-len(s) % 8)
        return bytes(int(s[k : k + 8], 2) for k in range(0, len(s), 8)).replace(b"\xff", b"\xff\0")

    before = [0, 0, 0]
    for m in range(wide * high):
        if restart and m and m % restart == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (m // restart - 1) % 8])
            bits, before = "", [0, 0, 0]
        for c, (x, y) in [(0, (0, 0)), (0, (1, 0)), (0, (0, 1)), (0, (1, 1)), (1, (0, 0)), (2, (0, 0))]:
            value = int(rng.integers(-100, 100))
            d = value - before[c]
            before[c] = value
            n = abs(d).bit_length()
            bits += put(dcc[n]) + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "")
            for _ in range(int(rng.integers(0, 3))):
                bits += put(acc[0x11]) + "1"
            bits += put(acc[0xF0]) * int(rng.integers(0, 2)) + put(acc[0])
            if c == 0:
                want[m // wide * 2 + y, m % wide * 2 + x] = value
    out += flush(bits)
    head = b"\xff\xd8" + media._segment(0xDB, b"\0" + bytes([4] * 64)) + media._segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\3\1\x22\0\2\x11\0\3\x11\0")
    head += media._segment(0xC4, b"\0" + bytes(dc[0]) + bytes(dc[1])) + media._segment(0xC4, b"\x10" + bytes(ac[0]) + bytes(ac[1])) + (media._segment(0xDD, restart.to_bytes(2, "big")) if restart else b"")
    grid = np.array([[want[y, x] for x in range(-(-width // 8))] for y in range(-(-height // 8))])
    return head + media._segment(0xDA, b"\3\1\0\2\0\3\0\0\x3f\0") + out + b"\xff\xd9", np.clip((grid * 4 + 4 >> 3) + 128, 0, 255)


@pytest.mark.parametrize("restart", [0, 2])
def test_subsampled_colour(restart):
    cases = [color(w, h, restart) for w, h in ((40, 24), (16, 16), (33, 57))]
    for (w, h), frames, (_, want) in zip(((40, 24), (16, 16), (33, 57)), media.thumbnails([f for f, _ in cases]), cases, strict=True):
        assert frames[0][:2] == (w, h) and (frames[0][2] == want).all()


def language_rows(n):
    rng = np.random.default_rng(1)
    parts = {"aa": ["the", "ing", "er", "on", "st"], "bb": ["ção", "que", "os", "ér", "la"]}
    return [(k, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(int(rng.integers(3, 30)))), lang) for k in range(n) for lang in [list(parts)[k % 2]]]


def test_language_accuracy_on_held_out(spark):
    docs = spark.createDataFrame([*language_rows(300), (1000, None, "aa"), (1001, "12 !?", "bb"), (1002, "", None), (None, "que os", "bb"), (1003, "Ω ж " * 30, None)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    out = {r.doc_id: r for r in langid.identify(docs, model, keep=("lang",)).collect()}
    held = [r for r in out.values() if r.doc_id is not None and r.doc_id < 1000 and r.held_out]
    assert len(held) > 40 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97
    assert all(r.accepted and 0 <= r.score <= 1 for r in held)
    assert [(out[k].lang_pred, out[k].score, out[k].accepted) for k in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert out[None].held_out and out[None].lang_pred == "bb" and not out[1003].accepted
    assert langid.identify(docs.where("false"), model).count() == 0
    nothing = langid.learn(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_kneser_ney_probabilities_sum_to_one():
    model = langid.Model.fit([Counter(["abab", "abc", "bca", "ca"])], ["x"], 3)
    letters = ["a", "b", "c", ""]  # "" is the end mark
    for prefix in ("", "a", "ab", "bc", "ccb"):
        # P(letter | prefix) from costs of words that go on with the same end
        total = 0.0
        for x in letters:
            codes, begin, n = langid.spell([prefix + x], 3)
            p, at, _ = langid._grams(codes, begin, n, 3)
            total += 2 ** -_step(model, p, at[len(prefix)])
        assert total + _unseen(model, prefix) == pytest.approx(1, abs=1e-6)


def plain_kneser_ney(counts, order):
    """By dictionaries, from the definition: bits of a word in each language."""
    padded = lambda w: [2] * (order - 1) + [ord(c) for c in w.lower() if c.isalpha()] + [3]
    letters = {x for c in counts for w in c if any(ch.isalpha() for ch in w) for x in padded(w)[order - 1 :]}
    models = []
    for c in counts:
        tables = {order: Counter()}
        for w, n in c.items():
            x = padded(w)
            for i in range(order - 1, len(x)):
                if len(x) > order:
                    tables[order][tuple(x[i - order + 1 : i + 1])] += n
        for k in range(order - 1, 0, -1):
            tables[k] = Counter(g[1:] for g in tables[k + 1])
        models.append(tables)

    def probability(tables, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(letters) + 1)
        t = tables[k]
        ones, twos = (sum(v == m for v in t.values()) for m in (1, 2))
        discount = min(0.9, max(0.1, ones / max(1, ones + 2 * twos)))
        after = [v for g, v in t.items() if g[:-1] == gram[:-1]]
        lower = probability(tables, gram[1:])
        return lower if not after else max(t[gram] - discount, 0) / sum(after) * (gram in t) + discount * len(after) / sum(after) * lower

    return lambda w: [-sum(np.log2(probability(t, tuple(padded(w)[i - order + 1 : i + 1]))) for i in range(order - 1, len(padded(w)))) for t in models]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_costs_equal_plain_kneser_ney(order):
    counts = [Counter({"abab": 3, "abc": 1, "bca": 2, "ca": 1, "a1b": 1, "99": 4}), Counter({"Ça": 2, "açab": 1, "bbb": 5}), Counter({"xyx": 1})]
    model, plain = langid.Model.fit(counts, ["x", "y", "z"], order), plain_kneser_ney(counts, order)
    words = ["abab", "ab", "cab", "ça", "zzz", "xb", "x", "aaaaab"]
    bits, n = model.cost(words)
    assert n.tolist() == [len(w) + 1 for w in words]
    for w, row in zip(words, bits, strict=True):
        assert row == pytest.approx(plain(w), rel=1e-5)


def test_rejection_is_calibrated(spark):
    """Documents like those learned pass at any length, but for the stated share; others don't."""
    docs = spark.createDataFrame(language_rows(2000), "doc_id long, text string, lang string")
    for rate, low, high in ((0.05, 0.02, 0.1), (1e-9, 0, 0)):
        out = langid.identify(docs, langid.learn(docs, rate=rate, calibration=10_000))
        refused = out.where("held_out and not accepted").count() / out.where("held_out").count()
        assert low <= refused <= high
    other = spark.createDataFrame([(k, " ".join("".join(x) for x in np.random.default_rng(k).choice(list("qxzwkvjпдя"), (8 + k, 6))), None) for k in range(50)], "doc_id long, text string, lang string")
    assert langid.identify(other, langid.learn(docs)).where("accepted").count() == 0


def _step(model, p, at):
    at, cost = np.array([at]), 0.0
    for k in range(model.order, 0, -1):
        row = langid._find(model.grams[k - 1], T.mix(T.slice_hash(p, at - k + 1, at + 1), k))[0]
        if row >= 0:
            return -(cost + model.logp[k - 1][row, 0]) / np.log(2)
        if k > 1 and (row := langid._find(model.contexts[k - 1], T.mix(T.slice_hash(p, at - k + 1, at), 50 + k))[0]) >= 0:
            cost += model.backoff[k - 1][row, 0]
    return -(cost + model.floor[0]) / np.log(2)


def _unseen(model, prefix):
    codes, begin, n = langid.spell([prefix + "z"], 3)
    p, at, _ = langid._grams(codes, begin, n, 3)
    return 2 ** -_step(model, p, at[len(prefix)])


def test_texts_of_arrow_slices():
    a = pa.array(["ab", None, "", "cd"]).slice(1)
    buf, offsets = T.texts(a)
    assert (buf.tobytes(), offsets.tolist()) == (b"cd", [0, 0, 0, 2])
