"""Language identification with interpolated Kneser-Ney character models in sorted hash arrays.

Each language has a character model of order ``order`` over the letters of a word, padded by word
marks: absolute discounts by order, continuation counts below the highest.  All languages share one
sorted array of n-gram hashes for each order, with a row of interpolated log probabilities by
language, and one of context hashes with back-off weights, so a letter costs a binary search for the
longest n-gram known.  Distinct words of a batch are scored once.  The language with the lowest
cross-entropy by letter wins.

*Rejection* is calibrated on at most about ``calibration`` training documents of each language that the models don't see (a fifth is
set aside): their cross-entropies have a mean, a variance between documents, and one within them that falls with the letters of a document.
Standardised by these, they have a 95th percentile and a mean excess beyond it; a document is rejected beyond the
point that a share ``rate`` of its language's documents exceeds if the excess is exponential with this mean, or 1 if that is more; with under 20 documents nothing is rejected.  (A normal law is too narrow: texts with many
capitals, repeats or quotations lie far out.)  ``lang_pred`` names the best language all the same.

The models are fitted on at most about ``sample`` documents of each language, chosen by a hash of the id.  Executors count
their words, one task fits the models from the counts, another pass scores the documents for calibration; the driver sees
the packed models and three numbers for each document of the calibration.  Prediction reads every document whole.

Defined results: ``und`` with score 0 where text is null or has no letter, or where nothing was
learned; null ``lang`` is not learned; a row without ``doc_id`` is held out; only text decides a prediction; other columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T

_START, _END = 2, 3
_letters: dict[int, bool] = {}


def _is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters (Unicode categories L)."""
    seen, back = np.unique(codes, return_inverse=True)
    for c in seen.tolist():
        if c not in _letters:
            _letters[c] = chr(c).isalpha()
    return np.array([_letters[c] for c in seen.tolist()], bool)[back] if len(seen) else np.zeros(0, bool)


def spell(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of the words between word marks: codes, where each word begins, letters by word."""
    words = [w.lower() for w in words]
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(words)), [len(w) for w in words]) if words else np.zeros(0, np.int64)
    keep = _is_letter(codes)
    codes, own = codes[keep], own[keep]
    n = np.bincount(own, minlength=len(words))
    size = n + order  # order - 1 marks before, one after
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), _START, np.uint32)
    out[T.ragged(begin + order - 1, n)] = codes
    out[begin + size - 1] = _END
    return out, begin, n


def _grams(codes: np.ndarray, begin: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hash sums, the positions that are predicted, and the word of each."""
    at = T.ragged(begin + order - 1, n + 1)
    return T.prefix(T.mix(codes.astype(np.uint64), 5)), at, np.repeat(np.arange(len(n)), n + 1)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of a sorted array; -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class Model:
    """Sorted hash arrays by order; columns are languages."""

    order: int
    languages: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray  # log probability of a letter never seen
    mean: np.ndarray  # of the cross-entropy of the language's own documents
    between: np.ndarray  # its variance between documents, beside
    within: np.ndarray  # that of a document of one letter, which falls with the letters
    z: np.ndarray  # standard deviations beyond the mean at which a document is rejected

    @staticmethod
    def fit(counts: list[Counter], languages: list[str], order: int) -> Model:
        words = sorted(set().union(*counts))
        codes, begin, n = spell(words, order)
        weight = np.array([[c[w] for c in counts] for w in words], np.float64).reshape(len(words), len(counts))
        weight[n == 0] = 0
        p, at, own = _grams(codes, begin, n, order)
        grams, logp, contexts, backoff = [], [], [], []
        held, count, where = {}, weight[own], at
        for k in range(order, 0, -1):
            h = T.mix(T.slice_hash(p, where - k + 1, where + 1), k)
            order_, first = T.groups(h)
            total = np.add.reduceat(count[order_], first, axis=0) if len(first) else count[:0]
            held[k] = h[order_[first]], total, where[order_[first]]
            where, count = held[k][2], (total > 0).astype(np.float64)  # continuation counts for the next order
        letters = held[1][0]
        below = np.full((len(letters), len(counts)), 1.0 / (len(letters) + 1))
        floor = None
        for k in range(1, order + 1):
            keys, total, where = held[k]
            context = T.mix(T.slice_hash(p, where - k + 1, where), 50 + k)
            order_, first = T.groups(context)
            size = np.diff(np.append(first, len(order_)))
            of = np.empty(len(order_), np.int64)
            of[order_] = np.repeat(np.arange(len(first)), size)
            one, two = (total == 1).sum(axis=0), (total == 2).sum(axis=0)
            discount = np.clip(one / np.maximum(1, one + 2 * two), 0.1, 0.9)
            whole = np.add.reduceat(total[order_], first, axis=0) if len(first) else total[:0]
            kinds = np.add.reduceat((total[order_] > 0).astype(np.float64), first, axis=0) if len(first) else total[:0]
            seen = whole > 0
            weight_ = np.where(seen, discount * kinds / np.where(seen, whole, 1), 1.0)
            if k > 1:
                row = _find(held[k - 1][0], T.mix(T.slice_hash(p, where - k + 2, where + 1), k - 1))
                below = np.exp(logp[-1])[row]
            prob = np.where(seen[of], np.maximum(total - discount, 0) / np.where(seen, whole, 1)[of], 0) + weight_[of] * below
            if k == 1:
                floor = np.log((weight_[0] if len(weight_) else np.ones(len(counts))) / (len(letters) + 1))
            grams.append(keys)
            logp.append(np.log(prob).astype(np.float32))
            contexts.append(context[order_[first]])
            backoff.append(np.log(weight_).astype(np.float32))
        return Model(order, languages, grams, logp, contexts, backoff, floor, *(np.zeros(len(counts)) for _ in range(3)), np.full(len(counts), np.inf))

    def cost(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each word in each language, and how many letters (with the end mark) they are over; 0 without a letter."""
        codes, begin, n = spell(words, self.order)
        some = np.flatnonzero(n > 0)
        p, at, own = _grams(codes, begin[some], n[some], self.order)
        total = np.zeros((len(at), len(self.languages)), np.float64)
        left = np.arange(len(at))
        for k in range(self.order, 0, -1):
            row = _find(self.grams[k - 1], T.mix(T.slice_hash(p, at[left] - k + 1, at[left] + 1), k))
            hit = row >= 0
            total[left[hit]] += self.logp[k - 1][row[hit]]
            left = left[~hit]
            if k > 1 and len(left):
                row = _find(self.contexts[k - 1], T.mix(T.slice_hash(p, at[left] - k + 1, at[left]), 50 + k))
                hit = row >= 0
                total[left[hit]] += self.backoff[k - 1][row[hit]]
        total[left] += self.floor
        out = np.zeros((len(words), len(self.languages)))
        for l in range(len(self.languages)):
            out[some, l] = -np.bincount(own, total[:, l], len(some)) / np.log(2)
        return out, np.where(n > 0, n + 1, 0)

    def entropy(self, buf: np.ndarray, offsets: np.ndarray, spread: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy by letter of each document in each language, its letters, and (spread) the variance of a single letter's, from the words' sums."""
        starts, ends, at = T.word_spans(buf, offsets)
        word, distinct = T.numbered(buf, starts, ends)
        bits, letters = self.cost([x.decode("utf-8", "replace") for x in distinct.to_pylist()])
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        n = np.bincount(doc, letters[word], len(offsets) - 1)
        mean = np.zeros((len(n), len(self.languages)))
        wide = np.zeros((len(n), len(self.languages)))
        for l in range(len(self.languages)):
            own = bits[word, l]
            mean[:, l] = np.bincount(doc, own, len(n)) / np.maximum(1, n)
            if spread:
                wide[:, l] = np.bincount(doc, (own - mean[doc, l] * letters[word]) ** 2, len(n)) / np.maximum(1, n)
        return mean, n, wide

    def accepts(self, entropy: np.ndarray, letters: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Is a document's cross-entropy within what its language's own documents reach?"""
        if not self.languages:
            return np.zeros(len(entropy), bool)
        width = np.sqrt(self.between[language] + self.within[language] / np.maximum(1, letters))
        return (entropy - self.mean[language] <= np.where(np.isinf(self.z[language]), 0, self.z[language]) * width) | np.isinf(self.z[language])

    def calibrate(self, language: int, entropy: np.ndarray, letters: np.ndarray, spread: np.ndarray, rate: float) -> None:
        """Set what a language accepts from documents of its own."""
        if len(entropy) < 20:  # too few to tell: nothing is rejected
            return
        self.mean[language], self.within[language] = entropy.mean(), spread.mean()
        self.between[language] = max(entropy.var() - (spread / letters).mean(), 0.1 * entropy.var(), 1e-4)
        z = (entropy - self.mean[language]) / np.sqrt(self.between[language] + self.within[language] / letters)
        most = np.quantile(z, 0.95)
        excess = max(1.0, (z[z > most] - most).mean()) if (z > most).any() else 1.0  # a few documents may miss a long tail
        self.z[language] = most + excess * np.log(max(1.0, 0.05 / rate))


def _slices(column: pa.Array, size: int) -> list[tuple[int, int]]:
    """Ranges of rows of about so many bytes."""
    at = np.cumsum(np.diff(T.texts(column)[1])) // size
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(column)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): the words of each batch."""
    for whole in batches:
        for a, b in _slices(whole["text"], 2_000_000):
            count: Counter = Counter()
            for lang, text in zip(whole["lang"].slice(a, b - a).to_pylist(), whole["text"].slice(a, b - a).to_pylist(), strict=True):
                count.update((lang, w) for w in text.split())
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([count[k] for k in keys], pa.int64())], ["lang", "word", "n"])


def fit(counts: dict[str, Counter], order: int) -> Model:
    """The models from the words of each language."""
    languages = sorted(counts)
    return Model.fit([counts[k] for k in languages], languages, order)


def _fit(table: pa.Table, order: int) -> pa.Table:
    counts: dict[str, Counter] = {}
    for lang, word, n in zip(table["lang"].to_pylist(), table["word"].to_pylist(), table["n"].to_pylist(), strict=True):
        counts.setdefault(lang, Counter())[word] = n
    return pa.table({"model": pa.array([pickle.dumps(fit(counts, order))], pa.binary())})


def held_out(doc_id: str) -> Column:
    """Every fifth id by CRC-32 of its digits; these documents teach nothing."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 400, calibration: int = 2000, order: int = 5, rate: float = 1e-9) -> Model:
    """The models of all languages, from about ``sample`` documents of each."""
    able = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = able.groupBy("lang").count().collect()
    if not sizes:
        return fit({}, order)
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("id")), F.lit(1_000_003)) / 1_000_003.0
    back = F.pmod(F.xxhash64(F.lit("calibration"), F.col("id")), F.lit(5)) == 0

    def share(most: float) -> F.Column:
        return F.create_map(*(F.lit(x) for row in sizes for x in (row["lang"], min(1.0, most / row["count"]))))[F.col("lang")]

    words = able.where(~back & (draw < share(sample))).select("lang", "text").mapInArrow(T.released(_counted), "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    packed = words.select(F.lit(0).alias("all"), "lang", "word", "n").groupBy("all").applyInArrow(lambda t: _fit(t, order), "model binary").collect()
    model = pickle.loads(packed[0]["model"]) if packed else fit({}, order)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        place = {k: i for i, k in enumerate(m.languages)}
        for whole in batches:
            for a, b in _slices(whole["text"], 2_000_000):
                batch = whole.slice(a, b - a)
                own = np.array([place[k] for k in batch["lang"].to_pylist()])
                entropy, n, spread = m.entropy(*T.texts(batch["text"]), spread=True)
                row = np.arange(len(n))
                yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(entropy[row, own]), pa.array(n), pa.array(spread[row, own])], ["lang", "entropy", "letters", "spread"])

    if model.languages:
        aside = able.where(back & (draw < share(5 * calibration)) & F.col("lang").isin(model.languages)).select("lang", "text")
        seen = aside.mapInArrow(T.released(reached), "lang string, entropy double, letters double, spread double").where("letters >= 20").toArrow().sort_by("entropy")
        for k, name in enumerate(model.languages):
            own = seen.filter(pa.compute.equal(seen["lang"], name))
            model.calibrate(k, *(own[c].to_numpy() for c in ("entropy", "letters", "spread")), rate)
    shared.destroy()
    return model


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), batch_bytes: int = 2_500_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy and accepted, and the columns to keep, for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(shared.value)
        names = np.array([*m.languages, "und"], object)
        for whole in batches:
            for a, b in _slices(whole["__text"], batch_bytes):
                batch = whole.slice(a, b - a)
                entropy, n, _ = m.entropy(*T.texts(batch["__text"]))
                none = (n == 0) | (not m.languages)
                best = entropy.argmin(axis=1) if m.languages else np.zeros(len(n), np.int64)
                low = entropy.min(axis=1) if m.languages else np.zeros(len(n))
                score = np.where(none, 0.0, 1 / np.maximum(1, np.exp(-10 * (entropy - low[:, None])).sum(axis=1)))
                accepted = ~none & m.accepts(low, n, best)
                columns = [*(batch[c] for c in ("__held", *kept)), pa.array(names[np.where(none, len(m.languages), best)].tolist(), pa.string()), pa.array(score), pa.array(low), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays(columns, ["held_out", *kept, "lang_pred", "score", "entropy", "accepted"])

    kept = tuple(f"k{i}" for i in range(len(keep) + 1))
    source = docs.select(held_out(doc_id).alias("__held"), F.col(text).alias("__text"), *(F.col(c).alias(k) for c, k in zip((doc_id, *keep), kept, strict=True)))
    kinds = dict(source.dtypes)
    schema = "held_out boolean, " + ", ".join(f"{k} {kinds[k]}" for k in kept) + ", lang_pred string, score double, entropy double, accepted boolean"
    out = source.mapInArrow(T.released(predict), schema)
    return out.select(F.col("k0").alias("doc_id"), "held_out", "lang_pred", "score", "entropy", "accepted", *(F.col(k).alias(c) for c, k in zip(keep, kept[1:], strict=True)))
