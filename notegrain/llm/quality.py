"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Rules reject; a document is kept if no rule does.  A rule is a condition over *measures*, and a measure is an expression over the raw
text alone, so a rule that isn't reached costs nothing.  On a sample (all documents whose id hashes below a share that makes
about ``sample`` of them) every rule is run by itself on the raw texts, ``repeat`` times each so that the job's own time is small beside it and is
taken off; that gives its cost (seconds a document) and its selectivity (share rejected).  The cascade tries rules by
rejection per cost, highest first, as one CASE, whose branches after the first that holds aren't evaluated.  Measures that
the caller wants as columns are computed for every row; rules over those read the columns, on the sample too, and so cost next to nothing.
A verdict is the same in any order; only the time isn't.

Repeated words need no explode and no shuffle: each 3-word window of a text becomes its hash, its words and its place; after one sort of these, equal
windows are neighbours, equal by their words.

Defined results: null text has no words and fails the base rule; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .text import WORD_PATTERN

_TEXT = "coalesce(text, '')"
_SPACES = r"' \t\n\u000b\u000c\r'"
_SYMBOLS = "'#*$%&|<>'"


def _let(value: str, name: str, body: str) -> str:
    """SQL of the body with a name for a value that it uses often: an array of one, transformed."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeated_words() -> str:
    """Words in 3-word windows found twice or more."""
    window = "named_struct('hash', xxhash64(w[i], w[i + 1], w[i + 2]), 'a', w[i], 'b', w[i + 1], 'c', w[i + 2], 'place', i)"
    same = "x.hash = s[{0}].hash and x.a = s[{0}].a and x.b = s[{0}].b and x.c = s[{0}].c"
    twice = f"filter(s, (x, i) -> (i > 0 and {same.format('i - 1')}) or (i < size(s) - 1 and {same.format('i + 1')}))"
    # a window at place p covers three words, less what the window before it covers
    covered = f"aggregate(array_sort(transform({twice}, x -> x.place)), named_struct('n', 0L, 'last', -10), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)"
    # with four words two windows are equal only if all words are
    return _let(_WORDS, "w", f"if(size(w) < 4, 0L, {_let(f'sort_array(transform(sequence(0, size(w) - 3), i -> {window}))', 's', covered)})")


_WORDS = f"regexp_extract_all({_TEXT}, r'{WORD_PATTERN}', 0)"
_LINES = f"filter(split({_TEXT}, '\\n', -1), x -> x rlike r'{WORD_PATTERN}')"

#: Each measure as an expression over the column ``text``.
MEASURES = {
    "n_words": f"cast(size({_WORDS}) as bigint)",
    "word_chars": f"cast(char_length(translate({_TEXT}, {_SPACES}, '')) as bigint)",
    "n_symbols": f"cast(char_length({_TEXT}) - char_length(translate({_TEXT}, {_SYMBOLS}, '')) as bigint)",
    "n_lines": f"cast(size({_LINES}) as bigint)",
    "n_dup_lines": _let(_LINES, "l", "cast(size(l) - size(array_distinct(l)) as bigint)"),
    "n_repeat_words": _repeated_words(),
    "n_letters": f"cast(char_length(regexp_replace({_TEXT}, r'\\P{{L}}', '')) as bigint)",
    "n_upper": f"cast(char_length(regexp_replace({_TEXT}, r'\\P{{Lu}}', '')) as bigint)",
}
#: What op10 returns for every document.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A reason to reject: a condition over measures."""

    name: str
    rejects: str


#: Limits far outside what prose reaches, so that clean documents pass.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("upper_case", "4 * n_upper > 3 * word_chars"),
)
BASE = ("few_words", "repeated_words")


def condition(rule: Rule, have: Sequence[str] = ()) -> str:
    """The rule over raw text, but for the measures that are columns already."""
    return f"coalesce({re.sub(r'[a-z_]+', lambda m: f'({MEASURES[m[0]]})' if m[0] in MEASURES and m[0] not in have else m[0], rule.rejects)}, false)"


def measured(docs: DataFrame, measures: Sequence[str], *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and these measures of every document."""
    rows, shared = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), {}
    for name, value in (("__words", _WORDS), ("__lines", _LINES)):
        if sum(value in MEASURES[m] for m in measures) > 1:  # split once, in a projection of its own
            shared[value] = name
            rows = rows.withColumn(name, F.expr(value))

    def over(sql: str) -> str:
        for value, name in shared.items():
            sql = sql.replace(value, name)
        return sql

    return rows.select("doc_id", "text", *(F.expr(over(MEASURES[m])).alias(m) for m in measures))


def order_rules(rows: DataFrame, rules: Sequence[Rule], have: Sequence[str] = (), repeat: int = 4) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost on these (few) rows (text and the measures in ``have``), with selectivity and cost."""
    many = rows.crossJoin(rows.sparkSession.range(repeat).withColumnRenamed("id", "__turn"))  # so many times the same few rows

    def run(what: str) -> tuple[float, float]:
        began = time.perf_counter()
        n, rejected = many.agg(F.count("*"), F.count_if(F.expr(what))).first()
        return (rejected or 0) / max(1, n), (time.perf_counter() - began) / max(1, n)

    run("text is null")  # the first run compiles and fills the cache
    _, idle = run("text is null")
    found = []
    for rule in rules:
        share, cost = run(condition(rule, have))
        found.append((rule, share, max(cost - idle, 1e-9)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def verdict(rules: Sequence[Rule], have: Sequence[str] = ()) -> Column:
    """The name of the first rule that rejects, in this order; null if none does."""
    out = F
    for rule in rules:
        out = out.when(F.expr(condition(rule, have)), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def quality(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES, measures: Sequence[str] = COLUMNS, sample: int = 500) -> DataFrame:
    """doc_id, the measures asked for, base_failed, kept and rejected_by (the first rule of the cascade that rejects) for every document.

    Without measures, a row costs no more than the rules up to the one that rejects it; base_failed is then whether a base rule is among them.
    """
    size = docs.count()
    draw = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(1, size)))
    probe = measured(docs.where(draw), measures, doc_id=doc_id, text=text).cache()
    ordered = [rule for rule, _, _ in order_rules(probe, rules, measures)]
    probe.unpersist()
    out = measured(docs, measures, doc_id=doc_id, text=text).withColumn("rejected_by", verdict(ordered, measures))
    base = [r for r in RULES if r.name in BASE]
    known = all(m in measures or m not in MEASURES for r in base for m in re.findall(r"[a-z_]+", r.rejects))
    failed = F.expr(" or ".join(condition(r, measures) for r in base)) if known else F.coalesce(F.col("rejected_by").isin(*BASE), F.lit(False))
    return out.select("doc_id", *measures, failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"), "rejected_by")
