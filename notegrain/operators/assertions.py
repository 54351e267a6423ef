"""Assertion cues and scopes, after NegEx (Chapman et al. 2001) and ConText (Harkema et al. 2009).

A cue governs what follows it in its sentence, up to a terminating word.  The text before a mention is cut at the
last sentence end and the last terminator; an attribute holds if one of its cues is left there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expressions import slice_text

#: Cues of each attribute, lower-cased words.
CUES = {
    "negated": ("no", "denies", "denied", "without", "negative for", "no evidence of", "not"),
    "uncertain": ("possible", "possibly", "probable", "suspected", "rule out", "may have", "questionable"),
    "history_of": ("history of", "past history of", "previous", "prior", "status post"),
    "family": ("mother", "father", "brother", "sister", "family history of", "grandmother", "grandfather", "aunt", "uncle"),
    "hypothetical": ("if", "should", "return for", "in case of"),
}
TERMINATORS = ("but", "however", "although", "except", "though", "aside from", "apart from")


def _any(words: tuple[str, ...]) -> str:
    return r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b"


def scope(text: str = "note", start: str = "start") -> Column:
    """The lower-cased text that can govern a mention: from its sentence's start, or after the last terminator."""
    before = F.lower(F.expr(f"substring({text}, 1, {start})"))
    sentence = F.element_at(F.split(before, r"[.!?\n]", -1), -1)
    return F.element_at(F.split(sentence, _any(TERMINATORS), -1), -1)


def assess(mentions: DataFrame, docs: DataFrame, attributes: tuple[str, ...] = ("negated", "uncertain", "history_of", "subject", "temporality")) -> DataFrame:
    """The mentions with these attributes assessed from the documents' text; others keep what they have."""
    note = docs.select("doc_seq", F.col("text").alias("note"))
    out = mentions.drop(*attributes).join(note, "doc_seq").withColumn("__scope", scope())
    cue = {k: F.col("__scope").rlike(_any(v)) for k, v in CUES.items()}
    values = {
        "negated": cue["negated"],
        "uncertain": cue["uncertain"],
        "history_of": cue["history_of"],
        "subject": F.when(cue["family"], "family_member").otherwise("patient"),
        "temporality": F.when(cue["hypothetical"], "hypothetical").when(cue["history_of"], "historical").otherwise("recent"),
    }
    return out.select(*mentions.drop(*attributes).columns, *(values[a].alias(a) for a in attributes))


def assess_spans(mentions: DataFrame, docs: DataFrame, attributes: tuple[str, ...] = ("negated", "uncertain", "history_of", "subject", "temporality")) -> DataFrame:
    """As assess, for another engine's spans: a span that reaches beyond its sentence, or has no letter or digit, is not assessed (all NULL)."""
    covered_ = slice_text("note", "start", "end")
    odd = covered_.rlike(r"[.!?](?=\s+\S)|\n\s*\S") | ~covered_.rlike(r"[\p{L}\p{N}]")
    out = assess(mentions, docs, attributes).join(docs.select("doc_seq", F.col("text").alias("note")), "doc_seq").withColumn("__odd", odd)
    return out.select(*(F.when(~F.col("__odd"), F.col(c)).alias(c) if c in attributes else F.col(c) for c in out.columns if c not in ("note", "__odd")))


#: Experiencer and temporality labels of ConText output, lower-cased, and what they mean here: fixed values.
EXPERIENCERS = {"patient": "patient", "other": "other", "family": "family_member", "family_member": "family_member"}
TEMPORALITIES = {"recent": "recent", "historical": "historical", "hypothetical": "hypothetical"}


def mapped(label: Column, table: dict[str, str]) -> Column:
    """A label's meaning; an unknown or empty label is not assessed."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.try_element_at(pairs, F.lower(F.trim(label)))


def checked_subject(subject: Column) -> Column:
    """The subject; a value outside the domain is an error."""
    known = subject.isNull() | subject.isin("patient", "family_member", "other")
    return F.when(known, subject).otherwise(F.raise_error(F.concat(F.lit("unknown subject: "), subject)))


def simple_negation(docs: DataFrame, mentions: DataFrame) -> DataFrame:
    """``negated``: "no " stands between the last full stop and the mention."""
    note = docs.select("doc_seq", F.col("text").alias("note"))  # as all joins to the text have it, so that one exchange serves them
    before = F.expr("substring_index(substring(lower(note), 1, start), '.', -1)")
    return mentions.join(note, "doc_seq").withColumn("negated", before.contains("no ")).drop("note")


def covered(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions with the text that their span covers."""
    return mentions.drop("text").join(docs.select("doc_seq", F.col("text").alias("note")), "doc_seq").withColumn("text", slice_text("note", "start", "end")).drop("note")
