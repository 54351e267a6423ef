"""Column expressions over texts, spans and assertions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that a span sheds at its edges: white space and ASCII punctuation.
TRIM = " \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def slice_text(text: str, start: str, end: str) -> Column:
    """text[start:end] by code points."""
    return F.expr(f"substring({text}, {start} + 1, {end} - {start})")


def strip(x: Column) -> Column:
    """Without white space (Unicode's) at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def trimmed_span(covered: str = "text", start: str = "start", end: str = "end") -> tuple[Column, Column]:
    """A span without white space and punctuation at its edges; one made of nothing else is unchanged. covered: its text."""
    quoted = F.lit(TRIM)
    left = F.call_function("ltrim", quoted, F.col(covered))
    both = F.call_function("rtrim", quoted, left)
    lead = F.char_length(F.col(covered)) - F.char_length(left)
    some = F.char_length(both) > 0
    return (
        F.when(some, F.col(start) + lead).otherwise(F.col(start)).cast("int"),
        F.when(some, F.col(start) + lead + F.char_length(both)).otherwise(F.col(end)).cast("int"),
    )


def overlap(a: str, b: str) -> Column:
    """Half-open spans a.start..a.end and b.start..b.end share a character."""
    return (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def mention_status() -> Column:
    """negated, other_subject, hedged or affirmed: the first that holds; NULL excludes nothing."""
    unsure = F.coalesce(F.col("uncertain"), F.lit(False)) | F.coalesce(F.col("conditional"), F.lit(False)) | F.coalesce(F.col("generic"), F.lit(False)) | F.coalesce(F.col("temporality") == "hypothetical", F.lit(False))
    return F.when(F.col("negated"), "negated").when(F.col("subject") != "patient", "other_subject").when(unsure, "hedged").otherwise("affirmed")


def term_exists() -> Column:
    """NOTE_NLP's term_exists: N if anything speaks against the term, NULL if negation wasn't assessed, else Y."""
    against = [F.col("negated"), F.col("subject") != "patient", F.col("conditional"), F.col("uncertain"), F.col("temporality") == "hypothetical"]
    out = F
    for a in against:
        out = out.when(a, F.lit("N"))
    return out.when(F.col("negated").isNull(), F.lit(None).cast("string")).otherwise(F.lit("Y"))


def term_temporal() -> Column:
    """past, present or NULL."""
    past = F.coalesce(F.col("history_of"), F.lit(False)) | F.coalesce(F.col("temporality") == "historical", F.lit(False))
    return F.when(past, "past").when(F.col("history_of").isNotNull() | (F.col("temporality") == "recent"), "present")


def snippet(text: str, start: str, end: str, width: int = 250) -> Column:
    """At most width characters of the text, with the span in the middle where the text allows."""
    n = f"char_length({text})"
    begin = f"greatest(0, least({start} - ({width} - ({end} - {start})) div 2, {n} - {width}))"
    return F.expr(f"substring({text}, if({end} - {start} >= {width}, {start}, {begin}) + 1, {width})")


def nth_occurrence(text: str, needle: str, n: str) -> Column:
    """Where the n-th occurrence (1: the first; they may overlap) begins; NULL if there are fewer."""
    found = f"aggregate(sequence(1, {n}), 0, (at, i) -> if(at < 0, -1, if(locate({needle}, {text}, at + 1) = 0, -1, locate({needle}, {text}, at + 1))))"
    return F.expr(f"if({n} < 1 or char_length({needle}) = 0, null, nullif({found}, -1) - 1)")


def escape_html(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def context(text: str, start: str, end: str, width: int = 160) -> Column:
    """The span in double brackets with its line around it, white space squeezed."""
    left = F.expr(f"substring_index(substring({text}, greatest(0, {start} - {width}) + 1, least({width}, {start})), '\\n', -1)")
    right = F.expr(f"substring_index(substring({text}, {end} + 1, {width}), '\\n', 1)")
    return F.trim(F.regexp_replace(F.concat(left, F.lit("[["), slice_text(text, start, end), F.lit("]]"), right), r"(?U)\s+", " "))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole; 0 where whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def scores(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> list[Column]:
    """precision, recall and f1, 0 where a denominator is 0."""
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return [p.alias("precision"), r.alias("recall"), ratio(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn)).alias("f1")]


def wilson(k: str, n: str, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k of n; NULL for n = 0."""
    k_, n_ = F.col(k).cast("double"), F.col(n).cast("double")
    p, s = F.try_divide(k_, n_), z * z
    middle, spread = F.try_divide(p + F.try_divide(F.lit(s), 2 * n_), 1 + F.try_divide(F.lit(s), n_)), F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n_) + F.try_divide(F.lit(s), 4 * n_ * n_)), 1 + F.try_divide(F.lit(s), n_))
    return middle - spread, middle + spread


def running_offsets(pieces: str, gap: int = 0, chunk: int = 512) -> str:
    """SQL of the code-point offset at which each piece of an array column begins; ``gap`` characters stand between pieces.

    Arrays grow by copying, so sums run within chunks and over the chunks' totals: n * chunk steps, not n * n.
    """
    parts = f"sequence(0, greatest(size({pieces}) - 1, 0) div {chunk})"
    inner = f"transform({parts}, c -> aggregate(slice({pieces}, c * {chunk} + 1, {chunk}), named_struct('at', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + char_length(x) + {gap}, 'out', array_append(a.out, a.at))))"
    before = "aggregate(parts, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, p) -> named_struct('at', a.at + p.at, 'out', array_append(a.out, a.at)), a -> a.out)"
    # an array of one, transformed, names a value that is used twice
    return f"transform(array({inner}), parts -> flatten(zip_with(parts, {before}, (p, o) -> transform(p.out, x -> x + o))))[0]"
