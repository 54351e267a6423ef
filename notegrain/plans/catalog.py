"""All registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import expressions as E
from ..model import assessed, hash63, mention_id
from ..operators import assertions, cohort, ensemble, evaluate, gold, graph, lexicon as lex, omop, spans, terminology as term
from ..run import remaining
from . import notes as N

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_ID = "left(sha256(doc_id || chr(31) || start || chr(31) || \"end\" || chr(31) || cui), 16)"


@_query(f"""WITH {N.NOTES},{N.LEXICON},
hit AS (SELECT doc_seq, doc_id, text note, strpos(lower(text), term) - 1 AS start, strpos(lower(text), term) - 1 + length(term) AS "end", cui FROM notes JOIN lexicon ON contains(lower(text), term))
SELECT doc_id, {_ID} mention_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", substring(note, start + 1, "end" - start) AS text, cui, contains(string_split(left(lower(note), start), '.')[-1], 'no ') negated FROM hit""")
def first_hit_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.first_hits(N.notes(spark, sf_dir), N.lexicon(spark, sf_dir)).select("doc_id", "mention_id", "start", "end", "text", "cui", "negated")


@_query(f"WITH {N.MENTIONS} SELECT doc_seq, CAST(ord AS INTEGER) AS ord, {_ID} mention_id, start, \"end\", text, cui, semantic_group, negated FROM broad")
def ngram_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.broad(spark, sf_dir).select("doc_seq", F.col("ord").cast("int").alias("ord"), "mention_id", "start", "end", "text", "cui", "semantic_group", "negated")


_WORDS = ("the", "of", "and", "that", "with", "of the", "to the", "de la", "que", "der", "und")


@_query(f"""WITH pieces AS (SELECT doc_id, unnest(p) piece, generate_subscripts(p, 1) i FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_]+') p FROM documents)),
t AS (SELECT *, sum(length(piece)) OVER w - length(piece) AS start, lead(piece, 1) OVER w gap, lead(piece, 2) OVER w other FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, start, piece x FROM t UNION ALL SELECT doc_id, start, piece || gap || other FROM t WHERE other IS NOT NULL)
SELECT lower(x) term, count(*) hits, count(DISTINCT doc_id) documents, CAST(sum(start) AS BIGINT) offsets FROM h WHERE lower(x) IN {_WORDS!r} GROUP BY 1""")
def natural_text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words over natural text with non-ASCII offsets."""
    docs = N.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_seq"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    words = spark.createDataFrame([(w, w, w, "WORD") for w in _WORDS], "term string, cui string, preferred_name string, semantic_group string")
    found = lex.match_terms(docs, words, "words", 2)
    return found.groupBy(F.col("matched_term").alias("term")).agg(F.count("*").alias("hits"), F.countDistinct("doc_seq").alias("documents"), F.sum(F.col("start").cast("bigint")).alias("offsets"))


@_query(f"""WITH {N.MENTIONS} SELECT doc_seq, cui, start, "end", start + length(text) - length(ltrim(text, ' ,.')) AS ts, start + length(rtrim(text, ' ,.')) AS te FROM clinical""")
def trimmed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble.with_trimmed(N.clinical(spark, sf_dir)).select("doc_seq", "cui", "start", "end", F.col("ts").cast("bigint").alias("ts"), F.col("te").cast("bigint").alias("te"))


@_query(f"""WITH {N.MENTIONS} SELECT doc_seq, start, "end", cui FROM broad b WHERE NOT EXISTS (SELECT 1 FROM broad x WHERE x.doc_seq = b.doc_seq AND x.start < b."end" AND b.start < x."end" AND x."end" - x.start > b."end" - b.start)""")
def longest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.longest_spans(N.broad(spark, sf_dir)).select("doc_seq", "start", "end", "cui")


_HEADS = f"""noteslines AS (SELECT doc_seq, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM notes),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_seq ORDER BY i) - length(line) - 1 AS pos FROM noteslines),
labels AS (SELECT doc_seq, pos, regexp_extract(line, '^[ \\t]*([A-Za-z][A-Za-z0-9 /&()'',.-]{{0,48}}?)[ \\t]*:', 1) label, regexp_extract(line, '^[^:]*:(.*)$', 1) rest FROM placed WHERE contains(line, ':')),
heads AS (SELECT doc_seq, CAST(pos AS INTEGER) AS start, CAST(pos + length(label) AS INTEGER) AS "end" FROM labels WHERE label <> '' AND len(string_split(label, ' ')) <= 4
  AND (trim(rest) = '' OR upper(label) = label OR lower(label) IN {spans.SECTION_LABELS!r}) AND NOT regexp_matches(label, '(^| )[a-z]'))"""


@_query(f"WITH {N.NOTES}, {_HEADS} SELECT doc_seq, start, \"end\" FROM heads")
def heading_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.headings(N.notes(spark, sf_dir)).select("doc_seq", "start", "end")


@_query(f"""WITH {N.MENTIONS}, {_HEADS} SELECT c.doc_seq, c.start, c."end", c.cui, CASE WHEN EXISTS (SELECT 1 FROM heads h WHERE h.doc_seq = c.doc_seq AND h.start <= c.start AND c."end" <= h."end") THEN NULL ELSE history_of END history_of FROM clinical c""")
def unassess_heading_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.unassess_heading_history(N.clinical(spark, sf_dir), N.notes(spark, sf_dir)).select("doc_seq", "start", "end", "cui", "history_of")


@_query(f"WITH {N.MENTIONS} SELECT doc_seq, start, \"end\", cui FROM broad WHERE semantic_group = 'FINDING'")
def group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.group_filter(N.broad(spark, sf_dir), ["finding"]).select("doc_seq", "start", "end", "cui")


@_query(f"""WITH {N.MENTIONS}, {_HEADS},
kept AS (SELECT * FROM broad b WHERE tui <> 'T079' AND NOT EXISTS (SELECT 1 FROM heads h WHERE h.doc_seq = b.doc_seq AND h.start <= b.start AND b."end" <= h."end")),
reach AS (SELECT *, max("end") OVER (PARTITION BY doc_seq ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM kept)
SELECT doc_seq, start, "end", cui FROM reach WHERE r IS NULL OR r < "end" """)
def guideline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.guideline_filter(N.broad(spark, sf_dir), N.notes(spark, sf_dir)).select("doc_seq", "start", "end", "cui")


_TWO = """twice AS (SELECT doc_seq, start, "end", cui, ord, FALSE standard FROM broad UNION ALL SELECT doc_seq, start, "end", 'X' || cui, ord + 1000, semantic_group = 'FINDING' FROM broad)"""


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = N.broad(spark, sf_dir).select("doc_seq", "start", "end", "cui", "ord", "semantic_group")
    other = m.withColumn("cui", F.concat(F.lit("X"), "cui")).withColumn("ord", F.col("ord") + 1000).withColumn("standard", F.col("semantic_group") == "FINDING")
    return m.withColumn("standard", F.lit(False)).unionByName(other)


@_query(f"""WITH {N.MENTIONS}, {_TWO} SELECT doc_seq, start, "end", cui FROM (SELECT *, row_number() OVER (PARTITION BY doc_seq, start, "end" ORDER BY CASE WHEN standard THEN 0 ELSE 1 END, ord, cui) n FROM twice) WHERE n = 1""")
def one_concept_per_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.one_concept_per_span(_twice(spark, sf_dir), "standard").select("doc_seq", "start", "end", "cui")


_STATUS = "CASE WHEN negated THEN 'negated' WHEN subject <> 'patient' THEN 'other_subject' WHEN uncertain THEN 'hedged' ELSE 'affirmed' END"


@_query(f"WITH {N.MENTIONS} SELECT cui, {_STATUS} status, count(*) mentions FROM clinical GROUP BY 1, 2")
def mention_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.with_status(N.clinical(spark, sf_dir)).groupBy("cui", "status").agg(F.count("*").alias("mentions"))


@_query(f"WITH {N.MENTIONS} SELECT doc_seq, start, cui, negated, subject, history_of, uncertain FROM clinical")
def assertion_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.clinical(spark, sf_dir).select("doc_seq", "start", "cui", "negated", "subject", "history_of", "uncertain")


@_query(f"WITH {N.MENTIONS} SELECT doc_seq, start, cui, 'negated,subject,history_of,uncertain' assessed FROM clinical")
def assessed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.clinical(spark, sf_dir).select("doc_seq", "start", "cui", F.array_join(assessed(), ",").alias("assessed"))


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term.mark_preferred(term.first_rows(N.part_codes(spark, sf_dir)), N.part_ranks(spark))


def _store(spark: SparkSession, sf_dir: str, walked: bool = False) -> term.TerminologyStore:
    above = graph.code_ancestors(*N.hierarchy(spark, sf_dir)) if walked else None
    return term.TerminologyStore(_codes(spark, sf_dir), above)


@_query(f"WITH {N.CODES} SELECT cui, sab, code, tty, str, is_preferred FROM codes")
def preferred_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("cui", "sab", "code", "tty", "str", "is_preferred")


_ORDER = "CASE sab WHEN 'SNOMEDCT_US' THEN 0 WHEN 'RXNORM' THEN 1 WHEN 'LNC' THEN 2 ELSE 3 END"


@_query(f"WITH {N.CODES} SELECT cui, str AS display FROM (SELECT *, row_number() OVER (PARTITION BY cui ORDER BY is_preferred DESC, {_ORDER}, sab, code, tty) n FROM codes) WHERE n = 1")
def preferred_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).preferred_display()


@_query(f"""WITH {N.MENTIONS}, {N.CODES.removeprefix(N.LEXICON).lstrip(",")}, lists AS (SELECT cui, string_agg(sab || ':' || code, ' ' ORDER BY sab, is_preferred DESC, code, tty) codes, count(*) n FROM codes WHERE sab IN ('SNOMEDCT_US', 'ICD10CM') GROUP BY 1)
SELECT doc_seq, start, "end", b.cui, coalesce(codes, '') codes, coalesce(n, 0) n FROM broad b LEFT JOIN lists USING (cui)""")
def code_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda codes: {"codes": F.array_join(F.transform(codes, lambda c: F.concat_ws(":", c["system"], c["code"])), " "), "n": F.size(codes).cast("bigint")}
    out = _store(spark, sf_dir).attach(N.broad(spark, sf_dir), of_codes=listed, systems=("ICD10CM", "SNOMEDCT_US"))
    return out.select("doc_seq", "start", "end", "cui", "codes", "n")


@_query(f"WITH RECURSIVE {N.HIERARCHY} SELECT code, ancestor_code, CAST(distance AS INTEGER) distance FROM ancestors")
def code_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.code_ancestors(*N.hierarchy(spark, sf_dir)).select("code", "ancestor_code", "distance")


@_query(f"WITH RECURSIVE {N.HIERARCHY} SELECT code, CAST(distance AS INTEGER) distance FROM ancestors WHERE ancestor_code = 'TOP'")
def code_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, True).descendants("icd10cm", "top")


@_query(f"WITH RECURSIVE {N.HIERARCHY} SELECT code, ancestor_code, CAST(distance AS INTEGER) distance FROM ancestors WHERE distance <= 1")
def parents_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk bounded in depth."""
    return graph.code_ancestors(*N.hierarchy(spark, sf_dir), max_depth=1).select("code", "ancestor_code", "distance")


def _breakdown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lexicon = N.lexicon(spark, sf_dir)
    names, nouns = lexicon.where("semantic_group = 'DISORDER'"), lexicon.where("semantic_group = 'FINDING'")
    down = names.withColumn("noun", F.substring_index("term", " ", -1)).join(nouns.select(F.col("term").alias("noun"), F.col("cui").alias("finer")), "noun").select(F.col("cui").alias("coarser"), "finer")
    brands = N.read(spark, sf_dir, "part").join(names, F.col("p_name") == F.col("term")).select(F.col("p_brand").alias("coarser"), F.col("cui").alias("finer")).distinct()
    return down.unionByName(brands), nouns.where("term <> 'ring'").select("cui")


@_query(f"""WITH {N.LEXICON},
down AS (SELECT n.cui coarser, m.cui finer FROM lexicon n JOIN lexicon m ON m.semantic_group = 'FINDING' AND split_part(n.term, ' ', 2) = m.term WHERE n.semantic_group = 'DISORDER'),
up AS (SELECT DISTINCT p_brand coarser, cui finer FROM part JOIN lexicon ON p_name = term),
good AS (SELECT cui FROM lexicon WHERE semantic_group = 'FINDING' AND term <> 'ring')
SELECT cui product_cui, cui ingredient_cui, 0 hops FROM good UNION ALL SELECT coarser, finer, 1 FROM down WHERE finer IN (SELECT cui FROM good)
UNION ALL SELECT DISTINCT up.coarser, down.finer, 2 FROM up JOIN down ON up.finer = down.coarser WHERE down.finer IN (SELECT cui FROM good)""")
def ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    down, good = _breakdown(spark, sf_dir)
    products = down.select(F.col("coarser").alias("cui")).unionByName(down.select(F.col("finer").alias("cui"))).distinct()
    return graph.resolve_ingredients(products, down, good).select("product_cui", "ingredient_cui", "hops")


@_query(f"""WITH {N.CODES}, t AS (SELECT cui, code target_code, str display, row_number() OVER (PARTITION BY cui, code ORDER BY is_preferred DESC, str) n FROM codes WHERE sab = 'SNOMEDCT_US')
SELECT DISTINCT c.code, c.cui, target_code, display FROM codes c JOIN t USING (cui) WHERE c.sab = 'ICD10CM' AND n = 1""")
def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).crosswalk("icd-10-cm", "SNOMEDCT_US")


def _placed(spark: SparkSession, sf_dir: str) -> term.TerminologyStore:
    """A store whose codes are the hierarchy's, each a concept of its own."""
    atoms, edges = N.hierarchy(spark, sf_dir)
    codes = atoms.select(F.concat(F.lit("D"), "code").alias("cui"), "sab", "code", "aui", F.lit("PT").alias("tty"), F.col("code").alias("str"), F.lit(True).alias("is_preferred"))
    return term.TerminologyStore(codes, graph.code_ancestors(atoms, edges))


@_query(f"""WITH RECURSIVE {N.HIERARCHY} SELECT DISTINCT 'D' || code cui, code via FROM (SELECT 'N3' code UNION ALL SELECT code FROM ancestors WHERE ancestor_code = 'N3')""")
def codes_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("ICD10CM", "n3")], "sab string, code string")
    return _placed(spark, sf_dir).resolve_codes(wanted).select("cui", F.array_join("via", ",").alias("via"))


@_query(f"WITH {N.CODES} SELECT DISTINCT cui, code FROM codes WHERE sab = 'LNC'")
def cuis_for_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).where("sab = 'LNC'").select("cui", "code").distinct()


def _merged(flag: str, rule: str) -> str:
    return {"prefer_clinical": f"coalesce(c.{flag}, b.{flag})", "prefer_broad": f"coalesce(b.{flag}, c.{flag})", "negated_if_any": f"CASE WHEN c.{flag} <> b.{flag} THEN TRUE ELSE coalesce(c.{flag}, b.{flag}) END", "unknown": f"CASE WHEN c.{flag} <> b.{flag} THEN NULL ELSE coalesce(c.{flag}, b.{flag}) END"}[rule]


def _union_sql(policy: str) -> str:
    first = "b" if policy == "prefer_broad" else "c"
    other = "c" if first == "b" else "b"
    return f"""SELECT '{policy}' policy, coalesce(c.doc_seq, b.doc_seq) doc_seq, coalesce(c.cui, b.cui) cui, coalesce({first}.start, {other}.start) AS start, coalesce({first}."end", {other}."end") AS "end",
 {_merged("negated", policy)} negated, c.history_of, CASE WHEN c.cui IS NULL THEN 'broad' WHEN b.cui IS NULL THEN 'clinical' ELSE 'broad,clinical' END found_by, coalesce(c.negated <> b.negated, FALSE) conflict
 FROM clinical c FULL JOIN broad b ON c.doc_seq = b.doc_seq AND c.cui = b.cui AND c.start = b.start AND c.te = b."end" """


def _union(spark: SparkSession, sf_dir: str, *policies: str) -> DataFrame:
    out = ensemble.union_policies(N.clinical(spark, sf_dir), N.broad(spark, sf_dir).drop("matched_term").withColumn("matched_term", F.lit(None).cast("string")), policies)
    return out.select("policy", "doc_seq", "cui", "start", "end", "negated", "history_of", F.array_join("found_by", ",").alias("found_by"), F.col("assertion_conflict").alias("conflict"))


@_query(f"WITH {N.MENTIONS} {_union_sql('prefer_clinical')}")
def ensemble_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir, "prefer_clinical")


@_query(f"WITH {N.MENTIONS} " + " UNION ALL ".join(_union_sql(p) for p in ensemble.POLICIES))
def ensemble_union_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir, *ensemble.POLICIES)


@_query(f"WITH {N.MENTIONS} SELECT negated, found_by, conflict, count(*) mentions FROM ({_union_sql('unknown')}) GROUP BY ALL")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir, "unknown").groupBy("negated", "found_by", "conflict").agg(F.count("*").alias("mentions"))


_PAIRED = """paired AS (SELECT c.doc_seq, c.cui, c.ord a, b.ord b, c.start, c."end", c.negated, c.negated <> b.negated conflict, b.negated other FROM clinical c JOIN broad b ON c.doc_seq = b.doc_seq AND c.cui = b.cui AND c.start < b."end" AND b.start < c.te)"""


@_query(f"WITH {N.MENTIONS}, {_PAIRED} SELECT doc_seq, cui, start, \"end\", negated, conflict, 'broad,clinical' found_by FROM paired")
def ensemble_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ensemble.consensus(N.clinical(spark, sf_dir), N.broad(spark, sf_dir))
    return out.select("doc_seq", "cui", "start", "end", "negated", F.col("assertion_conflict").alias("conflict"), F.array_join("found_by", ",").alias("found_by"))


@_query(f"""WITH {N.MENTIONS} SELECT b.doc_seq, b.cui, b.start, c.negated, c.history_of, c.subject, b.negated AS concept_negated, 'clinical' assessed_by FROM broad b LEFT JOIN clinical c ON c.doc_seq = b.doc_seq AND c.cui = b.cui AND c.start = b.start""")
def hybrid_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, c = N.broad(spark, sf_dir), N.clinical(spark, sf_dir)
    given = b.select("doc_seq", "ord", "cui", "start").join(c.select("doc_seq", "cui", "start", "negated", "history_of", "subject"), ["doc_seq", "cui", "start"])
    return ensemble.hybrid(b, given).select("doc_seq", "cui", "start", "negated", "history_of", "subject", F.col("engine_assertions")["broad"]["negated"].alias("concept_negated"), "assessed_by")


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clinical mentions of every heading and narrative, all negations as the broad engine has them."""
    return N.clinical(spark, sf_dir)


_SCORE = "SELECT CAST({tp} AS BIGINT) tp, CAST({fp} AS BIGINT) fp, CAST({fn} AS BIGINT) fn"
_PRF = ", coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1"


@_query(f"""WITH {N.MENTIONS}, r AS (SELECT DISTINCT doc_seq, cui, start, "end" FROM clinical), p AS (SELECT DISTINCT doc_seq, cui, start, "end" FROM broad),
s AS (SELECT (SELECT count(*) FROM (SELECT * FROM r INTERSECT SELECT * FROM p)) tp, (SELECT count(*) FROM p) np, (SELECT count(*) FROM r) nr), c AS ({_SCORE.format(tp="tp", fp="np - tp", fn="nr - tp")} FROM s) SELECT *{_PRF} FROM c""")
def score_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_scores(evaluate.score_exact(_reference(spark, sf_dir), N.broad(spark, sf_dir)))


@_query(f"""WITH {N.MENTIONS}, {_PAIRED}, s AS (SELECT (SELECT count(*) FROM paired) tp, (SELECT count(*) FROM broad) np, (SELECT count(*) FROM clinical) nr), c AS ({_SCORE.format(tp="tp", fp="np - tp", fn="nr - tp")} FROM s) SELECT *{_PRF} FROM c""")
def score_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_scores(evaluate.score_overlap(_reference(spark, sf_dir), N.broad(spark, sf_dir)))


@_query(f"""WITH {N.MENTIONS}, r AS (SELECT DISTINCT doc_seq, cui FROM clinical), p AS (SELECT DISTINCT doc_seq, cui FROM broad),
s AS (SELECT (SELECT count(*) FROM (SELECT * FROM r INTERSECT SELECT * FROM p)) tp, (SELECT count(*) FROM p) np, (SELECT count(*) FROM r) nr), c AS ({_SCORE.format(tp="tp", fp="np - tp", fn="nr - tp")} FROM s) SELECT *{_PRF} FROM c""")
def score_cui_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.with_scores(evaluate.score_concepts(_reference(spark, sf_dir), N.broad(spark, sf_dir)))


@_query(f"""WITH {N.MENTIONS}, {_PAIRED} SELECT 'negated' AS attribute, count(*) FILTER (negated AND other) tp, count(*) FILTER (NOT negated AND other) fp, count(*) FILTER (negated AND NOT other) fn, count(*) reference_assessed, count(*) predicted_assessed FROM paired
UNION ALL SELECT 'history_of', 0, 0, count(*) FILTER (c.history_of), count(*), 0 FROM paired p JOIN clinical c ON c.doc_seq = p.doc_seq AND c.ord = p.a
UNION ALL SELECT 'subject', 0, 0, count(*) FILTER (c.subject <> 'patient'), count(*), 0 FROM paired p JOIN clinical c ON c.doc_seq = p.doc_seq AND c.ord = p.a
UNION ALL SELECT 'uncertain', 0, 0, count(*) FILTER (c.uncertain), count(*), 0 FROM paired p JOIN clinical c ON c.doc_seq = p.doc_seq AND c.ord = p.a""")
def score_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.score_attributes(_reference(spark, sf_dir), N.broad(spark, sf_dir))


@_query("""WITH c AS (SELECT count(*) n, count(*) FILTER (quality = toxic) same, sum(quality) a, sum(toxic) b FROM labels),
k AS (SELECT n, same / n po, (a * b + (n - a) * (n - b)) / (n * n) pe FROM c) SELECT n, CASE WHEN pe = 1 THEN 1.0 ELSE round((po - pe) / (1 - pe), 9) END kappa FROM k""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.kappa(N.read(spark, sf_dir, "labels"), "quality", "toxic").select("n", F.round("kappa", 9).alias("kappa"))


@_query("""WITH c AS (SELECT count(*) FILTER (quality = 1) n, count(*) FILTER (quality = 1 AND toxic = 0) k, count(*) FILTER (quality = 0) m, count(*) FILTER (quality = 0 AND toxic = 1) j FROM labels),
p AS (SELECT *, k / n ppv, j / m npv, 1.96 * 1.96 z FROM c)
SELECT 'all' AS mode, 'toxic' AS attribute, n n_pos, k right_pos, m n_neg, j right_neg, round(ppv, 9) ppv, round((ppv + z / (2 * n) - 1.96 * sqrt(ppv * (1 - ppv) / n + z / (4 * n * n))) / (1 + z / n), 9) ppv_low, round((ppv + z / (2 * n) + 1.96 * sqrt(ppv * (1 - ppv) / n + z / (4 * n * n))) / (1 + z / n), 9) ppv_high,
round(npv, 9) npv, round(ppv * 1000 / (ppv * 1000 + (1 - npv) * 5000), 9) recall FROM p""")
def wilson_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = N.read(spark, sf_dir, "labels").select(F.lit("all").alias("mode"), F.lit("toxic").alias("attribute"), (F.col("quality") == 1).alias("engine_positive"), F.when(F.col("toxic") == 0, "yes").otherwise("no").alias("judgement"))
    totals = spark.createDataFrame([("all", "toxic", True, 1000), ("all", "toxic", False, 5000)], "mode string, attribute string, engine_positive boolean, total long")
    out = evaluate.review(judged, totals)
    return out.select("mode", "attribute", "n_pos", "right_pos", "n_neg", "right_neg", *(F.round(c, 9).alias(c) for c in ("ppv", "ppv_low", "ppv_high", "npv", "recall")))


_TARGETS = "targets AS (SELECT cui FROM lexicon WHERE term LIKE '%gear' AND semantic_group = 'DISORDER')"
_CLASS = f"""{_TARGETS}, st AS (SELECT doc_seq, {_STATUS} status FROM clinical WHERE cui IN (SELECT cui FROM targets)),
n AS (SELECT doc_seq, count(*) FILTER (status = 'affirmed') n_affirmed, count(*) FILTER (status = 'negated') n_negated, count(*) FILTER (status = 'other_subject') n_other_subject, count(*) FILTER (status = 'hedged') n_hedged FROM st GROUP BY 1),
classes AS (SELECT doc_seq, doc_id, coalesce(n_affirmed, 0) n_affirmed, coalesce(n_negated, 0) n_negated, coalesce(n_other_subject, 0) n_other_subject, coalesce(n_hedged, 0) n_hedged,
 CASE WHEN n_affirmed > 0 THEN 'affirmed' WHEN n_negated + n_other_subject + n_hedged > 0 THEN 'excluded' ELSE 'absent' END status FROM notes LEFT JOIN n USING (doc_seq))"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = N.lexicon(spark, sf_dir).where("term like '%gear' and semantic_group = 'DISORDER'")
    return cohort.classify(N.notes(spark, sf_dir), N.clinical(spark, sf_dir), targets)


@_query(f"WITH {N.MENTIONS}, {_CLASS} SELECT * FROM classes")
def cohort_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).drop("unassessed")


@_query(f"WITH {N.MENTIONS}, {_CLASS} SELECT status, count(*) documents FROM classes GROUP BY 1")
def cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.cohort_counts(_classified(spark, sf_dir))


_CELLS = f"cells AS (SELECT doc_seq, cui, max(CASE WHEN {_STATUS} = 'affirmed' THEN 1 ELSE -1 END) cell FROM clinical GROUP BY 1, 2)"


@_query(f"WITH {N.MENTIONS}, {_CELLS} SELECT cui, count(*) FILTER (cell = 1) n_affirmed, count(*) FILTER (cell = -1) n_not_affirmed FROM cells GROUP BY 1 HAVING count(*) FILTER (cell = 1) >= 2")
def concept_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.concept_stats(N.clinical(spark, sf_dir), 2)


_WIDE = ", ".join(f"coalesce(max(CASE WHEN cui = 'C1{k:06d}' THEN CASE WHEN negated THEN -1 ELSE 1 END END), 0) AS \"C1{k:06d}\"" for k in range(1, 9))


@_query(f"WITH {N.MENTIONS} SELECT n.doc_id row_key, {_WIDE} FROM notes n LEFT JOIN (SELECT * FROM broad WHERE semantic_group = 'FINDING') b USING (doc_seq) GROUP BY 1")
def concept_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.matrix(N.notes(spark, sf_dir), N.broad(spark, sf_dir), 1, ["FINDING"])


@_query(f"""WITH {N.MENTIONS}, s AS (SELECT *, {_STATUS} status FROM clinical),
g AS (SELECT doc_seq, cui, arg_min(preferred_name, ord) AS name, count(*) mentions, count(*) FILTER (status = 'affirmed') n_affirmed, count(*) FILTER (status = 'negated') n_negated, count(*) FILTER (status = 'other_subject') n_other_subject, count(*) FILTER (status = 'hedged') n_hedged, count(DISTINCT text) n_texts FROM s GROUP BY 1, 2)
SELECT *, CASE WHEN n_affirmed > 0 THEN 'affirmed' WHEN n_negated >= n_other_subject AND n_negated >= n_hedged THEN 'negated' WHEN n_other_subject >= n_hedged THEN 'other_subject' ELSE 'hedged' END status FROM g""")
def note_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cohort.note_summary(N.clinical(spark, sf_dir))
    return out.select("doc_seq", "cui", "name", "mentions", *(f"n_{s}" for s in cohort.STATUSES), F.size("texts").cast("bigint").alias("n_texts"), "status")


@_query(f"""WITH {N.MENTIONS}, g AS (SELECT doc_seq, cui, min(preferred_name) AS name, count(*) mentions FROM broad GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY doc_seq) total_concepts, row_number() OVER (PARTITION BY doc_seq ORDER BY mentions DESC, name, cui) place FROM g) SELECT doc_seq, cui, name, mentions, total_concepts, CAST(place AS INTEGER) place, total_concepts > 2 truncated FROM r WHERE place <= 2""")
def concept_summary_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.concept_summary(N.broad(spark, sf_dir), 2).select("doc_seq", "cui", "name", "mentions", "total_concepts", "place", "truncated")


@_query(f"""WITH {N.MENTIONS} SELECT doc_seq, cui, CAST(negated AS VARCHAR) negated, subject, CAST(history_of AS VARCHAR) history_of, CAST(uncertain AS VARCHAR) uncertain, count(*) n FROM clinical GROUP BY ALL""")
def assertion_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cohort.concept_summary(N.clinical(spark, sf_dir), None)
    return out.select("doc_seq", "cui", F.inline("assertions"))


@_query(f"""WITH {N.MENTIONS}, cuts AS (SELECT doc_seq, 0 cut FROM notes UNION SELECT doc_seq, length(text) FROM notes UNION SELECT doc_seq, start FROM broad UNION SELECT doc_seq, "end" FROM broad),
parts AS (SELECT doc_seq, cut, lead(cut) OVER (PARTITION BY doc_seq ORDER BY cut) until FROM cuts)
SELECT p.doc_seq, CAST(cut AS INTEGER) AS start, CAST(until AS INTEGER) AS "end", coalesce(string_agg(b.cui, ',' ORDER BY b."end" - b.start DESC, b.start, b."end", b.cui), '') cuis FROM parts p LEFT JOIN broad b ON b.doc_seq = p.doc_seq AND b.start <= cut AND until <= b."end" WHERE until IS NOT NULL GROUP BY 1, 2, 3""")
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.segments(N.notes(spark, sf_dir), N.broad(spark, sf_dir))
    return out.select("doc_seq", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.array_join("cuis", ",").alias("cuis"))


_OMOP = """concept AS (SELECT CASE sab WHEN 'SNOMEDCT_US' THEN 'SNOMED' WHEN 'RXNORM' THEN 'RxNorm' WHEN 'LNC' THEN 'LOINC' ELSE 'ICD10CM' END vocabulary_id, sab, code, CAST(substring(code, 2) AS INTEGER) + 1000 id, CAST(substring(code, 2) AS INTEGER) % 3 = 0 std FROM (SELECT DISTINCT sab, code FROM part_codes)),
maps AS (SELECT id a, id + d b FROM concept, (VALUES (5), (2)) x(d) WHERE NOT std AND id % 5 <> 0),
found AS (SELECT sab, code, id source_concept_id, CASE WHEN std THEN id ELSE coalesce((SELECT min(b) FROM maps WHERE a = id), 0) END concept_id FROM concept)"""


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = F.create_map(*(F.lit(x) for kv in omop.VOCABULARIES.items() for x in kv))
    number = F.expr("cast(substring(code, 2) as int)")
    concept = N.part_codes(spark, sf_dir).select("sab", "code").distinct().select(vocabulary[F.col("sab")].alias("vocabulary_id"), F.col("code").alias("concept_code"), (number + 1000).alias("concept_id"), F.when(number % 3 == 0, "S").alias("standard_concept"))
    open_ = concept.where("standard_concept is null and concept_id % 5 <> 0").select(F.col("concept_id").alias("concept_id_1"), F.explode(F.array((F.col("concept_id") + 5), (F.col("concept_id") + 2))).alias("concept_id_2"))
    return omop.lookup(concept, open_)


@_query(f"WITH {N.CODES}, {_OMOP} SELECT * FROM found")
def omop_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir)


_NLP = f"""{N.MENTIONS}, {N.CODES.removeprefix(N.LEXICON).lstrip(",")}, {_OMOP.replace("found AS", "looked AS")},
choice AS (SELECT cui, concept_id, source_concept_id FROM (SELECT cui, l.concept_id, l.source_concept_id, row_number() OVER (PARTITION BY cui ORDER BY l.concept_id = 0, {_ORDER.replace("sab", "c.sab")}, c.code) n FROM codes c JOIN looked l ON l.sab = c.sab AND l.code = c.code WHERE is_preferred) WHERE n = 1),
snip AS (SELECT *, length(note) nl, "end" - start w FROM clinical)"""


@_query(f"""WITH {_NLP} SELECT row_number() OVER (ORDER BY doc_seq, ord) note_nlp_id, doc_seq note_id, 0 section_concept_id,
 substring(note, CAST(CASE WHEN w >= 60 THEN start ELSE greatest(0, least(start - (60 - w) // 2, nl - 60)) END AS BIGINT) + 1, 60) snippet, CAST(start AS VARCHAR) "offset", text lexical_variant,
 coalesce(concept_id, 0) note_nlp_concept_id, coalesce(source_concept_id, 0) note_nlp_source_concept_id, 'notegrain' nlp_system, '2026-01-02' nlp_date, '2026-01-02 03:04:05' nlp_datetime,
 CASE WHEN negated OR subject <> 'patient' OR uncertain THEN 'N' ELSE 'Y' END term_exists, CASE WHEN history_of THEN 'past' ELSE 'present' END term_temporal,
 '{{"cui":"' || cui || '","negated":' || negated || ',"subject":"' || subject || '","uncertain":' || uncertain || ',"conditional":null}}' term_modifiers
FROM snip LEFT JOIN choice USING (cui)""")
def note_nlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = N.notes(spark, sf_dir)
    ids = docs.select("doc_id", F.col("doc_seq").alias("note_id"))
    # the table's snippets have 250 characters; narrower ones, so that the centring shows
    return omop.note_nlp(N.clinical(spark, sf_dir), docs, ids, _lookup(spark, sf_dir), started=datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC), width=60, codes=_store(spark, sf_dir).nested_codes())


@_query("SELECT o_orderkey, CAST('0x' || substring('01234567', CAST(strpos('0123456789abcdef', left(h, 1)) - 1 AS INTEGER) % 8 + 1, 1) || substring(h, 2, 15) AS BIGINT) id FROM (SELECT o_orderkey, sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus) h FROM orders)")
def note_nlp_hash63(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.read(spark, sf_dir, "orders").select("o_orderkey", hash63(F.concat_ws("\x1f", "o_orderkey", "o_custkey", "o_orderstatus")).alias("id"))


_FLAGS = "CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'N' THEN FALSE END negated, CASE l_linestatus WHEN 'O' THEN 'family_member' END subject, CASE l_linenumber % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END history_of, CASE l_linenumber % 4 WHEN 0 THEN 'historical' WHEN 1 THEN 'hypothetical' WHEN 2 THEN 'recent' END temporality"


@_query(f"""WITH f AS (SELECT {_FLAGS} FROM lineitem) SELECT CASE WHEN negated OR subject <> 'patient' OR temporality = 'hypothetical' THEN 'N' WHEN negated IS NULL THEN NULL ELSE 'Y' END term_exists,
CASE WHEN history_of OR temporality = 'historical' THEN 'past' WHEN NOT history_of OR temporality = 'recent' THEN 'present' END term_temporal, count(*) n FROM f GROUP BY 1, 2""")
def term_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued flags of every combination."""
    part = F.pmod("l_linenumber", F.lit(3)), F.pmod("l_linenumber", F.lit(4))
    rows = N.read(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False).alias("negated"),
        F.when(F.col("l_linestatus") == "O", "family_member").alias("subject"),
        F.when(part[0] == 0, True).when(part[0] == 1, False).alias("history_of"),
        F.when(part[1] == 0, "historical").when(part[1] == 1, "hypothetical").when(part[1] == 2, "recent").alias("temporality"),
        F.lit(None).cast("boolean").alias("conditional"), F.lit(None).cast("boolean").alias("uncertain"),
    )
    return rows.groupBy(E.term_exists().alias("term_exists"), E.term_temporal().alias("term_temporal")).agg(F.count("*").alias("n"))


@_query("""WITH k AS (SELECT event_id, CAST(user_id AS VARCHAR) doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) nth FROM events), a AS (SELECT event_id, row_number() OVER (ORDER BY event_id) n FROM k WHERE nth > 1)
SELECT k.event_id doc_seq, CASE WHEN n IS NULL THEN doc_id ELSE doc_id || '#' || n END row_key FROM k LEFT JOIN a USING (event_id)""")
def duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = N.read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_seq"), F.col("user_id").cast("string").alias("doc_id"))
    return cohort.unique_keys(docs).select("doc_seq", "row_key")


@_query("""SELECT conv_id || ':' || turn doc_id, sha256(text) content_sha256 FROM conversations WHERE NOT (role = 'user' AND turn > 0) OR turn = 0""")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later user turns were finished with the same text; first user turns with another."""
    docs = N.read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc_id"), "text", "role", "turn")
    finished = docs.where("role = 'user'").select("doc_id", F.when(F.col("turn") > 0, F.sha2("text", 256)).otherwise(F.sha2(F.concat("text", F.lit(" ")), 256)).alias("content_sha256"))
    return remaining(docs, finished).select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@_query("SELECT sha256(text) content_sha256, count(*) documents, min(doc_id) first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = N.read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return docs.where("documents > 1")


@_query("""WITH k AS (SELECT user_id, count(*) n FROM events GROUP BY 1), five AS (SELECT user_id FROM k WHERE n > 1 ORDER BY user_id LIMIT 5)
SELECT (SELECT count(*) FROM events) documents, (SELECT count(*) - count(DISTINCT user_id) FROM events) duplicates, (SELECT count(*) FROM events WHERE event_type = 'error') invalid_utf8,
(SELECT count(*) FROM lineitem) mentions, (SELECT count(*) FROM events WHERE event_type = 'error') errors, (SELECT string_agg(user_id, ',' ORDER BY user_id) FROM five) examples""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = N.read(spark, sf_dir, "events").select(F.col("event_id").alias("doc_seq"), F.col("user_id").alias("doc_id"), (F.col("event_type") == "error").cast("int").alias("replaced"))
    out = cohort.run_counters(docs, N.read(spark, sf_dir, "lineitem"), docs.where("replaced = 1"))
    return out.select("documents", "duplicates", "invalid_utf8", "mentions", "errors", F.array_join("duplicate_examples", ",").alias("examples"))


@_query("""WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 3 ELSE 0 END s, CASE o_orderkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 40 ELSE 9 END e, CASE o_orderkey % 3 WHEN 0 THEN 'C1' WHEN 1 THEN 'CUI-LESS' ELSE 'C0000001' END cui, CASE o_orderkey % 4 WHEN 0 THEN 'DISORDER' WHEN 1 THEN 'THING' END g, 'no ' || o_orderstatus || ' pain here' t FROM orders),
i AS (SELECT *, s < e AND e <= length(t) ok, substring(t, s + 1, e - s) sp FROM r)
SELECT * FROM (SELECT o_orderkey doc_seq, 'error' severity, unnest(list_filter([CASE WHEN NOT ok THEN 'span is empty or outside the text' END, CASE WHEN ok AND trim(sp) <> sp THEN 'span starts or ends with white space' END, CASE WHEN ok AND cui = 'C1' THEN 'cui is not C and 7 digits' END,
 CASE WHEN ok AND g = 'THING' THEN 'unknown group' END, CASE WHEN ok AND g IS NULL THEN 'needs a group or types' END, CASE WHEN ok THEN 'history_of not judged' END, CASE WHEN ok THEN 'uncertain not judged' END], lambda x: x IS NOT NULL)) problem FROM i)
UNION ALL SELECT o_orderkey, 'warning', 'CUI-LESS is scored as a miss' FROM i WHERE ok AND cui = 'CUI-LESS'""")
def gold_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = lambda n: F.pmod("o_orderkey", F.lit(n))
    mention = F.struct(
        F.when(k(5) == 0, 3).otherwise(0).alias("start"), F.when(k(7) == 0, 3).when(k(7) == 1, 40).otherwise(9).alias("end"), F.lit(None).cast("string").alias("text"),
        F.when(k(3) == 0, "C1").when(k(3) == 1, "CUI-LESS").otherwise("C0000001").alias("cui"), F.when(k(4) == 0, "DISORDER").when(k(4) == 1, "THING").alias("group"), F.array().cast("array<string>").alias("tuis"),
        F.lit(False).alias("negated"), F.lit("patient").alias("subject"), *(F.lit(None).cast("boolean").alias(c) for c in ("history_of", "uncertain", "conditional", "generic")),
    )
    records = N.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_seq"), F.col("o_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("no "), "o_orderstatus", F.lit(" pain here")).alias("text"), F.lit("manual").alias("source"), F.array(mention).alias("mentions"))
    return gold.validate(records).select("doc_seq", "severity", "problem")


@_query(f"""WITH {N.NOTES}, l AS (SELECT doc_seq, text, split_part(split_part(text, ': ', 2), chr(10), 1) x FROM notes)
SELECT doc_seq, strpos(text, x) - 1 AS first, CASE WHEN strpos(substring(text, strpos(text, x) + 1), x) > 0 THEN strpos(text, x) + strpos(substring(text, strpos(text, x) + 1), x) - 1 END AS second FROM l""")
def nth_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = N.notes(spark, sf_dir).withColumn("x", F.substring_index(F.substring_index("text", "\n", 1), ": ", -1))
    return docs.select("doc_seq", E.nth_occurrence("text", "x", "1").cast("bigint").alias("first"), E.nth_occurrence("text", "x", "2").cast("bigint").alias("second"))


@_query("""WITH s AS (SELECT p_partkey idx, CASE WHEN p_size % 2 = 0 THEN 'agree' ELSE 'differ' END status, 'C' || (p_partkey % 10) a, CASE WHEN p_partkey % 6 <> 0 THEN 'C' || (p_partkey % 10 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END) END b, p_size FROM part),
d AS (SELECT *, CASE WHEN idx % 4 = 0 THEN 'drop' WHEN idx % 4 = 1 THEN 'first' WHEN idx % 4 = 2 THEN 'second' END act FROM s),
o AS (SELECT idx, CASE WHEN act IS NULL AND status = 'agree' THEN 'keep' WHEN act IS NULL THEN 'error: no decision' WHEN act = 'drop' THEN 'drop' WHEN act = 'second' AND b IS NULL THEN 'error: not marked' ELSE 'keep' END outcome, CASE WHEN act = 'second' THEN b ELSE a END p, CASE WHEN act = 'first' AND idx % 8 = 1 THEN 'C9' END o FROM d)
SELECT idx, outcome, CASE WHEN outcome = 'keep' THEN CASE WHEN coalesce(o, p) = 'C3' THEN 'C33' ELSE coalesce(o, p) END END cui FROM o""")
def adjudicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = N.read(spark, sf_dir, "part"), F.col("p_partkey")
    label = lambda n: F.concat(F.lit("C"), n.cast("string"))
    even = F.pmod("p_size", F.lit(2)) == 0
    rows = part.select(k.alias("idx"), F.lit(0).alias("start"), F.lit(5).alias("end"), F.when(even, "agree").otherwise("differ").alias("status"), label(F.pmod(k, F.lit(10))).alias("a_cui"), F.when(F.pmod(k, F.lit(6)) != 0, label(F.pmod(k, F.lit(10)) + F.when(even, 0).otherwise(1))).alias("b_cui"))
    turn = F.pmod(k, F.lit(4))
    decisions = part.where(F.pmod(k, F.lit(4)) < 3).select(k.alias("idx"), F.when(turn == 0, "drop").when(turn == 1, "first").otherwise("second").alias("action"), F.when(F.pmod(k, F.lit(8)) == 1, "cui=C9").otherwise("").alias("overrides"))
    return gold.adjudicate(rows, decisions, spark.createDataFrame([("C3", "C33")], "from_cui string, to_cui string")).select("idx", "outcome", "cui")


@_query(f"""WITH {N.MENTIONS}, x AS (SELECT doc_seq, start, te AS "end", cui FROM clinical), y AS (SELECT doc_seq, start, "end", cui FROM broad), j AS (SELECT coalesce(x.doc_seq, y.doc_seq) doc_seq, coalesce(x.start, y.start) AS start, coalesce(x."end", y."end") AS "end", x.cui a, y.cui b FROM x FULL JOIN y ON x.doc_seq = y.doc_seq AND x.start = y.start AND x."end" = y."end")
SELECT doc_seq, start, "end", CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'keep' ELSE 'error: no decision' END outcome, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b END cui FROM j""")
def adjudicate_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = lambda df: ensemble.with_trimmed(df).select("doc_seq", F.col("ts").alias("start"), F.col("te").alias("end"), "cui")
    none = spark.range(0).selectExpr("id doc_seq", "cast(id as int) start", "cast(id as int) end", "'' take", "'' overrides")
    return gold.adjudicate_pair(flat(N.clinical(spark, sf_dir)), flat(N.broad(spark, sf_dir)), none)


@_query(f"""WITH {N.MENTIONS} SELECT doc_seq, start, "end", cui, previous_end FROM (SELECT *, lag("end") OVER (PARTITION BY doc_seq ORDER BY start, "end" DESC) previous_end FROM broad) WHERE previous_end > start""")
def adjacent_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.adjacent_overlaps(N.broad(spark, sf_dir)).select("doc_seq", "start", "end", "cui", "previous_end")


@_query(f"""WITH {N.MENTIONS}, x AS (SELECT DISTINCT doc_seq, start, "end", cui FROM clinical), y AS (SELECT DISTINCT doc_seq, start, "end", cui FROM broad)
SELECT kind, count(*) spans FROM (SELECT CASE WHEN x.cui IS NULL THEN 'only_b' WHEN y.cui IS NULL THEN 'only_a' ELSE 'both' END kind FROM x FULL JOIN y USING (doc_seq, start, "end")) GROUP BY 1""")
def agreement_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.span_agreement(N.clinical(spark, sf_dir), N.broad(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("spans"))


@_query(f"""WITH {N.MENTIONS}, b AS (SELECT c.negated x, d.negated y FROM clinical c JOIN broad d ON c.doc_seq = d.doc_seq AND c.cui = d.cui AND c.start = d.start AND c."end" = d."end")
SELECT 'negated' AS attribute, count(*) shared, count(*) FILTER (x = y) agree, count(*) FILTER (x) positive_a, count(*) FILTER (y) positive_b FROM b""")
def attribute_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.attribute_agreement(N.clinical(spark, sf_dir), N.broad(spark, sf_dir), ("negated",))


@_query(f"""WITH {N.MENTIONS}, x AS (SELECT DISTINCT doc_seq, start, "end" FROM clinical), y AS (SELECT DISTINCT doc_seq, start, "end" FROM broad),
n AS (SELECT (SELECT count(*) FROM x) n_a, (SELECT count(*) FROM y) n_b, (SELECT count(*) FROM x JOIN y USING (doc_seq, start, "end")) both_, (SELECT count(DISTINCT (x.doc_seq, x.start)) FROM x JOIN y ON x.doc_seq = y.doc_seq AND x.start < y."end" AND y.start < x."end") any_),
c AS (SELECT count(*) n, count(*) FILTER (p.cui = q.cui) same FROM (SELECT doc_seq, start, "end", min(cui) cui FROM clinical GROUP BY ALL) p JOIN (SELECT doc_seq, start, "end", min(cui) cui FROM broad GROUP BY ALL) q USING (doc_seq, start, "end"))
SELECT n_a, n_b, 2.0 * both_ / (n_a + n_b) exact_f1, 2.0 * any_ / (n_a + n_b) overlap_f1, same / n concept_agreement FROM n, c""".replace("SELECT n_a, n_b, 2.0 * both_", "SELECT n_a, n_b, CAST(2.0 AS DOUBLE) * both_").replace("2.0 * any_", "CAST(2.0 AS DOUBLE) * any_"))
def agreement_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Here the spans of either side overlap one another's names only, so greedy matching pairs every span that overlaps any; greedy_matching has contests."""
    return evaluate.agreement_f1(N.clinical(spark, sf_dir), N.broad(spark, sf_dir))


@_query(f"""WITH {N.MENTIONS}, d AS (SELECT doc_seq, CAST(ord AS INTEGER) AS ord, cui, negated, sha256('7' || chr(31) || doc_seq || chr(31) || ord) h FROM broad)
SELECT doc_seq, ord, cui, negated FROM (SELECT *, row_number() OVER (PARTITION BY cui, negated ORDER BY h, doc_seq, ord) n FROM d) WHERE n <= 20""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 20 rows of each (concept, negated)."""
    return evaluate.stratified(N.broad(spark, sf_dir).select("doc_seq", F.col("ord").cast("int").alias("ord"), "cui", "negated"), ["cui", "negated"], ["doc_seq", "ord"], 20, 7)


@_query(f"""WITH {N.MENTIONS} SELECT doc_id, cui, start old_start, "end" old_end, CAST(start + 9 AS INTEGER) AS start, CAST("end" + 9 AS INTEGER) AS "end", text, FALSE needs_review FROM clinical""")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions moved to notes with a word put before them and another end of the sentence after them."""
    docs = N.notes(spark, sf_dir)
    return gold.carry_over(N.clinical(spark, sf_dir).select("doc_id", "start", "end", "cui"), docs, docs.withColumn("text", F.concat(F.lit("<copied> "), F.replace("text", F.lit(" today."), F.lit(" since yesterday.")))))


@_query("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) n, count(*) OVER () c FROM events)
SELECT max(value) FILTER (n = CAST(round_even(0.5 * (c - 1), 0) AS BIGINT) + 1) p50, max(value) FILTER (n = CAST(round_even(0.95 * (c - 1), 0) AS BIGINT) + 1) p95, max(value) AS max FROM s""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.nearest_rank(N.read(spark, sf_dir, "events"), "value")


@_query(f"WITH {N.LEXICON} SELECT cui, preferred_name FROM lexicon WHERE term = 'red plate'")
def lookup_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lex.lookup_term(N.lexicon(spark, sf_dir), " Red Plate ")


@_query(f"""WITH {N.MENTIONS} SELECT doc_seq, CAST(ord AS INTEGER) AS ord, CASE tui WHEN 'T047' THEN 'DISO' WHEN 'T033' THEN 'FIND' ELSE 'UNKNOWN' END semantic_group FROM broad""")
def group_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = spark.createDataFrame([("T047", "DISO", 1), ("T033", "FIND", 2)], "tui string, semantic_group string, priority int")
    return ensemble.group_of_types(N.broad(spark, sf_dir), groups).select("doc_seq", F.col("ord").cast("int").alias("ord"), "semantic_group")


@_query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') escaped, length(html) n FROM pages")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.read(spark, sf_dir, "pages").select("page_id", E.escape_html(F.col("url")).alias("escaped"), F.char_length("html").cast("bigint").alias("n"))


@_query(f"""WITH {N.MENTIONS} SELECT doc_seq, start, cui, trim(regexp_replace(string_split(substring(note, greatest(0, start - 160) + 1, least(160, start)), chr(10))[-1] || '[[' || substring(note, start + 1, "end" - start) || ']]' || string_split(substring(note, "end" + 1, 160), chr(10))[1], '\\s+', ' ', 'g')) context FROM broad""")
def review_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = N.broad(spark, sf_dir).join(N.notes(spark, sf_dir).select("doc_seq", F.col("text").alias("note")), "doc_seq")
    return m.select("doc_seq", "start", "cui", E.context("note", "start", "end").alias("context"))


@_query("SELECT 'mention:' || o_orderkey AS doc_id, left(sha256('mention:' || o_orderkey || chr(31) || 0 || chr(31) || 5 || chr(31) || o_orderstatus), 16) mention_id FROM orders")
def mention_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.read(spark, sf_dir, "orders").select(F.concat(F.lit("mention:"), "o_orderkey").alias("doc_id"), "o_orderstatus")
    return rows.select("doc_id", mention_id("doc_id", F.lit(0), F.lit(5), "o_orderstatus").alias("mention_id"))


@_query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'patient' WHEN 'N' THEN 'family_member' END subject, count(*) n FROM lineitem GROUP BY ALL")
def label_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "A", "Patient").when(F.col("l_returnflag") == "N", " FAMILY ").otherwise("")
    return N.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", assertions.mapped(label, assertions.EXPERIENCERS).alias("subject")).agg(F.count("*").alias("n"))


