"""Clinical-looking views over the driver's tables, the same in Spark and in DuckDB's SQL.

The tables hold no notes, so a note is written for every order from its parts: headings, a finding that is asserted, negated or
uncertain, and one of the past, of a relative or denied.  Part names and their nouns are the lexicon, regions to customers
a code hierarchy, parts the codes of a concept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..model import mention_id, with_defaults
from ..operators import assertions, lexicon as lex


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_seq, doc_id, text: one note for every order with lines."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p1"), F.max("l_partkey").alias("p2"), F.min("l_returnflag").alias("flag"))
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(part.select(F.col("p_partkey").alias("p1"), F.col("p_name").alias("n1")), "p1").join(part.select(F.col("p_partkey").alias("p2"), F.col("p_name").alias("n2")), "p2")
    said = F.when(F.col("flag") == "A", "Patient has no ").when(F.col("flag") == "N", "Possible ").otherwise("Patient has ")
    other = F.when(F.col("o_orderstatus") == "F", "History of ").when(F.col("o_orderstatus") == "O", "Mother with ").otherwise("Denies ")
    noun = F.substring_index("n2", " ", -1)
    text = F.concat(F.lit("CHIEF COMPLAINT: "), "n1", F.lit("\n"), said, "n1", F.lit(". "), other, "n2", F.lit(", today.\nPhysical Exam:\nAssessment and plan: "), noun, F.lit(" stable.\n"))
    return rows.select(F.col("o_orderkey").alias("doc_seq"), F.concat(F.lit("note-"), "o_orderkey").alias("doc_id"), text.alias("text"))


NOTES = """
lines AS (SELECT l_orderkey, min(l_partkey) p1, max(l_partkey) p2, min(l_returnflag) flag FROM lineitem GROUP BY 1),
notes AS MATERIALIZED (
  SELECT o_orderkey doc_seq, 'note-' || o_orderkey doc_id,
    'CHIEF COMPLAINT: ' || a.p_name || chr(10) || CASE flag WHEN 'A' THEN 'Patient has no ' WHEN 'N' THEN 'Possible ' ELSE 'Patient has ' END || a.p_name || '. '
    || CASE o_orderstatus WHEN 'F' THEN 'History of ' WHEN 'O' THEN 'Mother with ' ELSE 'Denies ' END || b.p_name || ', today.' || chr(10)
    || 'Physical Exam:' || chr(10) || 'Assessment and plan: ' || split_part(b.p_name, ' ', 2) || ' stable.' || chr(10) AS text
  FROM orders JOIN lines ON o_orderkey = l_orderkey JOIN part a ON a.p_partkey = p1 JOIN part b ON b.p_partkey = p2
)"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """term, cui, preferred_name, semantic_group, semantic_types of part names and of their nouns."""
    part = read(spark, sf_dir, "part")
    number = lambda n: F.lpad(F.row_number().over(Window.orderBy("term")).cast("string"), n, "0")
    names = part.select(F.col("p_name").alias("term")).distinct().select("term", F.concat(F.lit("C"), number(7)).alias("cui"), F.upper("term").alias("preferred_name"), F.lit("DISORDER").alias("semantic_group"), F.array(F.lit("T047")).alias("semantic_types"))
    types = F.array(F.when(F.col("term").isin("ring", "rod"), "T079").otherwise("T033"))
    nouns = part.select(F.substring_index("p_name", " ", -1).alias("term")).distinct().select("term", F.concat(F.lit("C1"), number(6)).alias("cui"), F.upper("term").alias("preferred_name"), F.lit("FINDING").alias("semantic_group"), types.alias("semantic_types"))
    return names.unionByName(nouns)


LEXICON = """
lexicon AS MATERIALIZED (
  SELECT term, 'C' || lpad(CAST(row_number() OVER (ORDER BY term) AS VARCHAR), 7, '0') cui, upper(term) preferred_name, 'DISORDER' semantic_group, 'T047' tui FROM (SELECT DISTINCT p_name term FROM part)
  UNION ALL
  SELECT term, 'C1' || lpad(CAST(row_number() OVER (ORDER BY term) AS VARCHAR), 6, '0'), upper(term), 'FINDING', CASE WHEN term IN ('ring', 'rod') THEN 'T079' ELSE 'T033' END FROM (SELECT DISTINCT split_part(p_name, ' ', 2) term FROM part)
)"""


def broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits, with negation only."""
    docs = notes(spark, sf_dir)
    return assertions.simple_negation(docs, with_defaults(lex.match_terms(docs, lexicon(spark, sf_dir), "broad", 2)).drop("negated"))


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of names, one character longer where a comma follows, with cues for negation, subject, history and uncertainty."""
    docs = notes(spark, sf_dir)
    found = with_defaults(lex.match_terms(docs, lexicon(spark, sf_dir).where("semantic_group = 'DISORDER'").drop("semantic_types"), "clinical", 2))
    found = assertions.assess(found, docs, ("negated", "subject", "history_of", "uncertain"))
    longer = found.drop("text", "mention_id").join(docs.select("doc_seq", F.col("text").alias("note")), "doc_seq")
    longer = longer.withColumn("end", F.expr("if(substring(note, end + 1, 1) = ',', end + 1, end)")).withColumn("text", F.expr("substring(note, start + 1, end - start)")).drop("note")
    return longer.withColumn("mention_id", mention_id("doc_id", "start", "end", "cui"))


MENTIONS = f"""{NOTES},{LEXICON},
pieces AS (SELECT doc_seq, doc_id, text note, unnest(p) piece, generate_subscripts(p, 1) i FROM (SELECT *, regexp_extract_all(text, '\\w+|\\W+') p FROM notes)),
tokens AS (SELECT *, sum(length(piece)) OVER w - length(piece) AS start, lead(piece, 1) OVER w gap, lead(piece, 2) OVER w other FROM pieces WINDOW w AS (PARTITION BY doc_seq ORDER BY i)),
hits AS (
  SELECT doc_seq, doc_id, note, CAST(start AS INTEGER) AS start, piece AS text, lower(piece) AS term FROM tokens
  UNION ALL SELECT doc_seq, doc_id, note, CAST(start AS INTEGER), piece || gap || other, lower(piece || gap || other) FROM tokens WHERE other IS NOT NULL
),
found AS (SELECT doc_seq, doc_id, note, start, CAST(start + length(text) AS INTEGER) AS "end", text, cui, preferred_name, semantic_group, tui FROM hits JOIN lexicon USING (term)),
scoped AS MATERIALIZED (SELECT *, left(note, start) AS before, regexp_extract(lower(left(note, start)), '[^.!?\\n]*$') AS sentence FROM found),
broad AS MATERIALIZED (
  SELECT doc_seq, doc_id, note, start, "end", text, cui, preferred_name, semantic_group, tui, contains(lower(string_split(before, '.')[-1]), 'no ') AS negated,
    row_number() OVER (PARTITION BY doc_seq ORDER BY start, "end", cui) - 1 AS ord FROM scoped
),
clinical AS MATERIALIZED (
  SELECT doc_seq, doc_id, note, start, CAST(CASE WHEN substring(note, "end" + 1, 1) = ',' THEN "end" + 1 ELSE "end" END AS INTEGER) AS "end",
    CASE WHEN substring(note, "end" + 1, 1) = ',' THEN text || ',' ELSE text END AS text, "end" AS te, cui, preferred_name, semantic_group,
    regexp_matches(sentence, '\\b(no|denies|denied|without|not)\\b') AS negated,
    CASE WHEN regexp_matches(sentence, '\\bmother\\b') THEN 'family_member' ELSE 'patient' END AS subject,
    regexp_matches(sentence, '\\bhistory of\\b') AS history_of, regexp_matches(sentence, '\\bpossible\\b') AS uncertain,
    row_number() OVER (PARTITION BY doc_seq ORDER BY start, "end", cui) - 1 AS ord
  FROM scoped WHERE semantic_group = 'DISORDER'
)"""

#: Names of code systems in turn, and term types, as parts have them.
_SYSTEMS = ("SNOMEDCT_US", "RXNORM", "LNC", "ICD10CM")
_TYPES = ("PT", "SY", "IN", "HT")


def part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cui, sab, code, aui, tty, str, file_order: every part is a code of the concept it is named after."""
    of = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (F.pmod(F.col(n), F.lit(4)) + 1).cast("int"))
    key = F.col("p_partkey").cast("string")
    part = read(spark, sf_dir, "part").select(F.col("p_name").alias("term"), of(_SYSTEMS, "p_partkey").alias("sab"), F.concat(F.lit("P"), key).alias("code"), F.concat(F.lit("A"), key).alias("aui"), of(_TYPES, "p_size").alias("tty"), F.concat("p_name", F.lit(" "), key).alias("str"), F.col("p_partkey").alias("file_order"))
    return part.join(lexicon(spark, sf_dir).select("term", "cui"), "term").drop("term")


def part_ranks(spark: SparkSession) -> DataFrame:
    rows = [("SNOMEDCT_US", "PT", 500), ("SNOMEDCT_US", "SY", 490), ("RXNORM", "IN", 400), ("RXNORM", "SY", 300), ("ICD10CM", "PT", 450), ("ICD10CM", "HT", 440)]
    return spark.createDataFrame(rows, "sab string, tty string, rank int")


CODES = f"""{LEXICON},
part_codes AS (
  SELECT cui, ['SNOMEDCT_US', 'RXNORM', 'LNC', 'ICD10CM'][p_partkey % 4 + 1] sab, 'P' || p_partkey code, 'A' || p_partkey aui, ['PT', 'SY', 'IN', 'HT'][p_size % 4 + 1] tty, p_name || ' ' || p_partkey str
  FROM part JOIN lexicon ON term = p_name
),
ranks(sab, tty, rank) AS (VALUES ('SNOMEDCT_US', 'PT', 500), ('SNOMEDCT_US', 'SY', 490), ('RXNORM', 'IN', 400), ('RXNORM', 'SY', 300), ('ICD10CM', 'PT', 450), ('ICD10CM', 'HT', 440)),
ranked AS (SELECT c.*, coalesce(rank, -1) rnk FROM part_codes c LEFT JOIN ranks r ON r.sab = c.sab AND r.tty = c.tty),
best AS (SELECT cui, sab, max(rnk) top, bool_or(tty = 'PT') has_pt FROM ranked GROUP BY 1, 2),
codes AS (SELECT r.cui, r.sab, code, aui, tty, str, CASE WHEN has_pt THEN tty = 'PT' ELSE rnk = top END is_preferred FROM ranked r JOIN best USING (cui, sab))"""


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Atoms (sab, aui, code) and edges (sab, child, parent): customers under their nation and their segment, nations under regions; regions have no code."""
    sab = F.lit("ICD10CM").alias("sab")
    c, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    atom = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    edges = c.select(sab, atom("K", "c_custkey").alias("child"), atom("N", "c_nationkey").alias("parent")).unionByName(c.select(sab, atom("K", "c_custkey").alias("child"), atom("M", "c_mktsegment").alias("parent")))
    edges = edges.unionByName(n.select(sab, atom("N", "n_nationkey").alias("child"), atom("R", "n_regionkey").alias("parent")))
    edges = edges.unionByName(read(spark, sf_dir, "region").select(sab, atom("R", "r_regionkey").alias("child"), F.lit("TOP").alias("parent")))
    # segment atoms share one code with the top, so a code has several atoms
    atoms = c.select(sab, atom("K", "c_custkey").alias("aui"), atom("K", "c_custkey").alias("code")).unionByName(n.select(sab, atom("N", "n_nationkey").alias("aui"), atom("N", "n_nationkey").alias("code")))
    atoms = atoms.unionByName(c.select(sab, atom("M", "c_mktsegment").alias("aui"), F.lit("TOP").alias("code")).distinct()).unionByName(spark.range(1).select(sab, F.lit("TOP").alias("aui"), F.lit("TOP").alias("code")))
    return atoms, edges.distinct()


HIERARCHY = """
edges AS (
  SELECT 'K' || c_custkey child, 'N' || c_nationkey parent FROM customer UNION SELECT 'K' || c_custkey, 'M' || c_mktsegment FROM customer
  UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || r_regionkey, 'TOP' FROM region
),
atoms AS (
  SELECT 'K' || c_custkey aui, 'K' || c_custkey code FROM customer UNION SELECT 'N' || n_nationkey, 'N' || n_nationkey FROM nation
  UNION SELECT 'M' || c_mktsegment, 'TOP' FROM customer UNION SELECT 'TOP', 'TOP'
),
walk AS (
  SELECT code origin, parent node, 1 hops FROM atoms JOIN edges ON child = aui
  UNION ALL SELECT origin, parent, hops + 1 FROM walk JOIN edges ON child = node WHERE hops < 10
),
ancestors AS (
  SELECT origin code, a.code ancestor_code, min(hops) distance FROM walk JOIN atoms a ON a.aui = node
  WHERE a.code <> origin AND NOT EXISTS (SELECT 1 FROM atoms s WHERE s.code = origin AND s.aui = node) GROUP BY 1, 2
)"""
