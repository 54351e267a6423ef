"""The terminology store: built from vocabulary release files, queried as tables.

Tables: ``cui_codes`` (cui, sab, code, aui, tty, str, is_preferred), ``code_hierarchy`` (sab, code, ancestor_code, distance), ``ingredients``
(product_cui, ingredient_cui, ingredient_rxcui, ingredient_name, hops) and ``build_info``; each written as Parquet, the first two by source.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import __name__ as PACKAGE
from ..scratch import written
from ..sources import rrf
from .graph import code_ancestors, resolve_ingredients

# Source names, and the orders in which their names are used.
CODE_SYSTEMS = ("ICD10CM", "LNC", "RXNORM", "SNOMEDCT_US")
CROSSWALK_SYSTEMS = ("ICD10CM",)
DISPLAY_ORDER = ("SNOMEDCT_US", "RXNORM", "LNC", "ICD10CM")
SUMMARY_ORDER = ("SNOMEDCT_US", "RXNORM", "ICD10CM", "LNC")
HIERARCHY_SOURCES = ("ICD10CM", "SNOMEDCT_US")
INGREDIENT_TYPES = ("IN", "PIN")
ALIASES = {"ICD10": "ICD10CM", "ICD": "ICD10CM", "SNOMED": "SNOMEDCT_US", "SNOMEDCT": "SNOMEDCT_US", "LOINC": "LNC", "RX": "RXNORM"}


def guess_release(path: str) -> str | None:
    """A release name such as 2026AA in a path."""
    found = re.search(r"(?<!\d)\d{4}A[AB](?![A-Za-z0-9])", path)
    return found[0] if found else None


def system(name: str) -> str:
    """The source of this name, by any capitals and punctuation; an unknown one is an error that says what it may be."""
    plain = re.sub("[^A-Z0-9]", "", name.upper())
    by_plain = {re.sub("[^A-Z0-9]", "", s): s for s in CODE_SYSTEMS}
    if plain in by_plain:
        return by_plain[plain]
    hint = f"; did you mean {ALIASES[plain]}?" if plain in ALIASES else ""
    raise ValueError(f"unknown code system {name!r}: one of {', '.join(CODE_SYSTEMS)}{hint}")


def order_of(column: str, names: tuple[str, ...]) -> Column:
    out = F
    for k, n in enumerate(names):
        out = out.when(F.col(column) == n, k)
    return out.otherwise(len(names))


def first_rows(rows: DataFrame) -> DataFrame:
    """Of rows (cui, sab, code, aui, tty, str, file_order) the first of each (cui, sab, code, tty)."""
    return rows.groupBy("cui", "sab", "code", "tty").agg(F.min_by(F.struct("aui", "str"), "file_order").alias("f")).select("cui", "sab", "code", "f.aui", "tty", "f.str")


def mark_preferred(codes: DataFrame, ranks: DataFrame) -> DataFrame:
    """``is_preferred``: the PT rows of a (cui, sab); where it has none, the rows of its highest-ranked term type (no rank: -1), ties all."""
    per = Window.partitionBy("cui", "sab")
    ranked = codes.join(ranks.select("sab", "tty", "rank"), ["sab", "tty"], "left").withColumn("rank", F.coalesce("rank", F.lit(-1)))
    has_pt, best = F.max(F.col("tty") == "PT").over(per), F.max("rank").over(per)
    return ranked.withColumn("is_preferred", F.when(has_pt, F.col("tty") == "PT").otherwise(F.col("rank") == best)).select(*codes.columns, "is_preferred")


def ingredient_names(codes: DataFrame) -> DataFrame:
    """(cui, ingredient_rxcui, ingredient_name): an ingredient's preferred row first, then by term type and code."""
    rows = codes.where((F.col("sab") == "RXNORM") & F.col("tty").isin(*INGREDIENT_TYPES))
    first = Window.partitionBy("cui").orderBy(F.col("is_preferred").desc(), "tty", "code")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("cui", F.col("code").alias("ingredient_rxcui"), F.col("str").alias("ingredient_name"))


def preferred_display(codes: DataFrame) -> DataFrame:
    """(cui, display): a preferred name, of the first source in order, then by code."""
    first = F.struct(~F.col("is_preferred"), order_of("sab", DISPLAY_ORDER), "sab", "code", "tty")
    return codes.groupBy("cui").agg(F.min_by("str", first).alias("display"))


def dealt_by_strings(mentions: DataFrame, made: DataFrame) -> DataFrame:
    """The mentions (with doc_seq), dealt so that each partition meets few of the concepts' strings in ``made`` (cui, and columns).

    A Parquet file holds a string once if all that a column has in a row group fit a dictionary; if they don't, each row holds its own. So
    concepts are put into groups of strings that fit one, and a group's mentions are dealt by document over partitions of their own; those of other
    concepts go anywhere. Where all strings fit one dictionary the mentions stay where they are. A string longer than a dictionary is in every row.
    """
    spark = made.sparkSession
    room = spark._jsc.hadoopConfiguration().getInt("parquet.dictionary.page.size", 1 << 20) // 2
    lengths = [F.coalesce(F.octet_length(c), F.lit(0)) + 4 for c, kind in made.dtypes if kind == "string" and c != "cui"]
    sizes = made.select("cui", sum(lengths, F.lit(0)).cast("bigint").alias("size"))
    long = F.col("size") > room // 8
    by = {r["long"]: r["size"] for r in sizes.groupBy(long.alias("long")).agg(F.sum("size").alias("size")).collect()}
    if sum(by.values()) <= room:
        return mentions
    # long strings side by side, few enough for one window; short ones by a hash, at half the load
    packed, hashed = -(-by.get(True, 0) // room), -(-2 * by.get(False, 0) // room)
    at = F.sum("size").over(Window.orderBy("cui")) - F.col("size")
    groups = sizes.where(long).select("cui", F.floor(at / room).alias("group"))
    groups = groups.unionByName(sizes.where(~long).select("cui", (F.pmod(F.xxhash64("cui"), F.lit(max(hashed, 1))) + packed).alias("group")))
    each = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // (packed + hashed))
    share = lambda n: F.pmod(F.xxhash64("doc_seq"), F.lit(n))
    to = F.coalesce(F.col("group") * each + share(each), share((packed + hashed) * each))
    return mentions.join(groups, "cui", "left").repartitionById((packed + hashed) * each, to.cast("int")).drop("group")


def build(spark: SparkSession, mrconso: str, mrrank: str, out: str, *, mrrel: str | None = None, sources: tuple[str, ...] = CODE_SYSTEMS, include_suppressed: bool = False, max_depth: int | None = None, release: str | None = None) -> TerminologyStore:
    """Read a release's files and write the store; nothing is overwritten."""
    edges, breakdown = rrf.relations(spark, mrrel, HIERARCHY_SOURCES, include_suppressed) if mrrel else (None, None)
    rows = rrf.concepts(spark, mrconso, sources, include_suppressed)
    folder = out.rstrip("/")
    mark_preferred(first_rows(rows), rrf.ranks(spark, mrrank, sources)).write.partitionBy("sab").mode("error").parquet(f"{folder}/cui_codes")
    codes = spark.read.parquet(f"{folder}/cui_codes")
    walked: list[str] = []
    if edges is not None:
        walked = [s for s in HIERARCHY_SOURCES if s in sources]
        # only atoms that an edge mentions can start or end a walk
        used = edges.select("sab", F.explode(F.array("child", "parent")).alias("aui")).distinct()
        atoms = rows.where(F.col("sab").isin(*walked)).select("sab", "aui", "code").join(used, ["sab", "aui"], "left_semi").distinct()
        code_ancestors(atoms, edges.where(F.col("sab").isin(*walked)), max_depth).write.partitionBy("sab").mode("error").parquet(f"{folder}/code_hierarchy")
        if "RXNORM" in sources:
            names = ingredient_names(codes)
            found = resolve_ingredients(codes.where("sab = 'RXNORM'").select("cui").distinct(), breakdown, names)
            found.join(names.withColumnRenamed("cui", "ingredient_cui"), "ingredient_cui").select("product_cui", "ingredient_cui", "ingredient_rxcui", "ingredient_name", "hops").write.mode("error").parquet(f"{folder}/ingredients")
    built = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    info = (release or guess_release(mrconso) or "", built, ",".join(sorted(sources)), include_suppressed, PACKAGE, ",".join(walked), max_depth if walked else None, edges is not None and "RXNORM" in sources)
    schema = "umls_release string, built_at string, sources string, include_suppressed boolean, builder string, hierarchy_sources string, hierarchy_max_depth int, has_ingredients boolean"
    spark.createDataFrame([info], schema).write.mode("error").parquet(f"{folder}/build_info")
    return TerminologyStore.open(spark, folder)


class TerminologyStore:
    """Queries over the four tables. All answers are DataFrames but build_info."""

    def __init__(self, codes: DataFrame, hierarchy: DataFrame | None = None, ingredients: DataFrame | None = None, info: dict | None = None):
        self.codes, self.hierarchy, self.ingredient_rows, self.build_info = codes, hierarchy, ingredients, info or {}

    @staticmethod
    def open(spark: SparkSession, folder: str) -> TerminologyStore:
        info = spark.read.parquet(f"{folder}/build_info").first().asDict()
        read = lambda name: spark.read.parquet(f"{PurePosixPath(folder) if '://' not in folder else folder}/{name}")
        return TerminologyStore(read("cui_codes"), read("code_hierarchy") if info["hierarchy_sources"] else None, read("ingredients") if info["has_ingredients"] else None, info)

    def require(self, *, hierarchy: bool = False, ingredients: bool = False) -> None:
        for needed, have, what in ((hierarchy, self.hierarchy, "code hierarchy"), (ingredients, self.ingredient_rows, "ingredients")):
            if needed and have is None:
                raise ValueError(f"the store has no {what}: build it with a relations file")

    def cuis_for_code(self, sab: str, code: str) -> DataFrame:
        return self.codes.where((F.col("sab") == system(sab)) & (F.upper("code") == code.upper())).select("cui").distinct().orderBy("cui")

    def preferred_display(self) -> DataFrame:
        return preferred_display(self.codes)

    def ancestors(self, max_distance: int | None = None) -> DataFrame:
        self.require(hierarchy=True)
        return self.hierarchy.where(F.col("distance") <= max_distance) if max_distance is not None else self.hierarchy

    def descendants(self, sab: str, code: str, max_distance: int | None = None) -> DataFrame:
        rows = self.ancestors(max_distance).where((F.col("sab") == system(sab)) & (F.upper("ancestor_code") == code.upper()))
        return rows.select("code", "distance").orderBy("distance", "code")

    def ingredients(self) -> DataFrame:
        self.require(ingredients=True)
        return self.ingredient_rows

    def nested_codes(self, systems: tuple[str, ...] = CODE_SYSTEMS, *, preferred_only: bool = False, ancestor_depth: int = 0, ingredients: bool = False) -> DataFrame:
        """(cui, codes): a concept's codes as one array, by source, preferred first, then code and term type.

        Built once for each concept, so a join to mentions neither multiplies nor sorts them.
        """
        self.require(hierarchy=ancestor_depth > 0, ingredients=ingredients)
        rows = self.codes.where(F.col("sab").isin(*systems))
        rows = rows.where("is_preferred") if preferred_only else rows
        nothing = F.array().cast("array<string>")
        if ancestor_depth:
            above = self.ancestors(ancestor_depth).groupBy("sab", "code").agg(F.array_sort(F.collect_list(F.struct("distance", "ancestor_code"))).alias("up"))
            rows = rows.join(above, ["sab", "code"], "left").withColumn("ancestors", F.coalesce(F.transform("up", lambda x: x["ancestor_code"]), nothing)).drop("up")
        else:
            rows = rows.withColumn("ancestors", nothing)
        if ingredients:
            parts = self.ingredient_rows.groupBy(F.col("product_cui").alias("cui")).agg(F.array_sort(F.collect_list(F.struct("hops", "ingredient_name", "ingredient_rxcui"))).alias("parts"))
            rows = rows.join(parts, "cui", "left").withColumn("ingredients", F.when(F.col("sab") == "RXNORM", F.coalesce(F.transform("parts", lambda x: x["ingredient_rxcui"]), nothing)).otherwise(nothing)).drop("parts")
        else:
            rows = rows.withColumn("ingredients", nothing)
        code = F.struct(F.col("sab").alias("system"), (~F.col("is_preferred")).alias("other"), "code", "tty", F.col("str").alias("display"), "is_preferred", F.col("sab").isin(*CROSSWALK_SYSTEMS).alias("is_crosswalk"), "ancestors", "ingredients")
        return rows.groupBy("cui").agg(F.array_sort(F.collect_list(code)).alias("codes")).select("cui", F.transform("codes", lambda c: c.dropFields("other")).alias("codes"))

    def attach(self, mentions: DataFrame, *, of_codes: Callable[[Column], dict[str, Column]] | None = None, **options) -> DataFrame:
        """The mentions with ``codes``; a concept without codes has an empty array.

        of_codes: columns made of the codes, in their place. They are computed once for each concept, not for each mention, and written, so
        that the join knows their size. Mentions of concepts that share a dictionary of these strings stand together (``dealt_by_strings``).
        """
        nested = self.nested_codes(**options)
        none = F.array().cast(dict(nested.dtypes)["codes"])
        if of_codes is None:
            return mentions.join(nested, "cui", "left").withColumn("codes", F.coalesce("codes", none))
        made = written(nested.select("cui", *(x.alias(k) for k, x in of_codes(F.col("codes")).items())), "of-codes")
        return dealt_by_strings(mentions, made).join(made, "cui", "left").withColumns({k: F.coalesce(k, x) for k, x in of_codes(none).items()})

    def standard(self) -> DataFrame:
        """(cui) with a SNOMED CT or RxNorm code."""
        return self.codes.where(F.col("sab").isin("SNOMEDCT_US", "RXNORM")).select("cui").distinct()

    def crosswalk(self, sab: str, target: str, code: str | None = None) -> DataFrame:
        """(code, cui, target_code, display): codes of one source to those of another, by their concepts."""
        a = self.codes.where(F.col("sab") == system(sab)).select("code", "cui").distinct()
        a = a.where(F.upper("code") == code.upper()) if code is not None else a
        b = self.codes.where(F.col("sab") == system(target)).select("cui", F.col("code").alias("target_code"), F.col("str").alias("display"), "is_preferred")
        b = b.groupBy("cui", "target_code").agg(F.min_by("display", F.struct(~F.col("is_preferred"), "display")).alias("display"))
        return a.join(b, "cui").select("code", "cui", "target_code", "display")

    def resolve_codes(self, wanted: DataFrame) -> DataFrame:
        """(cui, via): concepts of the wanted codes (sab, code) and of all codes below them, with the codes they came by."""
        wanted = wanted.select("sab", F.upper("code").alias("top"))
        own = self.codes.join(wanted, (self.codes["sab"] == wanted["sab"]) & (F.upper(self.codes["code"]) == F.col("top"))).select(self.codes["cui"], self.codes["code"])
        found = own
        if self.hierarchy is not None:
            below = self.hierarchy.join(wanted, (self.hierarchy["sab"] == wanted["sab"]) & (F.upper(self.hierarchy["ancestor_code"]) == F.col("top"))).select(self.hierarchy["sab"], self.hierarchy["code"]).distinct()
            found = own.unionByName(self.codes.join(below, ["sab", "code"]).select("cui", "code"))
        return found.groupBy("cui").agg(F.array_sort(F.collect_set("code")).alias("via"))
