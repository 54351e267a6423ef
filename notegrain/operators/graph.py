"""Transitive closure by frontier joins.

Each hop joins the frontier to the edges and keeps what wasn't reached; hops go on until nothing is new, or to the
depth asked for. Reached pairs are written to the shared folder after each hop, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..scratch import discard, written


def reach(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(sab, origin, node, hops): nodes reached from an origin's start nodes, by the fewest hops; starts themselves have 0.

    starts: (sab, origin, node); edges: (sab, node, next). An origin may start from several nodes.
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError(f"max_depth must be 1 or more, or None: {max_depth}")
    frontier = written(starts.select("sab", "origin", "node").distinct(), "closure")
    tables, seen, hops = [frontier], [frontier.withColumn("hops", F.lit(0))], 0
    while (max_depth is None or hops < max_depth) and not frontier.isEmpty():
        hops += 1
        known = seen[0]
        for s in seen[1:]:
            known = known.unionByName(s)
        step = frontier.join(edges, ["sab", "node"]).select("sab", "origin", F.col("next").alias("node")).distinct()
        frontier = written(step.join(known.select("sab", "origin", "node"), ["sab", "origin", "node"], "left_anti"), "closure")
        tables.append(frontier)
        seen.append(frontier.withColumn("hops", F.lit(hops)))
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    out = written(out, "closure")
    discard(*tables)
    return out


def code_ancestors(atoms: DataFrame, parents: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(sab, code, ancestor_code, distance) from atoms (sab, aui, code) and edges (sab, child, parent).

    A walk starts from all atoms of a code; atoms without a code are walked through; a code isn't its own ancestor.
    """
    walked = reach(atoms.select("sab", F.col("code").alias("origin"), F.col("aui").alias("node")), parents.select("sab", F.col("child").alias("node"), F.col("parent").alias("next")), max_depth)
    named = atoms.select("sab", F.col("aui").alias("node"), F.col("code").alias("ancestor_code"))
    found = walked.where("hops > 0").join(named, ["sab", "node"]).where("ancestor_code <> origin")
    return found.groupBy("sab", F.col("origin").alias("code"), "ancestor_code").agg(F.min("hops").alias("distance"))


def resolve_ingredients(products: DataFrame, breakdown: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(product_cui, ingredient_cui, hops): what a product (cui) breaks down to along (coarser, finer).

    Only nodes that break down no further and are known ingredients (cui) count; an ingredient is its own, at 0 hops.
    """
    all_ = F.lit("").alias("sab")
    walked = reach(products.select(all_, F.col("cui").alias("origin"), F.col("cui").alias("node")), breakdown.select(all_, F.col("coarser").alias("node"), F.col("finer").alias("next")))
    ends = walked.join(breakdown.select(F.col("coarser").alias("node")), "node", "left_anti").join(ingredients.select(F.col("cui").alias("node")), "node", "left_semi")
    return ends.select(F.col("origin").alias("product_cui"), F.col("node").alias("ingredient_cui"), "hops")
