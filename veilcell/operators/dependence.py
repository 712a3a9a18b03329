"""Pairwise dependence of columns and their entropy, from one- and two-column trees.

Cells of a pair that hold no rows score 1, so their share of the result follows
from per-level sums of the single columns. Only cells that do exist are joined;
the cross product of two trees is never formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import column_combinations
from .cells import Forest


def column_entropy(forest: Forest) -> DataFrame:
    """Entropy in bits over the noisy leaf counts of each column: (col, entropy)."""
    nodes = forest.trees[1].nodes
    roots = nodes.where("level = 0").select("combo", F.col("noisy").alias("total"))
    share = F.col("noisy") / F.col("total")
    return (nodes.where("not split").join(roots, "combo")
            .groupBy(F.col("combo").alias("col")).agg(F.sum(-share * F.log2(share)).alias("entropy")))


def reachable_nodes(forest: Forest, threshold: int) -> DataFrame:
    """One-column nodes that count at least ``threshold`` along their whole path."""
    trees = forest.trees[1]
    heavy = trees.nodes.where(F.col("noisy") >= threshold).select("combo", "level", "c1", "noisy", "mn1", "mx1")
    above = heavy.where("level > 0").select(
        "combo", "level", "c1", "mn1", F.explode(F.sequence(F.lit(0), F.col("level") - 1)).alias("a_level"))
    above = forest.with_cells(above, 1, trees.combos, F.col("a_level"), "a_c")
    held = heavy.select("combo", F.col("level").alias("a_level"), F.col("c1").alias("a_c1"))
    whole = (above.join(held, ["combo", "a_level", "a_c1"], "left_semi").groupBy("combo", "level", "c1")
             .agg(F.count(F.lit(1)).alias("found")).where("found = level").select("combo", "level", "c1"))
    return heavy.where("level = 0").unionByName(heavy.join(whole, ["combo", "level", "c1"]))


def walk_nodes(forest: Forest, threshold: int) -> DataFrame:
    """Nodes a walk can stand on at each level: (col, level, cell, weight, carried).

    A node with a single value has no children but keeps its place on deeper
    levels, in the cell of its value.
    """
    trees = forest.trees[1]
    nodes = reachable_nodes(forest, threshold)
    own = nodes.select(F.col("combo").alias("col"), "level", F.col("c1").alias("cell"),
                       F.col("noisy").alias("weight"), F.lit(False).alias("carried"))
    single = nodes.where((F.col("mn1") == F.col("mx1")) & (F.col("level") < trees.depth)).select(
        "combo", "mn1", "noisy", F.explode(F.sequence(F.col("level") + 1, F.lit(trees.depth))).alias("level"))
    single = forest.with_cells(single, 1, trees.combos, F.col("level"))
    carried = single.select(F.col("combo").alias("col"), "level", F.col("c1").alias("cell"),
                            F.col("noisy").alias("weight"), F.lit(True).alias("carried"))
    return own.unionByName(carried)


def pair_dependence(forest: Forest) -> DataFrame:
    """Dependence of every column pair, 0 (independent) to 1: (col_x, col_y, dependence), col_x < col_y."""
    columns = [c.index for c in forest.data.columns]
    pairs = column_combinations(columns, 2)
    if not pairs:
        return forest.ws.spark.createDataFrame([], "col_x int, col_y int, dependence double")
    cells = forest.dimension(2, pairs)
    walk = forest.ws.cut(walk_nodes(forest, forest.config.range_threshold), "walk")
    pair_table = forest.ws.spark.createDataFrame(
        [(i, x, y) for i, (x, y) in enumerate(cells.combos)], "combo int, x int, y int")
    n_rows = float(forest.data.n_rows)

    sums = walk.where("level > 0").groupBy("col", "level").agg(
        F.sum("weight").alias("all"), F.sum(F.expr("if(carried, weight, 0L)")).alias("held"))
    sx = sums.select(F.col("col").alias("x"), "level", F.col("all").alias("all_x"), F.col("held").alias("held_x"))
    sy = sums.select(F.col("col").alias("y"), "level", F.col("all").alias("all_y"), F.col("held").alias("held_y"))
    # Pairs of columns, not of rows or cells.
    expected = pair_table.join(sx, "x").join(sy, ["y", "level"]).groupBy("combo").agg(
        F.sum((F.col("all_x").cast("double") * F.col("all_y") - F.col("held_x").cast("double") * F.col("held_y")) / n_rows)
        .alias("expected"))

    side = {s: walk.select(F.col("col").alias(s), "level", F.col("cell").alias(f"c{i}"),
                           F.col("weight").alias(f"w{s}"), F.col("carried").alias(f"k{s}"))
            for i, s in enumerate("xy", 1)}
    found = (cells.nodes.where("level > 0").select("combo", "level", "c1", "c2", F.col("noisy").cast("double").alias("a"))
             .join(F.broadcast(pair_table), "combo")
             .join(side["x"], ["x", "level", "c1"]).join(side["y"], ["y", "level", "c2"]).where("not (kx and ky)")
             .withColumn("e", F.expr(f"cast(wx as double) * wy / {n_rows}D"))
             .groupBy("combo").agg(F.sum("e").alias("met"),
                                   F.sum(F.expr("e * abs(e - a) / greatest(e, a)")).alias("scored")))
    score = F.expr("case when expected > 0 then (expected - coalesce(met, 0D) + coalesce(scored, 0D)) / expected else 0D end")
    return pair_table.join(expected, "combo", "left").join(found, "combo", "left").select(
        F.col("x").alias("col_x"), F.col("y").alias("col_y"), score.alias("dependence"))


def dependence_matrix(pairs: DataFrame, columns: int) -> DataFrame:
    """Both directions of every pair and a diagonal of 1."""
    mirrored = pairs.select(F.col("col_y").alias("col_x"), F.col("col_x").alias("col_y"), "dependence")
    diagonal = pairs.sparkSession.range(columns).selectExpr("cast(id as int) col_x", "cast(id as int) col_y",
                                                            "1D as dependence")
    return pairs.unionByName(mirrored).unionByName(diagonal)


def total_dependence(matrix: DataFrame) -> DataFrame:
    return matrix.where("col_x <> col_y").groupBy(F.col("col_x").alias("col")).agg(F.sum("dependence").alias("total"))


def column_weights(entropies: DataFrame) -> DataFrame:
    """What a column costs in a cluster."""
    return entropies.select("col", (1 + F.sqrt(F.greatest("entropy", F.lit(1.0)))).alias("weight"))
