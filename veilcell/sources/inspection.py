"""Tables that show the inside of a run: tree nodes, buckets and column facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cells import Forest, cell_names
from ..operators.harvest import Harvest


def node_table(forest: Forest, combo: Sequence[int]) -> DataFrame:
    """Nodes of one tree with their cell ranges, stub and split flags and noisy counts."""
    combo = tuple(combo)
    k, trees = len(combo), forest.trees[len(combo)]
    nodes = trees.nodes.where(F.col("combo") == forest.combo_id(combo))
    ranged = forest.with_ranges(nodes, k, trees.combos)
    ranges = [f"{n}{d}" for d in range(1, k + 1) for n in ("lo", "hi")]
    return ranged.select("level", *cell_names(k), *ranges, "stub", "split", F.col("noisy").alias("noisy_count"))


def bucket_table(harvest: Harvest, combo: Sequence[int]) -> DataFrame:
    return harvest.final(combo).drop("pos_first", "pos_end")


def column_table(forest: Forest) -> DataFrame:
    """Per column: kind, NULL code, and the root range after anonymizing its ends."""
    rows = [(c.name, c.kind, c.null_code, r.lo, r.lo + r.size) for c, r in zip(forest.data.columns, forest.roots)]
    return forest.ws.spark.createDataFrame(
        rows, "name string, kind string, null_code double, root_lo double, root_hi double")
