"""Joins that put synthesized clusters together: positional patching and range-refined stitching."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STITCH_MIN_RATIO
from ..functions.geometry import cell_of
from ..functions.hashing import draw_key, index_draw, shuffled_position
from ..workspace import Workspace
from .harvest import expand_counts
from .ranking import group_ranks

PASS_BITS = 16  # cells per bin and pass stay below 2^16
BIN_BATCH = 32  # bins per call of the splitting function
BIN_ROWS = 1 << 16  # rows of a side that are ranked by one task; larger bins are ranked by ranges


@dataclass(frozen=True)
class MicroTable:
    """Synthetic rows of some columns: pos (unique), s<i> values, n<i> codes."""

    rows: DataFrame
    columns: tuple[int, ...]
    count: int
    dense: bool  # pos runs 0, 1, .. without gaps


@dataclass(frozen=True)
class StitchColumn:
    index: int
    lo: float
    hi: float
    integral: bool


def fields(columns: Sequence[int]) -> list[str]:
    return [f"{p}{c}" for c in columns for p in ("s", "n")]


# -- positional join ------------------------------------------------------------

def aligned_index(index: Column, available: int, wanted: int, *keys: Column) -> Column:
    """Right-hand position for a left-hand index: itself, or a random repeat once the right side runs out."""
    if available >= wanted:
        return index
    return F.when(index < available, index).otherwise(index_draw(F.lit(available), index, *keys))


def patch(ws: Workspace, left: MicroTable, right: MicroTable) -> MicroTable:
    """Pairs the left rows in order with the right rows in shuffled order."""
    if right.count == 0 or left.count == 0:
        raise ValueError("a cluster has no rows")
    name = ",".join(map(str, right.columns))
    rights = (right.rows.withColumn("__index", F.col("pos").cast("bigint")) if right.dense
              else group_ranks(ws, right.rows, [], ["pos"], "__index"))
    shuffled = rights.withColumn("__slot", shuffled_position(F.col("__index"), right.count, name))
    lefts = (left.rows.withColumn("__index", F.col("pos").cast("bigint")) if left.dense
             else group_ranks(ws, left.rows, [], ["pos"], "__index"))
    lefts = lefts.withColumn("__slot", aligned_index(F.col("__index"), right.count, left.count, F.lit(name)))
    joined = lefts.join(shuffled.select("__slot", *fields(right.columns)), "__slot")
    columns = tuple(sorted({*left.columns, *right.columns}))
    rows = joined.select(F.col("__index").alias("pos"), *fields(columns))
    return MicroTable(ws.cut(rows, "patched"), columns, left.count, True)


# -- range-refined join ---------------------------------------------------------

def split_bins(limits: Sequence[tuple[float, bool]], bits: int, ratio: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function splitting bins over their cell counts, ``bits`` halvings per column at most.

    ``limits`` holds the root upper bound and integrality of each stitch column.
    A bin is halved at the middle of its next column while both halves hold
    similar row counts on the two sides; columns take turns, and a bin is final
    after a full round of refusals or when a side has one row. All bins of a call
    take their steps at once: the state is one array row per bin. Defined inside
    so that it travels to the workers by value.
    """
    size = len(limits)
    tops, integral = np.array([t for t, _ in limits]), np.array([i for _, i in limits])

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        cells = batch[[f"f{i}" for i in range(size)]].to_numpy()
        rows = {"l": batch["left_rows"].to_numpy(), "r": batch["right_rows"].to_numpy()}
        owner, names = pd.factorize(batch["bin"])
        first = batch.drop_duplicates("bin")  # in the order of the names
        lo, hi = (np.array(first[c].tolist(), float).reshape(-1, size) for c in ("lo", "hi"))
        turn, attempts = first["turn"].to_numpy().copy(), first["attempts"].to_numpy().copy()
        names, used = np.array(names, object), np.zeros((len(names), size), np.int64)
        state = np.zeros(len(names), np.int8)  # 0: open, 1: final, 2: needs finer cells
        while (state == 0).any():
            n = len(names)
            at = np.arange(n)

            def counted(side: str, where: np.ndarray) -> np.ndarray:
                return np.bincount(owner[where], weights=rows[side][where], minlength=n)

            everywhere = np.ones(len(owner), bool)
            state[(state == 0) & ((attempts == 0) | (counted("l", everywhere) == 1) | (counted("r", everywhere) == 1))] = 1
            low, high, depth = lo[at, turn], hi[at, turn], used[at, turn]
            width = high - low
            whole = integral[turn] & (width <= 1) & ~((high == tops[turn]) & (width == 1))
            state[(state == 0) & ~whole & (depth == bits)] = 2
            tried = (state == 0) & ~whole
            upper = (cells[np.arange(len(owner)), turn[owner]] >> np.maximum(bits - 1 - depth, 0)[owner]) & 1 == 1
            halves = [(counted("l", upper == up), counted("r", upper == up)) for up in (False, True)]
            fair = [(np.minimum(x, y) > 0) & (np.minimum(x, y) >= ratio * np.maximum(x, y)) for x, y in halves]
            split = tried & fair[0] & fair[1]
            # One empty half costs a turn but narrows the range.
            narrow = [tried & ~split & (x + y == 0) for x, y in reversed(halves)]
            middle, column = (low + high) / 2, turn.copy()
            moved = state == 0
            turn[moved] = (turn[moved] + 1) % size
            attempts[moved] -= 1
            attempts[split] = size
            used[at, column] += split | narrow[0] | narrow[1]
            old = np.flatnonzero(split)
            fresh = n + np.arange(len(old))
            lo, hi, used, turn, attempts, state = (np.concatenate([x, x[old]]) for x in (lo, hi, used, turn, attempts, state))
            hi[at, column] = np.where(split | narrow[0], middle, high)
            lo[at, column] = np.where(narrow[1], middle, low)
            lo[fresh, column[old]] = middle[old]
            names = np.concatenate([names, names[old] + "1"])
            names[old] = names[old] + "0"
            new = np.zeros(n, np.int64)
            new[old] = fresh
            owner = np.where(split[owner] & upper, new[owner], owner)
        return pd.DataFrame({
            "bin": batch["bin"], **{f"f{i}": cells[:, i] for i in range(size)}, "new_bin": names[owner], "lo": lo[owner].tolist(),
            "hi": hi[owner].tolist(), "turn": turn[owner], "attempts": attempts[owner], "done": state[owner] == 1})

    return run


def stitch_bins(ws: Workspace, rows: DataFrame, columns: Sequence[StitchColumn]) -> DataFrame:
    """Assigns every row of both sides to its final bin.

    ``rows``: side ('l' or 'r'), pos, n<i> per stitch column; result: side, pos, bin.
    Each pass needs the rows only for counting cells; the splitting itself works
    on one bounded cell table per bin.
    """
    size = len(columns)
    bits = max(1, PASS_BITS // size)
    limits = [(c.hi, c.integral) for c in columns]
    state = ws.spark.createDataFrame(
        [("b", [c.lo for c in columns], [c.hi for c in columns], 0, size)],
        "bin string, lo array<double>, hi array<double>, turn int, attempts int")
    # Every row carries the range of its bin: a join on the bin would send the rows of a large bin to one task.
    active, finished = rows.select("*", F.lit("b").alias("bin"), *[
        F.array(*[F.lit(getattr(c, n)) for c in columns]).cast("array<double>").alias(n) for n in ("lo", "hi")]), []
    cell_cols = [f"f{i}" for i in range(size)]
    schema = ("bin string, " + ", ".join(f"{c} bigint" for c in cell_cols)
              + ", new_bin string, lo array<double>, hi array<double>, turn int, attempts int, done boolean")
    while True:
        cells = [cell_of(F.col(f"n{c.index}"), F.col("lo")[i], F.col("hi")[i] - F.col("lo")[i], bits).alias(f"f{i}")
                 for i, c in enumerate(columns)]
        placed = active.select("side", "pos", "bin", *[f"n{c.index}" for c in columns], *cells)
        counts = placed.groupBy("bin", *cell_cols).agg(F.count_if(F.col("side") == "l").alias("left_rows"),
                                                       F.count_if(F.col("side") == "r").alias("right_rows"))
        # A bin has at most 2^PASS_BITS cells; a few bins share a call.
        spread = state.count() // BIN_BATCH + 1
        batched = counts.join(state, "bin").withColumn("batch", F.pmod(F.xxhash64("bin"), F.lit(spread)))
        mapping = ws.cut(batched.groupBy("batch").applyInPandas(
            split_bins(limits, bits, STITCH_MIN_RATIO), schema), "binmap")
        moved = placed.join(mapping.select("bin", *cell_cols, "new_bin", "lo", "hi", "done"), ["bin", *cell_cols]).select(
            "side", "pos", F.col("new_bin").alias("bin"), "done", "lo", "hi", *[f"n{c.index}" for c in columns])
        state = mapping.where("not done").select(F.col("new_bin").alias("bin"), "lo", "hi", "turn", "attempts").distinct()
        if state.isEmpty():
            finished.append(moved.select("side", "pos", "bin"))
            break
        moved = ws.cut(moved, "binned")
        finished.append(moved.where("done").select("side", "pos", "bin"))
        active = moved.where("not done").drop("done")
    return reduce(DataFrame.unionByName, finished)


def _draws(counts: DataFrame, n: str, tag: str) -> DataFrame:
    """The repeats that a side with ``n`` rows needs: bin, __copy and the rank __at of the row repeated."""
    short = counts.where(f"m > {n}").select("bin", n, "m")
    return expand_counts(short, ["bin"], n, "m", "__copy").select(
        "bin", "__copy", index_draw(F.col(n), F.col("bin"), F.col("__copy"), F.lit(tag)).alias("__at"))


def _pairs_in_task(left: DataFrame, right: DataFrame, counts: DataFrame, left_columns: Sequence[int], right_columns: Sequence[int],
                   stitch: Sequence[int]) -> DataFrame:
    """The pairs of bins of at most ``BIN_ROWS`` rows a side: bin, __row and the fields of both sides.

    The rows of both sides, the repeats asked for and the lengths meet once by bin;
    ranks, repeats and pairs come from there without another shuffle.
    """
    keys, parts = [f"n{c}" for c in stitch], []
    for rows, columns, n, tag in ((left, left_columns, "l", "l"), (right, right_columns, "r", "r")):
        side = F.lit(tag).alias("side")
        own = F.struct("pos", F.struct(*[F.col(k) for k in keys]).alias("keys"))
        parts += [rows.select("bin", side, F.lit(0).alias("kind"), draw_key(F.col("pos"), F.lit(tag)).alias("__key"), own.alias("own"),
                              F.struct(*fields(columns)).alias(f"{tag}_row")),
                  _draws(counts, n, tag).select("bin", side, F.lit(1).alias("kind"), "__copy", "__at"),
                  counts.select("bin", side, F.lit(2).alias("kind"), "m")]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("bin")
    group = Window.partitionBy("bin", "side")
    ranked = whole.withColumn("m", F.max("m").over(group)).withColumn("__rank", F.row_number().over(group.orderBy("kind", "__key", "own.pos")) - 1)
    ranked = ranked.where("m is not null and kind < 2").withColumn("__at", F.expr("if(kind = 0, cast(__rank as bigint), __at)"))
    # Behind each row stand its repeats.
    behind = group.orderBy("__at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = ranked.withColumns({c: F.last(c, True).over(behind) for c in ("own", "l_row", "r_row")})
    kept = filled.where("kind = 1 or __at < m").withColumn("__copy", F.coalesce("__copy", F.lit(0).cast("bigint")))
    kept = kept.withColumn("__again", draw_key(F.col("own.pos"), F.col("__copy"), F.concat("side", F.lit("2"))))
    order = group.orderBy(*[f"own.keys.{k}" for k in keys], "__again", "own.pos", "__copy")
    placed = kept.withColumn("__row", (F.row_number().over(order) - 1).cast("bigint"))
    pairs = placed.groupBy("bin", "__row").agg(*[F.first(f"{tag}_row", True).alias(f"{tag}_row") for tag in "lr"])
    return pairs.select("bin", "__row", *[F.col(f"{tag}_row.{f}").alias(f"{tag}_{f}")
                                          for tag, columns in (("l", left_columns), ("r", right_columns)) for f in fields(columns)])


def _pairs_by_range(ws: Workspace, left: DataFrame, right: DataFrame, counts: DataFrame, left_columns: Sequence[int],
                    right_columns: Sequence[int], stitch: Sequence[int]) -> DataFrame:
    """The pairs of :func:`_pairs_in_task` for bins of any size: ranks by range partitions, so no task sees a whole bin."""
    def side(rows: DataFrame, columns: Sequence[int], n: str, tag: str) -> DataFrame:
        keyed = rows.withColumn("__key", draw_key(F.col("pos"), F.lit(tag)))
        ranked = ws.cut(group_ranks(ws, keyed, ["bin"], ["__key", "pos"], "__at"), f"side-{tag}")
        sized = ranked.join(counts.select("bin", "m"), "bin")
        kept = sized.where("__at < m").drop("m").withColumn("__copy", F.lit(0).cast("bigint"))
        whole = kept.unionByName(ranked.join(_draws(counts, n, tag), ["bin", "__at"]))
        order = [f"n{c}" for c in stitch] + ["__again", "pos", "__copy"]
        whole = whole.withColumn("__again", draw_key(F.col("pos"), F.col("__copy"), F.lit(tag + "2")))
        paired = group_ranks(ws, whole, ["bin"], order, "__row")
        return paired.select("bin", "__row", *[F.col(f).alias(f"{tag}_{f}") for f in fields(columns)])

    return side(left, left_columns, "l", "l").join(side(right, right_columns, "r", "r"), ["bin", "__row"])


def merge_bins(ws: Workspace, left: DataFrame, right: DataFrame, left_columns: Sequence[int],
               right_columns: Sequence[int], stitch: Sequence[int], owner: str) -> DataFrame:
    """Pairs the rows of both sides inside each bin, in the order of the stitch columns.

    Both sides are brought to the owner's length, or the rounded mean, by dropping
    or repeating random rows. Shared columns come from the owner, or from the two
    sides in turn. Input: bin, pos and the fields of each side.
    """
    counts = left.groupBy("bin").agg(F.count(F.lit(1)).alias("l")).join(
        right.groupBy("bin").agg(F.count(F.lit(1)).alias("r")), "bin")
    length = {"left": F.col("l"), "right": F.col("r")}.get(owner, F.bround((F.col("l") + F.col("r")) / 2, 0).cast("bigint"))
    counts = ws.cut(counts.withColumn("m", length), "bins")
    large = F.broadcast(counts.where((F.col("l") > BIN_ROWS) | (F.col("r") > BIN_ROWS)).select("bin"))  # few: each has many rows
    if large.isEmpty():
        pairs = _pairs_in_task(left, right, counts, left_columns, right_columns, stitch)
    else:
        sides = {how: [df.join(large, "bin", how) for df in (left, right, counts)] for how in ("left_anti", "left_semi")}
        pairs = _pairs_in_task(*sides["left_anti"], left_columns, right_columns, stitch).unionByName(
            _pairs_by_range(ws, *sides["left_semi"], left_columns, right_columns, stitch))
    from_left = {"left": F.lit(True), "right": F.lit(False)}.get(owner, F.col("__row") % 2 == 0)
    chosen = []
    for c in sorted({*left_columns, *right_columns}):
        for f in (f"s{c}", f"n{c}"):
            if c in left_columns and c in right_columns:
                chosen.append(F.when(from_left, F.col(f"l_{f}")).otherwise(F.col(f"r_{f}")).alias(f))
            else:
                chosen.append(F.col(f"l_{f}" if c in left_columns else f"r_{f}").alias(f))
    return pairs.select(F.concat_ws(":", "bin", F.col("__row").cast("string")).alias("pos"), *chosen)


def binned_sides(ws: Workspace, left: MicroTable, right: MicroTable, columns: Sequence[StitchColumn]) -> tuple[DataFrame, DataFrame]:
    """The rows of both tables with the bin each falls into."""
    if not columns or not left.count or not right.count:
        raise ValueError("a stitch needs shared columns and rows on both sides")
    keys = [f"n{c.index}" for c in columns]
    both = left.rows.select(F.lit("l").alias("side"), F.col("pos").cast("string").alias("pos"), *keys).unionByName(
        right.rows.select(F.lit("r").alias("side"), F.col("pos").cast("string").alias("pos"), *keys))
    bins = ws.cut(stitch_bins(ws, both, columns), "rowbins")

    def binned(table: MicroTable, tag: str) -> DataFrame:
        mine = bins.where(F.col("side") == tag).drop("side")
        return table.rows.withColumn("pos", F.col("pos").cast("string")).join(mine, "pos")

    return binned(left, "l"), binned(right, "r")


def stitch(ws: Workspace, left: MicroTable, right: MicroTable, columns: Sequence[StitchColumn],
           owner: str) -> MicroTable:
    """Joins two tables that share the given columns."""
    sides = binned_sides(ws, left, right, columns)
    merged = ws.cut(merge_bins(ws, *sides, left.columns, right.columns, [c.index for c in columns], owner), "stitched")
    return MicroTable(merged, tuple(sorted({*left.columns, *right.columns})), merged.count(), False)
