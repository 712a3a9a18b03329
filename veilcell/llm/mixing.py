"""Mixing sources to target weights by fitting word budgets with subset sums.

Documents are counted by source and exact size. A source's target is met by whole
passes over the source and by one further copy of some documents: most of that
rest is spread evenly over all sizes, the last words are fitted by a bounded
knapsack over the documents still free. Which documents of a size are taken
follows from a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import global_positions
from ..workspace import Workspace

WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST_COPIES = 2
SEED = 11
KNAPSACK_WORDS = 1 << 16  # of a source's budget, fitted exactly at the end
BROADCAST_ROWS = 200_000  # decisions of about 60 bytes sent to every task; more are joined by shuffle


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space, tab and line ends; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(ws: Workspace, sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   most: float = MOST_COPIES) -> DataFrame:
    """One row per source: source, number, source_size, target.

    Sources are numbered by code point, null last. The share of all words is dealt
    out by weight; what a source cannot take, beyond ``most`` times its size, goes
    to the others by weight until none is above. Empty sources get nothing.
    """
    totals = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
              .withColumn("__last", F.col("source").isNull()))
    numbered = global_positions(ws, totals, ["__last", "source"], "number").drop("__last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = ws.cut(numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))), "sources")
    budget = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # a level only rises: sources that are full stay full
        full = F.col("weight") * F.lit(level) > F.col("cap")
        row = table.agg(F.sum(F.when(full, F.col("cap"))).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row.open:
            break
        new = (budget - (row.given or 0.0)) / row.open
        if new <= level:
            break
        level = new
    return table.select("source", "number", "source_size", F.least(F.col("weight") * F.lit(level), F.col("cap")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length, at most ``counts``, bring the words nearest to ``budget``."""
    take = np.zeros(len(lengths), np.int64)
    order = [i for i in np.argsort(-lengths, kind="stable") if lengths[i] > 0 and counts[i] > 0]
    total = sum(int(lengths[i]) * int(counts[i]) for i in order)
    if budget <= 0 or not order:
        return take
    # Evenly over all lengths, carrying on what a length leaves over.
    even, ideal, used = max(0, budget - reserve) / total, 0.0, 0
    for i in order:
        n, c = int(lengths[i]), int(counts[i])
        ideal += even * n * c
        take[i] = min(c, max(0, int((ideal - used) // n)))
        used += int(take[i]) * n
    for i in order:  # only if counts ran out above: bring the rest into the reach of the knapsack
        over = budget - used - reserve
        if over > 0:
            more = min(int(counts[i] - take[i]), over // int(lengths[i]))
            take[i] += more
            used += more * int(lengths[i])
    rest = budget - used
    return take + knapsack(lengths, counts - take, rest, order)


def knapsack(lengths: np.ndarray, free: np.ndarray, rest: int, order: list[int]) -> np.ndarray:
    """Bounded knapsack: bit s of a number is set if s words can be taken."""
    extra = np.zeros(len(lengths), np.int64)
    if rest <= 0:
        return extra
    # Sums up to the smallest step beyond the rest, so that a nearer sum above it is found too.
    limit = 2 * rest
    mask = (1 << (limit + 1)) - 1
    reach, steps = 1, []
    for i in order:
        n = int(lengths[i])
        c = min(int(free[i]), limit // n)
        if c <= 0:
            continue
        steps.append((n, c, i, reach))
        part = 1
        while c > 0:  # counts in binary parts
            part = min(part, c)
            reach |= (reach << (part * n)) & mask
            c -= part
            part *= 2
        if reach >> rest & 1:
            break
    below = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    above = reach >> (rest + 1)
    at = below
    if above:
        nearest = rest + 1 + ((above & -above).bit_length() - 1)
        at = nearest if nearest - rest < rest - below else below
    for n, c, i, before in reversed(steps):
        while not before >> at & 1:
            at -= n
            extra[i] += 1
    return extra


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    passes = int(target // total) if total else 0
    take = fit(rows["size"].to_numpy(np.int64), rows["rows"].to_numpy(np.int64), round(target - passes * total))
    return rows[["number", "size", "rows"]].assign(passes=passes, take=take)


def decisions(ws: Workspace, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source number and size: passes, and the largest hash that gets a further copy (null: none)."""
    numbered = sizes.join(targets.select(F.col("source").alias("__source"), "number"),
                          F.col("source").eqNullSafe(F.col("__source"))).select("number", "size", "key")
    counts = ws.cut(numbered.groupBy("number", "size").agg(F.count(F.lit(1)).alias("rows")), "counts")
    picks = ws.cut(counts.join(targets.select("number", "source_size", "target"), "number").groupBy("number")
                   .applyInPandas(_fit_source, "number bigint, size bigint, rows bigint, passes bigint, take bigint"), "picks")
    # Positions of all documents in (source, size, hash) order: no task ranks a whole source or size.
    placed = global_positions(ws, numbered, ["number", "size", "key"], "position")
    keys = placed.groupBy("number", "size", "key").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    starts = keys.groupBy("number", "size").agg(F.min("first").alias("start"))
    bound = (keys.join(picks.where("take > 0").join(starts, ["number", "size"]), ["number", "size"])
             .where("first <= start + take - 1 and last >= start + take - 1"))
    # Repeated rows have one hash and go together, to the side that is nearer.
    outside = F.col("last") - F.col("start") + 1 - F.col("take") > F.col("take") - (F.col("first") - F.col("start"))
    bound = bound.select("number", "size", F.when(outside, F.col("key") - 1).otherwise(F.col("key")).alias("bound"))
    return ws.cut(picks.join(bound, ["number", "size"], "left").select("number", "size", "passes", "bound"), "decisions")


def mixed(ws: Workspace, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies, taken) of every document, ``row`` holding all its columns.

    Null texts have size 0 and are never taken; null sources are one source; rows
    with null ids are told apart by their text, and repeated rows are treated
    alike. An empty table gives no rows. The result depends on ids, texts and the
    seed, not on partitions.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("doc_id"),
                       docs[source].alias("source"), size_of(docs[text]).alias("size"),
                       F.xxhash64(F.lit(seed), docs[doc_id], docs[text]).alias("key"))
    sizes = ws.cut(rows.select("source", "size", "key"), "sizes")
    targets = ws.cut(source_targets(ws, sizes, weights, share, most), "targets")
    table = decisions(ws, sizes, targets).join(targets, "number")
    table = ws.cut(table.select(F.col("source").alias("__source"), F.col("size").alias("__size"), "source_size", "target", "passes", "bound"), "table")
    small = table.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(table) if small else table,
                       F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")))
    copies = F.col("passes") + F.when(F.col("key") <= F.col("bound"), 1).otherwise(0)
    return joined.select("row", "doc_id", "source", "size", "source_size", "target", copies.cast("bigint").alias("copies"),
                         (copies * F.col("size")).cast("bigint").alias("taken"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return mixed(Workspace(spark), docs).select("doc_id", "source", "size", "source_size", "target", "taken")
