"""Row sample for measuring dependence: fixed size, with replacement, independent of partitioning."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import SynthConfig
from ..functions.hashing import index_draw
from .encoding import Encoded, column_extents, root_ranges

CHUNKS = 1 << 20


def sample_rows(rows: DataFrame, n_rows: int, size: int) -> DataFrame:
    """``size`` rows drawn uniformly with replacement.

    Rows fall into hash chunks; every draw is located first among the chunk
    sizes, then among the distinct rows of its chunk, weighted by how often they
    occur. Only rows of the chosen chunks are read a second time, and equal rows
    collapse before they are ordered.
    """
    columns = rows.columns
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64(*columns), F.lit(CHUNKS)).cast("int"))
    counts = chunked.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"), F.lit(None).cast(
        "bigint").alias("draw"))
    spark = rows.sparkSession
    draws = spark.range(size).select(F.lit(None).cast("int").alias("chunk"),
                                     index_draw(F.lit(n_rows), F.col("id"), F.lit("sample")).alias("at"),
                                     F.col("id").alias("draw"))
    # At most 2^20 chunk sizes and the draws: a bounded single window.
    so_far = Window.orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = starts.unionByName(draws).select(
        "draw", F.last("chunk", True).over(so_far).alias("chunk"),
        (F.col("at") - F.last(F.when(F.col("draw").isNull(), F.col("at")), True).over(so_far)).alias("at"))
    placed = placed.where("draw is not null")

    # The chosen chunks are at most ``size`` rows.
    chosen = F.broadcast(placed.select("chunk").distinct())
    members = chunked.join(chosen, "chunk").groupBy("chunk", *columns).agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("chunk").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    members = members.select("chunk", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("at"),
                             F.lit(None).cast("bigint").alias("draw"), F.struct(*columns).alias("row"))
    asked = placed.select("chunk", "at", "draw", F.lit(None).cast(members.schema["row"].dataType).alias("row"))
    latest = Window.partitionBy("chunk").orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    return (members.unionByName(asked).withColumn("row", F.last("row", True).over(latest))
            .where("draw is not null").select("row.*"))


def sampled_table(ws, data: Encoded, size: int) -> Encoded:
    """Encoded sample with extents, NULL codes and root ranges of its own."""
    rows = sample_rows(data.rows, data.n_rows, size)
    nulled = rows.select(*[c for c in rows.columns if c.startswith("e")], *[
        F.when(F.col(f"v{c.index}") != F.lit(c.null_code), F.col(f"v{c.index}")).alias(f"v{c.index}")
        for c in data.columns])
    nulled = ws.cut(nulled, "sample")
    names = [f"v{c.index}" for c in data.columns]
    facts = {r["column"]: r for r in root_ranges(column_extents(nulled, names)).collect()}
    columns = tuple(replace(c, null_code=facts[c.index]["null_code"], lo=facts[c.index]["root_lo"],
                            size=facts[c.index]["root_size"]) for c in data.columns)
    filled = nulled.select(*[c for c in rows.columns if c.startswith("e")], *[
        F.coalesce(f"v{c.index}", F.lit(c.null_code)).alias(f"v{c.index}") for c in columns])
    return replace(data, rows=filled, columns=columns, n_rows=size)


def sampling_config(config: SynthConfig) -> SynthConfig:
    """Softer suppression and no count noise: results only steer the clustering."""
    return replace(config, low_threshold=2, low_mean_gap=1.0, low_layer_sd=0.5, noise_sd=0.0)
