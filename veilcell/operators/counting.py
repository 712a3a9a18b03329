"""Private counting: entities per group, suppression, and noisy flattened row counts.

Groups are any grouping columns. Every aggregate is algebraic, so a group holding
a third of the table is still reduced inside the map tasks first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SynthConfig
from ..functions.geometry import noise_scale_for_report, round_away
from ..functions.hashing import NORMAL_LIMIT, entity_hash, layered_noise, mix, normal, salted, uniform_int


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on grouping columns that also matches NULL groups."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, match, how).drop(*[f"__r_{k}" for k in keys])


def unique_entity_counts(df: DataFrame, keys: Sequence[str], entity: Column) -> DataFrame:
    """Entity count and set seed when every row is its own entity."""
    hashed = df.withColumn("__entity", entity_hash(entity))
    present = F.col("__entity") != 0
    return hashed.groupBy(*keys).agg(
        F.count_if(present).alias("entities"),
        F.coalesce(F.bit_xor(F.when(present, F.col("__entity"))), F.lit(0)).alias("seed"))


def entity_contributions(df: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Rows per (group, id kind, entity); entity 0 collects the rows without one.

    Ids are counted first and hashed afterwards: one hash per entity and group, not per row.
    """
    raw = [F.struct(F.lit(i).alias("kind"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("id"))
           for i, c in enumerate(ids)]
    counted = df.select(*keys, F.inline(F.array(*raw))).groupBy(*keys, "kind", "id").agg(
        F.count(F.lit(1)).alias("contribution"))
    return counted.select(*keys, "kind", entity_hash(F.col("id")).alias("entity"), "contribution")


def entity_totals(contributions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct entities, set seed, accounted and unaccounted rows per (group, id kind)."""
    real = F.col("entity") != 0
    zero = F.lit(0).cast("bigint")
    return contributions.groupBy(*keys, "kind").agg(
        F.count_if(real).alias("entities"),
        F.coalesce(F.bit_xor(F.when(real, F.col("entity"))), zero).alias("seed"),
        F.coalesce(F.sum(F.when(real, F.col("contribution"))), zero).alias("accounted"),
        F.coalesce(F.sum(F.when(~real, F.col("contribution"))), zero).alias("unaccounted"))


def suppression_margin(seed: Column, config: SynthConfig) -> Column:
    """What a count must have beyond a threshold: the mean gap plus sticky noise, never below 0."""
    if config.low_layer_sd == 0:
        return F.lit(0.0)
    return margin_of(margin_seed(seed, config), config)


def margin_seed(seed: Column, config: SynthConfig) -> Column:
    return mix(salted(seed, config.salt or ""), "suppress")


def margin_of(mixed: Column, config: SynthConfig) -> Column:
    """The margin from its hashed seed, which is read twice and so best a column of its own."""
    return F.greatest(F.lit(0.0), config.low_layer_sd * (config.low_mean_gap + normal(mixed)))


def largest_margin(config: SynthConfig) -> float:
    """No margin is above this, whatever its seed."""
    return config.low_layer_sd * (config.low_mean_gap + NORMAL_LIMIT)


def strength(entities: Column, seed: Column, config: SynthConfig) -> Column:
    """Entity count less its margin; a group passes threshold t when strength >= t."""
    return entities - suppression_margin(seed, config)


def is_low_count(entities: Column, seed: Column, config: SynthConfig, threshold: int | None = None) -> Column:
    return strength(entities, seed, config) < (config.low_threshold if threshold is None else threshold)


def noisy_unique_count(entities: Column, seed: Column, bucket_seed: Column, config: SynthConfig) -> Column:
    if config.noise_sd == 0:
        return entities.cast("bigint")
    noise = layered_noise([bucket_seed, seed], "noise", config.noise_sd, config.salt or "")
    return round_away(entities + noise).cast("bigint")


def shrunk_intervals(entities: Column, config: SynthConfig) -> tuple[Column, Column]:
    """Upper bounds of the outlier and top intervals after fitting them to the entity count.

    Both are NULL when there are too few entities to flatten at all.
    """
    out, top = config.outliers, config.top
    out_room, top_room = out.upper - out.lower, top.upper - top.lower
    excess = F.greatest(F.lit(out.upper + top.upper) - entities, F.lit(0))
    # Half of the excess each, as far as either interval has room.
    out_cut = F.greatest(F.least(F.floor(excess / 2), F.lit(out_room)), excess - top_room)
    enough = entities >= out.lower + top.lower
    return F.when(enough, out.upper - out_cut), F.when(enough, top.upper - excess + out_cut)


def heaviest(contributions: DataFrame, keys: Sequence[str], config: SynthConfig) -> DataFrame:
    """The largest contributions per (group, id kind), enough for any flattening.

    The bounded row number lets Spark keep only that many rows per group in each
    map task, so a group with very many entities sends little over the network.
    """
    needed = max(config.outliers.upper + config.top.upper, 1)
    # Rows without an entity rank last and go afterwards: a filter up front would hash every input row.
    order = Window.partitionBy(*keys, "kind").orderBy(
        F.col("entity") == 0, F.col("contribution").desc(), F.col("entity").desc())
    ranked = (contributions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= needed)
              .where("entity <> 0"))
    entry = F.struct("rank", "contribution", "entity")
    return ranked.groupBy(*keys, "kind").agg(F.sort_array(F.collect_list(entry)).alias("heavy"))


def flattened(totals: DataFrame, bucket_seed: Column, config: SynthConfig) -> DataFrame:
    """Adds flattening, flattened_sum, noise_sd and noise to entity totals with their heavy list.

    All four are NULL where an id kind has too few entities.
    """
    salt = config.salt or ""
    entities = F.col("entities")
    zero, fzero = F.lit(0).cast("bigint"), F.lit(0.0)
    out_upper, top_upper = shrunk_intervals(entities, config)
    df = totals.withColumn("__out", out_upper.cast("int")).withColumn("__top", top_upper.cast("int"))
    group = F.slice("heavy", F.lit(1), F.coalesce(F.col("__out") + F.col("__top"), F.lit(0)))
    df = df.withColumn("__seed", salted(F.aggregate(group, zero, lambda a, e: a.bitwiseXOR(e["entity"])), salt))
    n_out = uniform_int(mix(F.col("__seed"), "outlier"), F.lit(config.outliers.lower), F.col("__out"))
    n_top = uniform_int(mix(F.col("__seed"), "top"), F.lit(config.top.lower), F.col("__top"))
    df = df.withColumn("__n_out", n_out.cast("int")).withColumn("__n_top", n_top.cast("int"))
    enough = F.col("__out").isNotNull()
    top_group = F.slice("heavy", F.coalesce(F.col("__n_out"), F.lit(0)) + 1, F.coalesce(F.col("__n_top"), F.lit(0)))
    top_mean = F.aggregate(top_group, fzero, lambda a, e: a + e["contribution"]) / F.nullif(F.col("__n_top"), F.lit(0))
    df = df.withColumn("__mean", F.when(enough, F.coalesce(top_mean, fzero)))
    out_group = F.slice("heavy", F.lit(1), F.coalesce(F.col("__n_out"), F.lit(0)))
    mean = F.col("__mean")
    df = df.withColumn("flattening", F.when(enough, F.aggregate(
        F.transform(out_group, lambda e: F.greatest(e["contribution"] - mean, F.lit(0.0))), fzero, lambda a, x: a + x)))
    flat_sum = F.col("accounted") - F.col("flattening")
    df = df.withColumn("flattened_sum", flat_sum + F.greatest(F.col("unaccounted") - F.col("flattening"), fzero))
    df = df.withColumn("noise_sd", config.noise_sd * F.greatest(flat_sum / F.nullif(entities, F.lit(0)), 0.5 * mean))
    if config.noise_sd == 0:
        noise = F.when(enough, 0.0)
    else:
        noise = layered_noise([bucket_seed, F.col("seed")], "noise", F.col("noise_sd"), salt)
    df = df.withColumn("noise", noise)
    return df.drop("__out", "__top", "__seed", "__n_out", "__n_top", "__mean")


def combined_count(per_kind: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One noisy count per group from its id kinds: the strongest flattening and the widest noise.

    Too few entities in any kind give 0.
    """
    value = F.max_by("flattened_sum", F.struct("flattening", "flattened_sum"))
    noise = F.max_by("noise", F.struct("noise_sd", F.abs("noise")))
    failed = F.bool_or(F.col("flattening").isNull())
    count = F.when(failed, F.lit(0).cast("bigint")).otherwise(round_away(value + noise).cast("bigint"))
    report = F.when(~failed, noise_scale_for_report(F.max("noise_sd")))
    return per_kind.groupBy(*keys).agg(count.alias("noisy_count"), report.alias("noise_scale"))


def flattened_counts(df: DataFrame, keys: Sequence[str], ids: Sequence[str], config: SynthConfig,
                     bucket_seed: Column) -> DataFrame:
    """Flattened noisy row count and suppression strength per group of a table with entity ids.

    ``bucket_seed`` is an expression over the grouping columns.
    """
    contributions = entity_contributions(df, keys, ids)
    heavy = heaviest(contributions, keys, config)
    totals = join_groups(entity_totals(contributions, keys), heavy, [*keys, "kind"], "left")
    totals = totals.withColumn("strength", strength(F.col("entities"), F.col("seed"), config))
    per_kind = flattened(totals, bucket_seed, config)
    weakest = per_kind.groupBy(*keys).agg(F.min("strength").alias("strength"))
    return join_groups(combined_count(per_kind, keys), weakest, keys)


def private_group_counts(df: DataFrame, keys: Sequence[str], ids: Sequence[str], config: SynthConfig,
                         bucket_seed: Column) -> DataFrame:
    """Anonymized GROUP BY: low-count groups are dropped, the others get a floored noisy count."""
    counts = flattened_counts(df, keys, ids, config, bucket_seed).where(F.col("strength") >= config.low_threshold)
    floor = F.greatest(F.col("noisy_count"), F.lit(config.low_threshold).cast("bigint"))
    return counts.select(*keys, floor.alias("noisy_count"))
