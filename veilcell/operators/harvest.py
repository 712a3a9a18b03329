"""Buckets from cell trees: suppressed leaves, rescaled counts, refined multi-column leaves.

Counts are rescaled to their parent's noisy count at every branch. A bucket keeps
its interval of running counts inside its own node, and a fold over its ancestors
maps that interval to any level, so no task ever walks all buckets of a tree.
The mapped interval at the root also gives every synthetic row its position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import child_code, rescale_prefix
from ..functions.hashing import index_draw
from .cells import BATCH_BITS, Forest, Trees, cell_names
from .ranking import running_total

UNIT_CHUNK = 100_000  # rows one input row may be expanded to in a task
POOL_CHUNKS = 1024
BIN_DRAWS = 65_536  # draws per weight bin, roughly

SLAB_BATCH = 200_000  # nodes per call of the totals function
FRONT_RUNS = 32  # runs of equal counts that travel up with a node; what they leave open, all buckets are asked
ALL_EXACT = 2**63 - 1


def least_names(k: int) -> list[str]:
    return [f"mn{d}" for d in range(1, k + 1)]


def node_name(k: int) -> Column:
    return F.concat_ws(":", "combo", "level", *cell_names(k)).alias("node")


def expand_counts(df: DataFrame, keys: Sequence[str], first: str, end: str, name: str) -> DataFrame:
    """One row per integer in [first, end), spread so that a huge count is no single task's work.

    The number of partitions is given, because the rows before the expansion are so
    few that partitions of some size would put all of them into one task.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last_chunk = f"({end} - 1 - {first}) div {UNIT_CHUNK}"
    chunks = (df.where(f"{end} > {first}")
              .select("*", F.expr(f"explode(sequence(0L, {last_chunk}))").alias("__chunk"))
              .repartition(tasks, *keys, "__chunk"))
    lo = f"{first} + __chunk * {UNIT_CHUNK}"
    return chunks.select("*", F.expr(f"explode(sequence({lo}, least({lo} + {UNIT_CHUNK}, {end}) - 1))")
                         .alias(name)).drop("__chunk")


# -- node totals ----------------------------------------------------------------

Runs = list[tuple[int, int]]  # (count, times) of buckets in order, from the front
Front = tuple[Runs, bool]  # the first runs of a node's buckets, and whether more follow

NOTHING: Front = ([], False)


def joined_fronts(parts: Sequence[Front], limit: int) -> Front:
    out: Runs = []
    for runs, more in parts:
        for count, times in runs:
            if out and out[-1][0] == count:
                out[-1] = (count, out[-1][1] + times)
            elif len(out) == limit:
                return out, True
            else:
                out.append((count, times))
        if more:
            return out, True
    return out, False


def scaled_front(front: Front, total: int, target: int, limit: int, lead: int | None = None) -> tuple[int | None, Front]:
    """How much of ``total`` in front scales to ``target`` exactly, and the scaled front; None where the front does not tell.

    A count scales exactly if it is a multiple of total / gcd(total, target).
    Behind the first one that does not, a count becomes the difference of the
    carried running totals. ``lead`` is the answer for a front that does not tell.
    """
    runs, more = front
    unit = total // math.gcd(total, target)
    bad = len(runs) if unit == 1 else next((i for i, (count, _) in enumerate(runs) if count % unit), len(runs))
    exact = [(count * target // total, times) for count, times in runs[:bad]]
    if bad == len(runs):
        return (total if unit == 1 or not more else lead), (exact, more)
    found = before = sum(count * times for count, times in runs[:bad])
    below, carried = found * target // total, []
    for count, times in runs[bad:]:
        for _ in range(times):
            if len(carried) > limit:
                return found, joined_fronts([(exact, False), (carried, True)], limit)
            before += count
            now = max(-(-before * target // total) - 1, 0)
            if now > below:
                carried.append((now - below, 1))
            below = now
    return found, joined_fronts([(exact, False), (carried, more)], limit)


def slab_totals(k: int, base: int, levels: int, limit: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Function giving harvested totals inside slabs of trees, deepest level first.

    A slab is a few levels below one node; a call takes a batch of whole slabs.
    The front of each node's bucket list travels up with its total, because it
    decides how far the counts scale exactly; ``open`` is 1 for nodes it leaves
    undecided, 2 for those above them. Leaves of several columns that are no points
    count as refined to single rows.
    """
    cells = [f"c{d}" for d in range(1, k + 1)]
    tops = [f"t{d}" for d in range(1, k + 1)]

    def totals(batch: pd.DataFrame) -> pd.DataFrame:
        tag = batch.groupby(["combo", *tops], sort=False).ngroup().to_numpy().astype(np.int64)
        batch = batch.assign(slab=tag << 32).sort_values(["level", "slab", "path"], ignore_index=True)
        level, slab = batch["level"].to_numpy() - base, batch["slab"].to_numpy()
        path, noisy, live = batch["path"].to_numpy(), batch["noisy"].to_numpy(), batch["live"].to_numpy()
        split, whole = batch["split"].to_numpy(), batch["whole"].to_numpy()
        total = np.where(split, batch["known_total"].to_numpy(), np.where(live, noisy, 0))
        inner = np.where(split, batch["known_inner"].to_numpy(), 0)
        lead = np.where(split, batch["known_lead"].to_numpy(), 0)
        before = np.zeros(len(batch), dtype=np.int64)
        open_ = np.zeros(len(batch), dtype=np.int64)
        told = [None if pd.isna(x) else int(x) for x in batch["told"]]
        bucket = [[(int(n), 1)] if one else [(1, int(n))] for n, one in zip(noisy, whole)]
        fronts = [(list(zip(c, t)), bool(m)) if inside and c is not None else (own, False) if alive and not inside else NOTHING
                  for c, t, m, own, alive, inside in zip(batch["known_counts"], batch["known_times"], batch["known_more"], bucket, live, split)]
        bounds = np.searchsorted(level, np.arange(levels + 2))
        for depth in range(levels - 1, -1, -1):
            mine, below = slice(bounds[depth], bounds[depth + 1]), slice(bounds[depth + 1], bounds[depth + 2])
            owner = np.searchsorted(slab[mine] + path[mine], slab[below] + (path[below] >> k))
            sums = np.zeros(bounds[depth + 1] - bounds[depth], dtype=np.int64)
            np.add.at(sums, owner, total[below])
            running = np.cumsum(total[below]) - total[below]
            before[below] = running - running[np.searchsorted(owner, owner)] if len(running) else running
            edges = np.searchsorted(owner, np.arange(len(sums) + 1))
            for i in np.flatnonzero(split[mine]):
                at, target = bounds[depth] + i, int(noisy[bounds[depth] + i])
                under = slice(bounds[depth + 1] + edges[i], bounds[depth + 1] + edges[i + 1])
                if open_[under].any():
                    open_[at] = 2
                    continue
                children = fronts[under]
                if 2 * sums[i] < target:
                    total[at], lead[at] = target, ALL_EXACT
                    rest = target - int(sums[i])
                    fronts[at] = ([(target, 1)], False) if k == 1 else joined_fronts(
                        [*children, ([(rest, 1)] if whole[at] else [(1, rest)], False)], limit)
                    continue
                found, fronts[at] = scaled_front(joined_fronts(children, limit), int(sums[i]), target, limit, told[at])
                if found is None:
                    open_[at] = 1
                else:
                    lead[at], total[at] = found, target if found == sums[i] else target - 1
            inner[mine] = np.where(split[mine], sums, inner[mine])
        top = level == 0  # only these are asked for by the slab above
        return pd.DataFrame({
            "combo": batch["combo"], "level": batch["level"], **{c: batch[c] for c in cells}, "total": total, "inner": inner,
            "before": before, "lead": lead, "open": open_, "counts": [[c for c, _ in f[0]] if t else None for f, t in zip(fronts, top)],
            "times": [[n for _, n in f[0]] if t else None for f, t in zip(fronts, top)], "more": [f[1] for f in fronts]})

    return totals


def harvested_totals(forest: Forest, trees: Trees) -> DataFrame:
    """Adds to every node: total (rows it yields), inner (rows its children yield), before (offset in its parent),
    lead (part of inner that scales exactly)."""
    k, low, cells = trees.k, forest.config.low_threshold, cell_names(trees.k)
    step = BATCH_BITS if k == 1 else max(1, BATCH_BITS // k - 1)
    keys = ["combo", "level", *cells]
    nodes = trees.nodes.withColumn("live", F.col("strength") >= low)
    point = " and ".join(f"mn{d} = mx{d}" for d in range(1, k + 1))
    bases = list(range(0, max(trees.depth, 1), step))
    known, parts = None, []
    for base in reversed(bases):
        levels = min(step, max(trees.depth - base, 1))
        members = nodes.where((F.col("level") > base) & (F.col("level") <= base + levels)
                              | (F.col("level") == base) & (F.col("split") | F.lit(base == 0)))
        dims = range(1, k + 1)
        members = forest.with_cells(members, k, trees.combos, F.lit(base), "t")
        members = forest.with_places(members, k, trees.combos, base, F.col("level"))
        tops = [f"t{d}" for d in dims]
        wide = child_code([F.call_function("shiftleft", F.col(f"p{d}"), F.lit(base + step) - F.col("level")) for d in dims], step)
        path = F.call_function("shiftright", wide, (F.lit(base + step) - F.col("level")) * k)
        slab = members.select(*keys, "noisy", "split", "live", F.expr("true" if k == 1 else point).alias("whole"), *tops, path.alias("path"))
        if known is None:
            slab = slab.selectExpr("*", "0L as known_total", "0L as known_inner", "0L as known_lead", "cast(null as array<bigint>) as known_counts",
                                   "cast(null as array<bigint>) as known_times", "false as known_more")
        else:
            slab = slab.join(known, keys, "left").fillna(0, ["known_total", "known_inner", "known_lead"]).fillna(False, ["known_more"])
        schema = ", ".join(["combo int", "level int", *[f"{c} bigint" for c in cells], "total bigint", "inner bigint", "before bigint",
                            "lead bigint", "open bigint", "counts array<bigint>", "times array<bigint>", "more boolean"])

        # A slab has fewer than 2^(BATCH_BITS + 1) nodes; small slabs share a call.
        spread = max(1, members.count() // SLAB_BATCH + 1) if base else len(trees.combos)
        slab = slab.withColumn("batch", F.pmod(F.xxhash64("combo", *[f"t{d}" for d in range(1, k + 1)]), F.lit(spread)))
        told = None
        while True:
            asked = slab.withColumn("told", F.lit(None).cast("bigint")) if told is None else slab.join(told, keys, "left")
            result = forest.ws.cut(asked.groupBy("batch").applyInPandas(slab_totals(k, base, levels, FRONT_RUNS), schema), f"totals{k}")
            undecided = result.where("open = 1")
            if undecided.isEmpty():
                break
            # The lowest undecided nodes learn from all their buckets; then those above them can be told.
            settled = reduce(DataFrame.unionByName, [*parts, result.where("open = 0")])
            more = forest.ws.cut(exact_leads(forest, trees, nodes.join(settled.drop("counts", "times", "more", "open"), keys), undecided), f"leads{k}")
            told = more if told is None else told.unionByName(more)
        # The lowest branches of the slab above learn here what their children yield.
        known = result.where(F.col("level") == base).select(
            *keys, *[F.col(c).alias(f"known_{c}") for c in ("total", "inner", "lead", "counts", "times", "more")])
        parts.append(result.where(F.col("level") > base) if base else result)
    totals = reduce(DataFrame.unionByName, parts)
    return nodes.join(totals.drop("counts", "times", "more", "open"), keys)


def exact_leads(forest: Forest, trees: Trees, nodes: DataFrame, undecided: DataFrame) -> DataFrame:
    """(combo, level, cells, told): where the first bucket of each undecided node begins that does not scale exactly.

    ``nodes`` are settled below the undecided ones. Every bucket is mapped to the
    level below its undecided ancestor and tested there; the answer is a minimum,
    so no task sees all buckets of a node.
    """
    k, cells = trees.k, cell_names(trees.k)
    keys = ["combo", "level", *cells]
    levels = [r["level"] for r in undecided.select("level").distinct().collect()]  # at most those of a batch
    asked = undecided.select("combo", F.col("level").alias("at_level"), *[F.col(c).alias(f"at_{c}") for c in cells], "inner").join(
        nodes_targets(trees).withColumnsRenamed({c: f"at_{c}" for c in ("level", *cells)}), ["combo", "at_level", *[f"at_{c}" for c in cells]])
    bearers = bucket_bearers(with_chains(forest, trees, nodes, nodes), k)
    under = bearers.withColumn("at_level", F.explode(F.array(*[F.lit(x) for x in levels]))).where("level > at_level")
    under = forest.with_cells(under, k, trees.combos, F.col("at_level"), "at_c")
    under = under.join(asked.withColumnRenamed("inner", "at_inner"), ["combo", "at_level", *[f"at_{c}" for c in cells]])
    if k > 1:
        point = " and ".join(f"mn{d} = mx{d}" for d in range(1, k + 1))
        units = expand_counts(under.where(f"not ({point})"), keys, "first", "end", "at").withColumn("first", F.col("at"))
        units = units.withColumn("end", F.col("at") + 1).drop("at")
        under = under.where(point).unionByName(units)
    steps = F.col("level") - F.col("at_level") - 1
    inside = F.when(steps == 0, F.col("before")).otherwise(F.get("chain", steps - 1)["before"])
    below = F.col("at_level") + 1
    placed = under.withColumn("start", interval_at(F.col("first"), below) + inside).withColumn(
        "count", interval_at(F.col("end"), below) + inside - F.col("start"))
    bad = F.expr("(cast(count as decimal(19,0)) * target) % at_inner <> 0")
    told = placed.groupBy("combo", "at_level", *[f"at_{c}" for c in cells]).agg(
        F.coalesce(F.min(F.when(bad, F.col("start"))), F.max("at_inner")).alias("told"))
    return told.select("combo", F.col("at_level").alias("level"), *[F.col(f"at_{c}").alias(c) for c in cells], "told")


def nodes_targets(trees: Trees) -> DataFrame:
    return trees.nodes.select("combo", "level", *cell_names(trees.k), F.col("noisy").alias("target"))


def bucket_bearers(nodes: DataFrame, k: int) -> DataFrame:
    """Nodes with buckets of their own: leaves that are shown, and branches whose children yield less than half.

    ``first`` and ``end`` are the running counts of these buckets inside the node.
    """
    gap = F.expr("split and 2 * inner < noisy")
    own = nodes.where(F.expr("(not split and live)") | gap)
    first = F.when(gap, F.col("inner")).otherwise(F.lit(0).cast("bigint")) if k > 1 else F.lit(0).cast("bigint")
    return own.withColumn("first", first).withColumn("end", F.col("noisy"))


# -- intervals ------------------------------------------------------------------

def interval_at(prefix: Column, level: Column) -> Column:
    """Running count of a bucket bound mapped from its node to its ancestor at ``level``.

    ``chain`` lists the ancestors from the parent up: scaling target, total
    and lead, and the offset inside the next ancestor.
    """
    steps = F.col("level") - level
    mapped = F.aggregate(F.slice("chain", F.lit(1), steps), prefix + F.col("before"),
                         lambda acc, a: rescale_prefix(acc, a["target"], a["total"], a["lead"]) + a["before"])
    last = F.get("chain", steps - 1)["before"]
    return F.when(steps == 0, prefix).otherwise(mapped - last)


def with_chains(forest: Forest, trees: Trees, bearers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the ancestor chain: one join on (combo, level, cells), at most one row per ancestor level."""
    k, cells = trees.k, cell_names(trees.k)
    keys = ["combo", "level", *cells]
    up = bearers.where("level > 0").select(
        *keys, *least_names(k), F.expr("explode(sequence(0, level - 1))").alias("a_level"))
    up = forest.with_cells(up, k, trees.combos, F.col("a_level"), "a_c").drop(*least_names(k))
    gap = "2 * inner < noisy"
    rule = f"named_struct('target', {0 if k == 1 else 1}L, 'total', 1L, 'lead', lead)"
    maps = nodes.where("split").select(
        F.col("combo"), F.col("level").alias("a_level"), *[F.col(c).alias(f"a_{c}") for c in cells],
        F.expr(f"if({gap}, {rule}, named_struct('target', noisy, 'total', inner, 'lead', lead))").alias("map"),
        F.col("before").alias("a_before"))
    chains = up.join(maps, ["combo", "a_level", *[f"a_{c}" for c in cells]]).groupBy(*keys).agg(
        F.expr("transform(sort_array(collect_list(struct(a_level, map.target as target, map.total as total, "
               "map.lead as lead, a_before as before)), false), x -> struct(x.target as target, x.total as total, x.lead as lead, x.before as before))")
        .alias("chain"))
    none = F.expr("cast(array() as array<struct<target: bigint, total: bigint, lead: bigint, before: bigint>>)")
    return bearers.join(chains, keys, "left").withColumn("chain", F.coalesce("chain", none))


# -- harvest --------------------------------------------------------------------

class Harvest:
    """Bucket tables of all trees of a forest, one per number of columns.

    Buckets: combo, level, c1.., lo1, hi1, .., first, end (running counts inside the node), before, chain.
    """

    def __init__(self, forest: Forest):
        self.forest, self.ws = forest, forest.ws
        self.buckets: dict[int, DataFrame] = {}

    def up_to(self, k: int) -> "Harvest":
        for size in range(1, k + 1):
            if size not in self.buckets:
                self.buckets[size] = self._harvest(self.forest.trees[size])
        return self

    def final(self, combo: Sequence[int]) -> DataFrame:
        """Buckets of one tree with row positions: pos_first, pos_end."""
        combo = tuple(combo)
        k = len(combo)
        mine = self.up_to(k).buckets[k].where(F.col("combo") == self.forest.combo_id(combo))
        root = F.lit(0)
        placed = mine.withColumn("pos_first", interval_at(F.col("first"), root)).withColumn(
            "pos_end", interval_at(F.col("end"), root))
        ranges = [f"{n}{d}" for d in range(1, k + 1) for n in ("lo", "hi")]
        return placed.where("pos_end > pos_first").select(
            "level", *cell_names(k), *ranges, "pos_first", "pos_end", (F.col("pos_end") - F.col("pos_first")).alias("count"))

    def _harvest(self, trees: Trees) -> DataFrame:
        k = trees.k
        nodes = self.ws.cut(harvested_totals(self.forest, trees), f"harvest{k}")
        bearers = bucket_bearers(nodes, k)
        bearers = self.forest.with_ranges(with_chains(self.forest, trees, bearers, nodes), k, trees.combos)
        ranges = [f"{n}{d}" for d in range(1, k + 1) for n in ("lo", "hi")]
        columns = ["combo", "level", *cell_names(k), *least_names(k), *ranges, "first", "end", "before", "chain"]
        if k == 1:
            return self.ws.cut(bearers.select(*columns), "buckets1")
        bearers = self.ws.cut(bearers, f"bearers{k}")
        point = " and ".join(f"lo{d} = hi{d}" for d in range(1, k + 1))
        refined = refine(self, trees, bearers.where(f"not ({point})"))
        return self.ws.cut(bearers.where(point).select(*columns).unionByName(refined.select(*columns)), f"buckets{k}")


# -- refinement -----------------------------------------------------------------

def refine(harvest: Harvest, trees: Trees, nodes: DataFrame) -> DataFrame:
    """Buckets of the given nodes rebuilt from the buckets of their subnodes.

    Every output row takes the ranges of one subnode bucket and, for the one
    dimension that subnode lacks, a range of that dimension; subnodes take turns.
    Picks are weighted by counts. Nodes whose pools come out empty keep their own range.
    """
    forest, ws, k = harvest.forest, harvest.ws, trees.k
    dims = range(1, k + 1)
    nodes = ws.cut(_with_halved_ranges(nodes.select("*", node_name(k)), forest, trees), f"refine{k}")
    pool = ws.cut(_sub_buckets(harvest, trees, nodes), f"subbuckets{k}")

    # Tightest hull per dimension over the slots, then trimmed to the halves that have enough entities.
    hulls = pool.groupBy("node", "slot").agg(*[F.expr(e) for d in dims for e in (
        f"min(lo{d}) as lo{d}", f"max(hi{d}) as hi{d}")])
    tight = hulls.groupBy("node").agg(F.count(F.lit(1)).alias("slots"), *[F.expr(
        f"min_by(struct(lo{d} as lo, hi{d} as hi), if(lo{d} is null, null, struct(hi{d} - lo{d} as size, slot))) as r{d}")
        for d in dims])
    tight = tight.where(F.col("slots") == k).join(
        nodes.select("node", *[f"{n}{d}" for d in dims for n in ("hlo", "hhi")]), "node")
    for d in dims:
        meet = f"hlo{d} < r{d}.hi and hhi{d} > r{d}.lo"
        tight = tight.withColumn(f"r{d}", F.expr(
            f"named_struct('lo', if({meet}, greatest(r{d}.lo, hlo{d}), least(r{d}.lo, hlo{d})), "
            f"'hi', if({meet}, least(r{d}.hi, hhi{d}), greatest(r{d}.hi, hhi{d})))"))
    tight = tight.select("node", *[f"r{d}" for d in dims])
    pool = pool.join(tight, "node")
    for d in dims:
        pool = pool.withColumn(f"in{d}", F.expr(f"lo{d} >= r{d}.lo and hi{d} <= r{d}.hi"))
    pool = ws.cut(pool.drop(*[f"r{d}" for d in dims]), f"pool{k}")

    sub_ranges = [f"{n}{d}" for d in dims for n in ("lo", "hi")]
    inside = " and ".join(f"coalesce(in{d}, true)" for d in dims)
    sub_pool = pool.where(inside).select("node", "slot", *sub_ranges, "weight")
    per_dim = F.inline(F.array(*[F.expr(f"struct({d} as dim, lo{d} as lo, hi{d} as hi, in{d} as fits)") for d in dims]))
    dim_pool = pool.select("node", "weight", per_dim).where("fits").groupBy("node", "dim", "lo", "hi").agg(
        F.sum("weight").alias("weight"))

    spread = F.pmod(F.xxhash64(*sub_ranges), F.lit(POOL_CHUNKS))
    sub_pool = ws.cut(running_total(sub_pool, ["node", "slot"], spread, sub_ranges, "weight", "start"), f"subpool{k}")
    spread = F.pmod(F.xxhash64("lo", "hi"), F.lit(POOL_CHUNKS))
    dim_pool = ws.cut(running_total(dim_pool, ["node", "dim"], spread, ["lo", "hi"], "weight", "start"), f"dimpool{k}")

    # Per node: total weight and number of entries of every pool.
    widths = sub_pool.groupBy("node").agg(*[F.expr(e) for s in range(k) for e in (
        f"sum(if(slot = {s}, weight, 0L)) as ws{s}", f"count_if(slot = {s}) as ns{s}")]).join(
        dim_pool.groupBy("node").agg(*[F.expr(e) for d in dims for e in (
            f"sum(if(dim = {d}, weight, 0L)) as wd{d}", f"count_if(dim = {d}) as nd{d}")]), "node")
    widths = widths.where(" and ".join([f"ws{s} > 0" for s in range(k)] + [f"wd{d} > 0" for d in dims]))
    facts = [f"{n}s{s}" for s in range(k) for n in "wn"] + [f"{n}d{d}" for d in dims for n in "wn"]
    turns = f"(end - first + {k - 1}) div {k}"
    ready = nodes.join(widths, "node").select(
        "node", "combo", "level", *cell_names(k), *least_names(k), "first", "end", "before", "chain", *facts, F.expr(turns).alias("turns"))
    plain = nodes.join(widths.select("node"), "node", "left_anti").select(
        "combo", "level", *cell_names(k), *least_names(k), *sub_ranges, "first", "end", "before", "chain")

    units = expand_counts(ready, ["node"], "first", "end", "at").withColumn("turn", F.expr("at - first"))
    units = units.withColumn("slot", F.expr(f"cast(turn % {k} as int)")).withColumn("dim", F.expr(f"{k} - slot"))
    sizes = {"slot": [F.element_at(F.array(*[F.col(f"{n}s{s}") for s in range(k)]), F.col("slot") + 1) for n in "wn"],
             "dim": [F.element_at(F.array(*[F.col(f"{n}d{d}") for d in dims]), F.col("dim")) for n in "wn"]}
    for name, (weight, entries) in sizes.items():
        units = units.withColumn(f"{name}_draw", index_draw(weight, F.col("node"), F.col("turn"), F.lit(name)))
        units = units.withColumn(f"{name}_bin", F.call_function("div", F.col(f"{name}_draw"), bin_width(weight, entries)))
    units = units.select("node", "combo", "level", *cell_names(k), *least_names(k), F.col("at").alias("first"),
                         (F.col("at") + 1).alias("end"), "before", "chain", "slot", "dim",
                         "slot_draw", "slot_bin", "dim_draw", "dim_bin")

    bins = ready.select("node", "turns", *facts)
    matched = _pick(units, sub_pool, bins, "slot", bin_width(*sizes["slot"]), sub_ranges)
    dim_pool = dim_pool.withColumnsRenamed({"lo": "d_lo", "hi": "d_hi"})
    matched = _pick(matched, dim_pool, bins, "dim", bin_width(*sizes["dim"]), ["d_lo", "d_hi"])
    ranges = [F.expr(f"if(dim = {d}, d_{n}, {n}{d})").alias(f"{n}{d}") for d in dims for n in ("lo", "hi")]
    refined = matched.select("combo", "level", *cell_names(k), *least_names(k), *ranges, "first", "end", "before", "chain")
    return plain.unionByName(refined)


def bin_width(weight: Column, entries: Column) -> Column:
    """Weight units per bin: about one pool entry per bin, and no bin with very many draws.

    A pool gives at most twice as many entry pieces as it has bins, and a draw
    meets two pieces on average, however uneven the weights are.
    """
    bins = F.greatest(entries, F.call_function("div", F.col("turns"), F.lit(BIN_DRAWS)), F.lit(1).cast("bigint"))
    return F.greatest(F.call_function("div", weight, bins), F.lit(1).cast("bigint"))


def _pick(units: DataFrame, pool: DataFrame, bins: DataFrame, name: str, width: Column, values: Sequence[str]) -> DataFrame:
    """Joins each draw to the pool entry whose weight interval holds it.

    Entries are cut into bins of the weight axis, so this is an equi-join on the
    bin, never all entries of a pool with all its draws.
    """
    spans = pool.join(bins, "node").withColumn("__width", width)
    spans = spans.select("node", name, *values, "start", (F.col("start") + F.col("weight")).alias("stop"), F.expr(
        "explode(sequence(start div __width, (start + weight - 1) div __width))").alias(f"{name}_bin"))
    joined = units.join(spans, ["node", name, f"{name}_bin"])
    return joined.where(f"{name}_draw >= start and {name}_draw < stop").drop("start", "stop", f"{name}_bin", f"{name}_draw")


def _with_halved_ranges(nodes: DataFrame, forest: Forest, trees: Trees) -> DataFrame:
    """Cell ranges, without the low-count half for stub leaves."""
    k = trees.k
    out = nodes
    for d in range(1, k + 1):
        start, end = forest.bounds(k, trees.combos, d)
        middle = (start + end) / 2
        half = F.when(F.expr("not split and stub"), F.col(f"half{d}")).otherwise(-1)
        out = (out.withColumn(f"hlo{d}", F.when(half == 1, middle).otherwise(start))
               .withColumn(f"hhi{d}", F.when(half == 0, middle).otherwise(end)))
    return out


def _sub_buckets(harvest: Harvest, trees: Trees, nodes: DataFrame) -> DataFrame:
    """Weighted ranges offered to each node by its subnodes: node, slot, lo1, hi1, .. (NULL where absent), weight."""
    forest, k = harvest.forest, trees.k
    lower = harvest.up_to(k - 1).buckets[k - 1]
    dims, subs = range(1, k + 1), range(1, k)
    base = nodes.select("node", "combo", "level", *cell_names(k), "noisy",
                        *[f"{n}{d}" for d in dims for n in ("lo", "hi", "mn", "mx")])
    slots = forest.subnode_keys(k, trees.combos, base).withColumn("omit", F.expr(f"{k} - slot"))
    own = " and ".join(f"(omit = {d} or mn{d} = mx{d})" for d in dims)
    points = slots.where(own).select("node", "slot", *[F.expr(f"if(omit = {d}, null, mn{d})").alias(f"{n}{d}")
                                                       for d in dims for n in ("lo", "hi")],
                                     F.col("noisy").alias("weight"))
    asked = slots.where(f"not ({own})").select("node", "slot", "omit", "sub_combo", "level", *[f"s{d}" for d in subs])
    asked_keys = ["sub_combo", "level", *[f"s{d}" for d in subs]]
    wanted = asked.select(*asked_keys).distinct()
    offers = lower.select("combo", F.col("level").alias("own_level"), *least_names(k - 1),
                          *[F.col(f"{n}{d}").alias(f"b{n}{d}") for d in subs for n in ("lo", "hi")],
                          "first", "end", "before", "chain",
                          F.expr("explode(sequence(0, level))").alias("target"))
    below = forest.trees[k - 1].combos
    offers = forest.with_cells(offers, k - 1, below, F.col("target"), "s").drop(*least_names(k - 1))
    offers = offers.withColumnsRenamed({"target": "at_level", "combo": "sub_combo"}).join(
        wanted.withColumnRenamed("level", "at_level"), ["sub_combo", "at_level", *[f"s{d}" for d in subs]], "left_semi")
    offers = offers.withColumnRenamed("own_level", "level")
    weight = interval_at(F.col("end"), F.col("at_level")) - interval_at(F.col("first"), F.col("at_level"))
    b_ranges = [f"b{n}{d}" for d in subs for n in ("lo", "hi")]
    offers = (offers.withColumn("weight", weight).where("weight > 0")
              .select("sub_combo", F.col("at_level").alias("level"), *[f"s{d}" for d in subs], *b_ranges, "weight")
              .groupBy(*asked_keys, *b_ranges).agg(F.sum("weight").alias("weight")))
    joined = asked.join(offers, asked_keys)
    # Dimension d of the node is dimension d (before the omitted one) or d - 1 (after it) of the subnode.
    def placed(d: int, n: str) -> Column:
        early = f"b{n}{d}" if d <= k - 1 else "null"
        late = f"b{n}{d - 1}" if d > 1 else "null"
        return F.expr(f"case when omit = {d} then null when {d} < omit then {early} else {late} end").alias(f"{n}{d}")

    joined = joined.select("node", "slot", *[placed(d, n) for d in dims for n in ("lo", "hi")], "weight")
    return points.unionByName(joined)
