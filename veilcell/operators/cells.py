"""Cell trees as node tables.

A node is a row keyed by (combo, level, c1..ck): the column subset, the depth, and
one cell number per dimension. Statistics of a cell do not depend on its
ancestors, so the trees of all subsets of one size are built together in batches
of levels: rows are aggregated once at the finest level of the batch, their levels
are counted where they lie (``rollup``; by entity where ids repeat), and a window
then keeps the cells whose ancestors all split.

A node that still splits at the end of a batch is the root of the next one: cells
inside a batch are counted from their own root, so depth has no limit. Where no
node of the front splits its values for many levels, those levels are written from
the front itself and the next batch begins below them. Only the rows of the front
are read again, one row for each subset in which it still has a splitting node. Those
below a root of few rows meet in one task as they are, which counts all levels that
nodes of their subset can reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SynthConfig
from ..functions.geometry import (EXACT_CELLS, cell_bounds, cell_number, cell_width, cells_from_zero, child_code, column_combinations,
                                  exact_label, parent_cell, shared_levels, value_cell)
from ..functions.hashing import combine_texts, noisy_row_limit, text_seed
from ..workspace import Workspace
from . import rollup
from .counting import combined_count, flattened, heaviest, largest_margin, margin_of, margin_seed, noisy_unique_count, suppression_margin
from .encoding import Encoded

BATCH_BITS = 16  # cells per node and batch stay below 2^16
SMALL_BITS = 62  # the same below a node of few rows: places in depth-first order fit a bigint
SMALL_ROWS = 1 << 18  # rows of a node that are few enough for one task
FRONT_ROWS = 500_000  # nodes of a front that are sent to all tasks
SET_PRIME = 8_388_593  # largest prime below 2^23: sums of entities fit a bigint up to 2^40 rows
LABEL_LEVELS = 40  # deeper midpoints are no multiples of 2^-40 roots


@dataclass(frozen=True)
class Root:
    """Root range of a column's tree and the span of the values inside it."""

    lo: float
    size: float
    amin: float | None = None
    amax: float | None = None
    level: int = 0
    cell: int = 0

    @property
    def last(self) -> float:
        """The largest number below the upper end, which belongs to the next range."""
        return math.nextafter(self.lo + self.size, -math.inf)


@dataclass(frozen=True)
class Trees:
    """Node table of all trees over k columns."""

    k: int
    combos: tuple[tuple[int, ...], ...]
    nodes: DataFrame
    depth: int


def zero() -> Column:
    return F.lit(0).cast("bigint")


def by_combo(values: Sequence) -> Column:
    """The value of each row's subset: literals, or columns that depend on no row."""
    columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.get(F.array(*columns), F.col("combo")) if len(columns) > 1 else columns[0]


def conj(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def key_hash(names: Iterable[str]) -> Column:
    """A number that tells keys apart: sorting and joining by it first compares little else."""
    return F.xxhash64(*[F.col(n).cast("bigint") for n in names])


def cell_names(k: int) -> list[str]:
    return [f"c{d}" for d in range(1, k + 1)]


def batch_levels(k: int, unique: bool) -> int:
    """Levels per batch: bounded cells per node; fewer with entity ids, whose rows repeat per level."""
    levels = BATCH_BITS if k == 1 else max(1, BATCH_BITS // k - 1)
    return levels if unique else min(levels, 6)


def combo_seed(config: SynthConfig, names: Sequence[str]) -> int:
    """Seed of a tree: the table name and its distinct column names."""
    return reduce(lambda a, n: a ^ text_seed(n), dict.fromkeys(names), text_seed(config.table_name))


class Forest:
    """Builds node tables over one encoded table, lower dimensions first."""

    def __init__(self, ws: Workspace, data: Encoded, config: SynthConfig):
        self.ws, self.data, self.config = ws, data, config
        self.roots = [Root(c.lo, c.size) for c in data.columns]
        self.trees: dict[int, Trees] = {}
        self.entity_rows: dict[int, list[DataFrame]] = {}  # rows per (cell, entity) of each batch, every pair once
        self.outlying: DataFrame | None = None  # rows per (cell, entity) that one-column nodes count besides
        self.trees[1] = self._flatten_roots(self._grow(1, [(c.index,) for c in data.columns]))

    # -- public -------------------------------------------------------------

    def dimension(self, k: int, combos: Sequence[tuple[int, ...]]) -> Trees:
        """Node tables for these k-column subsets; subsets of them must be present already."""
        wanted = tuple(sorted(set(combos)))
        built = self.trees.get(k)
        if built is None or not set(wanted) <= set(built.combos):
            self.trees[k] = self._grow(k, wanted)
        elif wanted != built.combos:  # keep the subsets asked for, without growing them again
            ids = [built.combos.index(c) for c in wanted]
            renumber = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("combo")).cast("int") - 1
            nodes = built.nodes.where(F.col("combo").isin(ids)).withColumn("combo", renumber)
            self.trees[k] = replace(built, combos=wanted, nodes=nodes)
        return self.trees[k]

    def grow_for(self, column_sets: Iterable[Sequence[int]]) -> None:
        """Builds every tree needed to harvest these column sets."""
        sets = [tuple(sorted(s)) for s in column_sets]
        for k in range(2, max(len(s) for s in sets) + 1):
            self.dimension(k, [c for s in sets for c in column_combinations(s, k)])

    def combo_id(self, combo: Sequence[int]) -> int:
        return self.trees[len(combo)].combos.index(tuple(combo))

    # -- node keys and ranges -------------------------------------------------

    def with_ranges(self, nodes: DataFrame, k: int, combos: Sequence[tuple[int, ...]]) -> DataFrame:
        """Adds bucket ranges lo1, hi1, ..: the value itself where a dimension has one value, else the cell."""
        for d in range(1, k + 1):
            start, end = self.bounds(k, combos, d)
            single = F.col(f"mn{d}") == F.col(f"mx{d}")
            nodes = (nodes.withColumn(f"lo{d}", F.when(single, F.col(f"mn{d}")).otherwise(start))
                     .withColumn(f"hi{d}", F.when(single, F.col(f"mx{d}")).otherwise(end)))
        return nodes

    def bounds(self, k: int, combos: Sequence[tuple[int, ...]], d: int) -> tuple[Column, Column]:
        """Ends of a node's cell in dimension ``d``; a cell numbered by its only value has that value's ends."""
        lo, size = self.roots_of(k, combos, d, "lo"), self.roots_of(k, combos, d, "size")
        start, end = cell_bounds(F.col(f"c{d}"), F.col("level"), lo, size)
        exact = F.abs(F.col(f"c{d}")) <= int(EXACT_CELLS)
        return F.when(exact, start).otherwise(F.col(f"mn{d}")), F.when(exact, end).otherwise(F.col(f"mx{d}"))

    def roots_of(self, k: int, combos: Sequence[tuple[int, ...]], d: int, field: str) -> Column:
        """A number of the root of dimension ``d``, which depends on the subset."""
        return by_combo([getattr(self.roots[combo[d - 1]], field) for combo in combos])

    def inside(self, k: int, combos: Sequence[tuple[int, ...]], d: int, value: str) -> Column:
        """A value of dimension ``d``, moved to the nearest end where it lies outside the root."""
        return F.greatest(self.roots_of(k, combos, d, "lo"), F.least(self.roots_of(k, combos, d, "last"), F.col(value)))

    def _ranges(self, combos: Sequence[tuple[int, ...]]) -> rollup.Ranges:
        return rollup.Ranges(*[np.array([[getattr(self.roots[c], field) for c in combo] for combo in combos], float) for field in ("lo", "last", "size")])

    def with_cells(self, df: DataFrame, k: int, combos: Sequence[tuple[int, ...]], level: Column, out: str = "c", value: str = "mn") -> DataFrame:
        """Adds the cells out1.. at any level that hold the values value1.. of each row; a node is told by its least values."""
        dims = range(1, k + 1)
        df = df.withColumns({f"__v{d}": self.inside(k, combos, d, f"{value}{d}") for d in dims})
        df = df.withColumns({f"__q{d}": cells_from_zero(F.col(f"__v{d}"), self.roots_of(k, combos, d, "size"), level) for d in dims})
        df = df.withColumns({f"{out}{d}": cell_number(F.col(f"__v{d}"), F.col(f"__q{d}"), level) for d in dims})
        return df.drop(*[f"__{n}{d}" for d in dims for n in "vq"])

    def with_places(self, df: DataFrame, k: int, combos: Sequence[tuple[int, ...]], base: int, level: Column, out: str = "p", value: str = "mn") -> DataFrame:
        """Adds the places out1.. of cells at ``level`` among those below their ancestors at ``base``."""
        dims, at = range(1, k + 1), F.lit(base) if base else level
        df = df.withColumns({f"__q{d}": cells_from_zero(self.inside(k, combos, d, f"{value}{d}"), self.roots_of(k, combos, d, "size"), at) for d in dims})
        for d in dims:
            cells = F.col(f"__q{d}")
            near = F.abs(cells) < EXACT_CELLS
            if base:
                place = F.floor((cells - F.floor(cells)) * F.pow(F.lit(2.0), (level - base).cast("double")))
                place = F.when(near, place).otherwise(zero())  # a cell of one value
            else:  # the root begins anywhere
                edge = cells_from_zero(self.roots_of(k, combos, d, "lo"), self.roots_of(k, combos, d, "size"), level)
                whole = F.when(near, F.floor(cells).cast("double")).otherwise(cells)
                place = F.when(level == 0, zero()).otherwise((whole - edge).cast("bigint"))
            df = df.withColumn(f"{out}{d}", place)
        return df.drop(*[f"__q{d}" for d in dims])

    # -- growing --------------------------------------------------------------

    def _grow(self, k: int, combos: Sequence[tuple[int, ...]]) -> Trees:
        with self.ws.short_methods():  # cells and hashes of several dimensions make long ones
            return self._grown(k, combos)

    def _grown(self, k: int, combos: Sequence[tuple[int, ...]]) -> Trees:
        step = batch_levels(k, self.data.unique_ids)
        self.entity_rows[k] = []
        deepest, end = self._deepest(k, combos)
        batches, waiting = [], [(self._exploded_rows(combos), 0, step, False)]
        while waiting:
            rows, base, levels, small = waiting.pop()
            levels = min(levels, end - base)
            stats = self._batch_stats(k, combos, rows, base, levels, small, deepest)
            if k > 1:  # read twice below
                stats = self.ws.cut(stats, f"stats{k}")
            batches.append(self.ws.cut(self._decide(k, combos, stats, base, levels), f"nodes{k}"))
            base += levels
            if base == end:
                continue
            front, size, few, ahead = self._front(k, combos, batches[-1], base)
            if size and ahead > base:
                batches.append(self.ws.cut(self._chains(k, combos, front, base, ahead), f"chains{k}"))
                base = ahead
                front, size, few, _ = self._front(k, combos, batches[-1], base)
            light = F.col("rows") <= SMALL_ROWS
            parts = [(front.where(light), few, SMALL_BITS // k - 1, True), (front.where(~light), size - few, step, False)]
            if k == 1 or not self.data.unique_ids:
                parts = [(front, size, step, False)]
            for part, nodes, levels, small in parts:
                if nodes:
                    below = self._front_rows(k, combos, rows, part, nodes, base)
                    if base + levels < end:  # read again by the batch after the next
                        below = self.ws.cut(below, f"rows{k}")
                    waiting.append((below, base, levels, small))
        nodes = reduce(DataFrame.unionByName, batches)
        depth = nodes.agg(F.max("level")).first()[0]
        trees = Trees(k, tuple(combos), nodes, depth)
        return self._count_rows(trees) if k > 1 else trees

    def _deepest(self, k: int, combos: Sequence[tuple[int, ...]]) -> tuple[list[int] | None, float]:
        """The deepest level of each subset on which a node can split, and the level below which there are none at all.

        A node of several columns splits where a subnode on its level can be refined.
        """
        if k == 1:
            return None, math.inf
        found = {r["combo"]: r["deepest"] for r in self._live(k).groupBy("combo").agg(F.max("level").alias("deepest")).collect()}
        ids = {combo: i for i, combo in enumerate(self.trees[k - 1].combos)}
        deepest = [max(found.get(ids[sub], -1) for sub in column_combinations(combo, k - 1)) for combo in combos]
        return deepest, max(1, max(deepest) + 1)

    def _live(self, k: int) -> DataFrame:
        """Nodes of one column less that let the nodes above them be refined."""
        single = conj([F.col(f"mn{d}") == F.col(f"mx{d}") for d in range(1, k)])
        needed = F.when(single, self.config.singularity_threshold).otherwise(self.config.range_threshold)
        return self.trees[k - 1].nodes.where(~F.col("stub") & (F.col("strength") >= needed))

    def _front(self, k: int, combos: Sequence[tuple[int, ...]], nodes: DataFrame, level: int) -> tuple[DataFrame, int, int, int]:
        """Nodes at ``level`` that split, their number, that of those with few rows, and the deepest level to which all stay whole.

        Subsets of several columns reach one level below their subnodes at most,
        so that bounds the search where only values beyond the roots differ.
        """
        front = nodes.where((F.col("level") == level) & F.col("split"))
        whole = [shared_levels(self.inside(k, combos, d, f"mn{d}"), self.inside(k, combos, d, f"mx{d}"),
                               self.roots_of(k, combos, d, "size"), F.col("level")) for d in range(1, k + 1)]
        found = front.agg(F.count(F.lit(1)), F.min(F.least(*whole) if k > 1 else whole[0]), F.count_if(F.col("rows") <= SMALL_ROWS)).first()
        if not found[0]:
            return front, 0, 0, level
        limits = [] if k == 1 else [self.trees[k - 1].depth + 1]
        # One level is left for the batch below, whose rows tell how the last whole cell is divided.
        return front, found[0], found[2], min([x for x in (found[1], *limits) if x is not None]) - 1

    def _exploded_rows(self, combos: Sequence[tuple[int, ...]]) -> DataFrame:
        """One row per (row, combo): entities and values x1..xk."""
        entities = [f"e{i}" for i in range(self.data.id_kinds)]
        parts = [F.struct(F.lit(i).alias("combo"), *[F.col(f"v{c}").alias(f"x{d}") for d, c in enumerate(combo, 1)])
                 for i, combo in enumerate(combos)]
        return self.data.rows.select(*entities, F.inline(F.array(*parts)))

    def _front_rows(self, k: int, combos: Sequence[tuple[int, ...]], rows: DataFrame, front: DataFrame, size: int, level: int) -> DataFrame:
        """Rows, one for each subset, whose node at ``level`` splits, and its cells c1..."""
        keys = ["combo", *cell_names(k)]
        placed = self.with_cells(rows.drop(*cell_names(k)), k, combos, F.lit(level), value="x")
        front = front.select(*keys)
        return placed.join(F.broadcast(front) if size <= FRONT_ROWS else front, keys, "left_semi")

    def _located(self, k: int, combos: Sequence[tuple[int, ...]], rows: DataFrame, base: int, levels: int) -> DataFrame:
        """Adds the cells t1.. at ``base`` and the places f1.. inside them, ``levels`` levels below."""
        return self.with_places(self._at_roots(k, combos, rows, base), k, combos, base, F.lit(base + levels), "f", "x")

    def _at_roots(self, k: int, combos: Sequence[tuple[int, ...]], rows: DataFrame, base: int) -> DataFrame:
        """Adds the cells t1.. at ``base``, which rows of a front have already."""
        if base:
            return rows.withColumnsRenamed({c: f"t{c[1:]}" for c in cell_names(k)})
        return self.with_cells(rows, k, combos, F.lit(base), "t", "x")

    def _batch_stats(self, k: int, combos: Sequence[tuple[int, ...]], rows: DataFrame, base: int, levels: int,
                     small: bool = False, deepest: Sequence[int] | None = None) -> DataFrame:
        """Statistics of every non-empty cell of a batch: its root t1.., its place p1.. below it, and its number c1...

        For k >= 2 one level more than the batch is aggregated: it tells which
        half of each dimension has few entities. Rows below ``small`` roots are
        dealt out as they are.
        """
        extra = 1 if k > 1 else 0
        dims = range(1, k + 1)
        rows = self._at_roots(k, combos, rows, base) if small else self._located(k, combos, rows, base, levels + extra)
        tops, places = [f"t{d}" for d in dims], [f"p{d}" for d in dims]
        fine = [*tops, *[f"f{d}" for d in dims]]
        spans = [f(f"x{d}").alias(f"{n}{d}") for d in dims for n, f in (("mn", F.min), ("mx", F.max))]
        merge_spans = [f(f"{n}{d}").alias(f"{n}{d}") for d in dims for n, f in (("mn", F.min), ("mx", F.max))]
        first = 0 if base == 0 else 1
        levels_up = F.explode(F.sequence(F.lit(first), F.lit(levels))).alias("__j")
        up = F.lit(levels + extra) - F.col("__j")
        keys = ["combo", "level", *tops, *places]
        at_level = [F.col("combo"), (F.col("__j") + base).alias("level"), *tops,
                    *[F.call_function("shiftright", F.col(f"f{d}"), up).alias(f"p{d}") for d in dims]]
        halves = [F.call_function("shiftright", F.col(f"f{d}"), up - 1).bitwiseAND(F.lit(1).cast("bigint"))
                  .alias(f"b{d}") for d in dims] if extra else []

        if self.data.unique_ids:
            present, numbered = F.col("e0") != 0, F.col("e0") % SET_PRIME
            if small:
                fine_stats = rows.select("combo", *tops, present.cast("bigint").alias("n0"), numbered.alias("s0"), *[f"x{d}" for d in dims])
            else:
                fine_stats = rows.groupBy("combo", *fine).agg(F.count(F.lit(1)).alias("rows"), F.count_if(present).alias("n0"), F.sum(numbered).alias("s0"), *spans)
            # What lies below one root, fewer than 2^(BATCH_BITS + 1) cells or SMALL_ROWS rows, meets in one task.
            # Sorting by one number is cheap; the cells are sorted depth first where they are counted.
            fine_stats = fine_stats.repartition("combo", *tops).withColumn("root", F.xxhash64("combo", *tops)).sortWithinPartitions("root")
            stats = fine_stats.mapInArrow(rollup.rolled_up(k, base, first, levels, extra, self.config.low_threshold, deepest,
                                                         self._ranges(combos) if base else None), rollup.schema(k, bool(extra), base > 0))
        else:
            rows = self._by_kind(rows)
            fine_stats = rows.groupBy("combo", *fine, "kind", "entity").agg(F.count(F.lit(1)).alias("rows"), *spans)
            # An entity has few cells below one root, however many rows: dealt by both, all levels are grouped where they are.
            # Columns that hold one value stay out: the optimizer makes literals of them, and the grouping would not know them again.
            dealt = [*(["combo"] if len(combos) > 1 else []), *(tops if base else []), *(["kind"] if self.data.id_kinds > 1 else []), "entity"]
            fine_stats = fine_stats.repartition(*dealt)
            spread = fine_stats.select("*", levels_up).select(
                *at_level, *halves, "kind", "entity", "rows", *[f"{n}{d}" for d in dims for n in ("mn", "mx")])
            bits = [f(f"b{d}").alias(f"{n}{d}") for d in dims for n, f in (("bmn", F.min), ("bmx", F.max))] if extra else []
            per_entity = spread.groupBy(*keys, "kind", "entity").agg(F.sum("rows").alias("rows"), *merge_spans, *bits)
            # Stored once: read here for the cells, and again for the flattened counts of those that are nodes.
            per_entity = self.ws.cut(self.with_cells(per_entity, k, combos, F.col("level")), f"entities{k}")
            self.entity_rows[k].append(per_entity.select("combo", "level", *cell_names(k), "kind", "entity", "rows", *[f"mn{d}" for d in dims]))
            aggs = [F.sum(F.when(F.col("kind") == 0, F.col("rows"))).alias("rows"), *merge_spans]
            for a in range(self.data.id_kinds):
                mine = (F.col("kind") == a) & (F.col("entity") != 0)
                aggs += [F.count_if(mine).alias(f"n{a}"),
                         F.coalesce(F.bit_xor(F.when(mine, F.col("entity"))), zero()).alias(f"s{a}")]
                for d in dims if extra else []:
                    for b, inside in ((0, F.col(f"bmn{d}") == 0), (1, F.col(f"bmx{d}") == 1)):
                        aggs += [F.count_if(mine & inside).alias(f"h{d}_{b}_n{a}"),
                                 F.coalesce(F.bit_xor(F.when(mine & inside, F.col("entity"))), zero())
                                 .alias(f"h{d}_{b}_s{a}")]
            stats = per_entity.groupBy(*keys).agg(*aggs)

        if self.data.unique_ids and base:  # numbered on the way, but for cells that one value numbers
            stats = stats.withColumns({f"c{d}": F.coalesce(f"c{d}", value_cell(self.inside(k, combos, d, f"mn{d}"))) for d in dims})
        else:
            stats = self.with_cells(stats, k, combos, F.col("level"))
        if not extra:
            return self._with_strengths(stats, {"strength": ("n", "s")})
        halves = {f"__ok{d}_{b}": (f"h{d}_{b}_n", f"h{d}_{b}_s") for d in dims for b in (0, 1)}
        stats = self._with_strengths(stats, {"strength": ("n", "s"), **halves}, passing=halves)
        for d in dims:
            ok = [F.col(f"__ok{d}_{b}") for b in (0, 1)]
            stats = stats.withColumn(f"half{d}", F.when(ok[0] & ~ok[1], 0).when(~ok[0] & ok[1], 1).otherwise(-1))
        return stats.drop(*halves, *[c for c in stats.columns if c.startswith("h") and not c.startswith("half")])

    def _chains(self, k: int, combos: Sequence[tuple[int, ...]], front: DataFrame, level: int, ahead: int) -> DataFrame:
        """Nodes of the levels after ``level`` up to ``ahead``, on which every node of the front stays whole.

        All rows of such a node lie in one half of each dimension, so its
        statistics are those of the front; only labels and limits differ.
        """
        dims = range(1, k + 1)
        lower = F.explode(F.sequence(F.lit(level + 1), F.lit(ahead))).alias("level")
        kept = [c for c in front.columns if c not in ("level", "stub", "split", "noisy", *cell_names(k), *[f"half{d}" for d in dims])]
        firsts = [F.col(c).alias(f"t{c[1:]}") for c in cell_names(k)]
        stats = front.select(*kept, *firsts, lower)
        stats = self.with_cells(stats, k, combos, F.col("level"))
        if k > 1:
            strong = F.col("strength") >= self.config.low_threshold
            stats = self.with_cells(stats, k, combos, F.col("level") + 1, "half")
            one_value = {d: F.col(f"half{d}") > int(EXACT_CELLS) for d in dims}
            side = {d: F.when(one_value[d], 0).otherwise(F.col(f"half{d}").bitwiseAND(F.lit(1).cast("bigint")).cast("int")) for d in dims}
            stats = stats.withColumns({f"half{d}": F.when(strong, side[d]).otherwise(-1) for d in dims})
        if not self.data.unique_ids:
            own = front.select("combo", *cell_names(k))
            entities = self.entity_rows[k][-1].where(F.col("level") == level).join(own, ["combo", *cell_names(k)], "left_semi")
            entities = entities.drop("level", *cell_names(k)).select("*", lower)
            self.entity_rows[k].append(self.with_cells(entities, k, combos, F.col("level")))
        flagged = self._flagged(k, combos, stats)
        above = (Window.partitionBy("combo", *[f"t{d}" for d in dims]).orderBy("level")
                 .rowsBetween(Window.unboundedPreceding, -1))
        kept = flagged.withColumn("__open", F.coalesce(F.min("split").over(above), F.lit(True))).where("__open")
        return self._with_noise(k, combos, kept.drop("__open", *[f"t{d}" for d in dims]), ahead)

    def _by_kind(self, rows: DataFrame) -> DataFrame:
        kinds = self.data.id_kinds
        if kinds == 1:
            return rows.withColumn("kind", F.lit(0)).withColumnRenamed("e0", "entity")
        parts = [F.struct(F.lit(a).alias("kind"), F.col(f"e{a}").alias("entity")) for a in range(kinds)]
        others = [c for c in rows.columns if not c.startswith("e")]
        return rows.select(*others, F.inline(F.array(*parts)))

    def _set_seed(self, seed: Column) -> Column:
        """Seed of an entity set: the XOR of different entities, or, where every row is an entity, the sum modulo a prime.

        Rows without ids are known by their values alone; equal ones add up where
        an XOR would cancel them.
        """
        return seed % SET_PRIME if self.data.unique_ids else seed

    def _strength(self, count: str, seed: str) -> Column:
        parts = [self._kind_strength(F.col(f"{count}{a}"), self._set_seed(F.col(f"{seed}{a}")))
                 for a in range(self.data.id_kinds)]
        return (F.least(*parts) if len(parts) > 1 else parts[0]).cast("double")

    def _with_strengths(self, df: DataFrame, wanted: dict[str, tuple[str, str]], passing: Iterable[str] = ()) -> DataFrame:
        """Adds strengths, each from its count and seed; of those in ``passing`` only whether they reach the low threshold.

        A seed is hashed once, into a column, and only where the outcome depends on
        it: a count that passes with the largest margin passes with every margin.
        """
        cfg, kinds = self.config, range(self.data.id_kinds)
        if cfg.low_layer_sd == 0:
            found = {out: self._strength(n, s) for out, (n, s) in wanted.items()}
            return df.withColumns({out: v >= cfg.low_threshold if out in passing else v for out, v in found.items()})
        least, sure = min(cfg.low_threshold, cfg.singularity_threshold, cfg.range_threshold), cfg.low_threshold + largest_margin(cfg)
        hashed, found = {}, {}
        for out, (n, s) in wanted.items():
            parts = []
            for a in kinds:
                count, name = F.col(f"{n}{a}"), f"__m_{out}{a}"
                open_ = (count >= cfg.low_threshold) & (count < sure) if out in passing else count >= least
                hashed[name] = F.when(open_, margin_seed(self._set_seed(F.col(f"{s}{a}")), cfg))
                strength = F.when(open_, count - margin_of(F.col(name), cfg)).otherwise(count.cast("double"))
                parts.append(strength >= cfg.low_threshold if out in passing else strength)
            found[out] = conj(parts) if out in passing else (F.least(*parts) if len(parts) > 1 else parts[0]).cast("double")
        return df.withColumns(hashed).withColumns(found).drop(*hashed)

    def _kind_strength(self, count: Column, seed: Column) -> Column:
        """Count less its margin; counts below every threshold fail anyway, so they skip the hashing."""
        cfg = self.config
        least = min(cfg.low_threshold, cfg.singularity_threshold, cfg.range_threshold)
        return F.when(count < least, count.cast("double")).otherwise(count - suppression_margin(seed, cfg))

    def _flagged(self, k: int, combos: Sequence[tuple[int, ...]], stats: DataFrame) -> DataFrame:
        """Adds stub and split, which depend on the cell alone."""
        cfg = self.config
        varied = reduce(lambda a, b: a | b, [F.col(f"mn{d}") < F.col(f"mx{d}") for d in range(1, k + 1)])
        may_split = varied & (F.col("strength") >= cfg.low_threshold)
        if k == 1:
            limits = [noisy_row_limit(F.lit(combo_seed(cfg, [self.data.columns[c].name])), F.lit(self.data.n_rows),
                                      cfg.depth_row_fraction, cfg.salt or "") for (c,) in combos]
            limit = by_combo(limits)
            deep_enough = (F.col("level") <= cfg.depth_threshold) | (F.col("rows") - 1 >= limit)
            return stats.withColumn("stub", F.lit(False)).withColumn("split", may_split & deep_enough)
        refined = self._refined(k, combos, stats.where(F.col("strength") >= cfg.low_threshold))
        keys = ["combo", "level", *cell_names(k)]
        flagged = stats.withColumn("__key", key_hash(keys)).join(refined, ["__key", *keys], "left").drop("__key")
        flagged = flagged.withColumn("stub", F.coalesce("stub", F.lit(True)))
        return flagged.withColumn("split", may_split & ~F.col("stub"))

    def _decide(self, k: int, combos: Sequence[tuple[int, ...]], stats: DataFrame, base: int, levels: int) -> DataFrame:
        """Split flags and existence. A cell is a node when all cells above it split."""
        flagged = self._flagged(k, combos, stats)
        dims = range(1, k + 1)
        bits_below = F.lit(base + levels) - F.col("level")
        if self.data.unique_ids:
            start = F.call_function("shiftleft", F.col("code"), bits_below * k)
        else:
            start = child_code([F.call_function("shiftleft", F.col(f"p{d}"), bits_below) for d in dims], levels)
        span = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits_below * k)
        coded = flagged.select("*", start.alias("__start"))
        coded = coded.withColumn("__closed", F.when(~F.col("split"), F.col("__start") + span))
        coded = coded.withColumn("__root", key_hash(["combo", *[f"t{d}" for d in dims]]))
        # One partition holds the cells below one base node: fewer than 2^(BATCH_BITS + 1), or what SMALL_ROWS rows make.
        above = (Window.partitionBy("__root", "combo", *[f"t{d}" for d in dims]).orderBy("__start", "level")
                 .rowsBetween(Window.unboundedPreceding, -1))
        reach = F.coalesce(F.max("__closed").over(above), F.lit(0).cast("bigint"))
        kept = coded.withColumn("__reach", reach).where(F.col("__reach") <= F.col("__start"))
        return self._with_noise(k, combos, kept.drop("__start", "__closed", "__reach", "__root", "code", *[f"{n}{d}" for d in dims for n in "tp"]), base + levels)

    def _with_noise(self, k: int, combos: Sequence[tuple[int, ...]], nodes: DataFrame, depth: int) -> DataFrame:
        if k == 1 or not self.data.unique_ids:  # counted later, on the flattened tree or per entity
            return nodes
        return self._with_unique_noise(nodes, k, combos, depth)

    def _refined(self, k: int, combos: Sequence[tuple[int, ...]], nodes: DataFrame) -> DataFrame:
        """Cells that are no stubs: a subnode exists, is none itself, and is strong enough to be refined further."""
        sub = self.subnode_keys(k, combos, nodes.select("combo", "level", *cell_names(k)))
        live = self._live(k).select(F.col("combo").alias("sub_combo"), "level", *[F.col(c).alias(f"s{c[1:]}") for c in cell_names(k - 1)])
        keys, sub_keys = ["combo", "level", *cell_names(k)], ["sub_combo", "level", *[f"s{d}" for d in range(1, k)]]
        sub, live = sub.withColumn("__key", key_hash(sub_keys)), live.withColumn("__key", key_hash(sub_keys))
        met = sub.join(live, ["__key", *sub_keys], "left_semi").withColumn("__key", key_hash(keys))
        return met.groupBy("__key", *keys).agg(F.lit(False).alias("stub"))

    def subnode_keys(self, k: int, combos: Sequence[tuple[int, ...]], nodes: DataFrame) -> DataFrame:
        """k rows per node: slot, sub_combo and the cells s1.. of the subnode; slot s omits dimension k - s."""
        ids = {combo: i for i, combo in enumerate(self.trees[k - 1].combos)}
        parts = []
        for slot in range(k):
            omit = k - slot  # 1-based dimension left out
            subs = [F.lit(ids[tuple(c for d, c in enumerate(combo, 1) if d != omit)]) for combo in combos]
            kept = [d for d in range(1, k + 1) if d != omit]
            parts.append(F.struct(F.lit(slot).alias("slot"),
                                  by_combo(subs).alias("sub_combo"),
                                  *[F.col(f"c{d}").alias(f"s{i}") for i, d in enumerate(kept, 1)]))
        return nodes.select("*", F.inline(F.array(*parts)))

    # -- one-column trees -----------------------------------------------------

    def _flatten_roots(self, trees: Trees) -> Trees:
        """Moves each root down while one half is weak, rebases the tree, and re-attaches outlying rows."""
        nodes, low = trees.nodes, self.config.low_threshold
        weak = ~F.col("split") & (F.col("strength") < low)
        # Cells are numbered from zero, the root from where it begins: the halves of a root are told by its middle.
        edge = self.per_column(lambda r: r.lo / (r.size / 2)).cast("bigint")
        side = F.when(F.col("level") == 1, F.col("c1") - edge).otherwise(F.col("c1").bitwiseAND(F.lit(1).cast("bigint")))
        children = nodes.where("level > 0").select(
            "combo", (F.col("level") - 1).alias("level"), parent_cell(F.col("c1"), F.col("level")).alias("c1"),
            side.alias("side"), weak.alias("weak"))
        sides = children.groupBy("combo", "level", "c1").agg(
            *[F.coalesce(F.bool_and(F.when(F.col("side") == b, F.col("weak"))), F.lit(True)).alias(f"w{b}")
              for b in (0, 1)])
        passing = sides.where("w0 <> w1").select("combo", "level", "c1", F.when(F.col("w0"), 1).otherwise(0).alias("go"))
        ends = passing.select("combo", (F.col("level") + 1).alias("to_level"), (
            F.when(F.col("level") == 0, edge).otherwise(F.col("c1") * 2) + F.col("go")).alias("to_cell"))
        steps = ends.select("*", F.explode(F.sequence(F.lit(0), F.col("to_level") - 1)).alias("level"))
        below = F.call_function("shiftright", F.col("to_cell"), F.least(F.col("to_level") - F.col("level") - 1, F.lit(63)))
        steps = steps.withColumn("c1", parent_cell(below, F.col("level") + 1)).withColumn(
            "go", F.when(F.col("level") == 0, below - edge).otherwise(below.bitwiseAND(F.lit(1).cast("bigint"))).cast("int"))
        reached = (steps.join(passing, ["combo", "level", "c1", "go"], "left_semi")
                   .groupBy("combo", "to_level", "to_cell").agg(F.count(F.lit(1)).alias("found"))
                   .where(F.col("found") == F.col("to_level")))
        deepest = {r["combo"]: r["end"] for r in reached.groupBy("combo").agg(
            F.max(F.struct("to_level", "to_cell")).alias("end")).collect()}  # one row per column

        # The weak halves passed on the way hold the outlying rows: at most one node per level and column.
        passed = []
        for c, end in deepest.items():
            middle = int(self.roots[c].lo / (self.roots[c].size / 2)) * 2 + 1
            for lv in range(1, end["to_level"] + 1):
                cell = end["to_cell"] >> (end["to_level"] - lv)
                other = middle - cell if lv == 1 else cell ^ 1
                passed.append((c, lv, other, "high" if other > cell else "low"))
        tops = [(c.index, *(deepest[c.index] if c.index in deepest else (0, 0))) for c in self.data.columns]
        marks = [(c, lv, cell, "root") for c, lv, cell in tops] + passed
        marked = self.ws.spark.createDataFrame(marks, "combo int, level int, c1 bigint, mark string")
        facts = nodes.join(F.broadcast(marked), ["combo", "level", "c1"]).groupBy("combo", "mark").agg(
            F.min("mn1").alias("mn"), F.max("mx1").alias("mx"), F.sum("rows").alias("rows"),
            *[F.sum(f"n{a}").alias(f"n{a}") for a in range(self.data.id_kinds)],
            *[(F.sum if self.data.unique_ids else F.bit_xor)(f"s{a}").alias(f"s{a}") for a in range(self.data.id_kinds)]).collect()
        by_mark = {(r["combo"], r["mark"]): r for r in facts}

        roots = []
        for c, level, cell in tops:
            old, fact = self.roots[c], by_mark[(c, "root")]
            width = math.ldexp(old.size, -level)
            roots.append(Root(cell * width if level else old.lo, width, fact["mn"], fact["mx"], level, cell))
        before, self.roots = self.roots, roots

        rebased = self._below_roots(nodes, before)
        outliers = None
        if any(mark != "root" for _, mark in by_mark):
            if self.data.unique_ids:
                rebased = self._attach_outliers(rebased, by_mark)
            else:
                weak_rows = marked.where("mark <> 'root'").withColumnRenamed("mark", "end")
                outliers = self._entity_rows(1).join(F.broadcast(weak_rows), ["combo", "level", "c1"])
        if self.data.unique_ids:
            rebased = self._with_unique_noise(rebased, 1, trees.combos, trees.depth)
        rebased = self.ws.cut(rebased, "nodes1")
        depth = rebased.agg(F.max("level")).first()[0]
        flat = replace(trees, nodes=rebased, depth=depth)
        if not self.data.unique_ids:
            self.entity_rows[1] = [self._below_roots(part, before) for part in self.entity_rows[1]]
            if outliers is not None:
                self.outlying = self.ws.cut(self._outlying_rows(rebased, outliers), "outlying")
        return flat if self.data.unique_ids else self._count_rows(flat)

    def _below_roots(self, nodes: DataFrame, before: Sequence[Root]) -> DataFrame:
        """Nodes under the roots that were moved down, with levels counted from there."""
        top_level = self.per_column(lambda r: r.level)
        size = by_combo([r.size for r in before])
        depth_in = F.col("level") - top_level
        top = cell_number(F.col("mn1"), cells_from_zero(F.col("mn1"), size, top_level), top_level)
        inside = nodes.where((depth_in >= 0) & (top == self.per_column(lambda r: r.cell).cast("bigint")))
        number = F.when(depth_in == 0, zero()).otherwise(F.col("c1"))
        return inside.withColumn("c1", number).withColumn("level", depth_in)

    def _outlying_rows(self, nodes: DataFrame, outliers: DataFrame) -> DataFrame:
        """Rows per entity outside the roots, for every node that holds the end value on their side."""
        at_low, at_high = F.col("mn1") == self.per_column(lambda r: r.amin), F.col("mx1") == self.per_column(lambda r: r.amax)
        ends = nodes.select("combo", "level", "c1", "mn1", F.explode(F.array_compact(F.array(
            F.when(at_low, "low"), F.when(at_high, "high")))).alias("end"))
        # At most two nodes of a level hold an end value, and the outlying halves have fewer entities than any node shown.
        return outliers.select("combo", "end", "kind", "entity", "rows").join(F.broadcast(ends), ["combo", "end"]).select(
            "combo", "level", "c1", "kind", "entity", "rows", "mn1")

    def _entity_rows(self, k: int) -> DataFrame:
        return reduce(DataFrame.unionByName, self.entity_rows[k])

    def _attach_outliers(self, nodes: DataFrame, facts: dict) -> DataFrame:
        """Adds outlying rows to the nodes on the left or right edge: those holding the end value of the root."""
        def constant(mark: str, field: str) -> Column:
            values = [facts[(c.index, mark)][field] if (c.index, mark) in facts else 0 for c in self.data.columns]
            return by_combo([F.lit(v).cast("bigint") for v in values])

        ends = {"low": self.per_column(lambda r: r.amin), "high": self.per_column(lambda r: r.amax)}
        touches = {"low": F.col("mn1") == ends["low"], "high": F.col("mx1") == ends["high"]}
        out = nodes
        for field in ("rows", "n0", "s0"):
            extra = [F.when(touches[m], constant(m, field)).otherwise(zero()) for m in ("low", "high")]
            out = out.withColumn(field, F.col(field) + extra[0] + extra[1])
        return out.withColumn("strength", self._strength("n", "s"))

    def per_column(self, value) -> Column:
        return by_combo([value(r) for r in self.roots])

    # -- noisy row counts -----------------------------------------------------

    def with_bucket_seed(self, nodes: DataFrame, k: int, combos: Sequence[tuple[int, ...]], depth: int) -> DataFrame:
        """Adds ``bucket``: tree seed plus the distinct midpoint labels of the node.

        A midpoint is written in units of 2^-40 root sizes: an exact integer, so
        no floating-point text enters the seed. Deeper ones, which only trees of
        more than ``LABEL_LEVELS`` levels have, get an exponent of their own.
        """
        dims = range(1, k + 1)
        sizes = {d: self.roots_of(k, combos, d, "size") for d in dims}
        nodes = nodes.withColumns({f"__w{d}": cell_width(sizes[d], F.col("level")) for d in dims})
        middle = {d: F.when(F.col("level") == 0, self.roots_of(k, combos, d, "lo")).otherwise(F.col(f"c{d}") * F.col(f"__w{d}")) + F.col(f"__w{d}") / 2
                  for d in dims}
        single = {d: (F.col(f"mn{d}") == F.col(f"mx{d}")) | (F.abs(F.col(f"c{d}")) > int(EXACT_CELLS)) for d in dims}
        nodes = nodes.withColumns({f"__m{d}": F.when(single[d], F.col(f"mn{d}")).otherwise(middle[d]) for d in dims})
        texts = {d: midpoint_label(F.col(f"__m{d}"), sizes[d]) for d in dims}
        if depth > LABEL_LEVELS:
            texts = {d: F.when(F.col("level") > LABEL_LEVELS, exact_label(F.col(f"__m{d}"))).otherwise(texts[d]) for d in dims}
        nodes = nodes.withColumns({f"__t{d}": texts[d] for d in dims})
        names = [c.name for c in self.data.columns]
        seed = by_combo([combo_seed(self.config, [names[c] for c in combo]) for combo in combos])
        seeded = nodes.withColumn("bucket", combine_texts(seed, [F.col(f"__t{d}") for d in dims]))
        return seeded.drop(*[f"__{n}{d}" for n in "wmt" for d in dims])

    def _with_unique_noise(self, nodes: DataFrame, k: int, combos: Sequence[tuple[int, ...]], depth: int) -> DataFrame:
        nodes = self.with_bucket_seed(nodes, k, combos, depth)
        noisy = noisy_unique_count(F.col("n0"), self._set_seed(F.col("s0")), F.col("bucket"), self.config)
        return nodes.withColumn("noisy", F.greatest(noisy, F.lit(self.config.low_threshold).cast("bigint"))).drop("bucket")

    def _count_rows(self, trees: Trees) -> Trees:
        """Flattened noisy row counts of every node for tables with repeating entities.

        The rows per cell and entity that the batches counted are met with the nodes;
        no row is read again. The entity counts of one-column trees are renewed
        here, because outlying rows count in the nodes at the ends.
        """
        if self.data.unique_ids:
            return trees
        k, combos, nodes = trees.k, trees.combos, trees.nodes
        keys = ["combo", "level", *cell_names(k)]
        owned = [*keys, "kind", "entity"]
        contributions = self._entity_rows(k).join(nodes.select(*keys), keys, "left_semi").select(*owned, F.col("rows").alias("contribution"))
        if k == 1 and self.outlying is not None:
            # Only the nodes at the ends, at most two of a level, have pairs that come more than once.
            ends = F.broadcast(self.outlying.select(*keys).distinct())
            met = contributions.join(ends, keys, "left_semi").unionByName(self.outlying.select(*owned, F.col("rows").alias("contribution")))
            met = met.groupBy(*owned).agg(F.sum("contribution").alias("contribution"))
            contributions = contributions.join(ends, keys, "left_anti").unionByName(met)
        contributions = self.ws.cut(contributions, f"contributions{k}")
        real = F.col("entity") != 0
        totals = contributions.groupBy(*keys, "kind").agg(
            F.count_if(real).alias("entities"),
            F.coalesce(F.bit_xor(F.when(real, F.col("entity"))), zero()).alias("seed"),
            F.coalesce(F.sum(F.when(real, F.col("contribution"))), zero()).alias("accounted"),
            F.coalesce(F.sum(F.when(~real, F.col("contribution"))), zero()).alias("unaccounted"))
        # The cells come first, because sorting begins with a column that tells most rows apart.
        heavy = heaviest(contributions, [*cell_names(k), "level", "combo"], self.config)
        spans = [f"{n}{d}" for d in range(1, k + 1) for n in ("mn", "mx")]
        totals = totals.join(heavy, [*keys, "kind"], "left").join(nodes.select(*keys, *spans), keys)
        totals = self.with_bucket_seed(totals, k, combos, trees.depth)
        per_kind = flattened(totals, F.col("bucket"), self.config)
        counted = combined_count(per_kind, keys).select(
            *keys, F.greatest(F.col("noisy_count"), F.lit(self.config.low_threshold).cast("bigint")).alias("noisy"))
        if k == 1:
            margin = self._kind_strength(F.col("entities"), F.col("seed"))
            renewed = totals.groupBy(*keys).agg(F.min(margin).cast("double").alias("strength"))
            counted = counted.join(renewed, keys)
            nodes = nodes.drop("strength")
        return replace(trees, nodes=self.ws.cut(nodes.join(counted, keys), f"counted{k}"))


def midpoint_label(mid: Column, size: Column) -> Column:
    scaled = mid / size * float(1 << 40)
    units = (scaled - F.pmod(scaled, F.lit(1.0))).cast("decimal(38,0)")
    power = F.round(F.log2(size)).cast("int")
    return F.concat(power.cast("string"), F.lit(":"), units.cast("string"))
