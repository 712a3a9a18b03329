"""Similarity join of documents on word n-grams by chosen paths.

Every distinct set of n-grams starts at the root of each of several runs. A node
samples coordinates, one always and a second with the probability that makes up
for the similarity searched; a coordinate is a random order of all n-grams, and a
set moves to the child named by its first n-gram in that order, so sets meet in
a child exactly when the sampled n-gram is shared. Nodes are split until they hold
few sets, or until a split leaves most of a node together: then its sets share
most n-grams, and they are compared with each other as they are.

A pair at the threshold has on average one common child per node, and the chance
that no path survives follows from that branching process; the number of runs is
the smallest that pushes the loss of all runs below 1 - recall at the depth at
which nodes are small as a rule. Closer pairs are lost less often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from .components import connected_components
from .texts import gram_hashes, groups, mix, slices, word_hashes

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.999
LEVELS = 4  # splits that most nodes need; a run's own coordinates last for them, then it goes on with those of the next run
LEAF = 64  # sets below which a node is no longer split
WHOLE = 0.6  # share of a node that stays together in a child of sets alike
BLOCK = 2048  # sets compared with each other in one step
SALTS = 16  # keys over which the rows of one path are spread
BLOCK_GRAMS = 2_000_000  # n-grams of one side of a comparison


def second_share(similarity: float) -> float:
    """How often a node samples a second coordinate: 1 / similarity coordinates on average."""
    return min(1.0, 1 / similarity - 1)


def loss(similarity: float, levels: int) -> float:
    """Chance that two sets of this similarity share no node at the last level of one run."""
    second, lost = second_share(similarity), 0.0
    for _ in range(levels):
        stay = 1 - similarity + similarity * lost
        lost = stay * (1 - second + second * stay)
    return lost


def runs_for(similarity: float, levels: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(loss(similarity, levels))))


def gram_sets(texts: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; fewer than n words are one gram, none are no gram."""
    words, bounds = word_hashes(texts)
    grams = gram_hashes(words, k)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(grams[a:b - k + 1])
        elif b > a:
            yield mix(gram_hashes(words[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def _name(grams: np.ndarray) -> str:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        return f"{int(mix(grams).sum()):016x}{int(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()):016x}"


def _coordinates(runs: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = runs * levels * 2
    return rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)


def _sketch(k: int, runs: int, levels: int):
    masks, factors = _coordinates(runs, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2)):
                sets = list(gram_sets(batch.column(2)[a:b], k))
                sizes = np.array([len(s) for s in sets], np.int64)
                firsts = np.zeros((len(masks), b - a), np.int32)
                full = np.flatnonzero(sizes)
                if len(full):
                    grams = np.concatenate([sets[i] for i in full])
                    begins = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for c, (mask, factor) in enumerate(zip(masks, factors, strict=True)):
                        lowest = np.minimum.reduceat((grams ^ mask) * factor, begins)
                        firsts[c, full] = (mix(lowest) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                flat = pa.array(np.ascontiguousarray(firsts.T).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(masks)), flat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array([_name(s) for s in sets]), pa.array(sizes), lists],
                    names=["doc_id", "text_hash", "name", "n_grams", "firsts"])
    return run


def _of_paths(rows: DataFrame, paths: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins rows to facts of their path; one that holds many rows is spread over several tasks."""
    salt = F.pmod(F.xxhash64("name", F.lit("salt")), F.lit(SALTS)).cast("int").alias("__salt")
    spread = paths.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.select("*", salt).join(spread, [key, "__salt"], how).drop("__salt")


def _paths(sets: DataFrame, runs: int, levels: int, similarity: float, ws: Workspace) -> DataFrame:
    """(name, leaf, members, grams) of all leaves with at least two sets."""
    width = 2 * levels
    rows = sets.where("n_grams > 0").select(
        "name", "n_grams", F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(
            r.alias("run"), F.xxhash64(F.lit("run"), r).alias("path"), F.slice("firsts", r * width + 1, width).alias("own")))).alias("at"))
    rows = rows.select("name", "n_grams", "at.run", "at.path", "at.own", F.lit(None).cast("bigint").alias("above"))
    share = int(second_share(similarity) * 10_000)
    leaves, level = [], 0
    while True:
        if level and level % levels == 0:
            start = F.pmod(F.col("run") + level // levels, F.lit(runs)) * width + 1
            rows = rows.drop("own").join(sets.select("name", "firsts"), "name").withColumn("own", F.slice("firsts", start, width)).drop("firsts")
        # Which coordinates a node samples depends on its path only, so all its sets agree.
        two = F.pmod(F.xxhash64(F.lit("two"), "path"), F.lit(10_000)) < share
        picks = F.when(two, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        rows = rows.withColumn("pick", F.explode(picks))
        path = F.xxhash64("path", "pick", F.element_at("own", F.col("pick") + 2 * (level % levels)))
        rows = rows.select("name", "n_grams", "run", "own", "above", path.alias("path"))
        sizes = (rows.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.sum("n_grams").alias("grams"))
                 .where("members > 1"))
        met = ws.cut(_of_paths(rows, sizes, "path"), f"level{level}")
        done = F.expr(f"members <= {LEAF} or coalesce(members > {WHOLE}D * above, false)")
        leaves.append(met.where(done).select("name", "path", "members", "grams"))
        rows = met.where(~done).withColumn("above", F.col("members")).select("name", "n_grams", "run", "own", "above", "path")
        if rows.isEmpty():
            break
        level += 1
    return reduce(DataFrame.unionByName, leaves).withColumnRenamed("path", "leaf")


def _distinct_leaves(leaves: DataFrame) -> DataFrame:
    """Without leaves that hold the same sets as another one."""
    content = leaves.groupBy("leaf").agg(F.first("members").alias("members"), F.bit_xor(F.xxhash64("name")).alias("x"),
                                         F.bit_xor(F.xxhash64("name", F.lit(1))).alias("y"))
    kept = content.groupBy("members", "x", "y").agg(F.min("leaf").alias("leaf")).select("leaf")
    return _of_paths(leaves, kept, "leaf", "left_semi")


def _with_grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for a, b in slices(texts):
                names = batch.column(1)[a:b].to_pylist()
                sets = list(gram_sets(texts[a:b], k))
                same = [i for i, s in enumerate(sets) if _name(s) == names[i]]
                lists = pa.array([sets[i].tobytes() for i in same], pa.binary())
                pick = pa.array(same, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[a:b].take(pick), lists, batch.column(2)[a:b].take(pick)],
                    names=["name", "grams", "leaves"])
    return run


def common_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None, width: int = 4096) -> np.ndarray:
    """How many n-grams each set of ``left`` shares with each of ``right`` (or of ``left``)."""
    sides = [left] if right is None else [left, right]
    owner = np.concatenate([np.full(len(s), i) for side in sides for i, s in enumerate(side)])
    where = np.concatenate([np.full(sum(map(len, side)), n) for n, side in enumerate(sides)])
    grams = np.concatenate([s for side in sides for s in side])
    order = np.argsort(grams, kind="stable")
    grams, owner, where = grams[order], owner[order], where[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1  # grams of one set only decide nothing
    owner, where, number = owner[shared], where[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    out = np.zeros((len(left), len(sides[-1])), np.float64)
    for begin in range(0, int(number.max()) + 1 if len(number) else 0, width):
        part = (number >= begin) & (number < begin + width)
        tables = []
        for n, side in enumerate(sides):
            table = np.zeros((len(side), width), np.float32)
            own = part & (where == n)
            table[owner[own], number[own] - begin] = 1
            tables.append(table)
        out += tables[0] @ tables[-1].T
    return np.rint(out).astype(np.int64)


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    both = common_counts(left, right)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in (left if right is None else right)])[None, :]
    # J >= s  <=>  common >= s * (a + b - common); a millionth absorbs the rounding of s.
    return both >= similarity * (sizes - both) - 1e-6


def _earlier_shared(leaf: int, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether two sets also meet in a leaf before this one, which then counts the pair."""
    return common_counts([x[x < leaf] for x in left], [x[x < leaf] for x in right]) > 0


def _compare(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 3):
            leaf, i, j = (block.column(c)[0].as_py() for c in range(3))
            rows = {}  # repeated rows of a document arrive more than once
            for name, side, grams, leaves in zip(*(block.column(c).to_pylist() for c in range(3, 7)), strict=True):
                rows.setdefault((side, name), (np.frombuffer(grams, np.uint64), np.sort(np.array(leaves, np.int64))))
            keys = sorted(rows)
            sides = [[k for k in keys if k[0] == n] for n in ((i,) if i == j else (i, j))]
            if not all(sides):
                continue
            a, b = sides[0], sides[-1]
            linked = _linked([rows[k][0] for k in a], None if i == j else [rows[k][0] for k in b], similarity)
            if i == j:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            counted = linked & ~_earlier_shared(leaf, [rows[k][1] for k in a], [rows[k][1] for k in b])
            names = [k[1] for k in a] + ([] if i == j else [k[1] for k in b])
            counts = counted.sum(1) if i == j else np.concatenate([counted.sum(1), counted.sum(0)])
            near = linked if i == j else np.block([[np.zeros((len(a),) * 2, bool), linked], [linked.T, np.zeros((len(b),) * 2, bool)]])
            root = np.arange(len(names))
            while True:  # smallest position in the component
                low = np.minimum(root, np.where(near, root[None, :], len(names)).min(1))
                low = low[low]
                if (low == root).all():
                    break
                root = low
            some = np.flatnonzero(near.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[x] for x in some]), pa.array([names[root[x]] for x in some]), pa.array(counts[some].astype(np.int64))],
                names=["name", "root", "links"])
    return run


class NgramJoin:
    """Classes and links of near copies.

    ``documents`` has one row per input row: doc_id, text_hash, class_id (the smallest id of
    its connected group), set_id (the smallest id of the rows with the same
    n-grams), n_copies (rows with the same n-grams), n_links (other distinct sets
    at or above the similarity), n_grams. Null and empty texts have no n-grams,
    no links, and share one set, which stands for equal empty documents. A class
    whose ids are all null has a null class_id; repeated rows are copies. Groups
    without ids, or with the same smallest id, share a class_id; ``members`` tells
    them apart.
    """

    def __init__(self, ws: Workspace, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                 similarity: float = SIMILARITY, recall: float = RECALL, levels: int = LEVELS):
        runs = runs_for(similarity, levels, recall)
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        sketch = ws.cut(rows.mapInArrow(_sketch(words, runs, levels),
                                        f"doc_id {kind}, text_hash bigint, name string, n_grams bigint, firsts array<int>"), "sketch")
        self.names = sketch.select("doc_id", "text_hash", "name")
        # Equal sets have equal coordinates: min() takes any of them with map-side aggregation.
        sets = ws.cut(sketch.groupBy("name").agg(F.min("doc_id").alias("set_id"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count(F.lit(1)).alias("n_copies"),
                                                 F.first("n_grams").alias("n_grams"), F.first("firsts").alias("firsts")), "sets")
        leaves = ws.cut(_distinct_leaves(_paths(sets, runs, levels, similarity, ws)), "leaves")
        members = leaves.groupBy("name").agg(F.collect_list(F.struct("leaf", "members", "grams")).alias("leaves"))
        # One row stands for each set; ids alone may be null or repeated, and repeated rows change nothing.
        wanted = members.join(sets.select("name", F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash")), "name")
        texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("text", "name", "leaves")
        grams = texts.mapInArrow(_with_grams(words), "name string, grams binary, leaves " + wanted.schema["leaves"].dataType.simpleString())
        links = ws.cut(self._blocks(grams).mapInArrow(_compare(similarity), "name string, root string, links bigint"), "links")
        counts = links.groupBy("name").agg(F.sum("links").alias("n_links"))
        edges = links.where("name <> root").select(F.col("name").alias("a"), F.col("root").alias("b"))
        parts = connected_components(ws, edges)
        named = (sets.select("name", "set_id", "n_copies", "n_grams")
                 .join(counts, "name", "left").join(parts.withColumnRenamed("node", "name"), "name", "left")
                 .withColumn("component", F.coalesce("component", "name")))
        first = named.groupBy("component").agg(F.min("set_id").alias("class_id"))
        self.sets = ws.cut(named.join(first, "component"), "classes")

    @staticmethod
    def _blocks(grams: DataFrame) -> DataFrame:
        """Splits each leaf into blocks and sends every pair of blocks to a task of its own."""
        each = grams.select("name", "grams", F.col("leaves.leaf").alias("all"), F.explode("leaves").alias("at"))
        n = F.greatest(F.ceil(F.col("at.members") / BLOCK), F.ceil(F.col("at.grams") / BLOCK_GRAMS)).cast("int")
        each = each.withColumn("n", n).withColumn("side", F.pmod(F.xxhash64("name", F.lit("block")), F.col("n")).cast("int"))
        pairs = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        keys = [F.col("at.leaf").alias("leaf"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")]
        return (pairs.select(*keys, "name", "side", "grams", "all").repartition("leaf", "i", "j")
                .sortWithinPartitions("leaf", "i", "j"))

    @property
    def members(self) -> DataFrame:
        """``documents`` with the component, which names a group also where ids are null or repeated."""
        return (self.names
                .join(self.sets.select("name", "component", "class_id", "set_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_grams"), "name")
                .select("doc_id", "text_hash", "component", "class_id", "set_id", "n_copies", "n_links", "n_grams"))

    @property
    def documents(self) -> DataFrame:
        return self.members.drop("component")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return NgramJoin(Workspace(spark), spark.read.parquet(f"{folder}/documents.parquet")).documents.drop("text_hash")
