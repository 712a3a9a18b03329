"""End-to-end synthesis: typed table in, private synthetic table with the same columns out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClusterSpec, DerivedCluster, SynthConfig
from ..operators import clustering
from ..operators.cells import Forest
from ..operators.dependence import column_entropy, column_weights, dependence_matrix, pair_dependence, total_dependence
from ..operators.encoding import Encoded, encode_table
from ..operators.features import FeatureRanking, select_features
from ..operators.harvest import Harvest
from ..operators.microdata import microdata
from ..operators.sampling import sampled_table, sampling_config
from ..operators.stitching import MicroTable, StitchColumn, patch, stitch
from ..sources.salt import content_salt
from ..workspace import Workspace


class Synthesizer:
    """One synthesis run; every intermediate result is available as a DataFrame.

    ``ids`` name the columns that identify the protected entities; without them
    every row is an entity. ``main_column`` with ``main_features`` keeps those
    columns close together; ``clusters`` sets the clusters by hand.
    """

    def __init__(self, df: DataFrame, config: SynthConfig | None = None, *, columns: Sequence[str] | None = None,
                 ids: Sequence[str] = (), unique_ids: bool | None = None, clusters: ClusterSpec | None = None,
                 main_column: str | None = None, main_features: Sequence[str] | None = None):
        self.ws = Workspace(df.sparkSession)
        self.ids = list(ids)
        self.columns = list(columns) if columns is not None else [c for c in df.columns if c not in self.ids]
        config = config or SynthConfig()
        if main_features is not None and main_column is None:
            raise ValueError("main features need a main column")
        unknown = [c for c in [main_column, *(main_features or [])] if c is not None and c not in self.columns]
        if unknown:
            raise ValueError(f"columns not found: {unknown}")
        if clusters is not None:
            clusters.validate(self.columns)
        if config.salt is None:
            config = replace(config, salt=content_salt(df.select(*dict.fromkeys([*self.columns, *self.ids]))))
        self.df, self.config, self.spec = df, config, clusters
        self.unique_ids, self.main_column, self.main_features = unique_ids, main_column, main_features

    @cached_property
    def data(self) -> Encoded:
        return encode_table(self.ws, self.df, self.columns, self.ids, self.config, self.unique_ids)

    @cached_property
    def forest(self) -> Forest:
        return Forest(self.ws, self.data, self.config)

    @cached_property
    def measured(self) -> Forest:
        """The forest on which dependence is measured: the table's own, or that of a sample asked for."""
        if self.config.sample_size is None:
            return self.forest
        sample = sampled_table(self.ws, self.data, self.config.sample_size)
        return Forest(self.ws, sample, sampling_config(self.config))

    def _measured_pairs(self) -> DataFrame:
        if self.measured is self.forest and 2 in self.forest.trees:
            # Trees of chosen clusters exist already: measure on a forest of its own.
            return pair_dependence(Forest(self.ws, self.data, self.config))
        return pair_dependence(self.measured)

    @cached_property
    def pairs(self) -> DataFrame:
        return self.ws.cut(self._measured_pairs(), "dependence")

    @cached_property
    def matrix(self) -> DataFrame:
        return dependence_matrix(self.pairs, len(self.columns))

    @cached_property
    def entropies(self) -> DataFrame:
        return self.ws.cut(column_entropy(self.measured), "entropy")

    def dependence_report(self) -> DataFrame:
        names = self._names()
        x, y = names.select(F.col("col").alias("col_x"), F.col("name").alias("column_x")), names.select(
            F.col("col").alias("col_y"), F.col("name").alias("column_y"))
        return self.matrix.join(F.broadcast(x), "col_x").join(F.broadcast(y), "col_y").select(
            "column_x", "column_y", "dependence")

    def column_report(self) -> DataFrame:
        """Per column: type, entropy, cluster weight and total dependence."""
        return (self._names().join(self.entropies, "col").join(column_weights(self.entropies), "col")
                .join(total_dependence(self.matrix), "col", "left")
                .select("name", "type", "entropy", "weight", F.coalesce("total", F.lit(0.0)).alias("total")))

    def cluster_report(self) -> DataFrame:
        names = self._names().select("col", "name")
        return clustering.plan_table(self.ws.spark, self.plan).join(F.broadcast(names), "col").select(
            "cluster", "position", "name", "role")

    def _names(self) -> DataFrame:
        rows = [(c.index, c.name, c.kind) for c in self.data.columns]
        return self.ws.spark.createDataFrame(rows, "col int, name string, type string")

    @cached_property
    def _entropy_order(self) -> list[float]:
        """Entropies that rank stitch columns; only the cluster search measures them."""
        if not self._searched:
            return [0.0] * len(self.columns)
        found = {r["col"]: r["entropy"] for r in self.entropies.collect()}
        return [found.get(i, 0.0) for i in range(len(self.columns))]

    @property
    def _searched(self) -> bool:
        return (self.config.clustering and self.config.max_cluster_weight > 1 and self.spec is None
                and not (self.main_column and self.main_features is not None))

    @cached_property
    def plan(self) -> clustering.Plan:
        index = {c: i for i, c in enumerate(self.columns)}
        everything = list(range(len(self.columns)))
        if not self.config.clustering:
            return everything, []
        if self.config.max_cluster_weight <= 1:
            return [0], [([], [c]) for c in everything[1:]]
        if self.spec is not None:
            return ([index[c] for c in self.spec.initial],
                    [([index[c] for c in d.stitch], [index[c] for c in d.derived]) for d in self.spec.derived])
        main = index[self.main_column] if self.main_column else None
        if self.main_column and self.main_features is not None:
            found = {r["col"]: r["entropy"] for r in column_entropy(self.forest).collect()}
            entropy = [found.get(i, 0.0) for i in everything]
            return clustering.plan_for_features(entropy, main, [index[c] for c in self.main_features],
                                                self.config.max_cluster_weight)
        if len(everything) < 3:
            return everything, []
        inputs = clustering.inputs_from(self.matrix, self.entropies, len(everything), self.config, main)
        return clustering.search(self.ws.spark, inputs, self.config.search_candidates)

    @cached_property
    def harvest(self) -> Harvest:
        initial, derived = self.plan
        self.forest.grow_for([initial] + [s + d for s, d in derived])
        return Harvest(self.forest)

    def micro_table(self, columns: Sequence[int]) -> MicroTable:
        rows = self.ws.cut(microdata(self.harvest, self.data, columns), "microdata")
        return MicroTable(rows, tuple(sorted(columns)), rows.count(), True)

    def result(self) -> DataFrame:
        """The synthetic table, stored in the shared scratch folder."""
        initial, derived = self.plan
        owners = [d.owner for d in self.spec.derived] if self.spec is not None else ["shared"] * len(derived)
        table = self.micro_table(initial)
        for (shared, own), owner in zip(derived, owners):
            other = self.micro_table([*shared, *own])
            if shared:
                order = sorted(shared, key=lambda c: (self._entropy_order[c], c))
                table = stitch(self.ws, table, other, [self._stitch_column(c) for c in order], owner)
            else:
                table = patch(self.ws, table, other)
        if list(table.columns) != list(range(len(self.columns))):
            raise RuntimeError("the clusters do not cover all columns")
        out = self.ws.cut(table.rows.select(*[F.col(f"s{i}").alias(c) for i, c in enumerate(self.columns)]), "synthetic")
        self.ws.release()
        return out

    def _stitch_column(self, c: int) -> StitchColumn:
        root = self.forest.roots[c]
        integral = self.data.columns[c].kind not in ("real", "timestamp")
        return StitchColumn(c, root.lo, root.lo + root.size, integral)


def synthesize(df: DataFrame, config: SynthConfig | None = None, **options) -> DataFrame:
    """Synthetic table for ``df``; see :class:`Synthesizer` for the options."""
    return Synthesizer(df, config, **options).result()


def synthesize_for_target(df: DataFrame, target: str, config: SynthConfig | None = None, *,
                          features_only: bool = False, columns: Sequence[str] | None = None,
                          ids: Sequence[str] = (), **options) -> DataFrame:
    """Synthesis that favours one column: its best features are found first and kept close to it."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    ranking = select_features(df.select(*columns), target)
    if features_only:
        columns = [c for c in columns if c == target or c in ranking.selected]
    return synthesize(df, config, columns=columns, ids=ids, main_column=target,
                      main_features=ranking.selected, **options)


__all__ = ["ClusterSpec", "DerivedCluster", "FeatureRanking", "SynthConfig", "Synthesizer", "synthesize",
           "synthesize_for_target"]
