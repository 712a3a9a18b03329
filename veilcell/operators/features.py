"""Features that best predict a target column: recursive elimination over decision trees."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import OneHotEncoder, RobustScaler, StringIndexer, VarianceThresholdSelector, VectorAssembler, VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORY_LIMIT, VARIANCE_LIMIT
from ..functions.values import kind_of, numeric_code

FOLDS = 5
DEPTH = 30  # the deepest trees that Spark ML grows
SEPARATOR = "$$"
TASK_ROWS = 20_000  # rows alike in a task that grows trees, at least


@dataclass(frozen=True)
class FeatureRanking:
    """Source columns from best to worst; the first ``k`` are worth using."""

    valid: bool
    features: list[str] = field(default_factory=list)
    k: int = 0
    scores: list[float] = field(default_factory=list)
    deviations: list[float] = field(default_factory=list)
    encoded: "FeatureRanking | None" = None

    @property
    def selected(self) -> list[str]:
        return self.features[:self.k]

    def table(self, spark) -> DataFrame:
        rows = [(i, f, self.scores[i], self.deviations[i], i < self.k) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "rank int, column string, score double, score_std double, selected boolean")


def column_roles(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """categorical (few values), text, or continuous, from one pass over the table."""
    counts = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    roles = {}
    for i, c in enumerate(columns):
        if counts[f"d{i}"] <= CATEGORY_LIMIT:
            roles[c] = "categorical"
        else:
            roles[c] = "text" if kind_of(df.schema[c].dataType) == "string" else "continuous"
    return roles


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without NULLs, timestamps as seconds since 1800."""
    moments = {f.name: numeric_code("timestamp", F.col(f.name)) for f in df.schema.fields
               if kind_of(f.dataType) == "timestamp"}
    return df.dropna().withColumns(moments) if moments else df.dropna()


def encode_features(df: DataFrame, columns: Sequence[str], roles: dict[str, str], one_hot: bool = False
                    ) -> tuple[DataFrame, list[str], dict[str, str]]:
    """Adds a vector column "features"; gives its slot names and the source column of each slot.

    Text gets a hash-ordered index, categories an ordinal index or one slot per
    value, numbers are centred and scaled by their quartiles. Near-constant slots go.
    """
    encode, names, source = fit_features(df, columns, roles, one_hot)
    return encode(df), names, source


def fit_features(df: DataFrame, columns: Sequence[str], roles: dict[str, str], one_hot: bool = False
                 ) -> tuple[Callable[[DataFrame], DataFrame], list[str], dict[str, str]]:
    """The encoding of :func:`encode_features`, learned from all rows, as a function of any rows of these columns."""
    stages, inputs, names, source, readable = [], [], [], {}, {}
    for i, c in enumerate(columns):
        if roles[c] == "text":
            # A position in hash order: unrelated to the order of the texts, and no dictionary is needed.
            readable[f"__f{i}"] = F.pmod(F.xxhash64(F.col(c)), F.lit(1 << 31)).cast("double")
        elif roles[c] == "categorical":
            readable[f"__c{i}"] = F.col(c).cast("string")
            stages.append(StringIndexer(inputCol=f"__c{i}", outputCol=f"__f{i}", stringOrderType="alphabetAsc"))
            if one_hot:
                stages.append(OneHotEncoder(inputCol=f"__f{i}", outputCol=f"__h{i}", dropLast=False))
        else:
            readable[f"__n{i}"] = F.col(c).cast("double")
            stages += [VectorAssembler(inputCols=[f"__n{i}"], outputCol=f"__v{i}"),
                       RobustScaler(inputCol=f"__v{i}", outputCol=f"__f{i}", withCentering=True)]
        inputs.append(f"__h{i}" if one_hot and roles[c] == "categorical" else f"__f{i}")
    work = df.withColumns(readable)
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="__all")]).fit(work)
    labels = {s.getInputCol(): s.labels for s in model.stages if hasattr(s, "labels")}
    for i, c in enumerate(columns):
        slots = [f"{c}{SEPARATOR}{v}" for v in labels[f"__c{i}"]] if one_hot and roles[c] == "categorical" else [c]
        names += slots
        source.update(dict.fromkeys(slots, c))
    varied = VarianceThresholdSelector(featuresCol="__all", outputCol="features",
                                       varianceThreshold=VARIANCE_LIMIT).fit(model.transform(work))
    return lambda rows: varied.transform(model.transform(rows.withColumns(readable))), [names[i] for i in varied.selectedFeatures], source


def _eliminate(train: DataFrame, slots: int, estimator, stop: int):
    """Drops the least important slot again and again; yields the slots alive and the fitted model."""
    alive = list(range(slots))
    while True:
        sliced = VectorSlicer(inputCol="features", outputCol="chosen", indices=alive)
        model = estimator.fit(sliced.transform(train))
        yield list(alive), sliced, model
        if len(alive) <= stop:
            return
        weight = model.featureImportances.toArray()
        alive.pop(min(range(len(alive)), key=lambda i: (weight[i], i)))


def _alike(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that no tree can tell apart as one: their number, and mean, spread and bounds of their labels.

    A tree splits by sums of labels and their squares. What the squares of rows
    alike have beyond those of their mean stays with them on any side of any
    split, so gains and predictions are those of the single rows.
    """
    label = F.col("__label")
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("__weight"), F.avg(label).alias("__mean"),
                                    F.var_pop(label).alias("__spread"), F.min(label).alias("__lo"), F.max(label).alias("__hi"))
    mean = F.greatest("__lo", F.least("__hi", "__mean"))  # equal labels keep their value
    return found.withColumns({"__mean": mean, "__spread": F.col("__spread") * F.col("__weight")})


def _over_folds(alike: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows alike of several folds as one; unless the label is a key, a tree learns their mean."""
    found = alike.groupBy(*keys).agg(F.sum("__weight").alias("__weight"), F.sum(F.col("__weight") * F.col("__mean")).alias("__total"),
                                     F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    if "__label" in keys:
        return found
    return found.withColumn("__label", F.greatest("__lo", F.least("__hi", F.col("__total") / F.col("__weight"))))


def _explained(test: DataFrame) -> Callable[[DataFrame], float]:
    """Gives r2 of predictions for rows alike, as of the single rows."""
    weight = F.col("__weight")
    facts = test.agg(F.sum(weight).alias("rows"), F.sum(weight * F.col("__mean")).alias("total"),
                     F.min("__lo").alias("lo"), F.max("__hi").alias("hi")).first()

    def squares(df: DataFrame, about: Column) -> float:
        return df.agg(F.sum(F.col("__spread") + weight * F.pow(F.col("__mean") - about, F.lit(2.0)))).first()[0]

    varied = squares(test, F.lit(facts["total"] / facts["rows"])) if facts["lo"] < facts["hi"] else 0.0

    def r2(predicted: DataFrame) -> float:
        missed = squares(predicted, F.col("prediction"))
        if varied == 0:
            return float("-inf") if missed > 0 else float("nan")
        return 1 - missed / varied

    return r2


def select_features(df: DataFrame, target: str, one_hot: bool = False, folds: int = FOLDS,
                    depth: int = DEPTH) -> FeatureRanking:
    """Ranks the other columns by how well decision trees predict the target from them.

    The number of features comes from cross-validation, the ranking from an
    elimination over all rows. ``depth`` bounds the trees. The trees are grown on
    rows alike, each weighted by its number: few, where the columns hold few values.
    """
    rows = complete_rows(df)
    columns = [c for c in df.columns if c != target]
    if target not in df.columns:
        raise ValueError(f"column not found: {target}")
    if rows.isEmpty() or not columns:
        return FeatureRanking(False, encoded=FeatureRanking(False))
    roles = column_roles(rows, [*columns, target])
    encode, names, source = fit_features(rows, columns, roles, one_hot)
    label = F.col(target)
    by = []
    if roles[target] == "categorical":
        rows = rows.withColumn("__target", label.cast("string"))
        labelled = StringIndexer(inputCol="__target", outputCol="__label").fit(rows).transform(rows)
        estimator = DecisionTreeClassifier(featuresCol="chosen", labelCol="__label", weightCol="__weight", maxDepth=depth, seed=1)
        by = ["__label"]
    else:
        number = (F.pmod(F.xxhash64(label), F.lit(1 << 31)) if roles[target] == "text" else label).cast("double")
        labelled = rows.withColumn("__label", number)
        estimator = DecisionTreeRegressor(featuresCol="chosen", labelCol="__label", weightCol="__weight", maxDepth=depth, seed=1)
    if not names:
        raise ValueError("no feature varies")
    if len(names) == 1:
        single = FeatureRanking(False, names, 1, [0.0], [0.0])
        return FeatureRanking(False, [source[names[0]]], 1, [0.0], [0.0], single)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy", labelCol="__label", weightCol="__weight")
    fold = F.pmod(F.xxhash64(*columns, target), F.lit(folds))
    alike = _alike(labelled.withColumn("__fold", fold), [*columns, *by, "__fold"]).persist()
    try:
        # A level of a tree is one pass over few rows: the passes should not cost more than the rows.
        tasks = max(1, math.ceil(alike.count() / TASK_ROWS))
        scores: dict[int, list[float]] = {}

        def training(rows: DataFrame) -> DataFrame:
            return encode(_over_folds(rows, [*columns, *by]).coalesce(tasks)).select("features", "__weight", "__label").persist()

        for f in range(folds):
            train = training(alike.where(F.col("__fold") != f))
            test = encode(alike.where(F.col("__fold") == f).coalesce(tasks))
            if test.isEmpty() or train.isEmpty():
                train.unpersist()
                continue
            judge = accuracy.evaluate if by else _explained(test)
            for alive, slicer, model in _eliminate(train, len(names), estimator, 1):
                scores.setdefault(len(alive), []).append(judge(model.transform(slicer.transform(test))))
            train.unpersist()
        sizes = sorted(scores)
        means = [sum(scores[n]) / len(scores[n]) for n in sizes]
        spread = [(sum((s - m) ** 2 for s in scores[n]) / len(scores[n])) ** 0.5 for n, m in zip(sizes, means)]
        best = sizes[max(range(len(sizes)), key=lambda i: (means[i], -sizes[i]))]
        rank = [1] * len(names)
        last = None
        whole = training(alike)
        for alive, _, _ in _eliminate(whole, len(names), estimator, best):
            if last is not None:
                gone = (set(last) - set(alive)).pop()
                rank[gone] = len(last) - best + 1
            last = alive
        whole.unpersist()
    finally:
        alike.unpersist()
    order = sorted(range(len(names)), key=lambda i: (rank[i], i))
    encoded = FeatureRanking(True, [names[i] for i in order], best, means, spread)
    return by_column(df.sparkSession, encoded, source)


def by_column(spark, slots: FeatureRanking, source: dict[str, str]) -> FeatureRanking:
    """The ranking of source columns that follows from a ranking of slots.

    A column stands where its first slot stands and scores what the ranking
    scores at the end of the unbroken run of its slots there.
    """
    rows = [(i, source[slot], slots.scores[i], slots.deviations[i]) for i, slot in enumerate(slots.features)]
    table = spark.createDataFrame(rows, "at int, column string, score double, deviation double")
    mine = Window.partitionBy("column").orderBy("at")
    # Inside a run the position and the number among the column's own slots rise together.
    runs = table.withColumn("run", F.col("at") - F.row_number().over(mine)).withColumn("first", F.min("at").over(Window.partitionBy("column")))
    columns = (runs.where("run = first - 1").groupBy("column", "first")
               .agg(F.max_by(F.struct("score", "deviation"), "at").alias("end")).orderBy("first").collect())
    return FeatureRanking(True, [r.column for r in columns], sum(r["first"] < slots.k for r in columns), [r.end.score for r in columns],
                          [r.end.deviation for r in columns], slots)
