"""Typed table to all-double rows: string ranks, column extents, NULL codes and root ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


from ..config import SynthConfig
from ..functions.geometry import binade, exact_label, snap_range
from ..functions.hashing import entity_hash, hash_text
from ..functions.values import kind_of, numeric_code
from ..workspace import Workspace
from .ranking import global_positions

EXACT_INTEGER = float(1 << 53)


@dataclass(frozen=True)
class ColumnInfo:
    """One encoded column: its type and the numbers that define its cell tree."""

    index: int
    name: str
    kind: str
    data_type: T.DataType
    null_code: float
    lo: float
    size: float
    dictionary_size: int = 0

    @property
    def hi(self) -> float:
        return self.lo + self.size


@dataclass(frozen=True)
class Encoded:
    """Encoded rows (v0.., entity columns e0..), the dictionary, and column facts."""

    rows: DataFrame
    columns: tuple[ColumnInfo, ...]
    dictionary: DataFrame
    n_rows: int
    id_kinds: int
    unique_ids: bool

    def with_rows(self, rows: DataFrame, n_rows: int) -> "Encoded":
        return replace(self, rows=rows, n_rows=n_rows)


def null_code(lo: Column, hi: Column) -> Column:
    """A code outside the data: twice the far bound, or 1 when the data is only 0."""
    return F.when(hi > 0, 2.0 * hi).when(lo < 0, 2.0 * lo).otherwise(1.0)


def column_extents(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column of codes: min and max over the values present, (0, 0) if there are none."""
    aggs = [f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(i).alias("column"), F.coalesce(F.col(f"lo_{i}"), F.lit(0.0)).alias("lo"),
                      F.coalesce(F.col(f"hi_{i}"), F.lit(0.0)).alias("hi")) for i in range(len(columns))]
    return one.select(F.inline(F.array(*parts)))


def root_ranges(extents: DataFrame) -> DataFrame:
    """Adds the NULL code and the snapped root range, which always covers the NULL code."""
    coded = extents.withColumn("null_code", null_code(F.col("lo"), F.col("hi")))
    snapped = snap_range(F.least("lo", "null_code"), F.greatest("hi", "null_code"))
    return coded.withColumn("root", snapped).select(
        "column", "lo", "hi", "null_code", F.col("root.lo").alias("root_lo"), F.col("root.size").alias("root_size"))


def string_ranks(ws: Workspace, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Dictionary of all string columns: (name, text, code), code = rank in binary order."""
    pairs = [F.struct(F.lit(c).alias("name"), F.col(c).alias("text")) for c in columns]
    values = df.select(F.inline(F.array(*pairs))).where("text is not null").distinct()
    values = ws.cut(values, "strings")
    placed = global_positions(ws, values, ["name", "text"])
    first = placed.groupBy("name").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "name").select(
        "name", "text", (F.col("position") - F.col("first")).alias("code"))


def row_hash(texts: Sequence[Column]) -> Column:
    """Hash of a row's values; NULL differs from every text."""
    return hash_text(F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), t), F.lit("~")) for t in texts]))


def encode_table(ws: Workspace, df: DataFrame, columns: Sequence[str], ids: Sequence[str], config: SynthConfig,
                 unique_ids: bool | None = None) -> Encoded:
    """Encodes a table once for all later passes.

    Without id columns each row is an entity of its own, known by a hash of its
    values. ``unique_ids`` declares that a single id column never repeats.
    """
    missing = [c for c in [*columns, *ids] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    if not columns:
        raise ValueError("no columns to synthesize")
    unique = (not ids) if unique_ids is None else unique_ids
    if unique and len(ids) > 1:
        raise ValueError("unique ids need exactly one id column")

    types = {f.name: f.dataType for f in df.schema.fields}
    kinds = {c: kind_of(types[c]) for c in columns}
    texts = [c for c in columns if kinds[c] == "string"]
    source = df.select(*dict.fromkeys([*columns, *ids]))

    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("code", T.LongType())])
    dictionary = ws.spark.createDataFrame([], schema)
    if texts:
        dictionary = ws.cut(string_ranks(ws, source, texts), "dictionary")

    direct = [numeric_code(kinds[c], F.col(c)).alias(f"v{i}") if kinds[c] != "string" else F.col(c).alias(f"__t{i}")
              for i, c in enumerate(columns)]
    if ids:
        coded = source.select(*[entity_hash(F.col(c)).alias(f"e{i}") for i, c in enumerate(ids)], *direct)
    else:
        # Equal rows share a hash; the set seed of the tree builder counts each of them. Codes and exponents are columns
        # of their own, because a label that holds their expressions computes them many times.
        coded = source.select(*direct).withColumns({f"__b{i}": binade(F.col(f"v{i}")) for i, c in enumerate(columns) if kinds[c] != "string"})
        coded = coded.withColumn("e0", row_hash([F.col(f"__t{i}") if kinds[c] == "string" else exact_label(F.col(f"v{i}"), F.col(f"__b{i}"))
                                                 for i, c in enumerate(columns)]))
    for i, c in enumerate(columns):
        if kinds[c] == "string":
            ranks = dictionary.where(F.col("name") == c).select(
                F.col("text").alias(f"__t{i}"), F.col("code").cast("double").alias(f"v{i}"))
            coded = coded.join(ranks, f"__t{i}", "left").drop(f"__t{i}")
    names = [f"v{i}" for i in range(len(columns))]
    coded = ws.keep(coded.select(*[f"e{i}" for i in range(max(len(ids), 1))], *names))

    facts = {r["column"]: r for r in root_ranges(column_extents(coded, names)).collect()}
    n_rows = coded.count()
    if n_rows == 0:
        raise ValueError("the table has no rows")
    sizes = {r["name"]: r["n"] for r in dictionary.groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    infos = []
    for i, c in enumerate(columns):
        fact = facts[i]
        if kinds[c] == "integer" and max(abs(fact["lo"]), abs(fact["hi"])) > EXACT_INTEGER:
            raise ValueError(f"integers beyond 2^53 in column {c}")
        infos.append(ColumnInfo(i, c, kinds[c], types[c], fact["null_code"], fact["root_lo"], fact["root_size"],
                                sizes.get(c, 0)))
    filled = coded.select(*[c for c in coded.columns if c.startswith("e")],
                          *[F.coalesce(F.col(f"v{i}"), F.lit(info.null_code)).alias(f"v{i}")
                            for i, info in enumerate(infos)])
    return Encoded(filled, tuple(infos), dictionary, n_rows, max(len(ids), 1), unique)
