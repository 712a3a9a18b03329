"""Typed tables from CSV files with declared or inferred column types, and CSV output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import SPARK_TYPES, TYPE_NAMES, kind_of, parse_text

# Delimiters tried when none is given, and the timestamp form written out.
DELIMITERS = (",", ";", "\t", "|")
TIMESTAMP_OUT = "yyyy-MM-dd HH:mm:ss"


def column_reference(text: str) -> tuple[str, str]:
    """Splits "name:i" into the name and the kind of value."""
    name, _, suffix = text.rpartition(":")
    if not name or suffix not in TYPE_NAMES:
        raise ValueError(f"invalid column reference: {text}")
    return name, TYPE_NAMES[suffix]


def declared_schema(types: Mapping[str, str]) -> T.StructType:
    """Spark schema for {column: type suffix}."""
    unknown = {s for s in types.values() if s not in TYPE_NAMES}
    if unknown:
        raise ValueError(f"unknown type suffixes: {sorted(unknown)}")
    return T.StructType([T.StructField(n, SPARK_TYPES[TYPE_NAMES[s]]) for n, s in types.items()])


def header_types(columns: Sequence[str]) -> dict[str, str]:
    """Types of the columns whose names end in a type suffix, such as "age:i"."""
    return {c: c.rpartition(":")[2] for c in columns if c.rpartition(":")[2] in TYPE_NAMES and ":" in c}


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The known delimiter used most in the first line."""
    head = spark.read.text(path).first()
    line = head[0] if head else ""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def read_text_table(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """All columns as trimmed text; header names without outer blanks and single quotes."""
    raw = (spark.read.option("header", True).option("sep", delimiter or detect_delimiter(spark, path))
           .option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    return raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.strip().strip("'")) for c in raw.columns])


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def read_csv(spark: SparkSession, path: str, types: Mapping[str, str], ids: Sequence[str] = (),
             delimiter: str | None = None) -> DataFrame:
    """Typed scan: declared columns parsed leniently, id columns kept as text."""
    declared_schema(types)
    text = read_text_table(spark, path, delimiter)
    extra = [c for c in ids if c not in types]
    picked = project(text, [*types, *extra])
    return picked.select(*[parse_text(TYPE_NAMES[s], F.col(f"`{c}`")).alias(c) for c, s in types.items()],
                         *[F.col(f"`{c}`") for c in extra])


def read_csv_inferred(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Scan with types taken from the data; only the empty string is NULL.

    A text column whose every value is an ISO 8601 moment becomes a timestamp.
    """
    df = (spark.read.option("header", True).option("sep", delimiter or detect_delimiter(spark, path))
          .option("inferSchema", True).option("nullValue", "").option("nanValue", "\u0000")
          .option("positiveInf", "\u0000").option("negativeInf", "\u0000").option("preferDate", False).csv(path))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        counts = df.agg(*[e for i, c in enumerate(texts) for e in (
            F.count(F.col(f"`{c}`")).alias(f"all{i}"),
            F.count(F.try_to_timestamp(F.col(f"`{c}`"))).alias(f"ok{i}"))]).first()
        moments = [c for i, c in enumerate(texts) if counts[f"all{i}"] and counts[f"all{i}"] == counts[f"ok{i}"]]
        df = df.withColumns({c: F.try_to_timestamp(F.col(f"`{c}`")) for c in moments})
    return df


def column_types(df: DataFrame) -> dict[str, str]:
    """Type suffix of every column of a table."""
    suffix = {name: s for s, name in TYPE_NAMES.items()}
    return {f.name: suffix[kind_of(f.dataType)] for f in df.schema.fields}


def csv_ready(df: DataFrame) -> DataFrame:
    """Text form of every value as written to CSV."""
    out = []
    for f in df.schema.fields:
        value = F.col(f"`{f.name}`")
        kind = kind_of(f.dataType)
        out.append((F.date_format(value, TIMESTAMP_OUT) if kind == "timestamp" else value.cast("string")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header, NULL as an empty field; values with delimiters are quoted."""
    csv_ready(df).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
