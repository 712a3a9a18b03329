"""Synthetic rows from buckets: one row per count, each field drawn from its range and decoded."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import unit_draw
from ..functions.values import common_prefix, decode_number, decode_value
from .encoding import ColumnInfo, Encoded
from .harvest import Harvest, expand_counts


def draw_in_range(lo: Column, hi: Column, u: Column) -> Column:
    return lo + u * (hi - lo)


def range_texts(dictionary: DataFrame, ranges: DataFrame, info: ColumnInfo) -> DataFrame:
    """Text of each string range (lo, hi): the value itself, or the prefix its two ends share and a star."""
    last = F.lit(float(max(info.dictionary_size - 1, 0)))
    words = dictionary.where(F.col("name") == info.name)
    low = words.select(F.col("code").alias("lo_code"), F.col("text").alias("lo_text"))
    high = words.select(F.col("code").alias("hi_code"), F.col("text").alias("hi_text"))
    coded = (ranges.withColumn("lo_code", F.least("lo", last).cast("bigint"))
             .withColumn("hi_code", F.least("hi", last).cast("bigint")))
    found = coded.join(low, "lo_code").join(high, "hi_code")
    prefix = F.concat(common_prefix(F.col("lo_text"), F.col("hi_text")), F.lit("*"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo_text")).otherwise(prefix)
    return found.select("lo", "hi", text.alias("text"))


def decoded_field(info: ColumnInfo, lo: Column, hi: Column, u: Column, text: Column | None) -> tuple[Column, Column]:
    """Value and numeric code of one field; a range that starts at the NULL code gives NULL."""
    null = lo == F.lit(info.null_code)
    code = draw_in_range(lo, hi, u)
    if info.kind == "string":
        value = F.when(lo == hi, text).otherwise(F.concat(text, code.cast("bigint").cast("string")))
        number = F.when(lo == hi, lo).otherwise(decode_number("string", code))
    else:
        value = decode_value(info.kind, code, info.data_type)
        number = decode_number(info.kind, code)
    return F.when(~null, value), F.when(null, lo).otherwise(number)


def bucket_rows(buckets: DataFrame, columns: Sequence[ColumnInfo], dictionary: DataFrame, stream: str) -> DataFrame:
    """Rows of a positioned bucket table: pos, one value column s<i> and one code column n<i> per column."""
    for d, info in enumerate(columns, 1):
        if info.kind == "string":
            ranges = buckets.select(F.col(f"lo{d}").alias("lo"), F.col(f"hi{d}").alias("hi")).distinct()
            texts = range_texts(dictionary, ranges, info).withColumnsRenamed(
                {"lo": f"lo{d}", "hi": f"hi{d}", "text": f"text{d}"})
            buckets = buckets.join(texts, [f"lo{d}", f"hi{d}"], "left")
    rows = expand_counts(buckets, ["pos_first"], "pos_first", "pos_end", "pos")
    fields = []
    for d, info in enumerate(columns, 1):
        u = unit_draw(F.col("pos"), F.lit(f"{stream}:{info.index}"))
        text = F.col(f"text{d}") if info.kind == "string" else None
        value, code = decoded_field(info, F.col(f"lo{d}"), F.col(f"hi{d}"), u, text)
        fields += [value.alias(f"s{info.index}"), code.alias(f"n{info.index}")]
    return rows.select("pos", *fields)


def microdata(harvest: Harvest, data: Encoded, combo: Sequence[int]) -> DataFrame:
    """Synthetic rows of one column subset; pos numbers them 0, 1, .. without gaps."""
    combo = tuple(sorted(combo))
    infos = [data.columns[c] for c in combo]
    return bucket_rows(harvest.final(combo), infos, data.dictionary, "-".join(map(str, combo)))
