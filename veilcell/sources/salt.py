"""Salt for the noise, derived from the table itself."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_digests(df: DataFrame) -> DataFrame:
    """60-bit SHA-256 digest of every row; NULL and the empty string differ."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in sorted(df.columns)]
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *marked), 256), 1, 15), 16, 10)
    return df.select(digest.cast("bigint").alias("digest"))


def content_digest(df: DataFrame) -> DataFrame:
    """One row (digest, rows): order-free digest of the content; a second, squared sum keeps repeated rows apart."""
    parts = row_digests(df).select("digest", F.expr("pmod(digest, 1048573)").alias("small"))
    return parts.agg(F.coalesce(F.bit_xor("digest"), F.lit(0)).alias("digest"),
                     F.coalesce(F.sum("small"), F.lit(0)).alias("weight"), F.count(F.lit(1)).alias("rows"))


def content_salt(df: DataFrame) -> str:
    one = content_digest(df).first()
    return hashlib.sha256(f"{one['digest']}:{one['weight']}:{one['rows']}".encode()).hexdigest()
