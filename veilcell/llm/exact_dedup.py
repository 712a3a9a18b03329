"""Exact duplicates against a persistent digest index.

The index is a table bucketed and sorted by digest. A new batch is reduced to
one row per digest, anti-joined with the index bucket by bucket, and what is new
is appended; the text of the row that stays is never read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BUCKETS = 64
HOT_SHARE = 1000  # a digest is hot from 1/1000 of the rows on, so at most 1000 digests are

DIGEST = "text_sha256"


def digest_of(text: Column) -> Column:
    """SHA-256 of the unchanged text in UTF-8, lower-case hexadecimal; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """Digests already seen and the document that stands for each of them.

    ``table`` names a managed table of the warehouse, which survives the session
    where the catalog does; ``buckets`` is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS):
        self.spark, self.table, self.buckets = spark, table, buckets

    def rows(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.spark.catalog.tableExists(self.table) else None

    def append(self, digests: DataFrame) -> None:
        (digests.select(DIGEST, "keep_id", "group_size", "last_rows").write.mode("append").format("parquet")
         .bucketBy(self.buckets, DIGEST).sortBy(DIGEST).saveAsTable(self.table))


def add_batch(index: DigestIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds the digests of a batch to the index and returns them.

    One row per digest that was new: ``keep_id`` is the largest id of its rows in
    this batch, ``group_size`` their number, ``last_rows`` how many of them carry
    that id. Null ids are smaller than all others. An empty batch adds nothing.
    """
    seen = index.rows()
    sizes = (docs.groupBy(digest_of(F.col(text)).alias(DIGEST), F.col(doc_id).alias("keep_id"))
             .agg(F.count(F.lit(1)).alias("last_rows")))
    batch = (sizes.groupBy(DIGEST)
             .agg(F.sum("last_rows").alias("group_size"),
                  F.max(F.struct("keep_id", "last_rows")).alias("top"))
             .select(DIGEST, "top.keep_id", "group_size", "top.last_rows"))
    if seen is not None:
        batch = batch.hint("merge").join(seen.select(DIGEST), DIGEST, "left_anti")
    # Parts of the write are buckets, so that a bucket gets one sorted file per batch.
    index.append(batch.repartition(index.buckets, DIGEST))
    return index.rows()


def with_group(rows: DataFrame, index_rows: DataFrame) -> DataFrame:
    """Joins rows that carry a digest to the index.

    Digests with over a thousandth of all rows, a thousand at most, are
    broadcast; the others are merge-joined, where no key is hot any more.
    """
    total = index_rows.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") * HOT_SHARE > F.lit(int(total))
    large = index_rows.where(hot & (F.col("group_size") > 1))
    rest = index_rows.where(~(hot & (F.col("group_size") > 1)))
    marked = rows.join(F.broadcast(large.withColumnRenamed(DIGEST, "__digest")),
                       F.col(DIGEST) == F.col("__digest"), "left")
    found = marked.where(F.col("__digest").isNotNull()).drop("__digest")
    other = marked.where(F.col("__digest").isNull()).select(*rows.columns)
    return found.unionByName(other.hint("merge").join(rest, DIGEST, "left").select(*found.columns))


def verdicts(docs: DataFrame, index_rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal text the one with the largest id is kept; of repeated rows
    with that id exactly one. Null texts count as empty, null ids as smallest. If
    the digest came with an earlier batch, no row of this one is kept unless it
    is that row again.
    """
    # Repeated (id, text) rows travel as one row with a count and part again after the join.
    rows = (docs.select(F.col(doc_id).alias("doc_id"), digest_of(F.col(text)).alias(DIGEST))
            .groupBy("doc_id", DIGEST).agg(F.count(F.lit(1)).alias("__times")))
    joined = with_group(rows, index_rows)
    return (joined.withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
            .select("doc_id", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__nth") == 1)).alias("kept"), DIGEST))


def unique_rows(docs: DataFrame, index_rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The whole rows that stay, with all their columns.

    Fully repeated rows of the id that stays are reduced to one of them.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in names]).alias("__row"), docs[doc_id].alias("__id"),
                        digest_of(docs[text]).alias("__digest"))
    winners = index_rows.select(F.col(DIGEST).alias("__digest"), F.col("keep_id").alias("__keep"), "last_rows")
    kept = keyed.join(winners, (F.col("__id").eqNullSafe(F.col("__keep"))) & (keyed["__digest"] == winners["__digest"]))
    kept = kept.select("__row", keyed["__digest"].alias("__digest"), "last_rows")
    single = kept.where("last_rows = 1").select("__row.*")
    tied = kept.where("last_rows > 1").dropDuplicates(["__digest"]).select("__row.*")
    return single.unionByName(tied)


def temporary_index(spark: SparkSession) -> DigestIndex:
    """An index of its own for one run."""
    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}")


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return verdicts(docs, add_batch(temporary_index(spark), docs))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
