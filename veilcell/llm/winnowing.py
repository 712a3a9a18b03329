"""Benchmark decontamination by winnowing.

From every window of w consecutive k-gram hashes the smallest is kept. Two texts
that share t = w + k - 1 words share at least one kept hash, so a join of kept
hashes finds every pair of a document and an item with a common window; the hits
are then extended word by word over the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from .texts import gram_hashes, mix, slices, word_hashes

SPAN = 13  # words of a window
GRAM = 5  # words of a winnowed gram
SHARE = 20  # a document is contaminated when at least one word in 20 is hit
BROADCAST_ROWS = 500_000  # fingerprints of 16 bytes that are sent to every task; more are joined by shuffle


def spans_of(length: int) -> tuple[int, int]:
    """Gram length and window for shared spans of ``length`` words."""
    gram = min(GRAM, length)
    return gram, length - gram + 1


def _kept_hashes(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, kept hash) of the texts with at least ``length`` words."""
    gram, window = spans_of(length)
    grams = gram_hashes(words, gram)
    n = len(grams) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, have = grams, 1  # minimum over ``have`` grams; doubling reaches the window in a few passes
    while have < window:
        step = min(have, window - have)
        low = np.minimum(low[:len(low) - step], low[step:])
        have += step
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    own = text[:n] == text[length - 1:length - 1 + n]  # the span ends in the text in which it begins
    text, low = text[:n][own], low[:n][own]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
    return text[new], mix(low[new] ^ np.uint64(length))


def _fingerprints(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                words, bounds = word_hashes(texts[a:b])
                for length in lengths:
                    text, kept = _kept_hashes(words, bounds, length)
                    yield pa.RecordBatch.from_arrays(
                        [ids[a:b].take(pa.array(text)), pa.array(kept.view(np.int64))], names=["id", "fingerprint"])
    return run


def fingerprints(rows: DataFrame, key: str, text: str, lengths: tuple[int, ...]) -> DataFrame:
    """(id, fingerprint) of all texts, for shared spans of the given numbers of words."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(_fingerprints(lengths), f"id {kind}, fingerprint bigint")


def _item_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(1)):
            words, bounds = word_hashes(batch.column(1)[a:b])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists, pa.array(np.diff(bounds))],
                                             names=["item_id", "words", "n"])


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of all documents; for those with candidates the words and items hit."""
    for batch in batches:
        texts, candidates = batch.column(2), batch.column(3)
        for a, b in slices(texts):
            words, bounds = word_hashes(texts[a:b])
            hits, found = np.zeros(b - a, np.int64), [[] for _ in range(b - a)]
            for i in range(b - a):
                if candidates[a + i].is_valid:
                    own = words[bounds[i]:bounds[i + 1]]
                    hits[i], found[i] = covered(own, candidates[a + i].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(bounds)), pa.array(hits),
                 pa.array(found, pa.list_(pa.string()))], names=["doc_id", "text_hash", "n_words", "n_hit", "items"])


def covered(words: np.ndarray, items: list[dict]) -> tuple[int, list[str]]:
    """Number of words inside windows of the items, and the items of which a window occurs."""
    change = np.zeros(len(words) + 1, np.int64)
    found, grams = [], {}
    for item in items:
        theirs = np.array(item["words"], np.int64).view(np.uint64)
        length = min(SPAN, len(theirs))
        if not length or len(words) < length:
            continue
        if length not in grams:
            grams[length] = gram_hashes(words, length)
        at = np.flatnonzero(np.isin(grams[length], gram_hashes(theirs, length)))
        if len(at):
            found.append(item["item_id"])
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
    return int((np.cumsum(change[:-1]) > 0).sum()), sorted(found)


def contamination(ws: Workspace, docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items, contaminated.

    Null and empty texts have no words and are clean; items without words are
    never found; repeated items count one each by their id, null ids not at all.
    Documents that share an id are judged each by its own text.
    """
    items = ws.cut(benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item_id"), item_text)
                   .mapInArrow(_item_facts, "item_id string, words array<bigint>, n bigint").where("n > 0"), "items")
    # At most 13 lengths: that of a window and those of shorter items.
    lengths = sorted(r[0] for r in items.select(F.least("n", F.lit(SPAN))).distinct().collect())
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    if not lengths:
        return _shaped(docs.withColumn("items", F.lit(None).cast("array<struct<item_id:string,words:array<bigint>>>")))
    theirs = ws.cut(_by_length(benchmark, item_id, item_text, lengths), "fingerprints")
    small = theirs.count() <= BROADCAST_ROWS
    ours = fingerprints(docs, "doc_id", "text", tuple(lengths))
    theirs = theirs.withColumnRenamed("id", "item_id")
    pairs = (ours.join(F.broadcast(theirs) if small else theirs, "fingerprint")
             .select(F.col("id").alias("doc_id"), "item_id").distinct())
    # A document meets each item once, with the words of the item.
    listed = (pairs.join(items.dropDuplicates(["item_id", "words"]).select("item_id", "words"), "item_id")
              .groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "words")).alias("items")))
    return _shaped(docs.join(listed.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")), "left")
                   .select("doc_id", "text_hash", "text", "items"))


def _by_length(benchmark: DataFrame, item_id: str, text: str, lengths: list[int]) -> DataFrame:
    """Fingerprints of items: of each for its own length only, as its windows have that many words."""
    rows = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    sized = rows.mapInArrow(_item_fingerprints, "id string, fingerprint bigint")
    return sized.distinct()


def _item_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words, bounds = word_hashes(batch.column(1)[i:i + 1])
            if len(words):
                _, kept = _kept_hashes(words, bounds, min(SPAN, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(kept), pa.string()), pa.array(kept.view(np.int64))],
                    names=["id", "fingerprint"])


def _shaped(joined: DataFrame) -> DataFrame:
    kind = joined.schema["doc_id"].dataType.simpleString()
    judged = joined.mapInArrow(_extend, f"doc_id {kind}, text_hash bigint, n_words bigint, n_hit bigint, items array<string>")
    return judged.select("doc_id", "text_hash", "n_words", "n_hit", F.size(F.array_distinct("items")).cast("bigint").alias("n_items"),
                         F.array_sort(F.array_distinct("items")).alias("items"),
                         ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    return (contamination(Workspace(spark), docs, benchmark)
            .select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"))
