"""The stages of the corpus pipeline: each takes documents and returns the rows that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import exact_dedup, language as lang, mixing, ngram_join, winnowing

ROW, ID, HASH = "__row", "__id", "__hash"


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows under one column, so that no column of theirs can clash, with id and hash of the text."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(ROW), docs["doc_id"].alias(ID),
                       F.xxhash64(docs["text"]).alias(HASH))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_hash) is not in ``gone``.

    Those that go are few as a rule; the anti-join leaves the adaptive plan free
    to send their keys to the texts.
    """
    keyed, gone = _keyed(docs), gone.select("doc_id", "text_hash").distinct()
    same = keyed[ID].eqNullSafe(gone["doc_id"]) & (keyed[HASH] == gone["text_hash"])
    return keyed.join(gone, same, "left_anti").select(f"{ROW}.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: too few letters or no clear posterior."""
    ws = Workspace(spark)
    model = lang.fit_letters(docs, "text", "lang", "doc_id")
    rows = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_hash"))
    told = lang.identify(ws, rows, model, ["doc_id", "text_hash"], "text", "lang", ["source"])
    return _without(docs, told.where(~F.col("accepted")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each text: that with the largest doc_id."""
    return exact_dedup.unique_rows(docs, exact_dedup.add_batch(exact_dedup.temporary_index(spark), docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each connected group of near copies the document with most n-grams, the smallest doc_id among equals.

    Texts without words are no copies of each other here. Fully repeated rows are
    reduced to one.
    """
    ws = Workspace(spark)
    copies = ngram_join.NgramJoin(ws, docs).members.where("n_grams > 0 and (n_copies > 1 or n_links > 0)")
    copies = copies.groupBy("component", "doc_id", "text_hash").agg(F.max("n_grams").alias("n_grams"), F.count(F.lit(1)).alias("times"))
    rank = F.struct("n_grams", (-F.coalesce("doc_id", F.lit(2**62))).alias("first"), "text_hash")
    best = copies.groupBy(F.col("component").alias("__group")).agg(F.max(rank).alias("best"))
    ranked = ws.cut(copies.join(best, F.col("component") == F.col("__group"))
                    .select("doc_id", "text_hash", "times", (rank == F.col("best")).alias("stays")), "copies")
    repeated = ranked.where("stays and times > 1")
    kept = _without(docs, ranked.where("not stays or times > 1"))
    if repeated.isEmpty():
        return kept
    keyed = _keyed(docs)
    same = keyed[ID].eqNullSafe(repeated["doc_id"]) & (keyed[HASH] == repeated["text_hash"])
    one = keyed.join(repeated, same, "left_semi").dropDuplicates([ID, HASH]).select(f"{ROW}.*")
    return kept.unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, winnowing.contamination(Workspace(spark), docs, benchmark).where("contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target, copies and taken."""
    out = mixing.mixed(Workspace(spark), docs).where("copies > 0")
    extra = ["size", "source_size", "target", "copies", "taken"]
    own = [c for c in docs.columns if c not in extra]
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], *extra)
