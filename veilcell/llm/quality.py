"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained on labelled text. A document is compressed
with each of them and without any, in pieces so that every part of a long text
meets the dictionary afresh; the difference of the two sizes per byte, and how
far the text shrinks by itself, are calibrated to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import slices, text_bytes

SAMPLE_ROWS = 1500  # per class, half for the dictionaries and half for the calibration
SAMPLE_CHARACTERS = 20_000  # of each, from its start; bounds what the driver holds
DICTIONARY_BYTES = 64 << 10
PIECE_BYTES = 1 << 11
LEVEL = 3
THRESHOLD = 0.7
HELD_OUT = 2


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


class CompressionModel:
    """Dictionaries and the calibration on top of them; plain data that travels to the tasks."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None, prior: float):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: size difference, plain compressed size and its own repetition, all per byte, and a constant."""
        import zstandard

        def compressor(dictionary: bytes | None):
            options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
            if dictionary:
                data = zstandard.ZstdCompressionDict(dictionary)
                data.precompute_compress(level=LEVEL)
                options["dict_data"] = data
            return zstandard.ZstdCompressor(**options)

        good, bad, plain = compressor(self.good), compressor(self.bad), compressor(None)
        data, offsets = text_bytes(texts)
        view = memoryview(np.ascontiguousarray(data))
        out = np.zeros((len(texts), 4))
        out[:, 3] = 1.0
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if a == b:
                continue
            sizes = [0, 0, 0]
            for start in range(a, b, PIECE_BYTES):
                piece = view[start:min(b, start + PIECE_BYTES)]
                for k, c in enumerate((good, bad, plain)):
                    sizes[k] += len(c.compress(piece))
            n = b - a
            out[i, :3] = (sizes[1] - sizes[0]) / max(sizes[0], sizes[1]), sizes[0] / n, sizes[2] / n
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        features = self.features(texts)
        empty = features[:, 2] == 0
        return np.where(empty, self.prior, 1 / (1 + np.exp(-np.clip(_expanded(features) @ self.weights, -30, 30))))


def _expanded(features: np.ndarray) -> np.ndarray:
    x = features[:, :3]
    return np.column_stack([features, x * x, x[:, [0]] * x[:, [1]], x[:, [0]] * x[:, [2]]])


def calibrate(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton's steps; ``weights`` bring the classes to their share of all labelled rows."""
    x = _expanded(features)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (labels - p)) - penalty * w
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + (penalty + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> CompressionModel:
    """Fits on about ``rows`` labelled documents of each class, drawn by hash outside the held-out fold.

    Rows without label or text are left out; several labels of a document count
    by their largest. With one class only, every score is the share of label 1 (or
    0.5 without labels).
    """
    import zstandard

    known = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    sizes = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2) if sizes else 0.5
    # Drawn by hash below the share of each class that gives ``rows``: no sort, and as many at any size.
    share = F.when(F.col("quality") == 1, rows / max(1, sizes.get(1, 0))).otherwise(rows / max(1, sizes.get(0, 0)))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) < share * float(1 << 40)).limit(4 * rows)
    # About 2 * rows ids, 4 * rows at most: small enough to send, so the texts are not shuffled.
    sample = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0)
              .select("doc_id", "quality", F.substring("text", 1, SAMPLE_CHARACTERS).alias("text")).collect())
    sample = sorted({(r.doc_id, r.quality, r.text) for r in sample})
    good, bad = ([t for _, q, t in sample if q == k] for k in (1, 0))
    if min(len(good), len(bad)) < 8:
        return CompressionModel(b"", b"", None, prior)

    def dictionary(texts: list[str]) -> bytes:
        pieces = [p for t in texts[::2] for p in _pieces(t.encode())]
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: its end serves as raw content
            return b"".join(pieces)[-DICTIONARY_BYTES:]

    model = CompressionModel(dictionary(good), dictionary(bad), None, prior)
    rest = good[1::2] + bad[1::2]
    truth = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    share = np.where(truth == 1, prior / max(1, truth.sum()), (1 - prior) / max(1, (1 - truth).sum())) * len(truth)
    model.weights = calibrate(model.features(pa.array(rest, pa.string())), truth, share)
    return model


def _pieces(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(model.scores(texts[a:b]))], names=["doc_id", "score"])
    return run


def scored(docs: DataFrame, model: CompressionModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; empty and null texts get the share of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text)).mapInArrow(_score(shared), f"doc_id {kind}, score double")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return (scored(docs, fit(docs, labels))
            .select("doc_id", (fold_of(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
