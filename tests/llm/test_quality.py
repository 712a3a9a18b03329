import pytest
from pyspark.sql import functions as F

from veilcell.llm import quality as ql

from .helpers import documents, odd_rows

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = ql.op2_quality(spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert got.where("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.7)").count() == 0
    held = got.join(labels, "doc_id").where("held_out")
    assert held.where("predicted = quality").count() >= 0.93 * held.count()


def test_held_out_labels_are_never_used(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(ql.fold_of(F.col("doc_id")) == ql.HELD_OUT, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ql.fit(docs, labels), ql.fit(docs, turned)
    assert a.good == b.good and a.bad == b.bad and (a.weights == b.weights).all() and a.prior == b.prior


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = ql.fit(docs, none)
    assert [r.score for r in ql.scored(docs, model).collect()] == [0.5] * len(odd_rows())
    some = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (4, 1, 1), (4, 0, 1), (99, 0, 0)], none.schema)
    assert ql.fit(docs, some).weights is None
    trained = ql.fit(*(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")))
    scores = [r.score for r in ql.scored(docs, trained).collect()]
    assert len(scores) == len(odd_rows()) and all(0 <= s <= 1 for s in scores)
    assert ql.scored(documents(spark, []), trained).count() == 0


@pytest.mark.parametrize("length", [0, 1, ql.PIECE_BYTES, 3 * ql.PIECE_BYTES + 1])
def test_pieces_cover_the_text(length):
    data = bytes(i % 251 for i in range(length))
    assert b"".join(ql._pieces(data)) == data
