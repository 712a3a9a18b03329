import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilcell.llm import stages

from .helpers import documents, odd_rows
from .test_ngram_join import expected as near
from .test_winnowing import judged

FOLDER = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark, ws):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = ws.cut(stage(spark, before, FOLDER), name)
        rows, left = ({r.doc_id: r for r in df.collect()} for df in (before, after))
        assert left and set(left) <= set(rows)
        if name == "language_id":
            assert len(left) >= 0.97 * len(rows)
        if name == "exact_dedup":
            assert set(left) == {max(d for d, r in rows.items() if r.text == t) for t in {r.text for r in rows.values()}}
        if name == "ngram_join":
            classes = {}
            for d, c, *_ in near([(d, r.text, None) for d, r in rows.items()]):
                classes.setdefault(c, []).append(d)
            assert sorted(sum(d in left for d in c) for c in classes.values()) == [1] * len(classes)
        if name == "decontamination":
            assert set(left) == {d for d, r in rows.items() if not judged(r.text, benchmark)[3]}
        if name == "mixing":
            targets = {r.source: r.target for r in left.values()}
            assert sum(r.taken for r in left.values()) == pytest.approx(sum(targets.values()), rel=0.01)
            assert set(columns) <= set(after.columns)
        else:
            assert after.columns == columns
        assert all(left[d][c] == rows[d][c] for d in left for c in columns)
        before = after


@pytest.mark.parametrize("rows", [odd_rows(), []])
def test_stages_take_odd_rows(spark, rows):
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, FOLDER)
        assert got.columns == docs.columns or name == "mixing"
        assert got.count() <= len(rows)


def test_repeated_rows_become_one(spark):
    docs = documents(spark, [(1, "one two three four five six", "a")] * 4 + [(2, "one two three four five six", "a"), (3, None, "a"), (3, None, "a")])
    assert sorted(r.doc_id for r in stages.near_duplicates(spark, docs, FOLDER).collect()) == [1, 3, 3]
    assert sorted(r.doc_id for r in stages.exact_duplicates(spark, docs, FOLDER).collect()) == [2, 3]


@pytest.mark.parametrize("ids", [(None,) * 4, (7,) * 4, (None, 7, None, 7)])
def test_groups_without_own_ids_keep_one_each(spark, ids):
    texts = [" ".join(f"{name}{i}" for i in range(60)) + end for name in ("red", "blue") for end in ("", " end")]
    docs = documents(spark, [(d, t, "a") for d, t in zip(ids, texts, strict=True)])
    left = [r.text for r in stages.near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(t.split("0")[0] for t in left) == ["blue", "red"]


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.where(F.col("taken") > 2 * F.col("size")).count() == 0 < got.count()
