import pytest
from dataclasses import replace

from pyspark.sql import functions as F

from tests import fixtures as fx
from veilcell import ClusterSpec, DerivedCluster, Interval, SynthConfig, Synthesizer, synthesize
from veilcell.operators import clustering as cl
from veilcell.operators.encoding import encode_table
from veilcell.operators.features import encode_features, select_features
from veilcell.operators.sampling import sample_rows
from veilcell.sources import tables
from veilcell.sources.salt import content_salt


def people(spark, rows=1500):
    return spark.range(rows).selectExpr(
        "id % 3 as kind", "id % 3 * 100 + id * 7 % 50 as score", "concat('c', id % 4) as city",
        "if(id % 11 = 0, null, id * 13 % 40) as age", "timestamp'2024-01-01' + make_interval(0,0,0,cast(id % 90 as int)) as day")


def test_configuration_is_checked():
    for bad in (dict(low_threshold=1), dict(noise_sd=-1.0), dict(sample_size=0)):
        with pytest.raises(ValueError):
            SynthConfig(**bad)
    with pytest.raises(ValueError):
        Interval(3, 2)
    with pytest.raises(ValueError):
        DerivedCluster(("a",), owner="both")
    with pytest.raises(ValueError):
        ClusterSpec(("a",), (DerivedCluster(("b",), ("x",)),)).validate(["a", "b"])
    with pytest.raises(ValueError):
        ClusterSpec(("a",)).validate(["a", "b"])


def test_missing_columns_are_errors(spark):
    with pytest.raises(ValueError):
        synthesize(spark.range(5).toDF("a"), SynthConfig(salt="s"), columns=["a", "b"])
    with pytest.raises(ValueError):
        Synthesizer(spark.range(5).toDF("a"), SynthConfig(salt="s"), main_features=["a"])


def test_manual_clusters_and_types(spark):
    df = people(spark)
    spec = ClusterSpec(("kind", "score"), (DerivedCluster(("age",), ("kind",)), DerivedCluster(("city",)), DerivedCluster(("day",))))
    out = synthesize(df, replace(SynthConfig(salt="s"), clustering=True), clusters=spec)
    assert out.schema.simpleString() == df.schema.simpleString()
    rows = out.collect()
    assert abs(len(rows) - 1500) < 40
    nulls = sum(r.age is None for r in rows) / len(rows)
    assert abs(nulls - 1 / 11) < 0.03
    assert {r.city for r in rows} == {"c0", "c1", "c2", "c3"}
    assert sum(r.kind * 100 <= r.score < r.kind * 100 + 50 for r in rows) > 0.95 * len(rows)


def test_cluster_search_end_to_end(spark):
    df = people(spark, 800).drop("day", "age")
    run = Synthesizer(df, SynthConfig(salt="s", max_cluster_weight=8.0, search_candidates=50))
    report = {(r.column_x, r.column_y): r.dependence for r in run.dependence_report().collect()}
    assert report["kind", "kind"] == 1.0 and report["kind", "score"] == report["score", "kind"] > report["kind", "city"]
    assert {r.name for r in run.cluster_report().collect()} == set(df.columns)
    assert abs(run.result().count() - 800) < 40


def planned(spark, inputs, order):
    row = cl.score_orders(spark.createDataFrame([(0, order)], "candidate bigint, ordering array<int>"), inputs).first()
    initial, *derived = row.plan
    return (list(initial.members), [(list(p.stitch), list(p.members)) for p in derived]), row.quality


def test_assignment_follows_dependence_and_weight(spark):
    matrix = ((1, .9, .0, .5), (.9, 1, .0, .2), (.0, .0, 1, .0), (.5, .2, .0, 1))
    inputs = cl.ClusterInputs(matrix, (1.0, 1.0, 1.0, 4.0), 6.0, 0.1)
    plan, quality = planned(spark, inputs, [0, 1, 2, 3])
    # Columns 0 and 1 fit together; 3 weighs too much for the first cluster and 2 depends on nothing.
    assert plan == ([0, 1], [([0], [2]), ([0], [3])])
    assert abs(quality - (2 * (0.9 + 0.5 + 0.2) - 2 * (0.9 + 0.0 + 0.5)) / 8) < 1e-12
    table = spark.createDataFrame([(x, y, float(matrix[x][y])) for x in range(4) for y in range(4)], "col_x int, col_y int, dependence double")
    assert abs(cl.plan_quality(cl.plan_table(spark, plan), table, 4).first().quality - quality) < 1e-12
    assert planned(spark, cl.ClusterInputs(matrix, (1.0,) * 4, 6.0, 0.1, main=3), [0, 1, 2, 3])[0][0][0] == 3


def test_search_ends_where_no_swap_improves(spark):
    matrix = tuple(tuple(1.0 if i == j else 0.9 if i // 2 == j // 2 else 0.05 * ((i + j) % 3) for j in range(6)) for i in range(6))
    inputs = cl.ClusterInputs(matrix, (4.0,) * 6, 7.0, 0.1)
    initial, derived = cl.search(spark, inputs, 3)
    groups = [set(initial), *({*s, *d} for s, d in derived)]
    assert all(any({i, i + 1} <= g for g in groups) for i in (0, 2, 4))


def test_feature_plan_packs_by_weight():
    plan = cl.plan_for_features([1.0, 9.0, 9.0, 1.0, 1.0], 0, [1, 2, 3], 8.0)
    assert plan == ([0, 1], [([0], [2, 3]), ([], [4])])
    assert cl.plan_for_features([1.0, 1.0, 1.0], 1, [], 8.0) == ([1], [([], [0]), ([], [2])])
    assert cl.plan_for_features([1.0] * 5, 0, [4, 3, 2, 1], 6.0) == ([0, 4, 3], [([0], [2, 1])])


def test_sampling_is_uniform_over_rows_and_stable(spark, ws):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 7D, cast(id as double)) as v0", "0L as e0")
    first = sample_rows(df.repartition(3), 3000, 900)
    hot = first.where("v0 = 7").count()
    assert first.count() == 900 and 230 < hot < 370
    again = sample_rows(df.repartition(5, "v0"), 3000, 900)
    assert sorted(r.v0 for r in first.collect()) == sorted(r.v0 for r in again.collect())


def test_content_salt_ignores_row_order(spark):
    df = spark.range(50).selectExpr("id % 7 as a", "if(id % 5 = 0, null, 'x') as b")
    assert content_salt(df) == content_salt(df.repartition(5)) != content_salt(df.where("a < 6"))


def test_integers_beyond_exact_doubles_are_refused(spark, ws):
    with pytest.raises(ValueError):
        encode_table(ws, spark.createDataFrame([(1 << 54,)], "a bigint"), ["a"], [], fx.NOISELESS)


def test_features_find_the_cause(spark):
    df = spark.range(400).selectExpr("id * 31 % 97 as noise", "id % 50 as cause", "concat('k', id % 3) as kind",
                                     "id % 50 * 2 + if(id % 3 = 0, 0, 300) as target")
    ranking = select_features(df, "target", folds=2)
    assert ranking.valid and set(ranking.features) == {"noise", "cause", "kind"} and {"cause", "kind"} <= set(ranking.selected)
    assert select_features(df.where("false"), "target").valid is False
    _, names, source = encode_features(df, ["kind", "cause"], {"kind": "categorical", "cause": "continuous"}, one_hot=True)
    assert names == ["kind$$k0", "kind$$k1", "kind$$k2", "cause"] and source["kind$$k1"] == "kind"


def test_csv_sources(spark, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text("int:i; 'real:r' ;bool:b;string:s;time:t;id\n1;2.5; true ;a;2023-01-25 12:27:30; 7\nx;;no;;later;\n")
    columns = tables.read_text_table(spark, str(path)).columns
    assert tables.header_types(columns) == {"int:i": "i", "real:r": "r", "bool:b": "b", "string:s": "s", "time:t": "t"}
    df = tables.read_csv(spark, str(path), tables.header_types(columns), ids=["id"])
    got = [tuple(r) for r in df.withColumn("time:t", F.col("`time:t`").cast("string")).collect()]
    assert got == [(1, 2.5, True, "a", "2023-01-25 12:27:30", "7"), (None, None, None, "", None, "")]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(path), {"other": "i"})
    assert tables.column_reference("a:b:i") == ("a:b", "integer")


def test_inferred_types(spark, tmp_path):
    path = tmp_path / "plain.csv"
    path.write_text("a,b,c,d,e\n1,1.5,2023-01-24T14:25:47Z,NA,true\n2,,2023-01-25T00:00:00Z,x,false\n")
    df = tables.read_csv_inferred(spark, str(path))
    assert tables.column_types(df) == {"a": "i", "b": "r", "c": "t", "d": "s", "e": "b"}
    assert df.where("b is null").count() == 1 and df.where("d = 'NA'").count() == 1


def test_row_hashes_compute_each_exponent_once(spark, ws, monkeypatch):
    from pyspark.sql import functions as F
    from veilcell.config import SynthConfig
    from veilcell.operators.encoding import encode_table
    plans, keep = [], ws.keep
    monkeypatch.setattr(ws, "keep", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df))[1])
    rows = spark.range(20).select((F.col("id") % 3).cast("double").alias("x"), F.col("id").cast("string").alias("t"))
    assert encode_table(ws, rows, ["x"], [], SynthConfig(salt="s")).rows.select("e0").distinct().count() == 3
    assert plans[0].upper().count("LOG2(") <= 5  # one exponent; a label that holds its expression has it twice
    assert encode_table(ws, rows, ["t"], [], SynthConfig(salt="s")).rows.select("e0").distinct().count() == 20


def test_feature_trees_grow_on_rows_alike(spark, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
    from pyspark.ml.regression import DecisionTreeRegressor

    # 16 pairs of values, each many times, with other labels each time.
    df = spark.range(960).selectExpr("id % 16 div 4 as a", "id % 4 as b", "id % 16 div 4 * 64 + id % 4 * 8 + id * 7 % 31 as number",
                                     "if(id * 7 % 31 < 20, int(id % 16 >= 12), id % 2) as class")
    wide = df.withColumn("number", F.col("number") + F.col("a") * 100)
    for target, kind, judge in (("number", DecisionTreeRegressor, RegressionEvaluator(metricName="r2")),
                                ("class", DecisionTreeClassifier, MulticlassClassificationEvaluator(metricName="accuracy"))):
        rows = wide.select("a", "b", target)
        fold = F.pmod(F.xxhash64("a", "b", target), F.lit(2))
        single = encode_features(rows, ["a", "b"], dict.fromkeys("ab", "categorical"))[0].withColumns({"label": F.col(target).cast("double"), "fold": fold})
        plain = [judge.evaluate(kind(maxDepth=3, seed=1).fit(single.where(F.col("fold") != f)).transform(single.where(F.col("fold") == f))) for f in (0, 1)]
        sizes, fit = [], kind.fit
        monkeypatch.setattr(kind, "fit", lambda self, data, fit=fit, sizes=sizes: (sizes.append(data.count()), fit(self, data))[1])
        ranking = select_features(rows, target, folds=2, depth=3)
        assert max(sizes) <= 32  # pairs of values, times classes; hundreds of rows before
        assert abs(ranking.encoded.scores[1] - sum(plain) / 2) < 1e-9
        assert ranking.features[0] == "a"
