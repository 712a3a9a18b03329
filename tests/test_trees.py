import pytest
from dataclasses import replace

from pyspark.sql import functions as F

from tests import fixtures as fx
from veilcell.operators.cells import Forest
from veilcell.operators.dependence import pair_dependence
from veilcell.operators.encoding import encode_table
from veilcell.operators.harvest import Harvest
from veilcell.operators.microdata import decoded_field, microdata, range_texts


def forest_of(ws, df, columns, ids, config, **options):
    return Forest(ws, encode_table(ws, df, columns, ids, config, **options), config)


def values(ws, df, columns, ids, config):
    forest = forest_of(ws, df, columns, ids, config)
    if len(columns) > 1:
        forest.grow_for([range(len(columns))])
    rows = microdata(Harvest(forest), forest.data, range(len(columns)))
    return [tuple(r)[0] if len(columns) == 1 else tuple(r)
            for r in rows.select(*[f"s{i}" for i in range(len(columns))]).collect()]


def test_root_ranges_are_anonymized(spark, ws):
    df = spark.createDataFrame(fx.PAIR_ROWS, "c0 bigint, c1 bigint")
    forest = forest_of(ws, df, ["c0", "c1"], [], fx.NOISY)
    assert [(r.lo, r.lo + r.size) for r in forest.roots] == [(0, 2), (0, 32)]


@pytest.mark.parametrize("rows, single", [(fx.SKEWED, False), ([1] * 8 + [100], True)])
def test_outliers_stay_in_the_counts(spark, ws, rows, single):
    df = spark.createDataFrame([(v,) for v in rows], "c bigint")
    for ids in ([], ["id"]):
        source = df.withColumn("id", F.monotonically_increasing_id().cast("string")) if ids else df
        root = forest_of(ws, source, ["c"], ids, fx.NOISELESS).trees[1].nodes.where("level = 0").first()
        assert root.noisy == len(rows) and (root.mn1 == root.mx1) == single


def test_one_entity_is_never_split(spark, ws):
    df = spark.createDataFrame([(1, v) for v in [1] * 9 + [0] * 8], "id bigint, c bigint")
    nodes = forest_of(ws, df, ["c"], ["id"], fx.NOISY).trees[1].nodes.collect()
    assert len(nodes) == 1 and nodes[0].n0 == 1


def test_depth_limit_applies_to_single_columns_only(spark, ws):
    df = spark.createDataFrame([(i, i) for i in range(1, 10)], "a bigint, b bigint")
    limited = replace(fx.NOISELESS, depth_threshold=-1, depth_row_fraction=1)
    assert forest_of(ws, df, ["a"], [], fx.NOISELESS).trees[1].nodes.where("level = 0").first().split
    forest = forest_of(ws, df, ["a", "b"], [], limited)
    assert not forest.trees[1].nodes.where("level = 0 and split").count()
    assert forest.dimension(2, [(0, 1)]).nodes.where("level = 0").first().split


def test_missing_ids_are_no_entities(spark, ws):
    df = spark.createDataFrame([(None, 1), (None, 5), ("", 2), ("0", 2)], "id string, c bigint")
    root = forest_of(ws, df, ["c"], ["id"], fx.NOISELESS).trees[1].nodes.where("level = 0").first()
    assert root.strength < 2


def test_flattening_one_id(spark, ws):
    got = values(ws, spark.createDataFrame(fx.ONE_ID, "aid bigint, c bigint"), ["c"], ["aid"], fx.NOISELESS)
    assert (got.count(1), got.count(2), len(got)) == (4, 12, 16)


def test_flattening_two_ids(spark, ws):
    got = values(ws, spark.createDataFrame(fx.TWO_IDS, "a bigint, b bigint, c bigint"), ["c"], ["a", "b"], fx.NOISELESS)
    assert (got.count(1), got.count(2), len(got)) == (4, 7, 11)


def test_single_buckets_lose_no_rows(spark, ws):
    """The suppressed value 3 goes to its neighbour: branches with one bucket scale exactly."""
    got = values(ws, spark.createDataFrame([(v,) for v in [0] * 10 + [3] * 2 + [7] * 10], "c bigint"), ["c"], [], fx.NOISELESS)
    assert len(got) == 22 and got.count(7) == 10


def test_low_counts_are_suppressed(spark, ws):
    one = values(ws, spark.createDataFrame(fx.LOW_ONE, "aid bigint, c string"), ["c"], ["aid"], fx.NOISELESS)
    two = values(ws, spark.createDataFrame(fx.LOW_TWO, "a bigint, b bigint, c string"), ["c"], ["a", "b"], fx.NOISELESS)
    for got in (one, two):
        assert "show" in got and not [v for v in got if v in ("suppress_1", "suppress_2", "suppress_3")]


def test_checkerboard_dependence(spark, ws):
    df = spark.createDataFrame(fx.CHECKERS, "x double, y double")
    assert pair_dependence(forest_of(ws, df, ["x", "y"], [], fx.NOISELESS)).first().dependence == 0.5


def test_string_codes_and_ranges(spark, ws):
    words = ["a", "aaa", "abc", "bac", "z", "Abc", "AAA", "aaa", "bac", "a", "a1", "123", "cab", "bbb"]
    data = encode_table(ws, spark.createDataFrame([(w,) for w in words], "w string"), ["w"], [], fx.NOISELESS)
    codes = {r.text: r.code for r in data.dictionary.collect()}
    assert (codes["123"], codes["AAA"], codes["z"]) == (0, 1, 10)
    ranges = spark.createDataFrame([(1.0, 1.0), (3.0, 5.0)], "lo double, hi double")
    texts = {r.lo: r.text for r in range_texts(data.dictionary, ranges, data.columns[0]).collect()}
    assert texts == {1.0: "AAA", 3.0: "a*"}


def test_dictionary_ranks_each_column_in_binary_order(spark, ws):
    from veilcell.operators.encoding import string_ranks
    df = spark.range(500).selectExpr("concat('w', id * 37 % 501) as a", "if(id % 7 = 0, null, concat('é', id % 9)) as b")
    got = {tuple(r) for r in string_ranks(ws, df, ["a", "b"]).select("name", "text", "code").collect()}
    values = {c: sorted({r[c] for r in df.collect() if r[c] is not None}, key=str.encode) for c in ("a", "b")}
    assert got == {(c, t, i) for c, texts in values.items() for i, t in enumerate(texts)}


def test_boolean_halves(spark, ws):
    data = encode_table(ws, spark.createDataFrame([(True,), (False,)], "b boolean"), ["b"], [], fx.NOISELESS)
    info = data.columns[0]
    df = spark.createDataFrame([(0.0, 0.5), (0.5, 1.0)], "lo double, hi double")
    got = df.select(decoded_field(info, F.col("lo"), F.col("hi"), F.lit(0.7), None)[0].alias("x")).collect()
    assert [r.x for r in got] == [False, True]


def test_string_ranges_give_more_values_than_prefixes(spark, ws):
    got = values(ws, spark.createDataFrame([(s,) for s in fx.STREETS], "s string"), ["s"], [], fx.NOISELESS)
    assert len(set(got)) > len({s.rsplit(" ", 1)[0] for s in fx.STREETS})
    assert not [v for v in got if v in set(fx.STREETS) and fx.STREETS.count(v) < fx.NOISELESS.low_threshold]


@pytest.mark.parametrize("name, copies, config", [(n, 1, fx.NOISELESS) for n in fx.SYSTEM] + [("four blobs", 8, fx.NOISY)])
def test_moments_of_synthetic_columns(spark, ws, name, copies, config):
    # Under noise a table of 16 rows may lose any cell, so the noisy case has more rows of the same shape.
    df = spark.createDataFrame(fx.SYSTEM[name] * copies, "x bigint, y bigint")
    got = values(ws, df, ["x", "y"], [], config)
    for i in (0, 1):
        old, new = [r[i] for r in fx.SYSTEM[name]], [r[i] for r in got]
        mean, mean2 = sum(old) / len(old), sum(new) / len(new)
        sd = (sum((v - mean) ** 2 for v in old) / len(old)) ** 0.5
        sd2 = (sum((v - mean2) ** 2 for v in new) / len(new)) ** 0.5
        assert abs(mean2 - mean) <= sd and abs(sd2 - sd) <= sd / 2


def test_nulls(spark, ws):
    rows = [(a, b, False, c) for (a, b), c in zip(fx.PAIR_ROWS[:19], [-1] * 10 + [-2] * 9)]
    rows += [(None, None, None, None)] + [(2, None, None, None)] * 7
    df = spark.createDataFrame(rows, "a bigint, b bigint, c boolean, d bigint")
    got = [values(ws, df, [c], [], fx.NOISY) for c in "abcd"]
    assert None not in got[0] and all(None in g for g in got[1:])


def test_buckets_do_not_depend_on_partitioning(spark, ws):
    df = spark.range(400).selectExpr("id * id % 97 as x", "cast(id % 5 as string) as y", "id % 40 as who")
    first = sorted(values(ws, df.repartition(1), ["x", "y"], ["who"], fx.NOISY))
    again = sorted(values(ws, df.repartition(7, "x"), ["x", "y"], ["who"], fx.NOISY))
    assert first == again and len(first) > 300


def test_three_columns_keep_their_relation(spark, ws):
    df = spark.range(600).selectExpr("id % 4 as a", "id % 4 * 10 as b", "id % 2 as c")
    got = values(ws, df, ["a", "b", "c"], [], fx.NOISY)
    assert abs(len(got) - 600) < 60
    kept = [r for r in got if r[1] == r[0] * 10 and r[2] == r[0] % 2]
    assert len(kept) > 0.9 * len(got)


def far_apart():
    """(value, level below which it shares no cell) for columns whose trees outgrow a 64-bit number."""
    return [[float(v) for v in range(50)] * 4 + [1e30], [v * 1e-300 for v in range(40)] * 4 + [1.0] * 30,
            [1e300 + v * 1e285 for v in range(30)] * 4 + [-1e-300] * 9]


@pytest.mark.parametrize("column", range(3))
def test_trees_have_no_depth_limit(spark, ws, column):
    rows = far_apart()[column]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "id bigint, v double")
    for ids in ([], ["id"]):
        leaves = forest_of(ws, df, ["v"], ids, fx.NOISELESS).trees[1].nodes.where("not split and strength >= 3").collect()
        assert sorted({x.mn1 for x in leaves}) == sorted({v for v in rows if rows.count(v) > 2}) and all(x.mn1 == x.mx1 for x in leaves)


def test_pairs_have_no_depth_limit(spark, ws):
    df = spark.createDataFrame([(v * 1e-300 if v % 2 else 1.0, 1 + v % 3) for v in range(40)] * 6, "x double, y bigint")
    forest = forest_of(ws, df, ["x", "y"], [], replace(fx.NOISELESS, range_threshold=3, singularity_threshold=3))
    leaves = forest.dimension(2, [(0, 1)]).nodes.where("not split and strength >= 3 and mn1 = mx1 and mn2 = mx2").collect()
    assert sorted((x.mn1, x.mn2, x.rows) for x in leaves if x.mn1 < 1) == sorted((v * 1e-300, 1.0 + v % 3, 6) for v in range(1, 40, 2))


def test_forty_alternating_buckets_scale_exactly(monkeypatch):
    from veilcell.operators import harvest as hv
    runs = [(4, 1), (2, 1)] * 20
    assert hv.scaled_front((runs, False), 120, 180, 32) == (120, ([(6, 1), (3, 1)] * 20, False))
    front = hv.joined_fronts([(runs, False)], 32)
    assert front == (runs[:32], True) and hv.scaled_front(front, 120, 180, 32)[0] is None
    assert hv.scaled_front(front, 120, 180, 32, 120) == (120, ([(6, 1), (3, 1)] * 16, True))
    assert hv.scaled_front(([(4, 1), (3, 5)], False), 19, 20, 32)[0] == 0


@pytest.mark.parametrize("columns", [["x"], ["x", "y"]])
def test_open_fronts_are_settled_by_all_buckets(spark, ws, monkeypatch, columns):
    from veilcell.operators import harvest as hv
    df = spark.range(400).selectExpr("id * 31 % 53 as x", "id % 3 as y")
    forest = forest_of(ws, df, columns, [], fx.NOISY)
    if len(columns) > 1:
        forest.grow_for([range(2)])
    keys = ["level", *[f"c{d}" for d in range(1, len(columns) + 1)], "total", "inner", "before"]
    found, asked, exact_leads = [], [], hv.exact_leads
    monkeypatch.setattr(hv, "exact_leads", lambda *a: asked.append(limit) or exact_leads(*a))
    for limit in (10_000, 0):
        monkeypatch.setattr(hv, "FRONT_RUNS", limit)
        found.append(sorted(tuple(r) for r in hv.harvested_totals(forest, forest.trees[len(columns)]).select(*keys).collect()))
    assert found[0] == found[1] and len(found[0]) > 60 and set(asked) == {0}


def test_levels_of_entities_are_grouped_where_they_are(spark, ws, monkeypatch):
    plans, cut = {}, ws.cut
    monkeypatch.setattr(ws, "cut", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), cut(df, name))[1])
    df = spark.range(600).selectExpr("id % 40 as person", "cast(id * 7 % 64 as double) as x")
    forest = Forest(ws, encode_table(ws, df, ["x"], ["person"], fx.NOISELESS), fx.NOISELESS)
    plan = plans["entities1"]
    assert 0 < plan.index("Generate") < plan.index("Exchange")  # the rows of all levels were dealt out before
    assert "outlying" in plans or "Aggregate" not in plans["contributions1"]  # pairs of cell and entity come once
    root = forest.trees[1].nodes.where("level = 0").first()
    assert (root.rows, root.n0) == (600, 40)
