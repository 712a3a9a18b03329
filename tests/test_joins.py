import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from veilcell.operators import stitching as st
from veilcell.operators.ranking import group_ranks, running_total
from veilcell.operators.stitching import MicroTable, StitchColumn


def recursive_bins(left, right, columns):
    """The stitch recursion row by row: {(side, row): bin} for tuples of stitch values."""
    out = {}

    def visit(ls, rs, ranges, turn, attempts, name):
        if attempts == 0 or len(ls) == 1 or len(rs) == 1:
            out.update({("l", i): name for i in ls})
            out.update({("r", i): name for i in rs})
            return
        lo, hi = ranges[turn]
        after = (turn + 1) % len(columns)
        col = columns[turn]
        if col.integral and not (hi - lo > 1 or hi == col.hi and hi - lo >= 1):
            return visit(ls, rs, ranges, after, attempts - 1, name)
        mid = (lo + hi) / 2
        parts = [([i for i in ls if (left[i][turn] >= mid) == up], [i for i in rs if (right[i][turn] >= mid) == up])
                 for up in (False, True)]
        halves = [[h if i == turn else r for i, r in enumerate(ranges)] for h in ((lo, mid), (mid, hi))]

        def fair(p):
            a, b = len(p[0]), len(p[1])
            return min(a, b) > 0 and min(a, b) / max(a, b) >= 0.7

        if fair(parts[0]) and fair(parts[1]):
            for k in (0, 1):
                visit(*parts[k], halves[k], after, len(columns), name + str(k))
        elif not any(parts[0]):
            visit(ls, rs, halves[1], after, attempts - 1, name)
        elif not any(parts[1]):
            visit(ls, rs, halves[0], after, attempts - 1, name)
        else:
            visit(ls, rs, ranges, after, attempts - 1, name)

    visit(list(range(len(left))), list(range(len(right))), [(c.lo, c.hi) for c in columns], 0, len(columns), "b")
    return out


def test_bins_equal_the_recursion(spark, ws, monkeypatch):
    rng = random.Random(3)
    for bits in (16, 4):  # few bits force several passes
        monkeypatch.setattr(st, "PASS_BITS", bits)
        columns = [StitchColumn(0, 0.0, 64.0, True), StitchColumn(1, -8.0, 8.0, False)]
        left = [(float(rng.randint(0, 70)), rng.uniform(-9, 9)) for _ in range(300)]
        right = [(float(rng.choice([3, 7, 7, 40, 41, 63])), rng.gauss(0, 3)) for _ in range(280)]
        rows = [(s, str(i), a, b) for s, t in (("l", left), ("r", right)) for i, (a, b) in enumerate(t)]
        df = spark.createDataFrame(rows, "side string, pos string, n0 double, n1 double")
        got = {(r.side, int(r.pos)): r.bin for r in st.stitch_bins(ws, df, columns).collect()}
        assert got == recursive_bins(left, right, columns)


def table(ws, spark, rows, columns, dense=True):
    names = ", ".join(f"s{c} double, n{c} double" for c in columns)
    df = spark.createDataFrame([(i, *[x for v in r for x in (v, v)]) for i, r in enumerate(rows)], f"pos bigint, {names}")
    return MicroTable(df, tuple(columns), len(rows), dense)


def test_patch_keeps_left_rows_and_uses_right_rows_evenly(spark, ws):
    left = [(float(i),) for i in range(50)]
    for n in (80, 20):
        right = [(100.0 + i,) for i in range(n)]
        got = st.patch(ws, table(ws, spark, left, [0]), table(ws, spark, right, [1]))
        rows = got.rows.collect()
        assert sorted(r.s0 for r in rows) == [v for (v,) in left] and sorted(r.pos for r in rows) == list(range(50))
        used = [r.s1 for r in rows]
        assert len(set(used)) == min(n, 50) and set(used) <= {v for (v,) in right}
        assert used != sorted(used)


def test_patch_does_not_depend_on_partitioning(spark, ws):
    left, right = [(float(i),) for i in range(60)], [(100.0 + i,) for i in range(45)]
    other = MicroTable(table(ws, spark, right, [1]).rows.repartition(7), (1,), 45, True)
    got = [sorted(map(tuple, st.patch(ws, table(ws, spark, left, [0]), r).rows.collect())) for r in (table(ws, spark, right, [1]), other)]
    assert got[0] == got[1]


def test_merge_lengths_and_shared_columns(spark, ws):
    rng = random.Random(4)
    left = [(float(rng.randint(0, 15)), float(i)) for i in range(200)]
    right = [(float(rng.randint(0, 15)), 1000.0 + i) for i in range(161)]
    column = StitchColumn(0, 0.0, 16.0, True)
    for owner in ("shared", "left", "right"):
        l, r = table(ws, spark, left, [0, 1]), table(ws, spark, right, [0, 2])
        got = st.stitch(ws, l, r, [column], owner)
        rows = got.rows.collect()
        bins = recursive_bins([(a,) for a, _ in left], [(a,) for a, _ in right], [column])
        per = {}
        for (side, _), b in bins.items():
            per.setdefault(b, {"l": 0, "r": 0})[side] += 1
        want = {"left": 200, "right": 161}.get(owner, sum(round((p["l"] + p["r"]) / 2) for p in per.values()))
        assert len(rows) == want == got.count and len({r.pos for r in rows}) == want
        share = {"left": 1.0, "right": 0.0}
        own = sum(dict((i, v) for v, i in left)[r.s1] == r.s0 for r in rows) / want
        if owner in share:
            assert own == 1.0 if owner == "left" else own < 1.0
        else:
            assert 0.4 < own <= 1.0
        paired = [(dict((i, v) for v, i in left)[r.s1], dict((i, v) for v, i in right)[r.s2]) for r in rows]
        assert sum(abs(a - b) <= 2 for a, b in paired) > 0.8 * want


def test_ranks_survive_a_hot_group(spark, ws):
    df = spark.range(2000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 50 as string)) as g", "id * 7919 % 2003 as k", "id")
    order = F.row_number().over(Window.partitionBy("g").orderBy("k", "id")) - 1
    plain = {(r.id, r.rank) for r in df.select("id", order.alias("rank")).collect()}
    assert plain == {(r.id, r.rank) for r in group_ranks(ws, df, ["g"], ["k", "id"]).collect()}


def test_running_totals_by_chunks(spark):
    df = spark.range(500).selectExpr("id % 3 as g", "id as k", "id % 5 + 1 as w")
    got = running_total(df, ["g"], F.col("k") % 4, ["k"], "w", "start").collect()
    for g in range(3):
        spans = sorted((r.start, r.start + r.w) for r in got if r.g == g)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_positions_are_permuted(spark):
    from veilcell.functions.hashing import shuffled_position
    for size in (1, 2, 3, 10, 1000, 4096):
        got = [r.x for r in spark.range(size).select(shuffled_position(F.col("id"), size, "a", 3).alias("x")).collect()]
        assert sorted(got) == list(range(size))
    again = [r.x for r in spark.range(4096).select(shuffled_position(F.col("id"), 4096, "b", 3).alias("x")).collect()]
    assert sum(a == b for a, b in zip(got, again)) < 20 and sum(a == i for i, a in enumerate(got)) < 20
    near = sum(abs(a - b) < 400 for a, b in zip(got, got[1:])) / 4095  # neighbours end up far apart, as by chance
    assert abs(near - 0.186) < 0.04
    ranks, places = sum(i * a for i, a in enumerate(got)) / 4096, (4095 / 2) ** 2
    assert abs(ranks - places) < 0.03 * places


def test_expansion_of_few_rows_is_spread_over_tasks(spark):
    from veilcell.operators.harvest import UNIT_CHUNK, expand_counts
    wide = spark.createDataFrame([(1, 0, 6 * UNIT_CHUNK)], "id long, first long, end long")
    units = expand_counts(wide, ["id"], "first", "end", "at")
    per_task = units.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in per_task) == 6 * UNIT_CHUNK
    assert len(per_task) > 1


def test_cut_tables_are_read_by_several_tasks(spark, ws):
    import glob
    import pyarrow.parquet as pq
    rows = spark.range(600_000, numPartitions=1).select("id", F.xxhash64("id").alias("x"))
    stored = ws.cut(rows, "wide")
    path = glob.glob(f"{ws.folder}/*-wide/*.parquet")
    assert len(path) == 1 and pq.ParquetFile(path[0]).num_row_groups > 1
    assert stored.count() == 600_000


def test_a_missing_position_stays_missing(spark):
    from veilcell.functions.hashing import shuffled_position
    rows = spark.createDataFrame([(None,), (3,), (0,)], "id long").select("id", shuffled_position(F.col("id"), 5, "a").alias("x")).collect()
    assert all((r.id is None) == (r.x is None) for r in rows)


def test_large_and_small_bins_are_paired_alike(spark, ws, monkeypatch):
    rows = [(f"b{i % 3}", str(i), f"v{i}", float(i % 7), f"w{i}", float(i)) for i in range(60)]
    left = spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 != 1 or i < 10], "bin string, pos string, s0 string, n0 double, s1 string, n1 double")
    right = spark.createDataFrame([r for i, r in enumerate(rows) if i % 3 or i > 40], "bin string, pos string, s0 string, n0 double, s2 string, n2 double")
    for owner in ("left", "right", "shared"):
        before = ws._tables
        one = st.merge_bins(ws, left, right, [0, 1], [0, 2], [0], owner)
        assert ws._tables == before + 1  # only the lengths are stored
        monkeypatch.setattr(st, "BIN_ROWS", 8)
        two = st.merge_bins(ws, left, right, [0, 1], [0, 2], [0], owner)
        monkeypatch.undo()
        assert one.count() and sorted(one.collect()) == sorted(two.collect())


def test_bins_are_split_without_bringing_the_rows_of_a_bin_together(spark, ws, monkeypatch):
    rows = spark.createDataFrame([(s, str(i), float(i)) for i in range(64) for s in "lr"], "side string, pos string, n0 double")
    monkeypatch.setattr(st, "PASS_BITS", 2)
    joins, cut = [], ws.cut
    monkeypatch.setattr(ws, "cut", lambda df, name: (joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
                                                     if name == "binned" else None, cut(df, name))[1])
    st.stitch_bins(ws, rows, [StitchColumn(0, 0.0, 64.0, False)]).count()
    assert joins and max(joins) == 1  # the cells' new bins; the ranges come with the rows
