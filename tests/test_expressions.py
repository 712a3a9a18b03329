import random

from pyspark.sql import functions as F

from tests.fixtures import expected_snaps
from veilcell import Interval, SynthConfig
from veilcell.functions import geometry as geo
from veilcell.functions import hashing as hs
from veilcell.functions import values as val
from veilcell.operators.harvest import joined_fronts, scaled_front
from veilcell.operators.counting import shrunk_intervals


def test_snapped_ranges(spark):
    cases = [tuple(map(float, c)) for c in expected_snaps()]
    df = spark.createDataFrame(cases, "lo double, hi double, want_lo double, want_hi double")
    snap = geo.snap_range(F.col("lo"), F.col("hi"))
    for r in df.select("*", snap["lo"].alias("a"), (snap["lo"] + snap["size"]).alias("b")).collect():
        assert (r.a, r.b) == (r.want_lo, r.want_hi), r


def test_cells_equal_repeated_halving(spark):
    rng = random.Random(1)
    cases = []
    for _ in range(3000):
        size = 2.0 ** rng.randint(-20, 30)
        lo = rng.randint(-50, 50) * size / 2
        value = lo + size * rng.uniform(-0.2, 1.2) if rng.random() < 0.9 else -1e-20
        level = rng.randint(0, 30)
        a, b, cell = lo, lo + size, 0
        for _ in range(level):
            mid = (a + b) / 2
            upper = value >= mid
            a, b, cell = (mid, b, 2 * cell + 1) if upper else (a, mid, 2 * cell)
        cases.append((value, lo, size, level, cell))
    df = spark.createDataFrame(cases, "v double, lo double, size double, level int, want bigint")
    assert df.where(geo.cell_of(F.col("v"), F.col("lo"), F.col("size"), F.col("level")) != F.col("want")).isEmpty()


def carried(counts, target):
    """Counts scaled one after the other, remainders carried when they exceed a unit; exact integers."""
    total, error, out = sum(counts), 0, []
    for c in counts:
        whole, rest = divmod(c * target, total)
        error += rest
        if error > total:
            whole, error = whole + 1, error - total
        out.append(whole)
    return out


def test_rescaling_equals_carried_remainders(spark):
    rng = random.Random(2)
    cases = [([10], 13), ([7], 2), ([2, 2, 2], 9), ([4, 11], 17), ([6, 4, 3], 26), ([6, 4, 3, 3], 24), ([5, 5, 1], 11), ([2] * 9, 27)]
    cases += [([rng.randint(1, 30) for _ in range(rng.randint(1, 8))], None) for _ in range(600)]
    rows = []
    for case, (counts, target) in enumerate(cases):
        total = sum(counts)
        target = target or rng.randint(2, 2 * total)
        lead, (out, _) = scaled_front(joined_fronts([([(c, 1)], False) for c in counts], 10_000), total, target, 10_000)
        assert [c for c, n in out for _ in range(n)] == [c for c in carried(counts, target) if c]
        run = 0
        for c, want in zip(counts, carried(counts, target)):
            rows.append((case, run, run + c, target, total, lead, want))
            run += c
    df = spark.createDataFrame(rows, "case int, a bigint, b bigint, t bigint, s bigint, lead bigint, want bigint")
    scaled = [geo.rescale_prefix(F.col(c), F.col("t"), F.col("s"), F.col("lead")) for c in "ab"]
    assert df.where(scaled[1] - scaled[0] != F.col("want")).isEmpty()


def test_rescaling_of_huge_counts_is_monotone(spark):
    df = spark.range(1000).select((F.col("id") * 10 ** 9).alias("p"))
    got = df.select(geo.rescale_prefix(F.col("p"), F.lit(7 * 10 ** 11), F.lit(10 ** 12), F.lit(0)).alias("x")).orderBy("p").collect()
    xs = [r.x for r in got]
    assert xs == sorted(xs) and abs(xs[-1] - 0.7 * 999 * 10 ** 9) < 10


def test_row_limit(spark):
    cases = [(100, 1, 100, 5), (200, 2, 100, 5), (100, 10000, 0, 0), (10000, 10000, 1, 0), (1000000, 10000, 100, 5)]
    for rows, fraction, want, tolerance in cases:
        got = spark.range(1).select(hs.noisy_row_limit(F.lit(0), F.lit(rows), fraction, "s").alias("x")).first().x
        assert abs(got - want) <= tolerance


def test_normal_noise_has_unit_deviation(spark):
    noise = hs.normal(hs.salted(F.col("id"), "s"))
    r = spark.range(20000).agg(F.avg(noise).alias("m"), F.stddev(noise).alias("s")).first()
    assert abs(r.m) < 0.03 and abs(r.s - 1) < 0.02


def test_driver_and_column_hashes_agree(spark):
    row = spark.createDataFrame([("précis",)], "t string").select(hs.hash_text(F.col("t")).alias("x")).first()
    assert row.x == hs.text_seed("précis")


def test_missing_entities_hash_to_zero(spark):
    df = spark.createDataFrame([(None,), ("",), ("0",)], "t string")
    assert [r.x != 0 for r in df.select(hs.entity_hash(F.col("t")).alias("x")).collect()] == [False, False, True]


def test_equal_labels_count_once(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "x string, y string")
    got = [r.s for r in df.select(hs.combine_texts(F.lit(7), [F.col("x"), F.col("y")]).alias("s")).collect()]
    assert got == [7 ^ hs.text_seed("a"), 7 ^ hs.text_seed("a") ^ hs.text_seed("b")]


def test_interval_shrinking_matches_its_rule(spark):
    config = SynthConfig(outliers=Interval(2, 5), top=Interval(1, 4), salt="s")
    out, top = shrunk_intervals(F.col("id"), config)
    for r in spark.range(0, 14).select("id", out.alias("o"), top.alias("t")).collect():
        n, excess = r.id, 9 - r.id
        if n < 3:
            want = (None, None)
        elif excess <= 0:
            want = (5, 4)
        else:
            o = excess // 2
            t = excess - o
            want = (5 - o, 4 - t) if o <= 3 and t <= 3 else (2, 4 - excess + 3) if o > 3 else (5 - excess + 3, 1)
        assert (r.o, r.t) == want


def test_parsing(spark):
    df = spark.createDataFrame([(" True ", "12", "1,234.5", "2023-01-24T14:25:47-05:00"), ("yes", "1.5", "x", "2023-01-24 14:25"),
                                ("f", " -3 ", "1e3", "2023/01/24 14:25:47"), ("", "", "", "2023-01-24")], "b string, i string, r string, t string")
    got = df.select(val.parse_boolean(F.col("b")), val.parse_integer(F.col("i")), val.parse_real(F.col("r")),
                    val.parse_timestamp(F.col("t")).cast("string")).collect()
    assert [tuple(r) for r in got] == [(True, 12, 1234.5, "2023-01-24 19:25:47"), (None, None, None, "2023-01-24 14:25:00"),
                                       (False, -3, 1000.0, "2023-01-24 14:25:47"), (None, None, None, "2023-01-24 00:00:00")]


def test_common_prefix(spark):
    df = spark.createDataFrame([("aaa", "abc"), ("abc", "abcd"), ("x", "y"), ("", "a"), ("straße 1", "straße 22"), ("𝒳a", "𝒳b")], "a string, b string")
    got = [r.p for r in df.select(val.common_prefix(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == ["a", "abc", "", "", "straße ", "𝒳"]


def test_money_rounding(spark):
    df = spark.createDataFrame([(1.4,), (1.5,), (34.0,), (36.0,), (750.0,), (0.0,), (0.02,)], "x double")
    got = [r.m for r in df.select(geo.money_round(F.col("x")).alias("m")).collect()]
    assert [round(g, 10) for g in got] == [1, 2, 20, 50, 1000, 0, 0.02]


def test_combinations():
    assert geo.column_combinations([0, 1, 2], 2) == [(0, 1), (0, 2), (1, 2)] and geo.column_combinations([0], 0) == []
