"""Queries over the test tables, one per operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ClusterSpec, DerivedCluster, SynthConfig
from ..functions import geometry as geo
from ..functions import hashing as hs
from ..functions import values as val
from ..operators import clustering, counting, dependence, encoding, features, harvest, microdata, sampling, stitching
from ..operators.cells import SET_PRIME, Forest
from ..sources import inspection, salt, tables
from ..workspace import Workspace
from .synthesis import Synthesizer, synthesize, synthesize_for_target

SALT = "demo-salt"
CONFIG = SynthConfig(salt=SALT, table_name="demo")
BLOCKS = replace(CONFIG, low_threshold=61, low_layer_sd=0.0, low_mean_gap=0.0, noise_sd=0.0)
SOFT = replace(CONFIG, low_layer_sd=0.5, low_mean_gap=1.0)

# Fixed plan for the quality query: (cluster, columns).
QUALITY_PLAN = ([0, 2], [([0], [1, 3])])
THREE_COLUMNS = ("o_totalprice", "o_custkey", "o_orderstatus")
FOUR_COLUMNS = ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micro(value):
    """A double as whole millionths: comparable across engines."""
    return F.floor(value * 1e6 + 0.5).cast("bigint")


# -- expressions -----------------------------------------------------------------

def value_parsing(spark, folder):
    o = load(spark, folder, "orders")
    n = F.col("o_orderkey")
    words = F.array(*[F.lit(w) for w in (" true", "T", "0", "yes", "f ", "", "1", "FALSE")])
    flag = F.element_at(words, (n % 8 + 1).cast("int"))
    number = F.when(n % 5 == 0, F.concat(n.cast("string"), F.lit(".5"))).otherwise(F.concat(F.lit(" "), n.cast("string")))
    price = F.concat((n + 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0"), F.lit(".25"))
    price = F.when(n % 7 == 0, F.lit("n/a")).otherwise(price)
    moment = (F.when(n % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"))
              .when(n % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("soon")))
    none = F.lit(-1)  # NULL integers read differently in data frame libraries
    return o.select("o_orderkey", F.coalesce(val.parse_boolean(flag).cast("string"), F.lit("NULL")).alias("flag"),
                    F.coalesce(val.parse_integer(number), none).alias("whole"), val.parse_real(price).alias("amount"), val.parse_timestamp(moment).cast("timestamp_ntz").alias("moment"))


def seed_texts(spark, folder):
    o = load(spark, folder, "orders")
    day = val.value_text("timestamp", F.col("o_orderdate"))
    flag = val.value_text("boolean", F.col("o_orderkey") % 2 == 0)
    none = val.value_text("string", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    listed = val.list_text(F.array("o_orderstatus", "o_orderpriority"))
    seed = hs.combine_texts(F.lit(hs.text_seed("demo")), [F.col("o_orderstatus"), flag, F.col("o_orderstatus")])
    return o.select("o_orderkey", day.alias("day"), flag.alias("flag"), none.alias("status"), listed.alias("listed"),
                    seed.alias("seed"))


def noise_values(spark, folder):
    o = load(spark, folder, "orders")
    entity = hs.entity_hash(F.nullif(F.col("o_orderkey") % 1000, F.lit(0)))
    salted = hs.salted(entity, SALT)
    noise = hs.layered_noise([entity, hs.hash_text(F.col("o_orderpriority"))], "noise", 2.0, SALT)
    return o.select("o_orderkey", entity.alias("entity"), salted.alias("salted"),
                    hs.uniform_int(hs.mix(salted, "top"), F.lit(2), F.lit(5)).alias("uniform"),
                    micro(hs.normal(salted)).alias("normal"), micro(noise).alias("noise"))


def row_limits(spark, folder):
    o = load(spark, folder, "orders")
    rows = F.col("o_orderkey") * 1000
    return o.select("o_orderkey", hs.noisy_row_limit(hs.hash_text(F.col("o_orderpriority")), rows, 10000, SALT).alias("row_limit"))


def rounding(spark, folder):
    o = load(spark, folder, "orders")
    x = F.col("o_totalprice") / 7
    return o.select("o_orderkey", micro(geo.money_round(x)).alias("money"),
                    geo.is_money_rounded(F.floor(x / 1000).cast("double")).alias("is_money"),
                    micro(geo.noise_scale_for_report(x)).alias("reported"),
                    geo.round_away(x - 20000).cast("bigint").alias("rounded"),
                    micro(geo.floor_by(x, 0.5)).alias("floored"), micro(geo.ceil_by(x, 0.5)).alias("ceiled"))


def range_tests(spark, folder):
    li = load(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
        F.min("l_discount").alias("lo2"), F.avg("l_quantity").alias("mean"))
    lo, hi, mid = F.col("lo"), F.col("hi"), geo.middle(F.col("lo"), F.col("hi"))
    snap = geo.snap_range(F.col("lo2"), F.col("mean"))
    return li.select(
        "l_suppkey", mid.alias("middle"), geo.half_index(F.col("mean"), lo, hi).alias("side"),
        geo.half(geo.half_index(F.col("mean"), lo, hi), lo, hi)["hi"].alias("half_hi"),
        geo.contains(lo, hi, F.lit(2.0), F.lit(49.0)).alias("holds"), geo.contains_value(lo, hi, F.lit(50.0)).alias("has"),
        geo.contains_value_inclusive(lo, hi, F.lit(50.0)).alias("has_end"),
        geo.overlaps(lo, hi, F.lit(50.0), F.lit(60.0)).alias("meets"), geo.is_singular(lo, hi).alias("single"),
        snap["lo"].alias("snap_lo"), snap["size"].alias("snap_size"))


def text_ranges(spark, folder):
    """Generalized text of every pair of neighbours in the dictionary of document texts."""
    ws = Workspace(spark)
    docs = load(spark, folder, "documents")
    words = ws.cut(encoding.string_ranks(ws, docs, ["text"]), "words")
    nexts = words.select((F.col("code") - 1).alias("code"), F.col("text").alias("high"))
    both = words.select("code", F.col("text").alias("low")).join(nexts, "code")
    return both.select("code", val.generalized_text(F.col("low"), F.col("high"), F.col("code")).alias("shown"))


def numeric_codes(spark, folder):
    e = load(spark, folder, "events")
    return e.select("event_id", micro(val.numeric_code("timestamp", F.col("ts"))).alias("moment"),
                    val.numeric_code("boolean", F.col("value") > 50).alias("flag"),
                    val.numeric_code("integer", F.col("user_id")).alias("whole"),
                    val.numeric_code("real", F.nullif(F.col("value"), F.lit(5.0))).alias("amount"))


def decoded_fields(spark, folder):
    o = load(spark, folder, "orders")
    u = hs.hash_text(F.col("o_orderkey").cast("string")) / float(1 << 60)
    lo = F.floor(F.col("o_totalprice") / 64).cast("double") * 64
    hi = F.when(F.col("o_orderkey") % 4 == 0, lo).otherwise(lo + 64)
    types = {f.name: f.dataType for f in o.schema.fields}
    null_code = 128.0 * 500

    def field(kind, name):
        info = encoding.ColumnInfo(0, name, kind, types[name], null_code, 0.0, 1.0)
        return microdata.decoded_field(info, lo, hi, u, None)

    whole, number = field("integer", "o_orderkey")[0], field("real", "o_totalprice")[0]
    moment = field("timestamp", "o_orderdate")[0]
    flag = val.decode_value("boolean", u, types["o_orderkey"])
    none = F.lit(-1)
    return o.select("o_orderkey", F.coalesce(whole, none).alias("whole"), F.coalesce(micro(number), none).alias("amount"),
                    F.date_trunc("second", moment).cast("timestamp_ntz").alias("moment"), flag.alias("flag"))


# -- scan and encoding -------------------------------------------------------------

def string_codes(spark, folder):
    parts = load(spark, folder, "part")
    return encoding.string_ranks(Workspace(spark), parts, ["p_name", "p_brand", "p_type"])


def root_ranges(spark, folder):
    li = load(spark, folder, "lineitem").select(*MEASURES, (-F.col("l_tax")).alias("negative"),
                                                F.lit(0.0).alias("zero"), F.lit(None).cast("double").alias("none"))
    found = encoding.root_ranges(encoding.column_extents(li, li.columns))
    return found.select("column", *[(F.col(c) + 0.0).alias(c) for c in found.columns[1:]])  # no negative zeros


def cell_counts(spark, folder):
    li = load(spark, folder, "lineitem").select("l_extendedprice", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("level"))
    cell = geo.cell_of(F.col("l_extendedprice"), 0.0, 131072.0, F.col("level"))
    return li.groupBy("level", cell.alias("cell")).agg(F.count(F.lit(1)).alias("rows"),
                                                       F.min("l_extendedprice").alias("lowest"))


def content_digests(spark, folder):
    return salt.content_digest(load(spark, folder, "conversations"))


def csv_texts(spark, folder):
    return tables.csv_ready(load(spark, folder, "orders"))


def csv_round_trip(spark, folder):
    ws = Workspace(spark)
    source = load(spark, folder, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    path = f"{ws.folder}/orders-csv"
    tables.write_csv(source, path)
    back = tables.read_csv(spark, path, {"o_orderkey": "i", "o_totalprice": "r", "o_orderdate": "t", "o_orderstatus": "s",
                                         "o_orderpriority": "s"}, ids=["o_custkey"])
    return back.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def csv_inferred(spark, folder):
    ws = Workspace(spark)
    path = f"{ws.folder}/events-csv"
    tables.write_csv(load(spark, folder, "events").select("event_id", "ts", "event_type", "value"), path)
    found = tables.read_csv_inferred(spark, path)
    kinds = tables.column_types(found)
    return found.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kinds[c] == "t" else F.col(c) for c in found.columns])


# -- counting ------------------------------------------------------------------------

def entity_counts(spark, folder):
    li = load(spark, folder, "lineitem")
    rows = counting.entity_contributions(li, ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_suppkey"])
    return counting.entity_totals(rows, ["l_returnflag", "l_linestatus"])


def low_count_groups(spark, folder):
    li = load(spark, folder, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = counting.entity_contributions(li, ["day"], ["l_suppkey"])
    totals = counting.entity_totals(rows, ["day"])
    low = counting.is_low_count(F.col("entities"), F.col("seed"), CONFIG)
    weak = counting.is_low_count(F.col("entities"), F.col("seed"), CONFIG, CONFIG.range_threshold)
    return totals.select("day", "entities", low.alias("low_count"), weak.alias("below_range"))


def noisy_unique_counts(spark, folder):
    o = load(spark, folder, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    counts = counting.unique_entity_counts(o, ["month", "o_orderpriority"], F.col("o_orderkey"))
    bucket = hs.hash_text(F.concat_ws("|", "month", "o_orderpriority"))
    noisy = counting.noisy_unique_count(F.col("entities"), F.col("seed"), bucket, CONFIG)
    return counts.select("month", "o_orderpriority", "entities", noisy.alias("noisy_count"))


def entity_contributions(spark, folder):
    e = load(spark, folder, "events").withColumn("visitor", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    return counting.entity_contributions(e, ["event_type"], ["visitor"])


def flattened_counts(spark, folder):
    e = load(spark, folder, "events").withColumn("visitor", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    e = e.withColumn("slot", F.date_format("ts", "yyyy-MM-dd HH"))
    bucket = hs.hash_text(F.concat_ws("|", "event_type", "slot"))
    return counting.flattened_counts(e, ["event_type", "slot"], ["visitor"], CONFIG, bucket).select(
        "event_type", "slot", "noisy_count", F.coalesce(micro(F.col("noise_scale")), F.lit(-1)).alias("noise_scale"),
        micro(F.col("strength")).alias("strength"))


def private_groups(spark, folder):
    li = load(spark, folder, "lineitem").withColumn("size", F.floor(F.col("l_quantity") / 10))
    bucket = hs.hash_text(F.concat_ws("|", "l_returnflag", "size"))
    return counting.private_group_counts(li, ["l_returnflag", "size"], ["l_orderkey", "l_suppkey"], CONFIG, bucket)


# -- trees and buckets ---------------------------------------------------------------

def _order_forest(spark, folder, columns, config=CONFIG):
    ws = Workspace(spark)
    data = encoding.encode_table(ws, load(spark, folder, "orders"), columns, ["o_orderkey"], config, unique_ids=True)
    return Forest(ws, data, config)


def tree_nodes_1d(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice"])
    return forest.trees[1].nodes.select("level", "c1", "rows", F.col("n0").alias("entities"), (F.col("s0") % SET_PRIME).alias("seed"),
                                        "mn1", "mx1", micro(F.col("strength")).alias("strength"), "split",
                                        F.col("noisy").alias("noisy_count"))


def tree_nodes_2d(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice", "o_custkey"])
    return forest.dimension(2, [(0, 1)]).nodes.select(
        "level", "c1", "c2", "rows", "mn1", "mx1", "mn2", "mx2", micro(F.col("strength")).alias("strength"),
        F.expr("strength >= 3 and stub").alias("stub"), "split", "half1", "half2",
        F.col("noisy").alias("noisy_count"))


def _tree_nodes(spark, folder, columns):
    """Nodes of the tree over all of these columns; the trees of their subsets are grown on the way."""
    k = len(columns)
    forest = _order_forest(spark, folder, list(columns))
    forest.grow_for([range(k)])
    dims = range(1, k + 1)
    return forest.trees[k].nodes.select("level", *[f"c{d}" for d in dims], "rows", *[f"{n}{d}" for d in dims for n in ("mn", "mx")],
                                        F.expr("strength >= 3 and stub").alias("stub"), "split", *[f"half{d}" for d in dims],
                                        F.col("noisy").alias("noisy_count"))


def tree_nodes_3d(spark, folder):
    return _tree_nodes(spark, folder, THREE_COLUMNS)


def tree_nodes_4d(spark, folder):
    return _tree_nodes(spark, folder, FOUR_COLUMNS)


def tree_nodes_by_entity(spark, folder):
    ws = Workspace(spark)
    data = encoding.encode_table(ws, load(spark, folder, "events"), ["value"], ["user_id"], CONFIG)
    forest = Forest(ws, data, CONFIG)
    return forest.trees[1].nodes.select("level", "c1", F.col("n0").alias("entities"), "mn1", "mx1", "split",
                                        F.col("noisy").alias("noisy_count"))


def tree_nodes_no_ids(spark, folder):
    """Tree of line item quantities whose rows have no ids and repeat."""
    ws = Workspace(spark)
    data = encoding.encode_table(ws, load(spark, folder, "lineitem"), ["l_quantity"], [], CONFIG)
    return Forest(ws, data, CONFIG).trees[1].nodes.select(
        "level", "c1", "rows", (F.col("s0") % SET_PRIME).alias("seed"), "mn1", "mx1", micro(F.col("strength")).alias("strength"), "split",
        F.col("noisy").alias("noisy_count"))


def _deep_tree(spark, folder, value):
    """Nodes of a tree over part sizes that needs far more levels than a number of 64 bits has."""
    parts = load(spark, folder, "part").select("p_partkey", value.alias("x"))
    ws = Workspace(spark)
    forest = Forest(ws, encoding.encode_table(ws, parts, ["x"], ["p_partkey"], CONFIG, unique_ids=True), CONFIG)
    return forest.trees[1].nodes.select("level", "c1", "rows", F.col("n0").alias("entities"), (F.col("mn1") == F.col("mx1")).alias("single"),
                                        "split", F.col("noisy").alias("noisy_count"))


def tree_nodes_far(spark, folder):
    """One value of 1e30 beside sizes from 1 to 50."""
    return _deep_tree(spark, folder, F.when(F.col("p_partkey") == 1, 1e30).otherwise(F.col("p_size").cast("double")))


def tree_nodes_fine(spark, folder):
    """Sizes in units of 1e-300 beside 1."""
    return _deep_tree(spark, folder, F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") * 1e-300).otherwise(1.0))


def root_facts(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice"])
    return inspection.column_table(forest)


def harvest_1d(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice"])
    return inspection.bucket_table(harvest.Harvest(forest), (0,)).select("level", "c1", "lo1", "hi1", "count")


def harvest_fronts(spark, folder):
    """Buckets of blocks of 3,780 orders: 40 values with 124 and 62 orders by turns beside a weak one with 60.

    Every block scales from 3,720 to 3,780 orders exactly, bucket for bucket.
    """
    place = F.expr("o_orderkey % 3780")
    value = F.when(place < 3720, F.expr("o_orderkey % 3780 div 186 * 2 + int(o_orderkey % 3780 % 186 >= 124)")).otherwise(F.lit(64))
    orders = load(spark, folder, "orders").select("o_orderkey", (F.expr("o_orderkey div 3780 * 128") + value).cast("double").alias("x"))
    ws = Workspace(spark)
    forest = Forest(ws, encoding.encode_table(ws, orders, ["x"], ["o_orderkey"], BLOCKS, unique_ids=True), BLOCKS)
    return inspection.bucket_table(harvest.Harvest(forest), (0,)).select("level", "c1", "lo1", "hi1", "count")


def node_totals_2d(spark, folder):
    """Rows every node of a two-column tree yields, what its children yield, and its offset in its parent."""
    forest = _order_forest(spark, folder, ["o_totalprice", "o_custkey"])
    totals = harvest.harvested_totals(forest, forest.dimension(2, [(0, 1)]))
    return totals.select("level", "c1", "c2", "total", F.col("inner").alias("children"), F.col("before").alias("offset_rows"))


def refined_buckets(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice", "o_orderstatus"])
    forest.grow_for([(0, 1)])
    return inspection.bucket_table(harvest.Harvest(forest), (0, 1))


def inspected_nodes(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice", "o_orderstatus"])
    forest.grow_for([(0, 1)])
    return inspection.node_table(forest, (0, 1))


def synthetic_rows(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice", "o_orderdate", "o_orderpriority"])
    rows = [microdata.microdata(harvest.Harvest(forest), forest.data, (c,)).select(
        F.lit(forest.data.columns[c].name).alias("column"), "pos", F.col(f"s{c}").cast("string").alias("value"))
        for c in range(3)]
    return reduce(DataFrame.unionByName, rows)


# -- dependence and clusters -----------------------------------------------------------

def column_entropies(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice"])
    found = dependence.column_entropy(forest)
    return found.join(dependence.column_weights(found), "col").select(
        "col", micro(F.col("entropy")).alias("entropy"), micro(F.col("weight")).alias("weight"))


def pair_dependence(spark, folder):
    forest = _order_forest(spark, folder, ["o_totalprice", "o_custkey"])
    return dependence.pair_dependence(forest).select("col_x", "col_y", micro(F.col("dependence")).alias("dependence"))


def _correlations(spark, folder):
    """A matrix of absolute correlations: (col_x, col_y, dependence)."""
    li = load(spark, folder, "lineitem")
    pairs = [(i, j) for i in range(4) for j in range(4)]
    one = li.agg(*[F.abs(F.corr(MEASURES[i], MEASURES[j])).alias(f"r{i}{j}") for i, j in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(i).alias("col_x"), F.lit(j).alias("col_y"),
                                                  F.col(f"r{i}{j}").alias("dependence")) for i, j in pairs])))


def total_dependences(spark, folder):
    return dependence.total_dependence(_correlations(spark, folder)).select("col", micro(F.col("total")).alias("total"))


def plan_quality(spark, folder):
    plan = clustering.plan_table(spark, QUALITY_PLAN)
    return clustering.plan_quality(plan, _correlations(spark, folder), 4).select(micro(F.col("quality")).alias("quality"))


def sampled_rows(spark, folder):
    ws = Workspace(spark)
    data = encoding.encode_table(ws, load(spark, folder, "lineitem"), list(MEASURES), [], CONFIG)
    return sampling.sample_rows(data.rows, data.n_rows, 1000)


def _line_columns(spark, folder):
    return load(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_tax")


def dependence_report(spark, folder):
    return Synthesizer(_line_columns(spark, folder), CONFIG).dependence_report()


def cluster_search(spark, folder):
    return Synthesizer(_line_columns(spark, folder), CONFIG).cluster_report()


def feature_ranking(spark, folder):
    li = load(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_extendedprice", "l_tax")
    return features.select_features(li, "l_extendedprice").table(spark)


def column_roles(spark, folder):
    li = load(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_returnflag", "l_shipdate", "l_suppkey")
    docs = load(spark, folder, "documents").select("text", "lang")
    rows = [(c, r) for df in (li, docs) for c, r in features.column_roles(df, df.columns).items()]
    return spark.createDataFrame(rows, "column string, role string")


def complete_rows(spark, folder):
    e = load(spark, folder, "events").select("event_id", "ts", F.nullif(F.col("event_type"), F.lit("view")).alias("kind"))
    return features.complete_rows(e).select("event_id", "kind", micro(F.col("ts")).alias("moment"))


# -- joins of synthetic tables ------------------------------------------------------------

def _micro_table(ws, df, columns, key):
    fields = [e for i, c in columns.items() for e in (F.col(c).alias(f"s{i}"), F.col(c).cast("double").alias(f"n{i}"))]
    rows = ws.cut(df.select(F.col(key).alias("pos"), *fields), "micro")
    return stitching.MicroTable(rows, tuple(sorted(columns)), rows.count(), True)


def patch_join(spark, folder):
    """Orders in order, each with a customer balance in shuffled order; customers repeat."""
    ws = Workspace(spark)
    left = _micro_table(ws, load(spark, folder, "orders"), {0: "o_totalprice"}, "o_orderkey")
    right = _micro_table(ws, load(spark, folder, "customer"), {1: "c_acctbal"}, "c_custkey")
    return stitching.patch(ws, left, right).rows.select("pos", F.col("s0").alias("price"),
                                                                            F.col("s1").alias("balance"))


def stitch_join(spark, folder):
    """Orders and line items refined by price range, then paired in price order."""
    ws = Workspace(spark)
    left = _micro_table(ws, load(spark, folder, "orders"), {0: "o_totalprice", 1: "o_custkey"}, "o_orderkey")
    numbered = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        (F.sum("l_extendedprice")).alias("price"), F.sum("l_quantity").alias("quantity"))
    right = _micro_table(ws, numbered, {0: "price", 2: "quantity"}, "l_orderkey")
    column = stitching.StitchColumn(0, 0.0, float(1 << 19), False)
    return stitching.stitch(ws, left, right, [column], "shared").rows.select(
        F.col("s0").alias("price"), F.col("s1").alias("customer"), F.col("s2").alias("quantity"))


def stitch_owners(spark, folder):
    """Orders and the same orders with a surcharge, refined by price and customer in turn and paired, once for each owner."""
    ws = Workspace(spark)
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("customer"),
                                                  F.col("o_orderkey").cast("double").alias("number"))
    raised = orders.withColumn("o_totalprice", F.col("o_totalprice") + 500 * (F.col("customer") % 7)).where("o_orderkey % 5 <> 0")
    left = _micro_table(ws, orders, {0: "o_totalprice", 1: "customer", 2: "number"}, "o_orderkey")
    right = _micro_table(ws, raised, {0: "o_totalprice", 1: "customer", 3: "number"}, "o_orderkey")
    columns = [stitching.StitchColumn(0, 0.0, float(1 << 19), False), stitching.StitchColumn(1, 0.0, float(1 << 20), True)]
    sides = [ws.cut(side, "side") for side in stitching.binned_sides(ws, left, right, columns)]
    merged = [stitching.merge_bins(ws, *sides, left.columns, right.columns, [0, 1], owner).select(
        F.lit(owner).alias("owner"), F.col("s0").alias("price"), F.col("s1").alias("customer"), F.col("s2").alias("number"), F.col("s3").alias("raised_number"))
        for owner in ("left", "right", "shared")]
    return reduce(DataFrame.unionByName, merged)


def stitch_bin_sizes(spark, folder):
    """Final price ranges of order prices against the same prices with a customer surcharge, and their merged length."""
    ws = Workspace(spark)
    orders = load(spark, folder, "orders")
    plain = orders.select(F.lit("l").alias("side"), F.col("o_orderkey").cast("string").alias("pos"), F.col("o_totalprice").alias("n0"))
    raised = orders.select(F.lit("r").alias("side"), F.col("o_orderkey").cast("string").alias("pos"),
                           (F.col("o_totalprice") + 500 * (F.col("o_custkey") % 7)).alias("n0"))
    column = stitching.StitchColumn(0, 0.0, float(1 << 19), False)
    bins = stitching.stitch_bins(ws, plain.unionByName(raised), [column])
    left, right = F.count_if(F.col("side") == "l"), F.count_if(F.col("side") == "r")
    sized = bins.groupBy("bin").agg(left.alias("left_rows"), right.alias("right_rows"))
    steps = F.expr("substring(bin, 2)")
    return sized.select(F.length(steps).alias("level"), F.coalesce(F.conv(steps, 2, 10).cast("bigint"), F.lit(0)).alias("cell"),
                        "left_rows", "right_rows", F.bround((F.col("left_rows") + F.col("right_rows")) / 2, 0).cast("bigint").alias("merged"))


# -- end to end ----------------------------------------------------------------------------

def synthesize_single(spark, folder):
    """The whole run over one column."""
    orders = load(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return synthesize(orders, CONFIG, columns=["o_totalprice"], ids=["o_orderkey"], unique_ids=True)


def synthesize_events(spark, folder):
    events = load(spark, folder, "events").select("user_id", "event_type", "value")
    return synthesize(events, CONFIG, ids=["user_id"])


def synthesize_manual(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    spec = ClusterSpec(("o_orderstatus", "o_orderpriority"), (DerivedCluster(("o_totalprice",), ("o_orderstatus",), "left"),))
    return synthesize(orders, CONFIG, clusters=spec)


def synthesize_independent(spark, folder):
    orders = load(spark, folder, "orders").select("o_orderstatus", "o_totalprice", "o_orderdate")
    return synthesize(orders, replace(CONFIG, max_cluster_weight=1.0))


def synthesize_target(spark, folder):
    parts = load(spark, folder, "part").select("p_size", "p_retailprice", "p_brand")
    return synthesize_for_target(parts, "p_retailprice", CONFIG)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    value_parsing, seed_texts, noise_values, row_limits, rounding, range_tests, text_ranges, numeric_codes,
    decoded_fields, string_codes, root_ranges, cell_counts, content_digests, csv_texts, csv_round_trip, csv_inferred,
    entity_counts, low_count_groups, noisy_unique_counts, entity_contributions, flattened_counts, private_groups,
    tree_nodes_1d, tree_nodes_2d, tree_nodes_3d, tree_nodes_4d, tree_nodes_by_entity, tree_nodes_no_ids, tree_nodes_far, tree_nodes_fine, root_facts, harvest_1d, harvest_fronts, node_totals_2d, refined_buckets, inspected_nodes,
    synthetic_rows, column_entropies, pair_dependence, total_dependences, plan_quality, sampled_rows, dependence_report,
    cluster_search, feature_ranking, column_roles, complete_rows, patch_join, stitch_join, stitch_owners, stitch_bin_sizes, synthesize_single, synthesize_events,
    synthesize_manual, synthesize_independent, synthesize_target)}
