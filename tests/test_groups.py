import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from areaindex import operators as op
from areaindex.operators import order_stats, pairs
from areaindex.operators.pairs import lookup_join, salted_join
from areaindex.plans.rent import rent_change
from areaindex.plans.disadvantage import census_shares, disadvantage_index, CENSUS_COLUMNS, CENSUS_PERIODS


def test_spread_and_gather_are_inverse(spark, rows):
    df = spark.createDataFrame([("a", "v1", 1.0), ("a", "v2", None), ("b", "v2", 4.0)], "id string, k string, x double")
    wide = op.spread(df, ["id"], "k", "x", ["v1", "v2"])
    assert rows(wide, "id") == [("a", 1.0, None), ("b", None, 4.0)]
    back = op.gather(wide, ["id"], ["v1", "v2"], "k", "x").filter("x is not null")
    assert rows(back) == rows(df.filter("x is not null"))


def test_spread_refuses_duplicates(spark):
    df = spark.createDataFrame([("a", "v1", 1.0), ("a", "v1", 2.0)], "id string, k string, x double")
    with pytest.raises(Exception, match="more than once"):
        op.spread(df, ["id"], "k", "x", ["v1"]).collect()
    assert op.spread(df, ["id"], "k", "x", ["v1"], on_duplicate="max").first().v1 == 2.0


def test_spread_counts_duplicates_over_many_keys(spark):
    keys = [f"k{i}" for i in range(130)]
    df = spark.createDataFrame([("a", k, 1.0) for k in keys], "id string, k string, x double")
    assert op.spread(df, ["id"], "k", "x", keys).first().k129 == 1.0
    twice = df.union(df.filter("k = 'k125'"))
    with pytest.raises(Exception, match="more than once"):
        op.spread(twice, ["id"], "k", "x", keys).collect()


def test_missing_keys_match_in_a_natural_join(spark, rows):
    left = spark.createDataFrame([(1, None)], "id int, m double")
    right = spark.createDataFrame([(1, None, 7)], "id int, m double, z int")
    assert rows(op.natural_left_join(left, right)) == [(1, None, 7)]


def test_rank_share_ties_and_missing(spark):
    df = spark.createDataFrame([("c", 1.0), ("c", 1.0), ("c", 3.0), ("c", None)], "county string, v double")
    got = op.rank_share(df, "county", "v", "r").orderBy("v").collect()
    assert [r.r for r in got] == [None, 0.375, 0.375, 0.75]


def test_medians_and_rank_from_one_positions_table(spark, rows, tmp_path):
    random.seed(4)
    values = [None, float("nan"), 1.0, 1.0, 2.5, 7.0]
    data = [(i, random.choice(["a", "b", None]), random.choice(values), random.choice(values)) for i in range(500)]
    data += [(500, "empty", None, None)]
    df = spark.createDataFrame(data, "id int, g string, v double, w double")
    medians = {"mv": "v", "mw": "w"}
    apart = op.with_group_median(op.rank_share(df, "g", "v", "r"), ["g"], medians)
    landed = []
    keep, order_stats.land = order_stats.land, lambda d, name: landed.append(name) or keep(d, name)
    try:
        together = op.with_medians_and_rank(df, "g", medians, "v", "r", ranges=3)
        alone = op.with_medians_and_rank(df, "g", {"mw": "w"}, "v", "r")
    finally:
        order_stats.land = keep
    assert landed == ["ranges", "ranges"]
    cols = ["id", "r", "mv", "mw"]
    assert rows(together.select(cols)) == rows(apart.select(cols))
    assert rows(alone.select("id", "r", "mw")) == rows(apart.select("id", "r", "mw"))


@pytest.mark.parametrize("error", [0.2, 0.01, 0.001])
def test_approximate_quantiles_keep_their_rank_error(spark, error):
    random.seed(5)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    data = [("a", random.choice([1.0, 2.0, random.gauss(0, 9)])) for _ in range(20000)]
    data += [("b", float(i)) for i in range(7)] + [("b", None), ("b", float("nan")), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(9)
    got = {r.g: r for r in op.approx_group_quantiles(df, ["g"], ["v"], probs, error).collect()}
    assert set(got) == {"a", "b"}
    for g, r in got.items():
        values = [v for h, v in data if h == g and v is not None and v == v]
        for i, p in enumerate(probs):
            q, n = r[f"q{i}"], len(values)
            assert q in values
            assert sum(v < q for v in values) - error * n - 1 <= p * n <= sum(v <= q for v in values) + error * n + 1
    empty = op.approx_group_quantiles(df.limit(0), ["g"], ["v"], probs, error)
    assert empty.columns == ["g", "measure", "q0", "q1", "q2", "q3", "q4"] and empty.isEmpty()
    with pytest.raises(ValueError, match="share of the rows"):
        op.approx_group_quantiles(df, ["g"], ["v"], probs, 0.0)


def test_rank_share_against_a_window(spark, rows):
    random.seed(1)
    data = [(random.choice("aab"), random.choice([None, 1.0, 2.5, random.random()])) for _ in range(3000)]
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(data)], "id int, g string, v double")
    cut = rows(op.rank_share(df, "g", "v", "r", ranges=7).select("id", F.round("r", 9)))
    got = rows(op.rank_share(df, "g", "v", "r").select("id", F.round("r", 9)))
    assert got == cut
    df.createOrReplaceTempView("ranked")
    want = rows(
        spark.sql(
            """select id, round(case when v is not null then (rank() over (partition by g order by v nulls last)
            + (count(*) over (partition by g, v) - 1) / 2d) / count(*) over (partition by g) end, 9) from ranked"""
        )
    )
    assert got == want


def test_strict_summary_propagates_missing(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (None, 2.0)], "a double, b double")
    got = op.strict_agg(df, {"a": "a", "b": "b"}).first()
    assert (got.pa, got.ma, got.pb, got.mb) == (None, None, 2.0, 2.0)


def test_zscores(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (None, None)], "a double, b double")
    got = op.zscore(df, ["a", "b"]).orderBy(F.col("a").asc_nulls_last()).collect()
    assert [r.a for r in got] == [pytest.approx(-math.sqrt(0.5)), pytest.approx(math.sqrt(0.5)), None]
    assert [r.b for r in got] == [None, None, None]


def test_zscores_have_mean_0_and_sd_1_per_group(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    got = op.zscore(df, ["v"], ["g"]).groupBy("g").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).collect()
    for r in got:
        assert r.m == pytest.approx(0, abs=1e-12) and r.s == pytest.approx(1)


def test_index_skips_missing_scores(spark):
    cols = [c for names in CENSUS_COLUMNS.values() for c in names.values()]
    data = [(str(i), *[float((i * 7 + j) % 5) for j in range(20)]) for i in range(4)] + [("x", *([-999.0] * 20))]
    df = spark.createDataFrame(data, ["GEO2010", *cols])
    got = disadvantage_index(census_shares(df), CENSUS_PERIODS, area_id="GEO2010").collect()
    assert set(CENSUS_PERIODS) == {"dis1980", "dis1990", "dis2000", "dis2010"}
    assert [tuple(r)[1:] for r in got if r.GEO2010 == "x"] == [(0.0, 0.0, 0.0, 0.0)]
    assert sum(r.dis1980 for r in got) == pytest.approx(0, abs=1e-12)


def quantile(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    lo, hi = values[math.floor(h)], values[math.ceil(h)]
    return lo + (hi - lo) * (h - math.floor(h))


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.floats(-1e6, 1e6))), min_size=1, max_size=60))
def test_quantiles_of_small_groups(spark, data):
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.q0, r.q1) for r in op.group_quantiles(df, ["g"], ["v"], [0.25, 0.5]).collect()}
    groups = {g: [v for h, v in data if h == g and v is not None] for g, _ in data}
    want = {g: (quantile(v, 0.25), quantile(v, 0.5)) for g, v in groups.items() if v}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g])


@pytest.mark.parametrize("shape", ["spread", "tied", "two"])
def test_quantiles_of_large_groups_(spark, shape):
    n = 40_000
    v = {
        "spread": F.sin(F.col("id") * 12.9898) * 43758.5453,
        "tied": F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") % 1000).cast("double")),
        "two": F.when(F.col("id") < n // 2, 1.0).otherwise(2.0),
    }[shape]
    df = spark.range(n).select(F.lit("g").alias("g"), v.alias("v"))
    got = op.group_quantiles(df, ["g"], ["v"], [0.25, 0.5, 0.75]).first()
    values = [r.v for r in df.select("v").collect()]
    assert (got.q0, got.q1, got.q2) == pytest.approx(tuple(quantile(values, p) for p in (0.25, 0.5, 0.75)))


def test_small_and_large_groups_together(spark):
    """Groups under the limit stay whole inside the brackets of a large one."""
    df = spark.range(30_050).select(
        F.when(F.col("id") < 20_000, "hot")
        .when(F.col("id") < 30_000, F.concat(F.lit("mid"), (F.col("id") % 4).cast("string")))
        .otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
        .alias("g"),
        (F.col("id") * 7919 % 10007).cast("double").alias("v"),
        F.when(F.col("id") % 3 == 0, F.sqrt("id")).alias("w"),
    )
    got = {r.g: (r.a, r.b) for r in op.group_medians(df, ["g"], {"a": "v", "b": "w"}).collect()}
    want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.median("v").alias("a"), F.median("w").alias("b")).collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert got[g] == pytest.approx(want[g])


def test_group_medians_with_missing_group_keys(spark, rows):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("b", None)], "g string, v double")
    out = op.with_group_median(df, ["g"], {"m": "v"})
    assert rows(out) == rows(spark.createDataFrame([(None, 1.0, 2.0), (None, 3.0, 2.0), ("a", 5.0, 5.0), ("b", None, None)], "g string, v double, m double"))


def test_lookup_join_without_broadcast_keeps_all_rows(spark, rows):
    group = F.when(F.col("id") % 5 > 0, F.col("id") % 7 * (F.col("id") % 3))
    df = spark.range(5000).select(group.alias("g"), "id")
    stats = df.filter("g is null or g <> 2").groupBy("g").agg(F.sum("id").alias("s"))
    small = rows(lookup_join(df, stats, ["g"]))
    assert len(small) == 5000
    assert rows(lookup_join(df, stats, ["g"], broadcast_cells=1)) == small
    assert rows(lookup_join(df, stats, ["g"], broadcast_cells=1, chunk=100)) == small


def test_salted_join_equals_plain_join(spark, rows):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(60).select((F.col("id") % 40).alias("k"), F.col("id").alias("r"))
    assert rows(salted_join(left, right, ["k"], chunk=100)) == rows(left.join(right, ["k"]).select("k", "id", "r"))


def test_impute_keeps_groups_without_values_missing(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", 2.0), ("b", None)], "g string, v double")
    assert rows(op.impute_group_median(df, ["g"], {"v": "v"})) == sorted([("a", 2.0), ("a", 2.0), ("b", None)], key=repr)


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_order_statistics_do_not_depend_on_the_ranges(spark, rows, ranges):
    df = spark.range(6000).select(
        "id",
        F.concat(F.lit("g"), F.col("id") % 40).alias("g"),
        F.when(F.col("id") % 11 > 0, F.sin(F.col("id") * 12.9898) * 43758.5453).alias("v"),
    )
    quantiles = op.group_quantiles(df, ["g"], ["v"], [0.25, 0.5, 0.75])
    assert rows(op.group_quantiles(df, ["g"], ["v"], [0.25, 0.5, 0.75], ranges)) == rows(quantiles)
    assert rows(op.rank_share(df, "g", "v", "r", ranges)) == rows(op.rank_share(df, "g", "v", "r"))


@pytest.mark.parametrize("chunk", [10, 40, 100])
def test_hot_keys_of_both_sides_are_split(spark, rows, chunk):
    """No task holds a whole side: every block pair has at most its share of rows of each."""
    left = spark.range(900).select(F.when(F.col("id") < 500, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(700).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 60).alias("k"), F.col("id").alias("r"))
    plain = left.join(right, ["k"]).select("k", "id", "r")
    for both in (False, True):
        assert rows(salted_join(left, right, ["k"], chunk, both)) == rows(plain)
    assert pairs.pair_count(left, right, ["k"]) == plain.count()
    sides = pairs._deal(left, right, ["k"], chunk, both=True)
    for side in sides:
        sizes = side.filter("k = 0").groupBy("_block", "_block_2").count()
        assert sizes.count() == math.ceil(510 / chunk) * math.ceil(307 / chunk)
        assert sizes.agg(F.max("count")).first()[0] <= 2 * chunk


def test_equal_rows_of_a_hot_key_use_all_blocks(spark):
    left = spark.range(50_000).select(F.lit(1).alias("k"), F.lit("same").alias("v"))
    right = spark.createDataFrame([(1, "r")], "k int, r string")
    dealt, copied = pairs._deal(left, right, ["k"], 1000)
    assert dealt.select("_block").distinct().count() == copied.count() == 50
    assert salted_join(left, right, ["k"], 1000).count() == 50_000


def test_rows_are_dealt_alike_when_a_task_runs_again(spark):
    """The side comes from a shuffle whose rows arrive in any order; another run finds the same blocks."""
    drawn = F.udf(lambda i: random.random(), "double").asNondeterministic()
    left = spark.range(20_000).withColumn("_o", drawn("id")).repartition(5, "_o").sortWithinPartitions("_o").select(F.lit(1).alias("k"), "id")
    assert [r.id for r in left.head(50)] != [r.id for r in left.head(50)]
    dealt, _ = pairs._deal(left, spark.createDataFrame([(1, "r")], "k int, r string"), ["k"], 500)
    first = {r.id: r._block for r in dealt.collect()}
    assert {r.id: r._block for r in dealt.orderBy(F.rand()).collect()} == first and len(first) == 20_000


def test_missing_values_are_spread_alike_when_a_task_runs_again(spark, rows):
    df = spark.range(4000).select("id", F.lit("g").alias("g"), F.when(F.col("id") % 3 == 0, F.col("id") * 1.0).alias("v"))
    out = op.rank_share(df, "g", "v", "r")
    assert rows(out) == rows(op.rank_share(df.repartition(7, "id"), "g", "v", "r"))
    assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_imputed_median_stays_the_median(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", None, None), ("a", 4.0, 9.0), ("b", None, 3.0), ("b", None, None)], "county string, medrent double, medrent12 double"
    )
    got = {(r.county, r.tr_medrent12): (r.medrent, r.co_medrent12) for r in rent_change(df).collect()}
    assert got == {("a", 2.0): (1.0, 5.5), ("a", 5.5): (2.5, 5.5), ("a", 9.0): (4.0, 5.5), ("b", 3.0): (None, 3.0)}


def test_joins_broadcast_only_what_was_counted(spark):
    left = spark.range(100).withColumnRenamed("id", "k")
    right = left.withColumn("v", F.col("k") * 2)
    plan = op.natural_left_join(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    plan = lookup_join(left, right, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    plan = lookup_join(left, right, ["k"], broadcast_cells=10)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
