import itertools

import pytest
from pyspark.sql import functions as F

from areaindex.plans import assess, export
from areaindex.plans.rent import (
    burden_totals,
    rent_burden_cells,
    rent_burden_measures,
    rent_change,
    split_cells,
    split_landed_cells,
)
from areaindex.plans.scoring import pressure_flags, scenario_one, scenario_three, tiers
from areaindex.registry import core

FLAGS = ["v_VLI", "v_Renters", "v_RB50VLI", "v_POC", "dp_PChRent", "dp_RentGap", "big_city", "tr_dq"]


def every_combination(spark):
    shares = [
        (students, population, rank, poc, lag)
        for students, population in [(0.1, 500.0), (0.2, 500.0), (0.1, 499.0), (None, 500.0)]
        for rank, poc in [(0.95, 0.6), (0.9, 0.9), (0.94, 0.89), (None, None)]
        for lag in (0.6, 0.59)
    ]
    data = [(*f, *s) for f in itertools.product((0, 1), repeat=len(FLAGS)) for s in shares]
    schema = ", ".join(f"{f} int" for f in FLAGS)
    schema += ", tr_pstudents double, tr_population double, tr_POC_rank double, tr_pPOC double, scen1_VLI50RB_lag double"
    return spark.createDataFrame(data, schema)


def expected(r):
    few, people = r.tr_pstudents is not None and r.tr_pstudents < 0.2, r.tr_population >= 500
    three = r.v_Renters + r.v_RB50VLI + r.v_POC
    pressures = r.dp_PChRent + r.dp_RentGap
    vulnerable = r.v_VLI == 1 and few and people and three >= 2
    high = (r.tr_POC_rank or 0) >= 0.95 or (r.tr_pPOC or 0) >= 0.9
    scen1 = int(pressures >= 1 and (vulnerable or (high and few and people and r.v_VLI + three >= 3)))
    scen3 = scen1 if r.big_city else int(vulnerable and pressures == 2)
    tier1 = None
    if r.tr_dq == 0:
        tier1 = "Poor Data Quality"
    elif scen3 or (r.big_city and r.scen1_VLI50RB_lag >= 0.6 and vulnerable):
        tier1 = "Heightened Sensitivity"
    tier2 = "Vulnerable" if r.tr_dq and vulnerable else None
    pairs = [
        r.v_POC + r.v_VLI, r.v_POC + r.v_RB50VLI, r.v_POC + r.v_Renters, r.v_VLI + r.v_RB50VLI, r.v_VLI + r.v_Renters,
    ]
    some = r.v_VLI == 1 or 2 in pairs
    return scen1, scen3, tier1, tier2, "Tier 3: Some Vulnerability" if r.tr_dq and some else None


def test_rules_over_every_combination(spark):
    out = tiers(scenario_three(scenario_one(every_combination(spark)))).collect()
    assert len(out) == 8192
    for r in out:
        assert (r.scen1_VLI50RB, r.scen3_VLI50RB, r.tier1, r.tier2, r.tier3) == expected(r), r


def test_pressure_flags(spark):
    df = spark.createDataFrame(
        [
            (0.1, 0.0, 0.05, 0.2, 0.1),
            (-0.1, -0.15, -0.2, -0.1, -0.2),
            (-0.1, -0.3, -0.2, 0.2, 0.3),
            (None, 0.2, 0.1, None, 0.1),
        ],
        "tr_pchrent double, tr_pchrent_lag double, co_pchrent double, tr_rentgapprop double, co_rentgapprop double",
    )
    got = [(r.dp_PChRent, r.dp_RentGap) for r in pressure_flags(df).collect()]
    assert got == [(1, 1), (1, 0), (0, 0), (1, 0)]


def cells(spark, data):
    return split_cells(spark.createDataFrame(data, "geoid string, variable string, estimate double"))


def test_burden_measure_without_qualifying_cell(spark):
    """LI limit 8000, VLI limit 5000 in county c; LI limit 16000, VLI limit 10000 in county d, where
    the 10000-19999 band is partly under the first and just touched by the second."""
    split = cells(
        spark,
        [
            ("none", "ir_tot_tot", 10.0), ("none", "ir_19_9999", 10.0), ("none", "ir_5plus_99999", 4.0),
            ("some", "ir_tot_tot", 10.0), ("some", "ir_5plus_19999", 5.0),
        ],
    )
    group = spark.createDataFrame([("none", 10000.0), ("some", 20000.0)], "geoid string, co_mhhinc double")
    counties = spark.createDataFrame([("none", "c"), ("some", "d")], "geoid string, county string")
    totals = burden_totals(split).join(counties, "geoid")
    out = {r.geoid: r for r in rent_burden_measures(rent_burden_cells(split, group), totals).collect()}
    none, some = out["none"], out["some"]
    assert none.tr_irLI_30p is None and none.tr_irVLI_50p is None and none.v_rbVLI_50rb == 0
    assert some.tr_irLI_30p == pytest.approx(6000 / 9999 / 2)
    assert some.tr_irVLI_50p == 0.0 and some.tr_irLI_50p is None
    fixed = {r.geoid: r for r in rent_burden_measures(rent_burden_cells(split, group), totals, fix_50=True).collect()}
    assert fixed["some"].tr_irLI_50p == pytest.approx(6000 / 9999 / 2) and fixed["some"].tr_irVLI_50p is None


def test_rent_change_imputes_from_raw_values(spark):
    df = spark.createDataFrame(
        [("a", "c", 900.0, 800.0), ("b", "c", None, 600.0), ("d", "c", 1100.0, None), ("e", "x", None, 5.0)],
        "geoid string, county string, medrent double, medrent12 double",
    )
    got = {r.geoid: r for r in rent_change(df).collect()}
    assert got["b"].medrent == 1000.0 and got["d"].tr_medrent12 == 700.0
    assert got["b"].tr_pchrent == pytest.approx(400 / 600)
    assert got["a"].co_medrent12 == 700.0
    assert got["e"].medrent is None and got["e"].tr_chrent is None


# The published table of types, areas and sensitive areas.
GOLDEN = [
    ("White-Latinx", 2562, 553, "21.6%"),
    ("White-Asian-Latinx", 1922, 474, "24.7%"),
    ("White-Asian", 509, 63, "12.4%"),
    ("White-Shared", 449, 14, "3.1%"),
    ("All White", 56, None, None),
    ("White-Black-Latinx", 433, 145, "33.5%"),
    ("Asian-Latinx", 376, 172, "45.7%"),
    ("White-Black-Asian-Latinx", 348, 132, "37.9%"),
    ("All Latinx", 335, 143, "42.7%"),
    ("Black-Latinx", 304, 185, "60.9%"),
    ("Latinx-Shared", 293, 153, "52.2%"),
    ("Black-Asian-Latinx", 94, 52, "55.3%"),
    ("White-Latinx-Other", 90, 18, "20.0%"),
    ("Asian-Shared", 13, 3, "23.1%"),
    ("Black-Asian-Latinx-Other", 10, 7, "70.0%"),
    ("Black-Latinx-Other", 7, 5, "71.4%"),
    ("Black-Shared", 7, 3, "42.9%"),
    ("Asian-Latinx-Other", 5, 3, "60.0%"),
    ("Asian-Black", 3, 2, "66.7%"),
    ("All Other", 2, None, None),
    ("All Asian", 1, 1, "100.0%"),
    ("Black-Other", 1, None, None),
    ("Latinx-Other", 1, None, None),
    ("Other-Shared", 1, None, None),
    ("White-Asian-Latinx-Other", 55, 9, "16.4%"),
    ("Integrated", 44, 18, "40.9%"),
    ("White-Black-Latinx-Other", 26, 16, "61.5%"),
    ("White-Other", 20, 1, "5.0%"),
    ("White-Asian-Other", 18, 4, "22.2%"),
    ("White-Black-Asian", 16, 5, "31.2%"),
    ("White-Black", 8, 3, "37.5%"),
    ("White-Black-Other", 2, 1, "50.0%"),
    ("White-Black-Asian-Other", 1, None, None),
    ("unpopulated tract", 29, None, None),
]


@pytest.fixture(scope="module")
def golden(spark):
    counts = spark.createDataFrame([(t, a, s or 0) for t, a, s, _ in GOLDEN], "neigh_type string, a int, s int")
    return counts.select(
        "neigh_type", F.explode(F.sequence(F.lit(1), "a")).alias("i"), "s"
    ).select("neigh_type", F.when(F.col("i") <= F.col("s"), "Heightened Sensitivity").alias("tier1"))


def test_published_type_table(golden):
    got = [tuple(r) for r in export.type_shares(golden).collect()]
    assert sorted(got) == sorted(GOLDEN)
    assert [r[1] for r in got] == sorted((r[1] for r in got), reverse=True)


def test_published_table_collapsed(golden):
    got = {r.nt2: (r.count_ca, r.count_sc) for r in export.type_shares(export.collapse_types(golden), "nt2").collect()}
    assert len(got) == 15
    assert got["Mostly White"] == (505, 14) and got["Mostly POC"] == (51, 24) and got["Diverse"] == (190, 57)
    assert got["unpopulated tract"] == (29, None)
    assert sum(a for a, _ in got.values()) == 8041


def test_palette_and_transit(spark):
    df = spark.createDataFrame([("Heightened Sensitivity",), ("Poor Data Quality",), (None,)], "tier1 string")
    assert [r[0] for r in df.select(export.palette("tier1", export.TIER_COLOURS)).collect()] == ["#FF6633", "#CCCCCC", "transparent"]
    buffers = spark.createDataFrame([("1", export.TRANSIT_LABELS["Bus"]), ("2", "else")], "geo_id string, label string")
    assert [(r.geo_id, r.layer) for r in export.transit_layers(buffers).collect()] == [("1", "Bus")]


POPUP_INPUTS = dict(
    geoid="06001", tr_population=1234.0, tr_households=456.0, v_VLI=1, tr_VLI_prop=0.25, co_VLI_prop=0.2,
    tr_pstudents=0.1, v_POC=0, tr_pPOC=0.4, co_pPOC=0.5, v_Renters=1, tr_prenters=0.6, co_prenters=0.5,
    v_RB50VLI=0, tr_irVLI_50p=0.1, co_irVLI_50p=0.2, dp_PChRent=1, tr_pchrent=0.3, tr_pchrent_lag=0.2,
    co_pchrent=0.1, dp_RentGap=0, tr_rentgap=-120.0, co_rentgap=35.0, tr_medrent=1500.0, tr_medrent_lag=1380.0,
    neigh_type="White-Latinx", tr_pWhite=0.6, tr_pBlack=0.1, tr_pAsian=0.1, tr_pLatinx=0.15, tr_pOther=0.05,
)


def test_popup(spark):
    df = spark.createDataFrame([POPUP_INPUTS])
    text = df.select(export.popup()).first()[0]
    assert text.startswith("<h3>Tract: 06001</h3><b>Total population</b><br>1,234<br>")
    assert "Yes<br>(<i>25.0% tract VLI, 20.0% county VLI, & 10.0% students</i>)" in text
    assert "<b>Rent gap</b><br>     No (<i>-$120 tract & $35 county</i>)" in text
    assert text.endswith("<b>Other</b><br>5.0%<br>")
    gone = df.withColumn("tr_rentgap", F.lit(None).cast("double"))
    assert gone.select(export.popup()).first()[0] is None


def test_each_cell_name_is_split_once(spark, rows, monkeypatch):
    from areaindex.plans import rent

    names = ["ir_5plus_9999", "ir_tot_tot", "ir_19", "", None]
    data = [(g, n, e) for g in ("a", "b", "b", None) for n in names for e in (1.0, None)]
    df = spark.createDataFrame(data, "geoid string, variable string, estimate double")
    want, split, seen = rows(split_cells(df)), rent.split_cells, []
    monkeypatch.setattr(rent, "split_cells", lambda names: seen.append(names.count()) or split(names))
    got = split_landed_cells(df)
    assert got.columns == split_cells(df).columns and rows(got) == want and seen == [len(names)]


def test_columns_that_nothing_reads_are_not_landed(spark, rows, monkeypatch):
    """A narrow result equals the wide one's columns, and estimates don't go from step to step for it."""
    from areaindex.registry import outputs

    small, landed, land = "/root/testdata/sf0.001", {}, assess.land
    wide = outputs.scored(spark, small).select("area_key", "tr_POC_rank", "scen1_VLI50RB_lag", "tier1", "tier2", "tier3")

    def recorded(df, name="table", **options):
        landed[name] = df.columns
        return land(df, name, **options)

    monkeypatch.setattr(assess, "land", recorded)
    narrow = outputs.scored(spark, small, ["tr_POC_rank"])
    assert rows(narrow.select(wide.columns)) == rows(wide)
    for name in ("base", "profiled", "scored"):
        assert not {"race_tot", "v1", "tr_punemp", "HHInc_10"} & set(landed[name]), name
    assert "tr_POC_rank" in landed["scored"] and "tr_pPOC" not in landed["scored"]


def _sold(spark, folder):
    """Orders and lines of customers with no, one, two and many prices, and of no customer; 1998 is of no vintage."""
    spark.createDataFrame(
        [(o, c, t) for o, c, t in [(1, 1, 30000.0), (2, 1, None), (3, 2, 9.0), (4, None, 50001.0), (5, 3, 700000.0), (6, 1, 30003.0), (7, 4, 1.0)]],
        "o_orderkey long, o_custkey long, o_totalprice double",
    ).write.parquet(f"{folder}/orders.parquet")
    lines = [
        (1, 1, 2.0, 21.0, 0.02, 1995), (1, 2, 1.0, 7.5, 0.04, 1995), (2, 1, 4.0, 400.0, 0.0, 1996), (6, 1, 1.0, 9.0, 0.01, 1997),
        (6, 3, 0.0, 9.0, 0.01, 1998), (6, 7, 3.0, None, 0.08, 1999), (3, 1, 5.0, 60.0, 0.03, 1999), (3, 2, 5.0, 75.0, 0.03, 2001),
        (4, 1, 1.0, 3.0, None, 1992), (4, 2, 1.0, 4.0, 0.05, 1992), (5, 1, 1.0, 3.0, 0.05, None), (9, 1, 1.0, 3.0, 0.05, 1995),
    ]
    lines = spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_tax double, y int"
    )
    lines.selectExpr("* EXCEPT (y)", "CAST(make_date(y, 6, 1) AS timestamp_ntz) AS l_shipdate").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("hot_orders", [0, 1, 250_000])
def test_customers_by_their_rows_hot_or_not(spark, tmp_path, rows, hot_orders):
    sf = _sold(spark, tmp_path)
    sales = core.sales_by_area(spark, sf, hot_orders)
    margin = F.col("l_quantity") * F.round(F.col("l_tax") * 100).cast("int")
    year, price = F.year("l_shipdate"), F.floor(F.col("l_extendedprice") / F.col("l_quantity"))
    lines = [
        f(F.when(F.col("l_linenumber") == i, c)) for i in range(1, 8) for f, c in ((F.sum, F.col("l_quantity")), (F.sum, margin), (F.count, F.lit(1)))
    ]
    medians = [F.median(F.when(year <= 1997, price)), F.median(F.when(year >= 1999, price))]
    want = rows(core._sales(spark, sf).groupBy("o_custkey").agg(*lines, *medians))
    assert rows(sales) == want and len(want) == 4
    assert [t for _, t in sales.dtypes[-2:]] == ["double", "double"]
    assert (1, 9.5, None) in [(r.o_custkey, r.medrent12, r.m17) for r in sales.collect()]
    incomes = core.incomes_by_area(spark, sf, hot_orders)
    # A missing area meets no area, so only the others are compared.
    apart = core.area_income(spark, sf).join(core.income_wide(spark, sf), "area_key", "full")
    assert incomes.dtypes == apart.dtypes
    assert rows(incomes.filter("area_key IS NOT NULL")) == rows(apart.filter("area_key IS NOT NULL"))


def test_customers_are_not_aggregated_before_their_rows_meet(spark, tmp_path):
    """Medians of parts were sent as tables of values, for hardly fewer parts than rows."""
    for df in (core.sales_by_area(spark, _sold(spark, tmp_path)), core.rent(spark, str(tmp_path)), core.incomes_by_area(spark, str(tmp_path))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "percentile" not in plan and "median" not in plan.lower().replace("medrent", "")
        aggregates = [i for i, line in enumerate(plan.splitlines()) if "Aggregate" in line]
        exchanges = [i for i, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning(o_custkey" in line]
        assert exchanges and max(aggregates) < min(exchanges)


@pytest.mark.parametrize("hot_orders", [0, 1, 250_000])
def test_burden_cells_come_with_the_incomes(spark, tmp_path, rows, hot_orders):
    """One pass over orders gives what three gave."""
    data = [(c, p, t) for c in (1, 2, 2, None) for p in ("1-URGENT", "2-HIGH", "4-NOT", "5-LOW", "", None) for t in (39999.0, 40000.0, 9e5, None)]
    orders = spark.createDataFrame(data, "o_custkey long, o_orderpriority string, o_totalprice double")
    orders.withColumn("o_orderkey", F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/orders.parquet")
    sf = str(tmp_path)
    both = core.orders_by_area(spark, sf, hot_orders)
    assert core.burden_long(spark, sf, both).dtypes == core.burden_long(spark, sf).dtypes
    assert rows(core.burden_long(spark, sf, both)) == rows(core.burden_long(spark, sf))
    assert rows(core.incomes_by_area(spark, sf, orders=both)) == rows(core.incomes_by_area(spark, sf, hot_orders))


def test_hot_customers_are_looked_for_once(spark, rows, monkeypatch):
    from areaindex.registry import outputs

    seen, land = [], core.land
    monkeypatch.setattr(core, "land", lambda df, name="table", **options: seen.append(name) or land(df, name, **options))
    outputs.scored(spark, "/root/testdata/sf0.001", ())
    assert seen.count("hot-customers") == 1
