import pytest
from pyspark.sql import functions as F

from areaindex import functions as fn
from areaindex import operators as op
from areaindex.functions.bands import count_under
from areaindex.plans.income import income_shares, low_quality
from areaindex.plans.profile import gentrification_profile
from areaindex.plans.variables import AREA_VARIABLES, burden_variables


def values(df, *cols):
    return [tuple(r) if len(r) > 1 else r[0] for r in df.select(*cols).collect()]


def test_row_sums(spark):
    df = spark.createDataFrame([(1.0, None, 2.0), (None, None, None)], "a double, b double, c double")
    assert values(df, fn.row_sum0("a", "b", "c")) == [3.0, 0.0]
    assert values(df, fn.row_sum("a", "b", "c")) == [None, None]


def test_share_of_nothing_is_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (None, 2.0), (1.0, 4.0)], "a double, b double")
    assert values(df, fn.share("a", "b")) == [None, None, None, 0.25]


def test_residual_clip(spark):
    df = spark.createDataFrame(
        [(10.0, 3.0, 3.0, 3.0, 0.0), (10.0, 4.0, 4.0, 4.0, 0.0), (10.0, None, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0, 0.0)],
        "t double, a double, b double, c double, d double",
    )
    parts = ["a", "b", "c", "d"]
    got = values(df, fn.residual_share("t", parts, clip=True))
    assert got[0] == pytest.approx(0.1)
    assert got[1:] == [0.0, None, None]
    skipping = values(df, fn.residual_share("t", parts, skip_missing=True))
    assert skipping[2] == pytest.approx(0.7)


def test_first_match_skips_unknown_conditions(spark):
    df = spark.createDataFrame([(None,), (1.0,), (5.0,)], "a double")
    out = fn.case_when([(F.col("a") > 3, "big"), (F.col("a") <= 3, "small")], "unknown")
    assert values(df, out) == ["unknown", "small", "big"]


BAND_CASES = [(49999.0, 45000.0, 1.0), (59999.0, 50000.0, 2000 / 9999), (74999.0, 50000.0, 2000 / 24999), (99999.0, 75000.0, 0.0)]


def test_band_fraction(spark):
    df = spark.createDataFrame([(hi, lo) for hi, lo, _ in BAND_CASES], "hi double, lo double")
    got = values(df, "lo", fn.band_floor("hi"), fn.band_fraction(F.lit(52000.0), "lo", "hi"))
    assert [g[0] for g in got] == [g[1] for g in got]
    assert [g[2] for g in got] == pytest.approx([c[2] for c in BAND_CASES])
    assert values(df, fn.band_fraction(F.lit(None).cast("double"), "lo", "hi")) == [0.0] * 4


def test_band_floor_option(spark):
    df = spark.createDataFrame([(74999,), (5,)], "hi int")
    assert values(df, fn.band_floor("hi"), fn.band_floor("hi", fix_band_75=True)) == [(50000.0, 60000.0), (None, None)]


def test_band_fraction_grows_with_the_threshold(spark):
    t = spark.range(0, 260000, 1000).select(F.col("id").cast("double").alias("t"))
    for hi in fn.INCOME_BANDS.values():
        shares = values(t.orderBy("t"), fn.band_fraction("t", fn.band_floor(F.lit(hi)), F.lit(float(hi))))
        assert shares == sorted(shares)
        assert min(shares) >= 0 and max(shares) <= 1


def test_count_under_equals_the_band_by_band_sum(spark):
    df = spark.createDataFrame(
        [(40000.0, *range(1, 17)), (None, *range(1, 17)), (70000.0, *([None] * 16))],
        ["t", *fn.INCOME_BANDS],
    )
    long = fn.row_sum0(
        *[fn.band_fraction("t", fn.band_floor(F.lit(hi)), F.lit(float(hi))) * F.col(n) for n, hi in fn.INCOME_BANDS.items()]
    )
    got = values(df, count_under("t", fn.INCOME_BANDS), long)
    assert got[0][0] == pytest.approx(got[0][1])
    assert [g[0] for g in got[1:]] == [0.0, 0.0]


def test_burden_bands(spark):
    df = spark.createDataFrame([(9999.0,), (74999.0,), (100000.0,), (7.0,)], "code double")
    lo, hi = fn.band_bounds("code")
    assert values(df, lo, hi) == [(0.0, 9999.0), (50000.0, 74999.0), (100000.0, 200000.0), (None, 7.0)]


def test_quality_rule(spark):
    cases = [(100.0, 60.0), (100.0, 59.0), (0.0, 12.0), (0.0, 0.0), (None, 5.0), (50.0, None)]
    df = spark.createDataFrame(
        [(str(i), "totrent", e, m) for i, (e, m) in enumerate(cases)],
        "geoid string, variable string, estimate double, moe double",
    )
    assert sorted(r[0] for r in low_quality(df).collect()) == ["0", "2", "4"]


def test_formats(spark):
    df = spark.createDataFrame([(1234567.0,), (-0.5,), (-1234.4,), (0.0,), (None,)], "x double")
    assert values(df, fn.fmt_comma("x"), fn.fmt_dollar("x")) == [
        ("1,234,567", "$1,234,567"),
        ("-0", "$0"),
        ("-1,234", "-$1,234"),
        ("0", "$0"),
        (None, None),
    ]
    shares = spark.createDataFrame([(0.2158,), (1.0,), (None,)], "x double")
    assert values(shares, fn.fmt_percent("x")) == ["21.6%", "100.0%", None]


def test_text_with_missing_parts(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert values(df, fn.str_c("x ", F.col("t")), fn.paste0("x ", F.col("t"))) == [("x a", "x a"), (None, "x NA")]


def test_dictionaries():
    cells = burden_variables()
    assert len(AREA_VARIABLES) == 46 and len(set(AREA_VARIABLES.values())) == 46
    assert len(cells) == 64
    assert cells["ir_tot_tot"] == "B25074_001"
    assert cells["ir_5plus_34999"] == "B25074_027"
    assert cells["ir_x_100000"] == "B25074_064"


def test_area_without_households_has_missing_shares(spark):
    bands = list(fn.INCOME_BANDS)
    df = spark.createDataFrame(
        [("a", "c", 50000.0, *([10.0] * 16)), ("b", "c", None, *([None] * 16))],
        "geoid string, county string, mhhinc double, " + ", ".join(f"{b} double" for b in bands),
    )
    got = {r.geoid: r for r in income_shares(df).collect()}
    assert got["a"].co_mhhinc == got["b"].co_mhhinc == 50000.0
    assert got["a"].tr_totinc_count == 160.0
    assert got["b"].tr_totinc_count == 0.0 and got["b"].tr_LI_prop is None and got["b"].tr_LI_count == 0.0
    assert 0 < got["a"].tr_ELI_prop < got["a"].tr_VLI_prop < got["a"].tr_LI_prop < 1


def test_profile_sums_propagate_missing(spark):
    from areaindex.registry.indicators import _GEN

    names = [c for c in _GEN]
    df = spark.createDataFrame([tuple([1.0] * len(names))], names)
    df = df.withColumn("povfamh", F.lit(None).cast("double")).withColumn("totrace", F.lit(3.0))
    got = gentrification_profile(df).first()
    assert got.pPov is None and got.pOther == 0.0 and got.Other == -1.0 and got.pChild == 8.0


def test_separate(spark):
    df = spark.createDataFrame([("ir_5plus_9999",), ("ir_tot",)], "variable string")
    out = op.separate(df, "variable", ["kind", "rb", "income"])
    assert values(out, "kind", "rb", "income") == [("ir", "5plus", "9999"), ("ir", "tot", None)]


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["geoid", "TR_a", "co_b", "tr_c"])
    assert op.cols_starting(df, ["co_", "tr_"]) == ["co_b", "TR_a", "tr_c"]
    assert op.cols_between(df, "TR_a", "co_b") == ["TR_a", "co_b"]
    assert op.cols_ending(df, "_A") == ["TR_a"]


def test_separate_runs_its_pattern_once_a_row(spark):
    df = spark.createDataFrame([("ir_5plus_9999",), ("--ir..tot_",), (None,), ("ir",), ("a_b c-d/e",)], "variable string")
    out = op.separate(df, "variable", ["kind", "rb", "income"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert [tuple(r) for r in out.collect()] == [
        ("ir", "5plus", "9999"), ("", "ir", "tot"), (None, None, None), ("ir", None, None), ("a", "b", "c")
    ]
    assert [tuple(r) for r in op.separate(df, "variable", ["x", "y"], "[.]+").collect()][1] == ("--ir", "tot_")
