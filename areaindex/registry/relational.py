"""Queries of the relational operators: reading, columns, reshape, joins, aggregates, groups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaindex import functions as fn
from areaindex import operators as op
from areaindex.plans.export import TYPE_GROUPS
from areaindex.registry import core
from areaindex.registry.core import VARIABLES, R, query, rounded
from areaindex.sources import (
    apply_dict,
    estimates_from,
    land,
    read_csv_clean,
    read_estimates,
    scratch_dir,
    write_estimates,
    write_table,
)

NAMED = {"renters": "v1", "black": "v2", "asian": "v3", "white": "v4"}
V_LIST = ", ".join(VARIABLES)


def _decode(c: str = "variable") -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{code}' THEN '{name}'" for name, code in NAMED.items()) + " END"


_CODES = ", ".join(f"'{c}'" for c in NAMED.values())


@query(
    "estimates_tidy",
    f"""SELECT a.geoid, concat('Area ', CAST(a.area_key AS STRING)) AS name, {_decode("l.variable")} AS variable,
       {R("estimate", "moe")}, 2017 AS year, '06' AS state
FROM acs_long l JOIN areas a ON l.area_key = a.area_key
WHERE l.variable IN ({_CODES})""",
    ["acs_long", "areas"],
)
def estimates_tidy(spark, sf):
    """Landed copy partitioned by year and state, two vintages and states, one of each read."""
    return rounded(read_estimates(spark, stored_estimates(spark, sf), NAMED, state="06", year=2017))


def stored_estimates(spark, sf):
    """Path of the landed copy."""
    recent = (
        core.acs_long(spark, sf)
        .join(core.areas(spark, sf).hint("merge"), "area_key")
        .select(
            "geoid",
            F.concat(F.lit("Area "), F.col("area_key").cast("string")).alias("name"),
            "variable",
            "estimate",
            "moe",
            F.lit(2017).alias("year"),
            F.substring("geoid", 1, 2).alias("state"),
        )
    )
    vintages = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(s).alias("s")) for y, s in [(2017, "06"), (2012, "06"), (2017, "53")]]))
    stored = recent.withColumn("v", vintages).withColumns({"year": F.col("v.y"), "state": F.col("v.s")}).drop("v")
    path = scratch_dir(spark, "estimates")
    write_estimates(stored, path)
    return path


@query("estimates_reused", core.ORACLES["estimates_tidy"])
def estimates_reused(spark, sf):
    """The selection fetched by one call, and found again by the next, which reads the copy alone."""
    path = stored_estimates(spark, sf)
    read_estimates(spark, path, NAMED, state="06", year=2017, cache=True)
    return rounded(read_estimates(spark, path, NAMED, state="06", year=2017, cache=True))


# Two names stand on one code.
SHARED = {**NAMED, "tenants": "v1"}


@query(
    "estimates_shared_code",
    f"""SELECT l.area_key, d.name AS variable, {R("estimate", "moe")} FROM acs_long l
JOIN (VALUES {", ".join(f"('{name}', '{code}')" for name, code in SHARED.items())}) AS d(name, code) ON l.variable = d.code""",
    ["acs_long"],
)
def estimates_shared_code(spark, sf):
    return rounded(estimates_from(core.acs_long(spark, sf), SHARED))


@query(
    "estimates_wide",
    "SELECT area_key, "
    + ", ".join(
        R(f"{n}_{s}=max(CASE WHEN variable = '{c}' THEN {col} END)")
        for n, c in NAMED.items()
        for s, col in (("e", "estimate"), ("m", "moe"))
    )
    + f" FROM acs_long WHERE variable IN ({_CODES}) GROUP BY area_key",
    ["acs_long"],
)
def estimates_wide(spark, sf):
    return rounded(
        estimates_from(core.acs_long(spark, sf), NAMED, output="wide", keep_moe=True, id_cols=["area_key"])
    )


@query(
    "apply_dict",
    f"SELECT area_key, {_decode()} AS variable, {R('estimate', 'moe')} FROM acs_long WHERE variable IN ({_CODES})",
    ["acs_long"],
)
def apply_dict_query(spark, sf):
    return rounded(apply_dict(core.acs_long(spark, sf), NAMED))


@query(
    "apply_dict_table",
    f"""SELECT l.area_key, d.name AS variable, {R("estimate", "moe")} FROM acs_long l
JOIN (SELECT 'part ' || CAST(p_partkey AS STRING) AS name, 'v' || CAST(p_partkey AS STRING) AS code FROM part) d
ON l.variable = d.code""",
    ["acs_long"],
)
def apply_dict_table(spark, sf):
    """A dictionary as long as the table of parts; most of its codes have no rows."""
    key = F.col("p_partkey").cast("string")
    names = core.table(spark, sf, "part").select(F.concat(F.lit("part "), key).alias("name"), F.concat(F.lit("v"), key).alias("code"))
    return rounded(apply_dict(core.acs_long(spark, sf), names))


@query(
    "csv_na_tokens",
    f"""SELECT geoid, CASE WHEN neigh_type = 'BUILDING' THEN NULL ELSE neigh_type END AS neigh_type,
       {R("v1", "v3")} FROM area_wide""",
    ["area_wide"],
)
def csv_na_tokens(spark, sf):
    """Missing values written as different tokens, padded with blanks, and read back as missing."""
    df = core.area_wide(spark, sf).select(
        "geoid",
        F.when(F.col("neigh_type") == "BUILDING", "NA").otherwise(F.col("neigh_type")).alias("neigh_type"),
        F.concat(F.lit("  "), F.coalesce(F.col("v1").cast("string"), F.lit("NA"))).alias("v1"),
        F.coalesce(F.col("v3").cast("string"), F.lit(" ")).alias("v3"),
    )
    path = scratch_dir(spark, "csv")
    df.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    schema = T.StructType(
        [
            T.StructField("geoid", T.StringType()),
            T.StructField("neigh_type", T.StringType()),
            T.StructField("v1", T.DoubleType()),
            T.StructField("v3", T.DoubleType()),
        ]
    )
    return rounded(read_csv_clean(spark, path, schema))


@query(
    "csv_bz2_roundtrip",
    f"SELECT geoid, county, neigh_type, {R(*VARIABLES)} FROM area_wide",
    ["area_wide"],
)
def csv_bz2_roundtrip(spark, sf):
    df = core.area_wide(spark, sf).select("geoid", "county", "neigh_type", *VARIABLES)
    path = scratch_dir(spark, "csv")
    write_table(df, path)
    return rounded(read_csv_clean(spark, path, df.schema))


@query(
    "select_rename",
    f"SELECT area_key AS id, variable AS name, {R('value=estimate')} FROM acs_long",
    ["acs_long"],
)
def select_rename(spark, sf):
    df = core.acs_long(spark, sf).drop("moe")
    return rounded(df.withColumnsRenamed({"area_key": "id", "variable": "name", "estimate": "value"}))


@query("row_filter", f"SELECT area_key, variable, {R('estimate', 'moe')} FROM acs_long WHERE variable = 'v1' AND estimate > 20", ["acs_long"])
def row_filter(spark, sf):
    df = core.acs_long(spark, sf)
    return rounded(df.filter((F.col("variable") == "v1") & (F.col("estimate") > 20)))


@query("isin_filter", f"SELECT area_key, variable, {R('estimate', 'moe')} FROM acs_long WHERE variable IN ('v2', 'v5', 'v7')", ["acs_long"])
def isin_filter(spark, sf):
    return rounded(core.acs_long(spark, sf).filter(F.col("variable").isin("v2", "v5", "v7")))


@query(
    "null_filter",
    f"""SELECT area_key, variable, {R("estimate", "moe")}, 'kept' AS part FROM acs_long WHERE estimate IS NOT NULL AND moe IS NOT NULL
UNION ALL SELECT area_key, variable, {R("estimate", "moe")}, 'missing' FROM acs_long WHERE estimate IS NULL OR moe IS NULL""",
    ["acs_long"],
)
def null_filter(spark, sf):
    df = core.acs_long(spark, sf)
    known = F.col("estimate").isNotNull() & F.col("moe").isNotNull()
    parted = df.withColumn("part", F.when(known, "kept").otherwise("missing"))
    return rounded(parted)


@query("distinct_rows", "SELECT DISTINCT area_key, floor(estimate / 50) AS level FROM acs_long", ["acs_long"])
def distinct_rows(spark, sf):
    return core.acs_long(spark, sf).select("area_key", F.floor(F.col("estimate") / 50).cast("double").alias("level")).distinct()


@query(
    "semi_subset",
    """SELECT geoid, county, neigh_type FROM areas
WHERE area_key IN (SELECT area_key FROM acs_long WHERE variable = 'v1' AND estimate > 50)""",
    ["areas", "acs_long"],
)
def semi_subset(spark, sf):
    large = core.acs_long(spark, sf).filter((F.col("variable") == "v1") & (F.col("estimate") > 50))
    members = op.ids(large, "area_key")
    return op.semi_filter(core.areas(spark, sf), members, "area_key").select("geoid", "county", "neigh_type")


@query("area_lookup", "SELECT * FROM areas WHERE area_key = 42", ["areas"])
def area_lookup(spark, sf):
    return core.areas(spark, sf).filter(F.col("area_key") == 42)


@query(
    "inflate_vintage",
    f"SELECT area_key, variable, {R('estimate=estimate * 1.07e0', 'moe')} FROM acs_long",
    ["acs_long"],
)
def inflate_vintage(spark, sf):
    return rounded(op.scale_col(core.acs_long(spark, sf), "estimate", 1.07))


@query("spread_wide", f"SELECT area_key, {R(*VARIABLES)} FROM wide", ["wide"])
def spread_wide(spark, sf):
    return rounded(core.wide(spark, sf))


@query(
    "gather_long",
    " UNION ALL ".join(f"SELECT area_key, '{v}' AS variable, {R(f'estimate={v}')} FROM wide" for v in VARIABLES),
    ["wide"],
)
def gather_long(spark, sf):
    return rounded(op.gather(core.wide(spark, sf), ["area_key"], VARIABLES, "variable", "estimate"))


@query(
    "fill_zero",
    "SELECT area_key, " + R(*[f"{v}=coalesce({v}, 0)" for v in VARIABLES]) + " FROM wide",
    ["wide"],
)
def fill_zero(spark, sf):
    return rounded(op.fill_zero(core.wide(spark, sf), VARIABLES))


@query(
    "sentinel_null",
    f"SELECT area_key, {R(*VARIABLES)} FROM (SELECT area_key, "
    + ", ".join(f"nullif(coalesce({v}, -999), -999) AS {v}" for v in VARIABLES)
    + " FROM wide) s",
    ["wide"],
)
def sentinel_null(spark, sf):
    coded = core.wide(spark, sf).fillna(-999.0, subset=VARIABLES)
    return rounded(op.sentinel_to_null(coded, VARIABLES))


@query(
    "cast_columns",
    f"""SELECT area_key, CAST(CAST(v1 AS BIGINT) AS STRING) AS as_text,
       {R("as_number=TRY_CAST(CASE WHEN v3 IS NULL THEN 'n/a' ELSE CAST(v3 AS STRING) END AS DOUBLE)")} FROM wide""",
    ["wide"],
)
def cast_columns(spark, sf):
    df = core.wide(spark, sf)
    mixed = df.withColumn("t", F.when(F.col("v3").isNull(), "n/a").otherwise(F.col("v3").cast("string")))
    return rounded(
        mixed.select(
            "area_key",
            fn.to_text(F.col("v1").cast("bigint")).alias("as_text"),
            fn.to_double("t").alias("as_number"),
        )
    )


@query(
    "row_sum0",
    f"SELECT area_key, {R('total=' + ' + '.join(f'coalesce({v}, 0)' for v in VARIABLES))} FROM wide",
    ["wide"],
)
def row_sum0(spark, sf):
    return rounded(core.wide(spark, sf).select("area_key", fn.row_sum0(*VARIABLES).alias("total")))


@query("row_sum_strict", f"SELECT area_key, {R('total=' + ' + '.join(VARIABLES))} FROM wide", ["wide"])
def row_sum_strict(spark, sf):
    return rounded(core.wide(spark, sf).select("area_key", fn.row_sum(*VARIABLES).alias("total")))


@query(
    "shares",
    f"SELECT area_key, {R('p_first=v1 / nullif(v1 + v2, 0)', 'p_rest=1 - v1 / nullif(v1 + v2, 0)', 'p_third=v3 / nullif(v1, 0)')} FROM wide",
    ["wide"],
)
def shares(spark, sf):
    first = fn.share("v1", F.col("v1") + F.col("v2"))
    return rounded(
        core.wide(spark, sf).select(
            "area_key",
            first.alias("p_first"),
            (1 - first).alias("p_rest"),
            fn.share("v3", "v1").alias("p_third"),
        )
    )


@query(
    "residual_share",
    f"""SELECT area_key, {R("plain=(v1 - v2 - v3) / nullif(v1, 0)",
                            "skipping=(v1 - coalesce(v2, 0) - coalesce(v3, 0)) / nullif(v1, 0)")} FROM wide""",
    ["wide"],
)
def residual_share(spark, sf):
    return rounded(
        core.wide(spark, sf).select(
            "area_key",
            fn.residual_share("v1", ["v2", "v3"]).alias("plain"),
            fn.residual_share("v1", ["v2", "v3"], skip_missing=True).alias("skipping"),
        )
    )


@query(
    "residual_share_clip",
    f"SELECT area_key, {R('other=CASE WHEN (v1 - v2 - v3) / nullif(v1, 0) < 0 THEN 0 ELSE (v1 - v2 - v3) / nullif(v1, 0) END')} FROM wide",
    ["wide"],
)
def residual_share_clip(spark, sf):
    return rounded(
        core.wide(spark, sf).select("area_key", fn.residual_share("v1", ["v2", "v3"], clip=True).alias("other"))
    )


@query(
    "case_when_null",
    """SELECT area_key, CASE WHEN v3 > 100 THEN 'high' WHEN v1 > 100 THEN 'first' WHEN v3 IS NULL THEN NULL ELSE 'rest' END AS label
FROM wide""",
    ["wide"],
)
def case_when_null(spark, sf):
    label = fn.case_when(
        [(F.col("v3") > 100, "high"), (F.col("v1") > 100, "first"), (F.col("v3").isNull(), None)], "rest"
    )
    return core.wide(spark, sf).select("area_key", label.alias("label"))


@query(
    "derived_chain",
    f"""SELECT area_key, {R("total", "p1", "p2")}, CASE WHEN p1 > p2 THEN 1 ELSE 0 END AS larger
FROM (SELECT *, v1 / nullif(total, 0) AS p1, v2 / nullif(total, 0) AS p2 FROM (SELECT *, v1 + v2 AS total FROM wide) a) b""",
    ["wide"],
)
def derived_chain(spark, sf):
    out = op.with_columns_seq(
        core.wide(spark, sf),
        [
            ("total", F.col("v1") + F.col("v2")),
            {"p1": fn.share("v1", "total"), "p2": fn.share("v2", "total")},
            ("larger", fn.above("p1", "p2")),
        ],
    )
    return rounded(out.select("area_key", "total", "p1", "p2", "larger"))


# --------------------------------------------------------------- categories


@query("parent_id", "SELECT geoid, substr(geoid, 1, 5) AS parent, substr(geoid, 1, 2) AS state FROM areas", ["areas"])
def parent_id(spark, sf):
    return core.areas(spark, sf).select(
        "geoid", fn.parent_id("geoid").alias("parent"), fn.parent_id("geoid", 2).alias("state")
    )


@query(
    "group_count",
    """SELECT CASE WHEN neigh_type = 'BUILDING' THEN NULL ELSE neigh_type END AS neigh_type, count(*) AS n
FROM areas GROUP BY 1""",
    ["areas"],
)
def group_count(spark, sf):
    typed = core.areas(spark, sf).withColumn("neigh_type", F.nullif("neigh_type", F.lit("BUILDING")))
    return typed.groupBy("neigh_type").agg(F.count(F.lit(1)).alias("n"))


@query("global_count", "SELECT count(*) AS n FROM acs_long WHERE variable = 'v1' AND estimate < 100", ["acs_long"])
def global_count(spark, sf):
    small = core.acs_long(spark, sf).filter((F.col("variable") == "v1") & (F.col("estimate") < 100))
    return small.agg(F.count(F.lit(1)).alias("n"))


@query(
    "membership_flag",
    """SELECT a.geoid, CASE WHEN a.area_key IN (SELECT area_key FROM acs_long WHERE moe IS NULL) THEN 0 ELSE 1 END AS ok
FROM areas a""",
    ["areas", "acs_long"],
)
def membership_flag(spark, sf):
    members = core.acs_long(spark, sf).filter(F.col("moe").isNull())
    return op.flag_in(core.areas(spark, sf), members, "area_key", "ok", if_in=0, if_out=1).select("geoid", "ok")


@query(
    "subset_share",
    f"""SELECT neigh_type, count(*) AS n_all,
       nullif(count(CASE WHEN area_key % 7 = 0 AND neigh_type <> 'BUILDING' THEN 1 END), 0) AS n_subset,
       {R("share=CAST(nullif(count(CASE WHEN area_key % 7 = 0 AND neigh_type <> 'BUILDING' THEN 1 END), 0) AS DOUBLE) / count(*)")}
FROM areas GROUP BY neigh_type ORDER BY n_all DESC, neigh_type""",
    ["areas"],
)
def subset_share(spark, sf):
    chosen = (F.col("area_key") % 7 == 0) & (F.col("neigh_type") != "BUILDING")
    return op.subset_share(core.areas(spark, sf), "neigh_type", chosen).withColumn("share", core.r6("share"))


@query(
    "collapse_categories",
    """SELECT geoid, CASE WHEN neigh_type IN ('BUILDING', 'HOUSEHOLD') THEN 'Home'
       WHEN neigh_type IN ('MACHINERY') THEN 'Industry' ELSE neigh_type END AS nt2 FROM areas""",
    ["areas"],
)
def collapse_categories(spark, sf):
    groups = {"Home": ["BUILDING", "HOUSEHOLD"], "Industry": ["MACHINERY"]}
    return op.collapse(core.areas(spark, sf), "neigh_type", groups, "nt2").select("geoid", "nt2")


@query(
    "type_flag",
    """SELECT geoid, CASE WHEN nullif(neigh_type, 'FURNITURE') IN ('BUILDING', 'MACHINERY') THEN 0 ELSE 1 END AS v_poc FROM areas""",
    ["areas"],
)
def type_flag(spark, sf):
    typed = core.areas(spark, sf).withColumn("neigh_type", F.nullif("neigh_type", F.lit("FURNITURE")))
    return typed.select("geoid", fn.flag_not_in("neigh_type", ["BUILDING", "MACHINERY"]).alias("v_poc"))


@query(
    "label_text",
    "SELECT geoid, concat('Tract: ', coalesce(nullif(neigh_type, 'BUILDING'), 'NA'), ' ', geoid) AS label FROM areas",
    ["areas"],
)
def label_text(spark, sf):
    typed = F.nullif(F.col("neigh_type"), F.lit("BUILDING"))
    return core.areas(spark, sf).select(
        "geoid", fn.paste0("Tract: ", typed, " ", F.col("geoid")).alias("label")
    )


# ------------------------------------------------------------------- groups


def landed_areas(spark, sf):
    """The joined base, evaluated once for the passes a group statistic makes over it."""
    return land(core.area_wide(spark, sf), "areas")


@query(
    "group_median",
    "SELECT county, " + R(*[f"med_{v}=median({v})" for v in VARIABLES]) + " FROM area_wide GROUP BY county",
    ["area_wide"],
)
def group_median(spark, sf):
    return rounded(
        op.group_medians(landed_areas(spark, sf), ["county"], {f"med_{v}": v for v in VARIABLES})
    )


@query(
    "group_median_back",
    f"""SELECT a.geoid, a.county, {R("v3=a.v3", "co_v3=m.m3", "co_v5=m.m5")} FROM area_wide a
LEFT JOIN (SELECT county, median(v3) AS m3, median(v5) AS m5 FROM area_wide GROUP BY county) m ON a.county = m.county""",
    ["area_wide"],
)
def group_median_back(spark, sf):
    out = op.with_group_median(landed_areas(spark, sf), ["county"], {"co_v3": "v3", "co_v5": "v5"})
    return rounded(out.select("geoid", "county", "v3", "co_v3", "co_v5"))


@query(
    "impute_median",
    f"""SELECT a.geoid, {R("v3=coalesce(a.v3, m.m3)")} FROM area_wide a
LEFT JOIN (SELECT county, median(v3) AS m3 FROM area_wide GROUP BY county) m ON a.county = m.county""",
    ["area_wide"],
)
def impute_median(spark, sf):
    out = op.impute_group_median(landed_areas(spark, sf), ["county"], {"v3": "v3"})
    return rounded(out.select("geoid", "v3"))


_QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


@query(
    "approx_quantiles",
    f"""SELECT l_returnflag, count(l_extendedprice) AS n, {", ".join(f"1 AS {q}_within" for q in _QUARTILES)}
FROM lineitem GROUP BY l_returnflag""",
)
def approx_quantiles(spark, sf, error=0.002):
    """The quartiles that the sketch gives, each held against its rank among all rows: within is 1 where
    it is off by no more than the error stated, and one row for the rounding of ranks."""
    prices = core.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    found = op.approx_group_quantiles(prices, ["l_returnflag"], ["price"], list(_QUARTILES.values()), error)
    met = op.attach_group(prices, found, ["l_returnflag"])
    counted = met.groupBy("l_returnflag").agg(
        F.count("price").alias("n"),
        *[F.count_if(F.col("price") < F.col(f"q{i}")).alias(f"_below{i}") for i in range(len(_QUARTILES))],
        *[F.count_if(F.col("price") <= F.col(f"q{i}")).alias(f"_upto{i}") for i in range(len(_QUARTILES))],
    )
    slack = F.col("n") * F.lit(error) + 1
    within = {
        f"{q}_within": (F.col(f"_below{i}") - slack <= F.col("n") * F.lit(p))
        & (F.col(f"_upto{i}") + slack >= F.col("n") * F.lit(p))
        for i, (q, p) in enumerate(_QUARTILES.items())
    }
    return counted.select("l_returnflag", "n", *[c.cast("int").alias(name) for name, c in within.items()])


@query(
    "rank_share",
    f"""SELECT geoid, {R("rank_share=CASE WHEN v3 IS NULL THEN NULL ELSE (r + (same - 1) / 2e0) / size END")}
FROM (SELECT geoid, v3, rank() OVER (PARTITION BY county ORDER BY v3 ASC NULLS LAST) AS r,
             count(*) OVER (PARTITION BY county, v3) AS same, count(*) OVER (PARTITION BY county) AS size
      FROM area_wide) s""",
    ["area_wide"],
)
def rank_share(spark, sf):
    out = op.rank_share(landed_areas(spark, sf), "county", "v3", "rank_share")
    return rounded(out.select("geoid", "rank_share"))


@query(
    "above_group_median",
    f"""SELECT a.geoid, {R("co_v1=m.m1")}, CASE WHEN a.v1 > m.m1 THEN 1 ELSE 0 END AS above FROM area_wide a
LEFT JOIN (SELECT county, median(v1) AS m1 FROM area_wide GROUP BY county) m ON a.county = m.county""",
    ["area_wide"],
)
def above_group_median(spark, sf):
    out = op.above_group(landed_areas(spark, sf), ["county"], "v1", "co_v1", "above")
    return rounded(out.select("geoid", "co_v1", "above"))


@query(
    "group_share",
    f"""SELECT a.geoid, {R("co_share=m.s")} FROM area_wide a
LEFT JOIN (SELECT county, sum(v1) / nullif(sum(v2), 0) AS s FROM area_wide GROUP BY county) m ON a.county = m.county""",
    ["area_wide"],
)
def group_share(spark, sf):
    out = op.group_share(landed_areas(spark, sf), ["county"], "v1", "v2", "co_share")
    return rounded(out.select("geoid", "co_share"))


@query(
    "left_join_suffix",
    f"""SELECT a.area_key, {R("v1_x=a.v1", "v1_y=b.v1")}, a.neigh_type FROM area_wide a
LEFT JOIN (SELECT area_key, v1 FROM wide WHERE v1 > 60) b ON a.area_key = b.area_key""",
    ["area_wide"],
)
def left_join_suffix(spark, sf):
    right = core.wide(spark, sf).filter(F.col("v1") > 60).select("area_key", "v1")
    out = op.left_join(core.area_wide(spark, sf), right, "area_key")
    return rounded(out.select("area_key", "v1_x", "v1_y", "neigh_type"))


@query(
    "six_number_summary",
    " UNION ALL ".join(
        f"""SELECT '{v}' AS measure, {R(f"min=min({v})", f"q1=quantile_cont({v}, 0.25)", f"median=median({v})",
            f"mean=avg({v})", f"q3=quantile_cont({v}, 0.75)", f"max=max({v})")},
            count(*) - count({v}) AS n_missing FROM wide"""
        for v in VARIABLES
    ),
    ["wide"],
)
def six_number_summary(spark, sf):
    return rounded(op.describe_cols(land(core.wide(spark, sf), "wide"), VARIABLES))


@query(
    "strict_summary",
    "SELECT "
    + R(*[
        f"{k}{v}=CASE WHEN count(*) = count({v}) THEN {f}({v}) END"
        for v in ["v1", "v2", "v3"]
        for k, f in (("p", "avg"), ("m", "median"))
    ])
    + " FROM wide WHERE v1 IS NOT NULL AND v2 IS NOT NULL",
    ["wide"],
)
def strict_summary(spark, sf):
    subset = core.wide(spark, sf).filter(F.col("v1").isNotNull() & F.col("v2").isNotNull())
    return rounded(op.strict_agg(land(subset, "wide"), {v: v for v in ["v1", "v2", "v3"]}))


def _z(c: str, source: str = "wide") -> str:
    return (
        f"({c} - (SELECT avg({c}) FROM {source})) / nullif((SELECT stddev_samp({c}) FROM {source}), 0)"
    )


@query("zscore_cols", "SELECT area_key, " + R(*[f"{v}={_z(v)}" for v in VARIABLES]) + " FROM wide", ["wide"])
def zscore_cols(spark, sf):
    return rounded(op.zscore(land(core.wide(spark, sf), "wide"), VARIABLES))


# ---------------------------------------------------------- keys and chains


@query(
    "separate_key",
    f"""SELECT area_key, split_part(variable, '_', 1) AS ir_type, split_part(variable, '_', 2) AS rb,
       split_part(variable, '_', 3) AS income, {R("estimate")} FROM burden_long""",
    ["burden_long"],
)
def separate_key(spark, sf):
    return rounded(op.separate(core.burden_long(spark, sf), "variable", ["ir_type", "rb", "income"]))


@query(
    "group_sum0",
    f"""SELECT area_key, {R("total=coalesce(sum(CASE WHEN split_part(variable, '_', 2) = '5plus' THEN estimate END), 0)")}
FROM burden_long GROUP BY area_key""",
    ["burden_long"],
)
def group_sum0(spark, sf):
    cells = op.separate(core.burden_long(spark, sf), "variable", ["ir_type", "rb", "income"])
    severe = cells.withColumn("severe", F.when(F.col("rb") == "5plus", F.col("estimate")))
    return rounded(op.group_sums(severe, ["area_key"], {"total": "severe"}))


@query(
    "natural_left_join",
    f"""SELECT l.area_key, l.county, {R("mhhinc=l.mhhinc")}, r.orders_n FROM
  (SELECT a.area_key, a.county, i.mhhinc FROM areas a LEFT JOIN area_income i ON a.area_key = i.area_key) l
LEFT JOIN (SELECT i.area_key, i.mhhinc, t.estimate AS orders_n FROM area_income i
           JOIN burden_long t ON i.area_key = t.area_key AND t.variable = 'ir_tot_tot') r
  ON l.area_key = r.area_key AND l.mhhinc IS NOT DISTINCT FROM r.mhhinc""",
    ["areas", "area_income", "burden_long"],
)
def natural_left_join(spark, sf):
    """Shared columns area_key and mhhinc; a missing income meets a missing income."""
    income = core.area_income(spark, sf)
    left = core.areas(spark, sf).select("area_key", "county").join(income.hint("merge"), "area_key", "left")
    totals = core.burden_long(spark, sf).filter(F.col("variable") == "ir_tot_tot")
    right = income.join(totals.select("area_key", F.col("estimate").alias("orders_n")).hint("merge"), "area_key")
    return rounded(op.natural_left_join(left, right))


@query(
    "join_chain",
    f"""SELECT a.area_key, {R("mhhinc=i.mhhinc", "total=t.estimate", "v1=w.v1")} FROM areas a
LEFT JOIN area_income i ON a.area_key = i.area_key
LEFT JOIN burden_long t ON a.area_key = t.area_key AND t.variable = 'ir_tot_tot'
LEFT JOIN wide w ON a.area_key = w.area_key""",
    ["areas", "area_income", "burden_long", "wide"],
)
def join_chain(spark, sf):
    totals = core.burden_long(spark, sf).filter(F.col("variable") == "ir_tot_tot")
    return rounded(
        op.reduce_left_join(
            [
                core.areas(spark, sf).select("area_key"),
                core.area_income(spark, sf),
                totals.select("area_key", F.col("estimate").alias("total")),
                core.wide(spark, sf).select("area_key", "v1"),
            ],
            ["area_key"],
        )
    )


@query(
    "type_summary",
    f"""SELECT nt, count(*) AS n, {R("med=median(v1)")} FROM
(SELECT CASE WHEN neigh_type IN ('BUILDING', 'HOUSEHOLD') THEN 'Mostly White' ELSE neigh_type END AS nt, v1 FROM area_wide) s
GROUP BY nt""",
    ["area_wide"],
)
def type_summary(spark, sf):
    """Median by collapsed category, the summary the result table is read back for."""
    groups = {next(iter(TYPE_GROUPS)): ["BUILDING", "HOUSEHOLD"]}
    typed = op.collapse(landed_areas(spark, sf), "neigh_type", groups, "nt")
    counts = typed.groupBy("nt").agg(F.count(F.lit(1)).alias("n"))
    return rounded(op.attach_group(counts, op.group_medians(typed, ["nt"], {"med": "v1"}), ["nt"]))
