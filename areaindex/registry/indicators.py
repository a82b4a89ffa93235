"""Queries of the indicators: quality, income, rent burden, profiles, disadvantage index."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaindex import functions as fn
from areaindex import operators as op
from areaindex.plans import disadvantage, income, profile, rent, scoring
from areaindex.registry import core
from areaindex.registry.core import VARIABLES, R, fraction, query, rounded
from areaindex.registry.relational import stored_estimates
from areaindex.sources import land, read_estimates


@query(
    "low_quality_areas",
    """SELECT DISTINCT area_key FROM acs_long WHERE variable = 'v1'
  AND (estimate IS NULL OR (estimate = 0 AND moe > 0) OR (estimate > 0 AND moe / estimate >= 0.6))""",
    ["acs_long"],
)
def low_quality_areas(spark, sf):
    return income.low_quality(core.acs_long(spark, sf), "v1", 0.6, "area_key")


# ------------------------------------------------------------------- income


def area_bands(spark, sf):
    """One row per area: county, median income and the 16 band counts, evaluated once."""
    return land(
        core.areas(spark, sf)
        .select("area_key", "geoid", "county")
        .join(core.area_income(spark, sf).hint("merge"), "area_key", "left")
        .join(core.income_wide(spark, sf).hint("merge"), "area_key", "left"),
        "bands",
    )


def area_incomes(spark, sf):
    df = core.areas(spark, sf).select("area_key", "geoid", "county")
    return land(df.join(core.area_income(spark, sf).hint("merge"), "area_key", "left"), "incomes")


_BAND_CASE = "CASE band " + " ".join(f"WHEN '{name}' THEN {hi}" for name, hi in fn.INCOME_BANDS.items()) + " END"


@query(
    "recode_bands",
    f"""SELECT area_key, {_BAND_CASE} AS medinc_cat, n FROM (
  SELECT i.area_key, b.band, i.n FROM income_long i JOIN (VALUES {", ".join(f"('{n}', {hi})" for n, hi in fn.INCOME_BANDS.items())}) AS b(band, hi)
    ON i.hi = b.hi) s""",
    ["income_long"],
)
def recode_bands(spark, sf):
    """Wide band counts to long, band names to upper bounds."""
    long = op.gather(core.income_wide(spark, sf), ["area_key"], list(fn.INCOME_BANDS), "band", "n")
    return long.filter(F.col("n").isNotNull()).select(
        "area_key", fn.recode("band", fn.INCOME_BANDS).alias("medinc_cat"), "n"
    )


@query(
    "band_columns",
    f"""SELECT area_key, {", ".join(f"max(CASE WHEN hi = {hi} THEN n END) AS {name}" for name, hi in fn.INCOME_BANDS.items())}
FROM income_long GROUP BY area_key""",
    ["income_long"],
)
def band_columns(spark, sf):
    """The range from the first to the last band of the frame's own column order, all 16 bands."""
    df = core.income_wide(spark, sf)
    return df.select("area_key", *op.cols_between(df, "HHInc_10", "HHInc_250"))


@query(
    "income_limits",
    f"SELECT geoid, county, {R('mhhinc', 'co_mhhinc', 'co_LI_val=co_li_val', 'co_VLI_val=co_vli_val', 'co_ELI_val=co_eli_val')} FROM limits",
    ["limits"],
)
def income_limits(spark, sf):
    return rounded(op.income_limits(area_incomes(spark, sf), ["county"], "mhhinc").drop("area_key"))


@query(
    "band_share",
    f"""SELECT l.area_key, i.hi, {R("lo=b.lo",
        f"li={fraction('l.co_li_val', 'b.lo', 'b.hi')}", f"li_count=i.n * {fraction('l.co_li_val', 'b.lo', 'b.hi')}",
        f"vli={fraction('l.co_vli_val', 'b.lo', 'b.hi')}", f"vli_count=i.n * {fraction('l.co_vli_val', 'b.lo', 'b.hi')}")}
FROM income_long i JOIN limits l ON i.area_key = l.area_key JOIN income_bands b ON i.hi = b.hi""",
    ["income_long", "limits", "income_bands"],
)
def band_share(spark, sf):
    limits = op.income_limits(area_incomes(spark, sf), ["county"], "mhhinc")
    bands = core.income_long(spark, sf).withColumn("lo", fn.band_floor("hi")).join(limits.hint("merge"), "area_key")
    return rounded(
        bands.withColumns(
            {k.lower(): fn.band_fraction(f"co_{k}_val", "lo", F.col("hi").cast("double")) for k in ["LI", "VLI"]}
        ).select(
            "area_key",
            "hi",
            "lo",
            "li",
            (F.col("li") * F.col("n")).alias("li_count"),
            "vli",
            (F.col("vli") * F.col("n")).alias("vli_count"),
        )
    )


@query(
    "group_sum_back",
    f"""SELECT i.area_key, i.hi, i.n, CAST(t.total AS BIGINT) AS total, {R("p=CAST(i.n AS DOUBLE) / nullif(t.total, 0)")}
FROM income_long i JOIN (SELECT area_key, sum(n) AS total FROM income_long GROUP BY area_key) t ON i.area_key = t.area_key""",
    ["income_long"],
)
def group_sum_back(spark, sf):
    out = op.with_group_sum(land(core.income_long(spark, sf), "income"), ["area_key"], {"total": "n"})
    return rounded(out.withColumn("p", fn.share("n", "total")))


INCOME_SQL = f"""SELECT area_key, county, {R("mhhinc", "co_mhhinc", "co_LI_val=co_li_val", "co_VLI_val=co_vli_val",
    "co_ELI_val=co_eli_val", "tr_totinc_count=tot", "tr_LI_count=li", "tr_VLI_count=vli", "tr_ELI_count=eli",
    "tr_LI_prop=round(li / nullif(tot, 0), 12)", "tr_VLI_prop=round(vli / nullif(tot, 0), 12)", "tr_ELI_prop=round(eli / nullif(tot, 0), 12)")} FROM income"""


@query("income_shares", INCOME_SQL, ["income"])
def income_shares(spark, sf):
    return rounded(income.income_shares(area_bands(spark, sf), "area_key"))


# -------------------------------------------------------------- rent burden


def burden_cells(spark, sf):
    incomes = area_incomes(spark, sf)
    group = op.with_group_median(incomes, ["county"], {"co_mhhinc": "mhhinc"}).select(
        "area_key", "county", "co_mhhinc"
    )
    return rent.rent_burden_cells(rent.split_cells(core.burden_long(spark, sf)), group, "area_key")


@query(
    "band_share_rb",
    f"SELECT area_key, rb, {R('income', 'lo', 'hi', 'li', 'vli', 'eli')} FROM cells",
    ["cells"],
)
def band_share_rb(spark, sf):
    out = burden_cells(spark, sf).select(
        "area_key",
        "rb",
        "income",
        F.col("bottom_inccat").alias("lo"),
        F.col("top_inccat").alias("hi"),
        F.col("LI").alias("li"),
        F.col("VLI").alias("vli"),
        F.col("ELI").alias("eli"),
    )
    return rounded(out)


@query(
    "rent_burden_cells",
    f"""SELECT area_key, county, rb, {R("income", "estimate", "tr_LI_ir_count=li * estimate",
        "tr_VLI_ir_count=vli * estimate", "tr_ELI_ir_count=eli * estimate")} FROM cells""",
    ["cells"],
)
def rent_burden_cells(spark, sf):
    out = burden_cells(spark, sf)
    return rounded(
        out.select("area_key", "county", "rb", "income", "estimate", *op.cols_ending(out, "_ir_count"))
    )


def burden_measures(spark, sf):
    totals = rent.burden_totals(rent.split_cells(core.burden_long(spark, sf)), "area_key").join(
        core.areas(spark, sf).select("area_key", "county").hint("merge"), "area_key"
    )
    return rent.rent_burden_measures(burden_cells(spark, sf), totals, area_id="area_key")


def _flag(a: str, b: str, name: str) -> str:
    return f"CASE WHEN {a} > {b} THEN 1 ELSE 0 END AS {name}"


_M = ["LI_30", "LI_50", "VLI_30", "VLI_50"]


def _m(name: str) -> str:
    return name.replace("_", "").lower()


@query(
    "rent_burden_measures",
    "SELECT area_key, county, "
    + R("tot_ir", *[x for m in _M for x in (f"tr_ir{m}rb_ct={_m(m)}", f"tr_ir{m}p={_m(m)}p", f"co_ir{m}_med={_m(m)}m")])
    + ", "
    + ", ".join(_flag(f"{_m(m)}p", f"{_m(m)}m", f"v_rb{m}rb") for m in _M)
    + " FROM measures",
    ["measures"],
)
def rent_burden_measures(spark, sf):
    return rounded(burden_measures(spark, sf))


# --------------------------------------------------------------------- rent


@query(
    "vintage_change",
    f"""SELECT geoid, {R("ch=medrent17 - medrent12", "pch=(medrent17 - medrent12) / nullif(medrent12, 0)")} FROM area_rent""",
    ["area_rent"],
)
def vintage_change(spark, sf):
    return rounded(
        core.area_rent(spark, sf).select(
            "geoid",
            fn.change("medrent17", "medrent12").alias("ch"),
            fn.proportional_change("medrent17", "medrent12").alias("pch"),
        )
    )


def rents(spark, sf):
    df = core.area_rent(spark, sf).withColumnRenamed("medrent17", "medrent")
    return rent.rent_change(land(df, "rents"))


@query(
    "rent_change",
    f"""SELECT area_key, county, {R("medrent", "tr_medrent12=old", "tr_chrent=medrent - old",
        "tr_pchrent=(medrent - old) / nullif(old, 0)", "co_medrent12=co_old")} FROM rents""",
    ["rents"],
)
def rent_change(spark, sf):
    out = rents(spark, sf).select(
        "area_key", "county", "medrent", "tr_medrent12", "tr_chrent", "tr_pchrent", "co_medrent12"
    )
    return rounded(out)


# ------------------------------------------------------------------ profile

_TOTAL = " + ".join(f"coalesce({v}, 0)" for v in VARIABLES)


def profile_inputs(df):
    """The driver table's seven variables under the names of the estimates."""
    total = fn.row_sum0(*VARIABLES).cast("double")
    named = {
        "totrent": F.col("v1"),
        "totten": F.col("v1") + F.col("v2"),
        "race_tot": total * 10,
        "race_White": F.col("v4") * 10,
        "race_Black": F.col("v2") * 10,
        "race_Asian": F.col("v3") * 10,
        "race_Latinx": F.col("v5") * 10,
        "st_colenroll": F.col("v6"),
        "st_proenroll": F.when(F.col("area_key") % 5 == 0, None).otherwise(F.lit(0.0)),
        "st_totenroll": total,
        "st_pov_under": F.col("v6"),
        "st_pov_grad": F.col("v3"),
        "rb_34_9": F.col("v1"),
        "rb_39_9": F.col("v3"),
        "rb_49_9": F.col("v5"),
        "rb_55": F.col("v7"),
        "rb_tot": total,
        "welf": F.col("v7"),
        "welf_tot": total,
        "pov_famh": F.col("v3"),
        "pov_nonfamh": F.col("v5"),
        "pov_tot": F.col("v1"),
        "unemp": F.col("v6"),
        "unemp_tot": F.col("v1"),
        "fhh_famheadch": F.col("v3"),
        "fhh_nonfamheadch": F.col("v4"),
        "fhh_tot": F.col("v2"),
    }
    return df.withColumns(named)


core.SQL_VIEWS["profile"] = (
    ("area_wide",),
    f"""SELECT s.*, v1 / nullif(v1 + v2, 0) AS prenters, coalesce(v6, 0) / nullif(total, 0) AS pstudents,
       1 - v4 / nullif(total, 0) AS ppoc, total * 10 AS population, v1 + v2 AS households
FROM (SELECT *, {_TOTAL} AS total FROM area_wide) s""",
)
PROFILE_COLUMNS = [
    "tr_population", "tr_households", "tr_pstudents", "tr_povstudents", "tr_prenters", "tr_rb",
    "tr_pWhite", "tr_pBlack", "tr_pAsian", "tr_pLatinx", "tr_pOther", "tr_pPOC", "tr_pwelf",
    "tr_ppoverty", "tr_punemp", "tr_pfemhhch",
]


@query(
    "area_profile",
    "SELECT geoid, "
    + R(
        "tr_population=population",
        "tr_households=households",
        "tr_pstudents=pstudents",
        "tr_povstudents=coalesce(v6, 0) + coalesce(v3, 0)",
        "tr_prenters=prenters",
        "tr_rb=(coalesce(v1, 0) + coalesce(v3, 0) + coalesce(v5, 0) + coalesce(v7, 0)) / nullif(total, 0)",
        "tr_pWhite=v4 / nullif(total, 0)",
        "tr_pBlack=v2 / nullif(total, 0)",
        "tr_pAsian=v3 / nullif(total, 0)",
        "tr_pLatinx=v5 / nullif(total, 0)",
        "tr_pOther=(total - v4 - v2 - v3 - v5) / nullif(total, 0)",
        "tr_pPOC=ppoc",
        "tr_pwelf=v7 / nullif(total, 0)",
        "tr_ppoverty=(coalesce(v3, 0) + coalesce(v5, 0)) / nullif(v1, 0)",
        "tr_punemp=v6 / nullif(v1, 0)",
        "tr_pfemhhch=(coalesce(v3, 0) + coalesce(v4, 0)) / nullif(v2, 0)",
    )
    + " FROM profile",
    ["profile"],
)
def area_profile(spark, sf):
    out = profile.area_profile(profile_inputs(core.area_wide(spark, sf)))
    return rounded(out.select("geoid", *PROFILE_COLUMNS))


def profiled(spark, sf, *cols):
    return profile.area_profile(profile_inputs(core.area_wide(spark, sf))).select(*cols)


_GEN = {
    "White": "v4", "Black": "v2", "Asian": "v3", "Latinx": "v5", "totrace": "v6",
    "welf": "v7", "totwelf": "v1", "povfamh": "v3", "povnonfamh": "v5", "totpov": "v1",
    "unemp": "v6", "totunemp": "v2", "femfamhh": "v3", "femnonfamhh": "v4", "totfemhh": "v5",
    "femfamheadch": "v1", "femnonfamheadch": "v2", "totfhc": "v7", "totage": "v4", "toted": "v2",
    "bach": "v1", "mas": "v3", "pro": "v5", "doc": "v7", "rent": "v1", "own": "v2", "totten": "v7",
    "Mmgr": "v3", "Fmgr": "v6", "totoccupation": "v1", "totschool": "v6",
    **{c: VARIABLES[i % 7] for i, c in enumerate(profile.CHILD_CELLS)},
    **{c: VARIABLES[i % 2] for i, c in enumerate(profile.ELDER_CELLS)},
    **{c: VARIABLES[3 + i % 2] for i, c in enumerate(profile.PRIVATE_SCHOOL_CELLS)},
}


def _gen(num: str | list[str], den: str) -> str:
    names = [num] if isinstance(num, str) else num
    return "(" + " + ".join(_GEN[n] for n in names) + f") / nullif({_GEN[den]}, 0)"


_OTHER = "(v6 - v4 - v2 - v3 - v5) / nullif(v6, 0)"
_GEN_OUT = {
    **{f"p{r}": _gen(r, "totrace") for r in profile.RACES},
    "Other": "v6 - v4 - v2 - v3 - v5",
    "pOther": f"CASE WHEN {_OTHER} < 0 THEN 0 ELSE {_OTHER} END",
    "pWelf": _gen("welf", "totwelf"),
    "pPov": _gen(["povfamh", "povnonfamh"], "totpov"),
    "pUnemp": _gen("unemp", "totunemp"),
    "pFemhh": _gen(["femfamhh", "femnonfamhh"], "totfemhh"),
    "pFemhhCh": _gen(["femfamheadch", "femnonfamheadch"], "totfhc"),
    "pChild": _gen(profile.CHILD_CELLS, "totage"),
    "pEld": _gen(profile.ELDER_CELLS, "totage"),
    "pCol": _gen(["bach", "mas", "pro", "doc"], "toted"),
    "pRent": _gen("rent", "totten"),
    "pOwn": _gen("own", "totten"),
    "pManagers": _gen(["Mmgr", "Fmgr"], "totoccupation"),
    "pPrivSchl": _gen(profile.PRIVATE_SCHOOL_CELLS, "totschool"),
}


@query(
    "gentrification_profile",
    "SELECT area_key, " + R(*[f"{k}={v}" for k, v in _GEN_OUT.items()]) + " FROM wide",
    ["wide"],
)
def gentrification_profile(spark, sf):
    named = core.wide(spark, sf).withColumns({name: F.col(v) for name, v in _GEN.items()})
    return rounded(profile.gentrification_profile(named).select("area_key", *_GEN_OUT))


@query(
    "gentrification_from_estimates",
    "SELECT a.geoid, " + R(*[f"{k}={v}" for k, v in _GEN_OUT.items()]) + " FROM wide w JOIN areas a ON w.area_key = a.area_key",
    ["wide", "areas"],
)
def gentrification_from_estimates(spark, sf):
    """The profile from landed estimates read wide; several names stand on each code."""
    read = read_estimates(spark, stored_estimates(spark, sf), _GEN, state="06", year=2017, output="wide")
    return rounded(profile.gentrification_profile(read).select("geoid", *_GEN_OUT))


@query(
    "variant_flags",
    f"""SELECT p.geoid, CASE WHEN p.prenters >= 0.4e0 THEN 1 ELSE 0 END AS v_renters_40p,
       CASE WHEN p.pstudents < 0.2e0 AND p.vli > m.m THEN 1 ELSE 0 END AS v_VLI_med FROM
  (SELECT q.*, round(i.vli / nullif(i.tot, 0), 12) AS vli FROM profile q LEFT JOIN income i ON q.area_key = i.area_key) p
LEFT JOIN (SELECT county, median(round(vli / nullif(tot, 0), 12)) AS m FROM income GROUP BY county) m ON p.county = m.county""",
    ["profile", "income"],
)
def variant_flags(spark, sf):
    df = profiled(spark, sf, "area_key", "geoid", "county", "tr_pstudents", "tr_prenters")
    shares = income.income_shares(area_bands(spark, sf), "area_key").select("area_key", "tr_VLI_prop")
    out = profile.variant_flags(land(df.join(shares.hint("merge"), "area_key", "left"), "profile"))
    return out.select("geoid", "v_renters_40p", "v_VLI_med")


@query(
    "vulnerability_flags",
    """SELECT p.geoid,
       CASE WHEN p.pstudents < 0.2e0 AND round(i.vli / nullif(i.tot, 0), 12) > 0.2e0 THEN 1 ELSE 0 END AS v_VLI,
       CASE WHEN p.prenters > 0.4e0 THEN 1 ELSE 0 END AS v_Renters,
       CASE WHEN m.li30p > m.li30m THEN 1 ELSE 0 END AS v_RB30LI, CASE WHEN m.li50p > m.li50m THEN 1 ELSE 0 END AS v_RB50LI,
       CASE WHEN m.vli30p > m.vli30m THEN 1 ELSE 0 END AS v_RB30VLI, CASE WHEN m.vli50p > m.vli50m THEN 1 ELSE 0 END AS v_RB50VLI,
       CASE WHEN p.ppoc > 0.5e0 THEN 1 ELSE 0 END AS v_POC
FROM profile p LEFT JOIN income i ON p.area_key = i.area_key LEFT JOIN measures m ON p.area_key = m.area_key""",
    ["profile", "income", "measures"],
)
def vulnerability_flags(spark, sf):
    df = profiled(spark, sf, "area_key", "geoid", "tr_pstudents", "tr_prenters", "tr_pPOC")
    shares = income.income_shares(area_bands(spark, sf), "area_key").select("area_key", "tr_VLI_prop")
    measures = burden_measures(spark, sf).drop("county")
    out = scoring.vulnerability_flags(df.join(shares.hint("merge"), "area_key", "left").join(measures.hint("merge"), "area_key", "left"))
    return out.select(
        "geoid", "v_VLI", "v_Renters", "v_RB30LI", "v_RB50LI", "v_RB30VLI", "v_RB50VLI", "v_POC"
    )


# ------------------------------------------------------- disadvantage index

_SPEC = {
    "child": (["v2", "v3"], "v1"),
    "femh": (["v4"], "v1"),
    "welf": (["v5"], "v2"),
    "pov": (["v6"], "v2"),
    "unemp": (["v7", "v3"], "v6"),
}
core.SQL_VIEWS["shares5"] = (
    ("wide",),
    "SELECT area_key, "
    + ", ".join(
        "(" + " + ".join(f"coalesce({n}, 0)" for n in num) + f") / nullif(coalesce({den}, 0), 0) AS {name}"
        for name, (num, den) in _SPEC.items()
    )
    + " FROM wide",
)


@query("disadvantage_inputs", f"SELECT area_key, {R(*_SPEC)} FROM shares5", ["shares5"])
def disadvantage_inputs(spark, sf):
    """Counts in two tables, as the survey periods come."""
    counts = core.wide(spark, sf)
    tables = [counts.select("area_key", "v1", "v2", "v3", "v4"), counts.select("area_key", "v5", "v6", "v7")]
    return rounded(disadvantage.disadvantage_inputs(tables, _SPEC, "area_key"))


def _z(c: str, source: str) -> str:
    return f"coalesce(({c} - (SELECT avg({c}) FROM {source})) / nullif((SELECT stddev_samp({c}) FROM {source}), 0), 0)"


# The driver table's seven variables, in turn, under the names of the census columns.
_CENSUS = {
    source: VARIABLES[i % 7]
    for i, source in enumerate(c for columns in disadvantage.CENSUS_COLUMNS.values() for c in columns.values())
}
_PERIODS = {
    period: [_CENSUS[c] for c in columns.values()]
    for period, columns in zip(disadvantage.CENSUS_PERIODS, disadvantage.CENSUS_COLUMNS.values())
}
core.SQL_VIEWS["wide_even"] = (
    ("wide", "areas"),
    "SELECT w.* FROM wide w JOIN areas a ON w.area_key = a.area_key WHERE a.neigh_type <> 'BUILDING'",
)


@query(
    "disadvantage_index",
    "SELECT area_key, "
    + R(*[f"{p}=" + " + ".join(_z(c, "wide_even") for c in cols) for p, cols in _PERIODS.items()])
    + " FROM wide_even",
    ["wide_even"],
)
def disadvantage_index(spark, sf):
    """All four census periods: -999 as missing, subset by id, then scored over the subset."""
    coded = land(core.wide(spark, sf), "wide").fillna(-999.0)
    census = coded.select("area_key", *[F.col(v).alias(c) for c, v in _CENSUS.items()])
    members = core.areas(spark, sf).filter(F.col("neigh_type") != "BUILDING")
    shares = disadvantage.census_shares(census, "area_key")
    return rounded(disadvantage.disadvantage_index(shares, disadvantage.CENSUS_PERIODS, members, "area_key"))


# Both survey periods with their own columns, and the areas of each: all but one type.
_SURVEYS = {
    "dis09": (disadvantage.INPUTS_2009, "BUILDING"),
    "dis14": (disadvantage.INPUTS_2014, "MACHINERY"),
}


def _survey_columns(spec) -> dict[str, str]:
    """The driver table's seven variables, in turn, under the names of the counts."""
    used = dict.fromkeys(c for num, den in spec.values() for c in [*num, den])
    return {c: VARIABLES[i % 7] for i, c in enumerate(used)}


def _survey_sql(spec, left_out: str) -> str:
    of = _survey_columns(spec)
    shares = ", ".join(
        "(" + " + ".join(f"coalesce({of[n]}, 0)" for n in num) + f") / nullif(coalesce({of[den]}, 0), 0) AS {name}"
        for name, (num, den) in spec.items()
    )
    return f"SELECT w.area_key, {shares} FROM wide w JOIN areas a ON w.area_key = a.area_key WHERE a.neigh_type <> '{left_out}'"


for _period, (_inputs, _left_out) in _SURVEYS.items():
    core.SQL_VIEWS[f"survey_{_period}"] = (("wide", "areas"), _survey_sql(_inputs, _left_out))


@query(
    "disadvantage_index_acs",
    " UNION ALL ".join(
        f"SELECT area_key, '{period}' AS period, "
        + R("dis=" + " + ".join(_z(c, f"survey_{period}") for c in spec))
        + f" FROM survey_{period}"
        for period, (spec, _) in _SURVEYS.items()
    ),
    [f"survey_{period}" for period in _SURVEYS],
)
def disadvantage_index_acs(spark, sf):
    """Shares of nine and twenty-six counts, each period scored over its own areas."""
    counts = land(core.wide(spark, sf), "wide")
    out = []
    for period, (spec, left_out) in _SURVEYS.items():
        named = counts.select("area_key", *[F.col(v).alias(c) for c, v in _survey_columns(spec).items()])
        shares = land(disadvantage.disadvantage_inputs(named, spec, "area_key"), "shares")
        members = core.areas(spark, sf).filter(F.col("neigh_type") != left_out)
        index = disadvantage.disadvantage_index(
            shares, {"dis": disadvantage.SURVEY_PERIODS[period]}, members, "area_key"
        )
        out.append(index.select("area_key", F.lit(period).alias("period"), "dis"))
    return rounded(out[0].unionByName(out[1]))
