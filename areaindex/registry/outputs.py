"""Queries of the scored table and of what is written from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from areaindex import functions as fn
from areaindex.operators.geometry import contiguity
from areaindex.operators.neighbours import band_limit
from areaindex.plans import assess, export, income
from areaindex.plans.profile import BENCHMARKS
from areaindex.registry import core
from areaindex.registry.core import BAND_FACTOR, R, query, rounded, table
from areaindex.registry.indicators import profile_inputs
from areaindex.registry.spatial import city_layers, nations
from areaindex.sources import land, scratch_dir, write_features


def scored(spark, sf, keep=None):
    """All areas scored: one pass over lineitem, one over orders, and neighbours that share a vertex of their polygons.  ``keep``
    names the columns beside the flags and tiers that the query reads; without it all are carried."""
    points = land(core.points(spark, sf), "points")
    d2 = band_limit(points, BAND_FACTOR, "area_key")
    edges = contiguity(core.area_vertex(spark, sf))
    hot = core.hot_customers(spark, sf)
    sales = land(core.sales_by_area(spark, sf, hot=hot), "sales", dictionary=False)
    orders = land(core.orders_by_area(spark, sf, hot=hot), "orders")
    keyed = (
        core.area_wide(spark, sf, sales)
        .drop("x", "y")
        .join(core.incomes_by_area(spark, sf, orders=orders).hint("merge"), "area_key", "left")
        .join(core.rent(spark, sf, sales).withColumnRenamed("medrent17", "medrent").hint("merge"), "area_key", "left")
    )
    types = core.areas(spark, sf).select("area_key", "neigh_type")
    return assess.assess(
        wide=land(profile_inputs(keyed.drop("neigh_type")), "wide", dictionary=False),
        burden=core.burden_long(spark, sf, orders),
        low_quality_ids=income.low_quality(core.acs_long(spark, sf, sales), "v1", 0.6, "area_key"),
        big_city=assess.big_city_ids(points, city_layers(spark, sf), "area_key"),
        points=points,
        neighbour_edges=edges,
        neigh_type=types,
        area_id="area_key",
        band=d2,
        keep=keep,
    )


core.SQL_VIEWS["scen_base"] = (
    ("profile", "income", "measures", "pressures", "acs_long", "big_city"),
    """SELECT p.*, round(i.vli / nullif(i.tot, 0), 12) AS vli_prop, m.vli50p, m.vli50m, g.medrent, g.medrent_lag, g.gap, g.co_gap,
       g.pch, g.pchrent_lag, g.co_pch, g.dp_PChRent, g.dp_RentGap,
       CASE WHEN p.pstudents < 0.2e0 AND round(i.vli / nullif(i.tot, 0), 12) > 0.2e0 THEN 1 ELSE 0 END AS v_VLI,
       CASE WHEN p.prenters > 0.4e0 THEN 1 ELSE 0 END AS v_Renters,
       CASE WHEN m.vli50p > m.vli50m THEN 1 ELSE 0 END AS v_RB50VLI,
       CASE WHEN p.ppoc > 0.5e0 THEN 1 ELSE 0 END AS v_POC,
       CASE WHEN p.area_key IN (SELECT area_key FROM big_city) THEN 1 ELSE 0 END AS big_city,
       CASE WHEN p.area_key IN (SELECT area_key FROM acs_long WHERE variable = 'v1'
              AND (estimate IS NULL OR (estimate = 0 AND moe > 0) OR (estimate > 0 AND moe / estimate >= 0.6e0))) THEN 0 ELSE 1 END AS tr_dq,
       CASE WHEN p.ppoc IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY p.county ORDER BY p.ppoc ASC NULLS LAST)
         + (count(*) OVER (PARTITION BY p.county, p.ppoc) - 1) / 2e0) / count(*) OVER (PARTITION BY p.county) END AS poc_rank
FROM profile p LEFT JOIN income i ON p.area_key = i.area_key LEFT JOIN measures m ON p.area_key = m.area_key
LEFT JOIN pressures g ON p.area_key = g.area_key""",
)
core.SQL_VIEWS["scen1"] = (
    ("scen_base",),
    """SELECT *, CASE
  WHEN v_VLI = 1 AND pstudents < 0.2e0 AND population >= 500 AND v_Renters + v_RB50VLI + v_POC >= 2
       AND dp_PChRent + dp_RentGap >= 1 THEN 1
  WHEN poc_rank >= 0.95e0 AND pstudents < 0.2e0 AND population >= 500 AND v_VLI + v_Renters + v_RB50VLI + v_POC >= 3
       AND dp_PChRent + dp_RentGap >= 1 THEN 1
  WHEN ppoc >= 0.9e0 AND pstudents < 0.2e0 AND population >= 500 AND v_VLI + v_Renters + v_RB50VLI + v_POC >= 3
       AND dp_PChRent + dp_RentGap >= 1 THEN 1
  ELSE 0 END AS scen1 FROM scen_base""",
)
core.SQL_VIEWS["scen3"] = (
    ("scen1", "area_touch"),
    """SELECT s.*, CASE WHEN big_city = 1 THEN scen1
  WHEN big_city = 0 AND pstudents < 0.2e0 AND population >= 500 AND v_VLI = 1 AND v_Renters + v_RB50VLI + v_POC >= 2
       AND dp_PChRent + dp_RentGap = 2 THEN 1 ELSE 0 END AS scen3, coalesce(n.nshare, 0) AS nshare
FROM scen1 s LEFT JOIN (SELECT b.src, CAST(sum(t.scen1) AS DOUBLE) / count(*) AS nshare
                        FROM area_touch b JOIN scen1 t ON b.dst = t.area_key GROUP BY b.src) n ON s.area_key = n.src""",
)
core.SQL_VIEWS["tiered"] = (
    ("scen3",),
    """SELECT *,
  CASE WHEN tr_dq = 0 THEN 'Poor Data Quality' WHEN scen3 = 1 THEN 'Heightened Sensitivity'
       WHEN big_city = 1 AND nshare >= 0.6e0 AND pstudents < 0.2e0 AND population >= 500 AND v_VLI = 1
            AND v_Renters + v_RB50VLI + v_POC >= 2 THEN 'Heightened Sensitivity' END AS tier1,
  CASE WHEN tr_dq = 0 THEN NULL WHEN pstudents < 0.2e0 AND population >= 500 AND v_VLI = 1
            AND v_Renters + v_RB50VLI + v_POC >= 2 THEN 'Vulnerable' END AS tier2,
  CASE WHEN tr_dq = 0 THEN NULL
       WHEN v_POC + v_VLI = 2 OR v_POC + v_RB50VLI = 2 OR v_POC + v_Renters = 2 OR v_VLI = 1
            OR v_VLI + v_RB50VLI = 2 OR v_VLI + v_Renters = 2 THEN 'Tier 3: Some Vulnerability' END AS tier3
FROM scen3""",
)


@query("scenario_one", f"SELECT area_key, {R('tr_POC_rank=poc_rank')}, scen1 AS scen1_VLI50RB FROM scen1", ["scen1"])
def scenario_one(spark, sf):
    return rounded(scored(spark, sf, ("tr_POC_rank",)).select("area_key", "tr_POC_rank", "scen1_VLI50RB"))


@query("scenario_three", "SELECT area_key, big_city, scen3 AS scen3_VLI50RB FROM scen3", ["scen3"])
def scenario_three(spark, sf):
    return scored(spark, sf, ()).select("area_key", "big_city", "scen3_VLI50RB")


@query(
    "tiers",
    f"SELECT area_key, tr_dq, {R('scen1_VLI50RB_lag=nshare')}, tier1, tier2, tier3 FROM tiered",
    ["tiered"],
)
def tiers(spark, sf):
    out = scored(spark, sf, ()).select("area_key", "tr_dq", "scen1_VLI50RB_lag", "tier1", "tier2", "tier3")
    return rounded(out)


@query(
    "tier_counts",
    "SELECT tier1, count(*) AS n FROM tiered WHERE population >= 500 GROUP BY tier1",
    ["tiered"],
)
def tier_counts(spark, sf):
    return export.tier_counts(scored(spark, sf, ("tr_population",)))


@query(
    "type_shares",
    """SELECT neigh_type, count(*) AS count_ca, nullif(count(CASE WHEN tier1 = 'Heightened Sensitivity' THEN 1 END), 0) AS count_sc,
  format('{:,.1f}', CAST(nullif(count(CASE WHEN tier1 = 'Heightened Sensitivity' THEN 1 END), 0) AS DOUBLE) / count(*) * 100) || '%' AS p
FROM tiered GROUP BY neigh_type""",
    ["tiered"],
)
def type_shares(spark, sf):
    return export.type_shares(scored(spark, sf, ("neigh_type",)))


core.SQL_VIEWS["benched"] = (
    ("profile", "income", "measures", "gaps"),
    """SELECT p.*, g.gap, g.gapprop, g.pch, m.vli50p, round(i.li / nullif(i.tot, 0), 12) AS li_p,
       round(i.vli / nullif(i.tot, 0), 12) AS vli_p, round(i.eli / nullif(i.tot, 0), 12) AS eli_p,
       rank() OVER (PARTITION BY p.county ORDER BY p.ppoc ASC NULLS LAST) AS r,
       count(*) OVER (PARTITION BY p.county, p.ppoc) AS same, count(*) OVER (PARTITION BY p.county) AS size
FROM profile p LEFT JOIN income i ON p.area_key = i.area_key LEFT JOIN measures m ON p.area_key = m.area_key
LEFT JOIN gaps g ON p.area_key = g.area_key""",
)
_BENCHED = dict(
    zip(
        BENCHMARKS,
        ["gap", "gapprop", "pstudents", "vli50p", "pch", "prenters", "ppoc", "li_p", "vli_p", "eli_p"],
    )
)


@query(
    "group_benchmarks",
    f"""SELECT b.geoid, {R("tr_POC_rank=CASE WHEN b.ppoc IS NULL THEN NULL ELSE (b.r + (b.same - 1) / 2e0) / b.size END",
        *[f"{k}=c.{k}" for k in _BENCHED])}
FROM benched b LEFT JOIN (SELECT county, {", ".join(f"median({c}) AS {k}" for k, c in _BENCHED.items())} FROM benched GROUP BY county) c
  ON b.county = c.county""",
    ["benched"],
)
def group_benchmarks(spark, sf):
    """The rank and all ten medians, as the scored table carries them."""
    return rounded(scored(spark, sf, ("geoid", "tr_POC_rank", *BENCHMARKS)).select("geoid", "tr_POC_rank", *BENCHMARKS))


_GROUPED = {"BUILDING": "White-Shared", "HOUSEHOLD": "All White", "MACHINERY": "Asian-Shared", "FURNITURE": "Integrated"}


@query(
    "type_group_shares",
    """SELECT nt2, count(*) AS count_ca, nullif(count(CASE WHEN tier1 = 'Heightened Sensitivity' THEN 1 END), 0) AS count_sc,
  format('{:,.1f}', CAST(nullif(count(CASE WHEN tier1 = 'Heightened Sensitivity' THEN 1 END), 0) AS DOUBLE) / count(*) * 100) || '%' AS p
FROM (SELECT *, CASE WHEN neigh_type IN ('BUILDING', 'HOUSEHOLD') THEN 'Mostly White' WHEN neigh_type = 'MACHINERY' THEN 'Mostly POC'
  WHEN neigh_type = 'FURNITURE' THEN 'Diverse' ELSE neigh_type END AS nt2 FROM tiered) t GROUP BY nt2""",
    ["tiered"],
)
def type_group_shares(spark, sf):
    """The segments stand for four of the published types; the fifth is in no group."""
    df = scored(spark, sf, ("neigh_type",))
    named = F.coalesce(*[F.when(F.col("neigh_type") == s, t) for s, t in _GROUPED.items()], "neigh_type")
    return export.type_group_shares(df.withColumn("neigh_type", named))


@query(
    "tier_medians",
    f"SELECT tier1, count(*) AS n, {R('median_tr_VLI_prop=median(vli_prop)')} FROM tiered GROUP BY tier1",
    ["tiered"],
)
def tier_medians(spark, sf):
    """From the final table as written and read again."""
    written = land(export.final_projection(scored(spark, sf)), "final")
    return rounded(export.tier_medians(written))


@query("small_areas", "SELECT count(*) AS n FROM tiered WHERE population < 500", ["tiered"])
def small_areas(spark, sf):
    return export.small_areas(scored(spark, sf, ("tr_population",)))


@query(
    "tier_summary",
    "SELECT "
    + R(
        *[
            f"{k}{name}=CASE WHEN count(*) = count({c}) THEN {f}({c}) END"
            for name, c in [
                ("POC", "ppoc"), ("Renter", "prenters"), ("VLI", "vli_prop"), ("VLI_50RB", "vli50p"), ("pChRent", "pch"),
            ]
            for k, f in (("p", "avg"), ("m", "median"))
        ]
    )
    + " FROM tiered WHERE tier1 = 'Heightened Sensitivity'",
    ["tiered"],
)
def tier_summary(spark, sf):
    return rounded(export.tier_summary(scored(spark, sf, ("tr_pPOC", "tr_prenters", "tr_VLI_prop", "tr_irVLI_50p", "tr_pchrent"))))


# ------------------------------------------------------------------ formats


def _pct(x: str) -> str:
    return f"format('{{:,.1f}}', ({x}) * 100) || '%'"


def _num(x: str) -> str:
    return f"format('{{:,.0f}}', {x})"


def _usd(x: str) -> str:
    return (
        f"CASE WHEN ({x}) < 0 AND regexp_matches({_num(f'abs({x})')}, '[1-9]') THEN '-' ELSE '' END "
        f"|| '$' || {_num(f'abs({x})')}"
    )


def _yn(x: str) -> str:
    return f"CASE WHEN {x} = 1 THEN 'Yes' ELSE 'No' END"


@query(
    "format_values",
    f"""SELECT area_key, {_num("total * 10")} AS population, {_pct("v1 / nullif(v1 + v2, 0)")} AS renters,
       {_usd("(v1 - v2) * 10")} AS gap, {_yn("CASE WHEN v1 > v2 THEN 1 ELSE 0 END")} AS more FROM profile""",
    ["profile"],
)
def format_values(spark, sf):
    df = core.area_wide(spark, sf)
    return df.select(
        "area_key",
        fn.fmt_comma(fn.row_sum0(*core.VARIABLES) * 10).alias("population"),
        fn.fmt_percent(fn.share("v1", F.col("v1") + F.col("v2"))).alias("renters"),
        fn.fmt_dollar((F.col("v1") - F.col("v2")) * 10).alias("gap"),
        fn.yes_no(fn.above("v1", "v2")).alias("more"),
    )


def _popup_sql() -> str:
    br = "'<br>'"
    parts = [
        "'<h3>Tract: '", "geoid", "'</h3>'",
        "'<b>Total population</b><br>'", _num("population"), br,
        "'<b>Total households</b><br>'", _num("households"), br, br,
        "'<b><i><u>Vulnerable Population Measures Met</b></i></u>'", br,
        "'<b>Very low income</b><br>'", _yn("v_VLI"), "'<br>(<i>'", _pct("vli_prop"), "' tract VLI, '",
        _pct("co_vli_prop"), "' county VLI, & '", _pct("pstudents"), "' students</i>)'", br,
        "'<b>Persons of color</b><br>'", _yn("v_POC"), "' (<i>'", _pct("ppoc"), "' tract & '",
        _pct("co_ppoc"), "' county</i>)'", br,
        "'<b>Renting household percentage</b><br>    '", _yn("v_Renters"), "' (<i>'", _pct("prenters"),
        "' tract & '", _pct("co_prenters"), "' county</i>)'", br,
        "'<b>Very low income renters paying<br>over 50% of income to rent</b><br>    '", _yn("v_RB50VLI"),
        "' (<i>'", _pct("vli50p"), "' tract & '", _pct("vli50m"), "' county</i>)'", br, br,
        "'<b><i><u>Displacement Pressures Met</b></i></u>'", br,
        "'<b>Change in rent</b><br>    '", _yn("dp_PChRent"), "' (<i>'", _pct("pch"), "' tract, '",
        _pct("pchrent_lag"), "' nearby, & '", _pct("co_pch"), "' county</i>)'", br,
        "'<b>Rent gap</b><br>     '", _yn("dp_RentGap"), "' (<i>'", _usd("gap"), "' tract & '",
        _usd("co_gap"), "' county</i>)'", br, br,
        "'<b><i><u>Rent</b></i></u>'", br, "'<b>Local</b>'", br, _usd("medrent"), br,
        "'<b>Nearby</b>'", br, _usd("medrent_lag"), br, br,
        "'<b><i><u>Racial composition</b></i></u>'", br, "'<b>Neighborhood Type</b>'", br, "neigh_type", br,
        "'<b>White alone</b>'", br, _pct("v4 / nullif(total, 0)"), br,
        "'<b>Black or African American alone</b>'", br, _pct("v2 / nullif(total, 0)"), br,
        "'<b>Asian alone</b>'", br, _pct("v3 / nullif(total, 0)"), br,
        "'<b>Latinx</b>'", br, _pct("v5 / nullif(total, 0)"), br,
        "'<b>Other</b>'", br, _pct("(total - v4 - v2 - v3 - v5) / nullif(total, 0)"), br,
    ]
    return " || ".join(f"({p})" for p in parts)


core.SQL_VIEWS["popups"] = (
    ("tiered",),
    f"""SELECT area_key, geoid, {_popup_sql()} AS popup FROM
(SELECT t.*, m.co_ppoc, m.co_prenters, m.co_vli_prop FROM tiered t LEFT JOIN
  (SELECT county, median(ppoc) AS co_ppoc, median(prenters) AS co_prenters, median(vli_prop) AS co_vli_prop
   FROM tiered GROUP BY county) m ON t.county = m.county) s""",
)
_FINAL = {
    "tr_medrent12": "g.old", "tr_chrent": "g.ch", "tr_pchrent": "g.pch",
    "tr_totinc_count": "i.tot", "tr_LI_count": "i.li", "tr_VLI_count": "i.vli", "tr_ELI_count": "i.eli",
    "tr_LI_prop": "b.li_p", "tr_VLI_prop": "b.vli_p", "tr_ELI_prop": "b.eli_p",
    "tr_irLI_30rb_ct": "m.li30", "tr_irLI_50rb_ct": "m.li50", "tr_irVLI_30rb_ct": "m.vli30", "tr_irVLI_50rb_ct": "m.vli50",
    "tr_irLI_30p": "m.li30p", "tr_irLI_50p": "m.li50p", "tr_irVLI_30p": "m.vli30p", "tr_irVLI_50p": "m.vli50p",
    "tr_pchrent_lag": "g.pchrent_lag", "tr_chrent_lag": "g.chrent_lag", "tr_medrent_lag": "g.medrent_lag",
    "tr_rentgap": "g.gap", "tr_rentgapprop": "g.gapprop", "tr_medrent": "g.medrent", "tr_POC_rank": "t.poc_rank",
    "co_medrent12": "g.co_old", "co_mhhinc": "i.co_mhhinc", "co_LI_val": "i.co_li_val", "co_VLI_val": "i.co_vli_val", "co_ELI_val": "i.co_eli_val",
    "co_irLI_30_med": "m.li30m", "co_irLI_50_med": "m.li50m", "co_irVLI_30_med": "m.vli30m", "co_irVLI_50_med": "m.vli50m",
    "scen1_VLI50RB_lag": "t.nshare",
    **{k: f"c.{k}" for k in _BENCHED},
    **{k: f"t.{v}" for k, v in {
        "tr_population": "population", "tr_households": "households", "tr_pstudents": "pstudents", "tr_prenters": "prenters", "tr_pPOC": "ppoc",
    }.items()},
    "tr_povstudents": "coalesce(t.v6, 0) + coalesce(t.v3, 0)",
    "tr_rb": "(coalesce(t.v1, 0) + coalesce(t.v3, 0) + coalesce(t.v5, 0) + coalesce(t.v7, 0)) / nullif(t.total, 0)",
    "tr_pWhite": "t.v4 / nullif(t.total, 0)", "tr_pBlack": "t.v2 / nullif(t.total, 0)",
    "tr_pAsian": "t.v3 / nullif(t.total, 0)", "tr_pLatinx": "t.v5 / nullif(t.total, 0)",
    "tr_pOther": "(t.total - t.v4 - t.v2 - t.v3 - t.v5) / nullif(t.total, 0)",
    "tr_pwelf": "t.v7 / nullif(t.total, 0)", "tr_ppoverty": "(coalesce(t.v3, 0) + coalesce(t.v5, 0)) / nullif(t.v1, 0)",
    "tr_punemp": "t.v6 / nullif(t.v1, 0)", "tr_pfemhhch": "(coalesce(t.v3, 0) + coalesce(t.v4, 0)) / nullif(t.v2, 0)",
}
_BURDENS = {"LI_30": "li30", "LI_50": "li50", "VLI_30": "vli30", "VLI_50": "vli50"}
_FINAL_FLAGS = {
    **{f"v_rb{k}rb": f"CASE WHEN m.{c}p > m.{c}m THEN 1 ELSE 0 END" for k, c in _BURDENS.items()},
    **{f"v_RB{k[-2:]}{k[:-3]}": f"CASE WHEN m.{c}p > m.{c}m THEN 1 ELSE 0 END" for k, c in _BURDENS.items()},
    "scen1_VLI50RB": "t.scen1",
    "scen3_VLI50RB": "t.scen3",
    **{c: f"t.{c}" for c in ("tr_dq", "v_VLI", "v_Renters", "v_POC", "dp_PChRent", "dp_RentGap", "tier1", "tier2", "tier3")},
}


@query(
    "final_projection",
    f"""SELECT t.geoid, t.county, t.neigh_type, t.big_city, {R(*[f"{k}={v}" for k, v in _FINAL.items()])},
  {", ".join(f"{v} AS {k}" for k, v in _FINAL_FLAGS.items())}, 'Tract: ' || t.geoid AS text, x.popup AS popup_text
FROM tiered t LEFT JOIN benched b ON t.area_key = b.area_key LEFT JOIN income i ON t.area_key = i.area_key
LEFT JOIN measures m ON t.area_key = m.area_key LEFT JOIN gaps g ON t.area_key = g.area_key
LEFT JOIN (SELECT county, {", ".join(f"median({c}) AS {k}" for k, c in _BENCHED.items())} FROM benched GROUP BY county) c ON t.county = c.county
LEFT JOIN popups x ON t.area_key = x.area_key""",
    ["tiered", "benched", "income", "measures", "gaps", "popups"],
)
def final_projection(spark, sf):
    """Every result column of the final table, and its two texts."""
    return rounded(export.final_projection(scored(spark, sf)))


@query("popup_text", "SELECT geoid, popup FROM popups", ["popups"])
def popup_text(spark, sf):
    return scored(spark, sf, export.POPUP_COLUMNS).select("geoid", export.popup().alias("popup"))


@query(
    "transit_layers",
    """SELECT area_key, geoid, neigh_type AS label, CASE neigh_type WHEN 'MACHINERY' THEN 'Bus' ELSE 'Rail' END AS layer
FROM areas WHERE neigh_type IN ('MACHINERY', 'BUILDING')""",
    ["areas"],
)
def transit_layers(spark, sf):
    df = core.areas(spark, sf).select("area_key", "geoid", F.col("neigh_type").alias("label"))
    return export.transit_layers(df, {"Bus": "MACHINERY", "Rail": "BUILDING"})


core.SQL_VIEWS["shapes"] = (
    ("poly_vertex",),
    """SELECT geo_id, '[[[' || string_agg('[' || CAST(x AS STRING) || ',' || CAST(y AS STRING) || ']', ',' ORDER BY vertex_no) || ']]]' AS coords
FROM poly_vertex GROUP BY geo_id""",
)
core.SQL_VIEWS["nation_tiers"] = (
    (),
    """SELECT CAST(n_nationkey AS STRING) AS geo_id, n_name,
  CASE WHEN n_regionkey = 0 THEN 'Poor Data Quality' WHEN n_regionkey = 1 THEN 'Heightened Sensitivity' END AS tier1,
  CASE WHEN n_regionkey IN (1, 2) THEN 'Vulnerable' END AS tier2,
  CASE WHEN n_regionkey = 3 THEN 'Fixed Transit Stop Buffer' WHEN n_regionkey = 4 THEN 'High-Quality Bus Corridor Buffer' END AS stop
FROM nation""",
)


def _json_text(x: str) -> str:
    return f"coalesce('\"' || {x} || '\"', 'null')"


@query(
    "feature_json",
    f"""SELECT l.geo_id, l.label, l.color, l.popup, l.layer,
  '{{"type":"Feature","properties":{{"geo_id":"' || l.geo_id || '","label":' || {_json_text("l.label")} || ',"color":"' || l.color
  || '","popup":' || {_json_text("l.popup")} || ',"layer":"' || l.layer || '"}},"geometry":{{"type":"MultiPolygon","coordinates":'
  || s.coords || '}}}}' AS feature
FROM (
  SELECT geo_id, tier1 AS label, CASE tier1 WHEN 'Heightened Sensitivity' THEN '#FF6633' WHEN 'Poor Data Quality' THEN '#CCCCCC' ELSE 'transparent' END AS color,
         'Tract: ' || n_name AS popup, 'Heightened Sensitivity' AS layer FROM nation_tiers
  UNION ALL SELECT geo_id, tier2, '#6699FF', 'Tract: ' || n_name, 'Vulnerable' FROM nation_tiers WHERE tier2 IS NOT NULL
  UNION ALL SELECT geo_id, stop, '#CCCCCC', NULL, CASE stop WHEN 'Fixed Transit Stop Buffer' THEN 'Rail' ELSE 'Bus' END FROM nation_tiers WHERE stop IS NOT NULL
) l JOIN shapes s ON l.geo_id = s.geo_id""",
    ["shapes", "nation_tiers"],
)
def feature_json(spark, sf):
    """Map layers of the nations; the lines also go to a file layer."""
    region = F.col("n_regionkey")
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("geo_id"),
        "n_name",
        F.when(region == 0, "Poor Data Quality").when(region == 1, "Heightened Sensitivity").alias("tier1"),
        F.when(region.isin(1, 2), "Vulnerable").alias("tier2"),
        F.when(region == 3, export.TRANSIT_LABELS["Rail"])
        .when(region == 4, export.TRANSIT_LABELS["Bus"])
        .alias("label"),
    )
    vertices = core.poly_vertex(spark, sf)
    return export.feature_layers(
        nation.drop("label"),
        vertices,
        nation.select("geo_id", "label"),
        vertices,
        area_id="geo_id",
        popup_column=export.label_text("n_name"),
    )


core.SQL_VIEWS["area_shapes"] = (
    ("areas",),
    f"""SELECT area_key, '[[[' || {" || ',' || ".join(
        f"'[' || CAST(CAST(cx + {dx} AS DOUBLE) AS STRING) || ',' || CAST(CAST(cy + {dy} AS DOUBLE) AS STRING) || ']'"
        for dx, dy in [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    )} || ']]]' AS coords FROM
  (SELECT area_key, floor(x * k / 10009e0) AS cx, floor(y * k / 10009e0) AS cy FROM areas, (SELECT ceil(sqrt(count(*) / 2e0)) AS k FROM areas)) g""",
)


@query(
    "scored_layers",
    f"""SELECT l.area_key, l.label, l.color, l.popup, l.layer,
  '{{"type":"Feature","properties":{{"area_key":' || CAST(l.area_key AS STRING) || ',"label":' || {_json_text("l.label")} || ',"color":"' || l.color
  || '","popup":' || {_json_text("l.popup")} || ',"layer":"' || l.layer || '"}},"geometry":{{"type":"MultiPolygon","coordinates":'
  || s.coords || '}}}}' AS feature
FROM (
  SELECT t.area_key, tier1 AS label, CASE tier1 WHEN 'Heightened Sensitivity' THEN '#FF6633' WHEN 'Poor Data Quality' THEN '#CCCCCC' ELSE 'transparent' END AS color,
         p.popup, 'Heightened Sensitivity' AS layer FROM tiered t LEFT JOIN popups p ON t.area_key = p.area_key
  UNION ALL SELECT t.area_key, tier2, '#6699FF', p.popup, 'Vulnerable' FROM tiered t LEFT JOIN popups p ON t.area_key = p.area_key WHERE tier2 IS NOT NULL
  UNION ALL SELECT area_key, neigh_type, '#CCCCCC', NULL, CASE neigh_type WHEN 'MACHINERY' THEN 'Bus' ELSE 'Rail' END
  FROM areas WHERE neigh_type IN ('MACHINERY', 'BUILDING')
) l JOIN area_shapes s ON l.area_key = s.area_key""",
    ["tiered", "popups", "areas", "area_shapes"],
)
def scored_layers(spark, sf):
    """Map layers of the scored table: both tier layers with the whole popup, and the transit buffers."""
    vertices = core.area_vertex(spark, sf)
    stops = core.areas(spark, sf).select(F.col("area_key").alias("geo_id"), F.col("neigh_type").alias("label"))
    return export.feature_layers(
        scored(spark, sf, export.POPUP_COLUMNS), vertices, stops, vertices, labels={"Bus": "MACHINERY", "Rail": "BUILDING"}, area_id="area_key"
    )


@query(
    "features_file",
    """SELECT '{"type":"Feature","properties":{"geo_id":"' || n.geo_id || '","name":"' || n.n_name
  || '"},"geometry":{"type":"MultiPolygon","coordinates":' || s.coords || '}}' AS feature
FROM nation_tiers n JOIN shapes s ON n.geo_id = s.geo_id""",
    ["shapes", "nation_tiers"],
)
def features_file(spark, sf):
    """Written layer, lines as read back."""
    path = scratch_dir(spark, "features")
    write_features(nations(spark, sf), core.poly_vertex(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "feature")
