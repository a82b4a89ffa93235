"""The whole assessment from estimates and geometry to tiers."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.functions.expr import parent_id
from areaindex.operators.columns import ids, scale_col, semi_filter
from areaindex.operators.geometry import centroid, contiguity, label_point, points_in_polygons
from areaindex.operators.groups import attach_group
from areaindex.operators.joins import flag_in, natural_left_join, reduce_left_join
from areaindex.operators.neighbours import band_lag, band_limit, neighbour_share
from areaindex.operators.order_stats import group_medians
from areaindex.operators.reshape import spread
from areaindex.plans.income import income_shares, low_quality
from areaindex.plans.profile import BENCHMARKS, area_profile, group_benchmarks, quality_flag, rent_gap
from areaindex.plans.rent import (
    burden_totals,
    rent_burden_cells,
    rent_burden_measures,
    rent_change,
    rent_medians,
    split_landed_cells,
)
from areaindex.plans.scoring import (
    DEFAULT,
    FLAG_INPUTS,
    TIER_INPUTS,
    Thresholds,
    pressure_flags,
    scenario_one,
    scenario_three,
    tiers,
    vulnerability_flags,
)
from areaindex.plans.variables import AREA_VARIABLES, OLD_RENT_VARIABLES
from areaindex.sources.landing import land

LAGGED = ["tr_pchrent", "tr_chrent", "medrent"]
INFLATION_2012_TO_2017 = 1.07


def wide_vintages(
    new: DataFrame,
    old: DataFrame,
    new_variables: dict[str, str] = AREA_VARIABLES,
    old_variables: dict[str, str] = OLD_RENT_VARIABLES,
    inflation: float = INFLATION_2012_TO_2017,
    by_geoid: bool = False,
) -> DataFrame:
    """One row per area from two tidy vintages, the older one inflated.  The vintages join on id and
    name, as published, so a renamed area loses its old value; ``by_geoid`` joins on the id alone."""
    id_cols = ["geoid", "name"]
    recent = spread(new, id_cols, "variable", "estimate", list(new_variables))
    inflated = scale_col(old, "estimate", inflation)
    earlier = spread(inflated, id_cols, "variable", "estimate", list(old_variables))
    if by_geoid:
        joined = natural_left_join(recent, earlier.drop("name"), ["geoid"])
    else:
        joined = natural_left_join(recent, earlier, id_cols)
    return joined.withColumn("county", parent_id("geoid", 5))


def big_city_ids(
    points: DataFrame, layers: Sequence[tuple[DataFrame, DataFrame]], area_id: str = "geoid"
) -> DataFrame:
    """Ids of points inside any of the selected polygons; ``layers`` holds (selected ids, vertices)
    per layer."""
    found = None
    for selected, vertices in layers:
        hits = points_in_polygons(points, semi_filter(vertices, selected, "geo_id"), area_id)
        named = ids(hits, area_id)
        found = named if found is None else found.unionByName(named)
    return found.distinct()


def _carried(df: DataFrame, needed: Collection[str], keep: Collection[str] | None) -> DataFrame:
    """The columns that later steps need or that are to be kept; all of them where ``keep`` is None."""
    return df if keep is None else df.select(*[c for c in df.columns if c in needed or c in keep])


def score(
    df: DataFrame,
    neighbour_edges: DataFrame,
    t: Thresholds = DEFAULT,
    by: str = "county",
    area_id: str = "geoid",
    keep: Collection[str] | None = None,
) -> DataFrame:
    """Benchmarks, flags, scenarios and tiers for one row per area that already carries profile,
    burden measures, lags, tr_dq and big_city.  ``keep`` as in ``assess``."""
    flagged = group_benchmarks(df, by)
    flagged = pressure_flags(vulnerability_flags(flagged, t))
    scored = scenario_three(scenario_one(flagged, t), t)
    scored = land(_carried(scored, [area_id, *TIER_INPUTS], keep), "scored", dictionary=False)
    # The lag counts the edges by neighbour and joins them: two passes.
    neighbour_edges = land(neighbour_edges, "edges", dictionary=False)
    return tiers(neighbour_share(scored, neighbour_edges, "scen1_VLI50RB", area_id), t)


def assess(
    wide: DataFrame,
    burden: DataFrame,
    low_quality_ids: DataFrame,
    big_city: DataFrame,
    points: DataFrame,
    neighbour_edges: DataFrame,
    neigh_type: DataFrame | None = None,
    band_factor: float = 0.1,
    t: Thresholds = DEFAULT,
    by: str = "county",
    area_id: str = "geoid",
    band: float | None = None,
    keep: Collection[str] | None = None,
) -> DataFrame:
    """One scored row per area.

    With ``keep`` the result has these columns, the flags, scenarios and tiers, and those that they come from.  Every
    step runs as without it, but other columns are not carried through the tables that are landed between the
    steps, across which Catalyst can't prune.

    The distance band is searched by place and never listed; with a band as wide as the map, its
    work still grows with the pairs of places within it, as the lag is defined over them.

    ``wide`` one row per area with the named estimates, medrent12 and the group; ``burden`` the long
    income x burden cells; ``points`` the label points (area id, x, y); ``neighbour_edges`` the
    contiguity edges; ``band`` the distance band if it is already known.  Tables used by more than one later step are landed once, which also bounds
    the lineage and lets Catalyst see the true size of group tables before it joins them.
    """
    # One positions table for all group medians of the input columns.
    medians = group_medians(wide, [by], {"co_mhhinc": "mhhinc", **rent_medians()})
    wide = attach_group(wide, medians, [by])
    income = land(income_shares(wide, area_id, [by]), "income", dictionary=False)
    cells = split_landed_cells(land(burden, "cells"))
    totals = natural_left_join(burden_totals(cells, area_id), income.select(area_id, by), [area_id])
    measures = rent_burden_measures(
        rent_burden_cells(cells, income.select(area_id, "co_mhhinc"), area_id), totals, [by], area_id
    )
    rent = rent_change(wide.drop("co_mhhinc"), by=[by])
    base = reduce_left_join([rent, income.drop(by, "mhhinc"), measures.drop(by)], [area_id])
    if neigh_type is not None:
        base = natural_left_join(base, neigh_type, [area_id])
    base = area_profile(natural_left_join(base, points, [area_id]))
    inputs = [area_id, by, *FLAG_INPUTS, *BENCHMARKS.values()]
    base = land(_carried(base, [*inputs, *LAGGED, "x", "y"], keep), "base", dictionary=False)

    d2 = band_limit(points, band_factor, area_id) if band is None else band
    lagged = band_lag(base, d2, LAGGED).withColumnRenamed("medrent_lag", "tr_medrent_lag")
    profiled = rent_gap(lagged, "medrent", "tr_medrent_lag").withColumn("tr_medrent", F.col("medrent"))
    profiled = quality_flag(profiled, low_quality_ids, area_id)
    profiled = flag_in(profiled, big_city, area_id, "big_city")
    profiled = land(_carried(profiled, inputs, keep), "profiled", dictionary=False)
    return score(profiled, neighbour_edges, t, by, area_id, keep)


def assess_estimates(
    new: DataFrame,
    old: DataFrame,
    burden: DataFrame,
    poly_vertex: DataFrame,
    city_layers: Sequence[tuple[DataFrame, DataFrame]],
    neigh_type: DataFrame | None = None,
    snap: float = 0.0,
    band_factor: float = 0.1,
    t: Thresholds = DEFAULT,
) -> DataFrame:
    """The assessment from landed inputs: tidy estimates of two vintages, income x burden cells, area
    polygons (geo_id = geoid) and big-city layers.  The polygons make the rows: one without estimates
    stays, with missing measures and flags of 0.  Centroids select cities; label points, the
    centres of the largest parts, carry the neighbour weights."""
    estimates = wide_vintages(new, old).drop("county")
    centres = centroid(poly_vertex).select(F.col("geo_id").alias("geoid"), "x", "y")
    labels = land(label_point(poly_vertex).select(F.col("geo_id").alias("geoid"), "x", "y"), "points")
    wide = natural_left_join(labels.select("geoid"), estimates, ["geoid"])
    wide = land(wide.withColumn("county", parent_id("geoid", 5)), "wide")
    edges = contiguity(poly_vertex, snap)
    return assess(
        wide,
        burden,
        low_quality(new),
        big_city_ids(centres, city_layers),
        labels,
        edges,
        neigh_type,
        band_factor,
        t,
    )
