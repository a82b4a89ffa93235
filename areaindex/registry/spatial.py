"""Queries of geometry, neighbour graphs and spatial lags."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaindex.operators import geometry as geo
from areaindex.operators import neighbours as nb
from areaindex.plans.assess import big_city_ids as find_big_city_ids
from areaindex.plans.profile import rent_gap as with_rent_gap
from areaindex.plans.scoring import pressure_flags as with_pressure_flags
from areaindex.operators.groups import with_group_median
from areaindex.registry import core
from areaindex.registry.core import BAND_FACTOR, R, query, rounded, table
from areaindex.registry.indicators import rents
from areaindex.sources import land, read_polygons, scratch_dir, write_features

NATION_PROPERTIES = T.StructType(
    [T.StructField("geo_id", T.StringType()), T.StructField("name", T.StringType())]
)


def nations(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("geo_id"), F.col("n_name").alias("name")
    )


@query(
    "polygon_vertices",
    f"SELECT v.geo_id, n.n_name AS name, part_no, ring_no, vertex_no, {R('x', 'y')} FROM poly_vertex v "
    "JOIN nation n ON v.geo_id = CAST(n.n_nationkey AS STRING)",
    ["poly_vertex"],
)
def polygon_vertices(spark, sf):
    """Polygons written as GeoJSON lines and read back."""
    path = scratch_dir(spark, "features")
    write_features(nations(spark, sf), core.poly_vertex(spark, sf), path)
    attributes, vertices = read_polygons(spark, path, NATION_PROPERTIES)
    return rounded(vertices.join(attributes, "geo_id"))


@query("srid_check", f"SELECT area_key, {R('x', 'y')}, 4269 AS srid FROM areas", ["areas"])
def srid_check(spark, sf):
    tagged = geo.with_srid(core.points(spark, sf), 4269)
    layer = geo.with_srid(core.poly_vertex(spark, sf), 4269)
    return rounded(geo.same_srid(tagged, layer))


@query(
    "polygon_centroid",
    f"SELECT geo_id, {R('x=min(x) + 1000', 'y=min(y) + 1000', 'area=(max(x) - min(x)) * (max(y) - min(y))')} FROM poly_vertex GROUP BY geo_id",
    ["poly_vertex"],
)
def polygon_centroid(spark, sf):
    return rounded(geo.centroid(core.poly_vertex(spark, sf)))


@query(
    "label_point",
    f"SELECT geo_id, {R('x=min(x) + 1000', 'y=min(y) + 1000')} FROM poly_vertex GROUP BY geo_id",
    ["poly_vertex"],
)
def label_point(spark, sf):
    return rounded(geo.label_point(core.poly_vertex(spark, sf)))


_TOUCH = """SELECT DISTINCT a.geo_id AS src, b.geo_id AS dst FROM poly_vertex a JOIN poly_vertex b
  ON a.x = b.x AND a.y = b.y AND a.geo_id <> b.geo_id"""
core.SQL_VIEWS["touch"] = (("poly_vertex",), _TOUCH)


@query("queen_contiguity", "SELECT src, dst FROM touch", ["touch"])
def queen_contiguity(spark, sf):
    return geo.contiguity(core.poly_vertex(spark, sf))


@query(
    "contiguity_weights",
    f"SELECT t.src, t.dst, {R('w=1e0 / d.n')} FROM touch t JOIN (SELECT src, count(*) AS n FROM touch GROUP BY src) d ON t.src = d.src",
    ["touch"],
)
def contiguity_weights(spark, sf):
    return rounded(nb.row_standardise(geo.contiguity(core.poly_vertex(spark, sf))))


_INSIDE = """SELECT a.area_key, b.geo_id FROM areas a
JOIN (SELECT geo_id, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM poly_vertex GROUP BY geo_id) b
  ON a.x BETWEEN b.x1 AND b.x2 AND a.y BETWEEN b.y1 AND b.y2"""


@query("point_in_polygon", _INSIDE, ["areas", "poly_vertex"])
def point_in_polygon(spark, sf):
    return geo.points_in_polygons(core.points(spark, sf), core.poly_vertex(spark, sf), "area_key")


# Two layers: whole regions of nations, and nations by name, one of them in both.
_LAYER_REGION = 2
_LAYER_NAMES = ["FRANCE", "CHINA", "JAPAN"]


def city_layers(spark, sf):
    nation = table(spark, sf, "nation").withColumn("geo_id", F.col("n_nationkey").cast("string"))
    vertices = core.poly_vertex(spark, sf)
    return [
        (nation.filter(F.col("n_regionkey") == _LAYER_REGION).select("geo_id"), vertices),
        (nation.filter(F.col("n_name").isin(*_LAYER_NAMES)).select("geo_id"), vertices),
    ]


core.SQL_VIEWS["big_city"] = (
    ("areas", "poly_vertex"),
    f"""SELECT DISTINCT area_key FROM ({_INSIDE}) i JOIN nation n ON i.geo_id = CAST(n.n_nationkey AS STRING)
WHERE n.n_regionkey = {_LAYER_REGION} OR n.n_name IN ({", ".join(f"'{n}'" for n in _LAYER_NAMES)})""",
)


@query("big_city_ids", "SELECT area_key FROM big_city", ["big_city"])
def big_city_ids(spark, sf):
    return find_big_city_ids(core.points(spark, sf), city_layers(spark, sf), "area_key")


@query("nearest_neighbour", f"SELECT src, dst, {R('dist')} FROM nn", ["nn"])
def nearest_neighbour(spark, sf):
    return rounded(nb.knn(core.points(spark, sf), 1, "area_key"))


@query("band_width", f"SELECT {R('max_nn=max(dist)', f'd2=max(dist) * {BAND_FACTOR}e0')} FROM nn", ["nn"])
def band_width(spark, sf):
    return rounded(nb.band_width(nb.knn(core.points(spark, sf), 1, "area_key"), BAND_FACTOR))


def band_edges(spark, sf):
    points = land(core.points(spark, sf), "points")
    return nb.distance_band(points, nb.band_limit(points, BAND_FACTOR, "area_key"), "area_key")


@query("distance_band", f"SELECT src, dst, {R('dist')} FROM band", ["band"])
def distance_band(spark, sf):
    return rounded(band_edges(spark, sf))


@query("idw_weights", f"SELECT src, dst, {R('dist', 'w')} FROM idw", ["idw"])
def idw_weights(spark, sf):
    return rounded(nb.idw_weights(band_edges(spark, sf)))


def lagged_rents(spark, sf, cols):
    df = land(rents(spark, sf), "rents")
    return nb.band_lag(df, nb.band_limit(df, BAND_FACTOR, "area_key"), cols)


@query(
    "spatial_lag",
    f"SELECT area_key, {R('medrent_lag', 'tr_chrent_lag=chrent_lag', 'tr_pchrent_lag=pchrent_lag')} FROM rent_lagged",
    ["rent_lagged"],
)
def spatial_lag(spark, sf):
    cols = ["medrent", "tr_chrent", "tr_pchrent"]
    return rounded(lagged_rents(spark, sf, cols).select("area_key", *[f"{c}_lag" for c in cols]))


@query(
    "spatial_lag_edges",
    f"SELECT area_key, {R('medrent_lag')} FROM rent_lagged",
    ["rent_lagged"],
)
def spatial_lag_edges(spark, sf):
    """The same lag over an explicit edge table."""
    df = land(rents(spark, sf), "rents")
    edges = nb.distance_band(df, nb.band_limit(df, BAND_FACTOR, "area_key"), "area_key")
    out = nb.spatial_lag(df, nb.idw_weights(edges), ["medrent"], "area_key")
    return rounded(out.select("area_key", "medrent_lag"))


@query(
    "rent_gap",
    f"""SELECT area_key, {R("tr_rentgap=medrent_lag - medrent",
        "tr_rentgapprop=(medrent_lag - medrent) / nullif((medrent + medrent_lag) / 2, 0)")} FROM rent_lagged""",
    ["rent_lagged"],
)
def rent_gap(spark, sf):
    out = with_rent_gap(lagged_rents(spark, sf, ["medrent"]))
    return rounded(out.select("area_key", "tr_rentgap", "tr_rentgapprop"))


@query(
    "lag_change",
    f"SELECT area_key, {R('tr_propchrent_lag=(medrent_lag - old_lag) / nullif(old_lag, 0)')} FROM rent_lagged",
    ["rent_lagged"],
)
def lag_change(spark, sf):
    lagged = lagged_rents(spark, sf, ["medrent", "tr_medrent12"])
    out = nb.lag_change(lagged, "medrent", "tr_medrent12", "tr_propchrent_lag")
    return rounded(out.select("area_key", "tr_propchrent_lag"))


core.SQL_VIEWS["gaps"] = (
    ("rent_lagged",),
    """SELECT *, (medrent_lag - medrent) / nullif((medrent + medrent_lag) / 2, 0) AS gapprop,
       medrent_lag - medrent AS gap FROM rent_lagged""",
)
core.SQL_VIEWS["pressures"] = (
    ("gaps",),
    """SELECT g.*, m.co_pch, m.co_gapprop, m.co_gap,
       CASE WHEN g.pch > 0 AND g.pch > m.co_pch THEN 1 WHEN g.pchrent_lag > m.co_pch THEN 1 ELSE 0 END AS dp_PChRent,
       CASE WHEN g.gapprop > 0 AND g.gapprop > m.co_gapprop THEN 1 ELSE 0 END AS dp_RentGap
FROM gaps g LEFT JOIN (SELECT county, median(pch) AS co_pch, median(gapprop) AS co_gapprop, median(gap) AS co_gap
                       FROM gaps GROUP BY county) m ON g.county = m.county""",
)


@query("pressure_flags", "SELECT area_key, dp_PChRent, dp_RentGap FROM pressures", ["pressures"])
def pressure_flags(spark, sf):
    df = land(with_rent_gap(lagged_rents(spark, sf, ["medrent", "tr_pchrent"])), "gaps")
    df = with_group_median(df, ["county"], {"co_pchrent": "tr_pchrent", "co_rentgapprop": "tr_rentgapprop"})
    return with_pressure_flags(df).select("area_key", "dp_PChRent", "dp_RentGap")


@query(
    "lag_missing_areas",
    f"""SELECT w.area_key, {R("v2_lag=CASE WHEN l.src IS NULL THEN 0 ELSE l.v2_lag END", "flag_lag=coalesce(l.flag_lag, 0)")}
FROM wide w LEFT JOIN (
  SELECT t.src, CASE WHEN count(*) = count(g.v2) THEN sum(g.v2) / count(*) END AS v2_lag,
         CAST(sum(CASE WHEN g.v1 > g.v2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS flag_lag
  FROM area_touch t LEFT JOIN wide g ON t.dst = g.area_key GROUP BY t.src) l ON w.area_key = l.src""",
    ["wide", "area_touch"],
)
def lag_missing_areas(spark, sf):
    """Lags where a third of the polygons have no estimates: a neighbour's value is missing then, its
    flag counts as 0."""
    held = land(
        core.wide(spark, sf).select("area_key", "v2", F.when(F.col("v1") > F.col("v2"), 1).otherwise(0).alias("flag")),
        "held",
    )
    edges = land(geo.contiguity(core.area_vertex(spark, sf)), "edges")
    lagged = nb.neighbour_share(nb.spatial_lag(held, edges, ["v2"], "area_key"), edges, "flag", "area_key")
    return rounded(lagged.select("area_key", "v2_lag", "flag_lag"))


@query(
    "neighbour_share",
    f"""SELECT f.geo_id, f.flag, {R("flag_lag=coalesce(s.lag, 0)")} FROM
  (SELECT CAST(n_nationkey AS STRING) AS geo_id, CASE WHEN count(c_custkey) * 25 > (SELECT count(*) FROM customer) THEN 1 ELSE 0 END AS flag
   FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey) f
LEFT JOIN (SELECT t.src, avg(g.flag) AS lag FROM touch t JOIN
  (SELECT CAST(n_nationkey AS STRING) AS geo_id, CASE WHEN count(c_custkey) * 25 > (SELECT count(*) FROM customer) THEN 1 ELSE 0 END AS flag
   FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey) g ON t.dst = g.geo_id GROUP BY t.src) s
  ON f.geo_id = s.src""",
    ["touch"],
)
def neighbour_share(spark, sf):
    """Share of adjoining nations holding more customers than the average nation."""
    customers = table(spark, sf, "customer")
    total = customers.agg(F.count(F.lit(1))).scalar()
    counts = customers.groupBy(F.col("c_nationkey").cast("string").alias("geo_id")).agg(F.count(F.lit(1)).alias("n"))
    flagged = (
        nations(spark, sf)
        .join(counts, "geo_id", "left")
        .select("geo_id", F.when(F.coalesce("n", F.lit(0)) * 25 > total, 1).otherwise(0).alias("flag"))
    )
    return rounded(nb.neighbour_share(flagged, geo.contiguity(core.poly_vertex(spark, sf)), "flag"))
