import math
import random

import pytest
from pyspark.sql import functions as F

from areaindex.operators import geometry as geo
from areaindex.operators import neighbours as nb

VERTEX = "geo_id string, part_no int, ring_no int, vertex_no int, x double, y double"
POINT = "geo_id string, x double, y double"


def ring(geo_id, part, number, corners):
    closed = [*corners, corners[0]]
    return [(geo_id, part, number, i, float(x), float(y)) for i, (x, y) in enumerate(closed)]


def square(geo_id, x, y, side=1, part=0, number=0):
    return ring(geo_id, part, number, [(x, y), (x + side, y), (x + side, y + side), (x, y + side)])


def test_two_parts(spark):
    poly = spark.createDataFrame(square("a", 0, 0, 2) + square("a", 10, 0, 1, part=1), VERTEX)
    c = geo.centroid(poly).first()
    assert (c.x, c.y, c.area) == pytest.approx((2.9, 0.9, 5))
    p = geo.label_point(poly).first()
    assert (p.x, p.y) == pytest.approx((1, 1))


def test_hole_is_subtracted_whatever_its_direction(spark):
    hole = square("a", 0, 0, 2, number=1)
    for vertices in (hole, [(g, p, r, 4 - i, x, y) for g, p, r, i, x, y in hole]):
        poly = spark.createDataFrame(square("a", 0, 0, 4) + vertices, VERTEX)
        c = geo.centroid(poly).first()
        assert (c.x, c.y, c.area) == pytest.approx(((16 * 2 - 4 * 1) / 12, (16 * 2 - 4 * 1) / 12, 12))


def test_far_off_coordinates_keep_precision(spark):
    poly = spark.createDataFrame(square("a", 1e9, -1e9, 1e-3), VERTEX)
    c = geo.centroid(poly).first()
    lo = 1e9
    assert lo < c.x < lo + 1e-3 and c.area > 0


def test_points_in_polygons(spark, rows):
    poly = spark.createDataFrame(square("a", 0, 0, 1) + square("a", 0.25, 0.25, 0.5, number=1), VERTEX)
    pts = [(1, 0.1, 0.1), (2, 0.0, 0.5), (3, 1.0, 1.0), (4, 2.0, 0.5), (5, 0.5, 0.5)]
    points = spark.createDataFrame(pts, "point_id int, x double, y double")
    assert rows(geo.points_in_polygons(points, poly)) == [(1, "a"), (2, "a"), (3, "a")]


def winding(px, py, corners):
    inside = False
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def test_points_in_irregular_polygons(spark, rows):
    random.seed(4)
    shapes, vertices = {}, []
    for i in range(12):
        cx, cy, scale = random.uniform(0, 50), random.uniform(0, 50), random.choice([1, 5, 20])
        angles = sorted(random.uniform(0, 2 * math.pi) for _ in range(9))
        shapes[str(i)] = [(cx + scale * random.uniform(0.3, 1) * math.cos(a), cy + scale * random.uniform(0.3, 1) * math.sin(a)) for a in angles]
        vertices += ring(str(i), 0, 0, shapes[str(i)])
    pts = [(j, random.uniform(-5, 60), random.uniform(-5, 60)) for j in range(400)]
    got = geo.points_in_polygons(spark.createDataFrame(pts, "point_id int, x double, y double"), spark.createDataFrame(vertices, VERTEX))
    want = [(j, g) for j, x, y in pts for g, corners in shapes.items() if winding(x, y, corners)]
    assert rows(got) == sorted(want, key=repr) and want


def zigzag(n, height=1000.0):
    """A comb of n teeth: all its edges but the base are nearly as long as it is high."""
    teeth = [(float(i), 1.0 + (i * 37 % 11) / 7 if i % 2 else height - (i * 53 % 13) / 3) for i in range(n + 1)]
    return [*teeth, (float(n), 0.0), (0.0, 0.0)]


def test_strip_tree_tiles_each_edge_once(spark):
    """Every height of an edge is under exactly one of its nodes on the path of that height, and the rows of
    long edges grow as n log n."""
    sizes = {}
    for n in (256, 4096):
        poly = spark.createDataFrame(ring("z", 0, 0, zigzag(n)), VERTEX)
        areas = geo._area_grid(poly)
        halvings = areas.first().halvings
        nodes = geo.edges_by_strip(poly, areas)
        sizes[n] = nodes.count()
        assert 2**halvings >= n / geo.EDGES_PER_STRIP and sizes[n] <= (n + 4) * 2 * max(1, halvings)
        if n == 256:
            ymin, ymax = areas.first().ymin, areas.first().ymax
            edges = {}
            for r in nodes.collect():
                edges.setdefault((r.x1, r.y1, r.x2, r.y2), []).append(r.node)
            for (_, y1, _, y2), held in edges.items():
                lowest = [int(min(2**halvings - 1, (y - ymin) / (ymax - ymin) * 2**halvings)) for y in sorted((y1, y2))]
                for leaf in range(2**halvings):
                    path = [(leaf + 2**halvings) >> k for k in range(halvings + 1)]
                    assert sum(node in path for node in held) == (lowest[0] <= leaf <= lowest[1])
    assert sizes[4096] < 4096 * 512 / 16


def test_points_in_a_zigzag(spark, rows):
    draw = random.Random(8)
    corners = zigzag(600)
    poly = spark.createDataFrame(ring("z", 0, 0, corners) + square("flat", 700, 0), VERTEX)
    pts = [(j, draw.uniform(-5, 610), draw.uniform(-5, 1005)) for j in range(500)] + [(900, 300.0, 0.0), (901, 0.0, 0.0), (902, 700.5, 0.5)]
    got = geo.points_in_polygons(spark.createDataFrame(pts, "point_id int, x double, y double"), poly)
    want = [(j, "z") for j, x, y in pts[:500] if winding(x, y, corners)] + [(900, "z"), (901, "z"), (902, "flat")]
    assert rows(got) == sorted(want, key=repr) and len(want) > 100


def block():
    return [s for i, (x, y) in enumerate([(0, 0), (1, 0), (0, 1), (1, 1)]) for s in square(str(i), x, y)] + square("far", 9, 9)


def test_contiguity_of_a_block(spark, rows):
    poly = spark.createDataFrame(block(), VERTEX)
    edges = geo.contiguity(poly)
    got = rows(edges)
    assert len(got) == 12 and all((b, a) in got for a, b in got)
    weights = nb.row_standardise(edges).groupBy("src").agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
    assert all(r.w == pytest.approx(1) and r.n == 3 for r in weights)


def test_contiguity_within_a_snap_distance(spark):
    poly = spark.createDataFrame(square("a", 0, 0) + square("b", 1.0005, 0), VERTEX)
    assert geo.contiguity(poly).count() == 0
    assert geo.contiguity(poly, snap=0.001).count() == 2


def test_nearest_on_a_line(spark, rows):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 10.0, 0.0)], POINT)
    edges = nb.knn(points)
    assert rows(edges) == [("a", "b", 1.0), ("b", "a", 1.0), ("c", "b", 9.0)]
    assert nb.band_width(edges).first().d2 == pytest.approx(0.9)
    assert nb.distance_band(points, 0.9).count() == 0


def brute_nearest(pts, k):
    out = []
    for i, x, y in pts:
        near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in pts if j != i)
        out += [(i, j, d) for d, j in near[:k]]
    return sorted(out, key=repr)


def clustered(n=300, seed=7):
    """A third of the points on one spot, a third in one small cluster, the rest far apart."""
    random.seed(seed)
    pts = []
    for i in range(n):
        if i % 3 == 0:
            x, y = 5.0, 5.0
        elif i % 3 == 1:
            x, y = 100 + random.randrange(1000) / 4096, 100 + random.randrange(1000) / 4096
        else:
            x, y = float(random.randrange(4000)), float(random.randrange(4000))
        pts.append((i, x, y))
    return pts


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_against_brute_force(spark, rows, k):
    pts = clustered()
    got = nb.knn(spark.createDataFrame(pts, "geo_id int, x double, y double"), k)
    assert rows(got) == brute_nearest(pts, k)


@pytest.mark.parametrize("places", [1, 4])
def test_nearest_with_small_leaves(spark, rows, monkeypatch, places):
    monkeypatch.setattr(nb, "LEAF_PLACES", places)
    pts = clustered(150)
    got = nb.knn(spark.createDataFrame(pts, "geo_id int, x double, y double"))
    assert rows(got) == brute_nearest(pts, 1)


def spread_and_dense(side):
    """Scattered places, and as many in one square of the given side."""
    draw = random.Random(21)
    scattered = [(i, draw.uniform(0, 1000), draw.uniform(0, 1000)) for i in range(400)]
    return scattered + [(400 + i, 500 + draw.random() * side, 500 + draw.random() * side) for i in range(400)]


def test_dense_and_sparse_parts_have_their_own_cells(spark):
    places = spark.createDataFrame(spread_and_dense(1e-5), "id int, x double, y double").select("x", "y")
    tree = nb.Quadtree(places)
    leaves = tree.leaves(places)
    keys = ["level", *(tree.cell(c, F.col("level")).alias(f"c{c}") for c in "xy")]
    held = leaves.groupBy(*keys).count().toPandas()
    assert held["count"].max() <= nb.LEAF_PLACES and held["count"].sum() == 800
    levels = {bool(r.dense): (r.low, r.high) for r in leaves.groupBy((F.abs(F.col("x") - 500) < 1e-4).alias("dense")).agg(F.min("level").alias("low"), F.max("level").alias("high")).collect()}
    assert levels[False][1] <= 8 and levels[True][0] >= 24


def test_rounds_do_not_grow_with_a_dense_cluster(spark, rows, monkeypatch):
    searched, plain = [], nb.Quadtree.near
    monkeypatch.setattr(nb.Quadtree, "near", lambda *args, **named: searched.append(1) or plain(*args, **named))
    rounds = {}
    for side in (1000.0, 1e-2, 1e-7):
        searched.clear()
        pts = spread_and_dense(side)
        assert rows(nb.knn(spark.createDataFrame(pts, "geo_id int, x double, y double"))) == brute_nearest(pts, 1)
        rounds[side] = len(searched)
    assert rounds[1e-7] <= rounds[1e-2] <= 4


def test_lowest_ids_without_lists(spark, rows):
    """Few lowest numbers of a group come from a hash table; the same rows as from lists, missing ids left out."""
    data = [(i % 7, i) for i in range(40)] + [(1, 1), (1, 1), (2, None), (9, None)]
    df = spark.createDataFrame(data, "g int, id long")
    for k in (2, 3, nb.FEW_LOWEST + 1):
        got = nb._lowest(df, ["g"], "id", k, "ids")
        want = []
        for g in sorted({g for g, _ in data}):
            ids = sorted((i for h, i in data if h == g), key=lambda i: (i is not None, i or 0))[:k]
            want.append((g, [i for i in ids if i is not None]))
        assert rows(got, "g") == want
        assert ("collect_list" in _plan(got)) == (k > nb.FEW_LOWEST)


def test_nearest_of_few_points(spark, rows):
    schema = "geo_id int, x double, y double"
    assert nb.knn(spark.createDataFrame([(1, 0.0, 0.0)], schema)).count() == 0
    assert nb.knn(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], schema)
    assert rows(nb.knn(two, 3)) == [(1, 2, 0.0), (2, 1, 0.0)]


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_distance_band_against_brute_force(spark, rows, monkeypatch, chunk):
    monkeypatch.setattr(nb.near_pairs, "__defaults__", (chunk,))
    pts = clustered(200)
    got = nb.distance_band(spark.createDataFrame(pts, "geo_id int, x double, y double"), 300.0)
    want = []
    for i, x, y in pts:
        for j, u, v in pts:
            d = math.sqrt((x - u) * (x - u) + (y - v) * (y - v))
            if i != j and 0 < d <= 300:
                want.append((i, j, d))
    assert rows(got) == sorted(want, key=repr)


def test_distance_band_in_one_crowded_cell(spark, rows, monkeypatch):
    """All points in one cell: blocks of left by blocks of right rows, and the pairs counted beforehand."""
    draw = random.Random(12)
    pts = [(i, draw.random(), draw.random()) for i in range(400)]
    points = spark.createDataFrame(pts, "geo_id int, x double, y double")
    assert nb.band_pairs_bound(points, 10.0) == 400 * 400 and nb.band_pairs_bound(points, 0.0) == 0
    monkeypatch.setattr(nb.near_pairs, "__defaults__", (30,))
    got = {(r.src, r.dst) for r in nb.distance_band(points, 10.0).collect()}
    assert len(got) == 400 * 399
    few = {(r.src, r.dst) for r in nb.distance_band(points, 0.05).collect()}
    assert few == {(i, j) for i, x, y in pts for j, u, v in pts if i != j and math.sqrt((x - u) * (x - u) + (y - v) * (y - v)) <= 0.05}


def test_lag_of_two_neighbours(spark):
    areas = spark.createDataFrame([("s", 0.0, 0.0, 1.0), ("a", 1.0, 0.0, 10.0), ("b", 0.0, 2.0, 20.0), ("z", 99.0, 99.0, 5.0)], POINT + ", v double")
    weights = nb.idw_weights(nb.distance_band(areas, 2.0))
    from_s = {r.dst: r.w for r in weights.filter("src = 's'").collect()}
    assert from_s == pytest.approx({"a": 0.8, "b": 0.2})
    for out in (nb.spatial_lag(areas, weights, ["v"]), nb.band_lag(areas, 2.0, ["v"])):
        lags = {r.geo_id: r.v_lag for r in out.collect()}
        assert lags["s"] == pytest.approx(12) and lags["z"] == 0.0


def test_lag_variants_agree_with_stacked_points(spark, rows):
    areas = spark.createDataFrame([(*p, float(p[0] % 11)) for p in clustered(200)], "geo_id int, x double, y double, v double")
    edges = nb.idw_weights(nb.distance_band(areas, 400.0))
    by_edges = {r.geo_id: r.v_lag for r in nb.spatial_lag(areas, edges, ["v"]).collect()}
    by_band = {r.geo_id: r.v_lag for r in nb.band_lag(areas, 400.0, ["v"]).collect()}
    assert by_band == pytest.approx(by_edges)


def test_lag_of_a_constant_and_of_missing_values(spark):
    areas = spark.createDataFrame([(i, float(i), 0.0, 3.0, None if i == 2 else 1.0) for i in range(6)], "geo_id int, x double, y double, c double, m double")
    out = nb.band_lag(areas, 1.0, ["c", "m"]).orderBy("geo_id").collect()
    assert [r.c_lag for r in out] == pytest.approx([3.0] * 6)
    assert [r.m_lag for r in out] == [1.0, None, 1.0, None, 1.0, 1.0]
    with pytest.raises(Exception, match="missing value in the lag of m"):
        nb.band_lag(areas, 1.0, ["m"], on_null="error").collect()


def test_no_band_means_no_neighbours(spark):
    areas = spark.createDataFrame([("a", 0.0, 0.0, 1000.0), ("b", 1.0, 0.0, 800.0)], POINT + ", medrent double")
    from areaindex.plans.profile import rent_gap

    out = rent_gap(nb.band_lag(areas, 0.0, ["medrent"])).orderBy("geo_id").first()
    assert (out.medrent_lag, out.tr_rentgap, out.tr_rentgapprop) == (0.0, -1000.0, -2.0)
    assert nb.spatial_lag(areas, nb.distance_band(areas, 0.0), ["medrent"], zero_policy=False).first().medrent_lag is None


def test_neighbours_without_a_row_count_without_the_flag(spark):
    areas = spark.createDataFrame([("a", 0), ("b", 1)], "geo_id string, flag int")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "src string, dst string")
    got = {r.geo_id: r.flag_lag for r in nb.neighbour_share(areas, edges, "flag").collect()}
    assert got == {"a": 0.5, "b": 0.0}
    lags = {r.geo_id: r.flag_lag for r in nb.spatial_lag(areas, edges, ["flag"]).collect()}
    assert lags == {"a": None, "b": 0.0}


def test_one_large_polygon_among_small_ones(spark, rows):
    draw = random.Random(5)
    small = [square(f"s{i}", i % 20, i // 20) for i in range(400)]
    large = square("large", -1000, -1000, 5000)
    poly = spark.createDataFrame([v for p in small for v in p] + large, VERTEX)
    places = [(i, draw.uniform(-2, 22), draw.uniform(-2, 22)) for i in range(300)]
    points = spark.createDataFrame(places, "point_id int, x double, y double")
    want = [(i, "large") for i, _, _ in places]
    want += [(i, f"s{int(y) * 20 + int(x)}") for i, x, y in places if 0 <= x < 20 and 0 <= y < 20]
    assert rows(geo.points_in_polygons(points, poly)) == sorted(want, key=repr)


def test_nearest_with_remote_points(spark):
    draw = random.Random(9)
    places = [(f"p{i}", draw.random(), draw.random()) for i in range(300)] + [("far", 1e6, 1e6), ("farther", -3e7, 2.0)]
    got = {r.src: (r.dst, r.dist) for r in nb.knn(spark.createDataFrame(places, POINT), 1).collect()}
    for name, x, y in places:
        dist, near = min((math.sqrt((x - a) ** 2 + (y - b) ** 2), n) for n, a, b in places if n != name)
        assert got[name] == (near, pytest.approx(dist))


def test_an_empty_layer_has_nothing_to_check(spark):
    points = geo.with_srid(spark.createDataFrame([("a", 0.0, 0.0)], POINT), 1)
    empty = geo.with_srid(spark.createDataFrame([], POINT), 2)
    assert geo.same_srid(points, empty).count() == 1


def test_srid_mismatch_raises(spark):
    poly = spark.createDataFrame(square("a", 0, 0), VERTEX)
    points = spark.createDataFrame([("p", 0.0, 0.0)], POINT)
    assert geo.same_srid(geo.with_srid(points, 4269), geo.with_srid(poly, 4269)).count() == 1
    with pytest.raises(Exception, match="different reference systems"):
        geo.same_srid(geo.with_srid(points, 4269), geo.with_srid(poly, 4326)).collect()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_areas_are_not_sent_through_the_driver(spark):
    points = spark.range(400).select(
        F.col("id").alias("geo_id"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y")
    )
    edges = nb.distance_band(points, 1.0)
    assert "Broadcast" not in _plan(edges)
    assert edges.count() == 4 * 20 * 19
    values = points.withColumn("v", F.col("x"))
    assert "Broadcast" not in _plan(nb.band_lag(values, 1.0, ["v"]))
    assert "Broadcast" not in _plan(nb.idw_weights(edges))
    assert "Broadcast" not in _plan(geo.contiguity(points.select("geo_id", "x", "y")))
