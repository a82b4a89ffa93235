"""Planar geometry over a vertex table (geo_id, part_no, ring_no, vertex_no, x, y), rings closed,
ring 0 the outer ring and further rings holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.operators.pairs import near_pairs, salted_join
from areaindex.sources.landing import land

RING = ["geo_id", "part_no", "ring_no"]


def with_srid(df: DataFrame, srid: int) -> DataFrame:
    """Tag a layer with its reference system; coordinates stay as they are."""
    return df.withColumn("srid", F.lit(srid))


def same_srid(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with a check that both layers carry one and the same tag; a mismatch raises when the
    frame runs.  The right side enters as one aggregated scalar; an empty one agrees with any."""
    tag = right.agg(F.min("srid").alias("lo"), F.max("srid").alias("hi")).select(F.struct("lo", "hi")).scalar()
    agrees = (tag.getField("lo") == tag.getField("hi")) & (F.col("srid") == tag.getField("lo"))
    agrees = agrees | tag.getField("lo").isNull()  # a layer without rows or tags: nothing to check
    stop = F.raise_error(F.lit("layers carry different reference systems")).cast("int")
    return left.withColumn("srid", F.when(agrees, F.col("srid")).otherwise(stop))


def ring_edges(poly_vertex: DataFrame) -> DataFrame:
    """Consecutive vertex pairs.  An equi-join on the vertex number, so a ring of any length is
    spread over tasks."""
    nxt = poly_vertex.select(
        *RING, (F.col("vertex_no") - 1).alias("vertex_no"), F.col("x").alias("x2"), F.col("y").alias("y2")
    )
    return poly_vertex.withColumnsRenamed({"x": "x1", "y": "y1"}).join(nxt.hint("merge"), [*RING, "vertex_no"])


def _ring_moments(poly_vertex: DataFrame) -> DataFrame:
    """Area and first moments per ring about the lower left corner of its area, orientation
    removed.  The shift keeps the products small, so nothing cancels for far-off coordinates."""
    corner = poly_vertex.groupBy("geo_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    local = poly_vertex.join(corner.hint("merge"), "geo_id").select(
        *RING,
        "vertex_no",
        "x0",
        "y0",
        (F.col("x") - F.col("x0")).alias("x"),
        (F.col("y") - F.col("y0")).alias("y"),
    )
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = (
        ring_edges(local)
        .groupBy(*RING, "x0", "y0")
        .agg(
            F.sum(cross).alias("a"),
            F.sum((F.col("x1") + F.col("x2")) * cross).alias("mx"),
            F.sum((F.col("y1") + F.col("y2")) * cross).alias("my"),
        )
    )
    sign = F.signum("a")
    return sums.select(
        *RING,
        "x0",
        "y0",
        (sign * F.col("a") / 2).alias("area"),
        (sign * F.col("mx") / 6).alias("mx"),
        (sign * F.col("my") / 6).alias("my"),
    )


def centroid(poly_vertex: DataFrame) -> DataFrame:
    """Area-weighted centroid over all parts, holes subtracted: geo_id, x, y, area."""
    role = F.when(F.col("ring_no") == 0, 1.0).otherwise(-1.0)
    total = (
        _ring_moments(poly_vertex)
        .groupBy("geo_id", "x0", "y0")
        .agg(
            F.sum(role * F.col("area")).alias("area"),
            F.sum(role * F.col("mx")).alias("mx"),
            F.sum(role * F.col("my")).alias("my"),
        )
    )
    return total.select(
        "geo_id",
        (F.col("x0") + F.try_divide("mx", "area")).alias("x"),
        (F.col("y0") + F.try_divide("my", "area")).alias("y"),
        "area",
    )


def label_point(poly_vertex: DataFrame) -> DataFrame:
    """Centroid of the outer ring of the largest part (the first of equals): geo_id, x, y."""
    shells = _ring_moments(poly_vertex.filter(F.col("ring_no") == 0))
    point = F.struct(
        (F.col("x0") + F.try_divide("mx", "area")).alias("x"),
        (F.col("y0") + F.try_divide("my", "area")).alias("y"),
    )
    largest = F.max_by(point, F.struct("area", -F.col("part_no"))).alias("p")
    return shells.groupBy("geo_id").agg(largest).select("geo_id", "p.x", "p.y")


# Edges of an area for each of the lowest strips.
EDGES_PER_STRIP = 8
# Halvings of an area's height at most.
MOST_HALVINGS = 40


def _area_grid(poly_vertex: DataFrame) -> DataFrame:
    """Box of each area, the level whose cells of side 2^level just hold it, and how often its height is
    halved into strips, so that there is one lowest strip to about EDGES_PER_STRIP edges.  Landed."""
    boxes = poly_vertex.groupBy("geo_id").agg(
        F.min("x").alias("xmin"),
        F.max("x").alias("xmax"),
        F.min("y").alias("ymin"),
        F.max("y").alias("ymax"),
        F.count(F.lit(1)).alias("n"),
    )
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    level = F.when(side > 0, F.greatest(F.lit(-60.0), F.ceil(F.log2(side)).cast("double"))).otherwise(-60.0)
    halvings = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / EDGES_PER_STRIP)))
    halvings = F.when(F.col("ymax") > F.col("ymin"), F.least(F.lit(MOST_HALVINGS), halvings)).otherwise(0)
    return land(
        boxes.withColumns({"level": level.cast("int"), "halvings": halvings.cast("int")}).drop("n"), "areas"
    )


def _lowest_strip(y: str) -> Column:
    """Number of the lowest strip at height ``y``, among the nodes of the tree: the whole height is node
    1, and node i is halved into 2i and 2i + 1."""
    strips = F.pow(F.lit(2.0), F.col("halvings"))
    at = F.floor((F.col(y) - F.col("ymin")) / (F.col("ymax") - F.col("ymin")) * strips)
    at = F.least(strips - 1, F.greatest(F.lit(0.0), at.cast("double")))
    return F.when(F.col("halvings") > 0, at + strips).otherwise(1.0).cast("long")


def edges_by_strip(poly_vertex: DataFrame, areas: DataFrame) -> DataFrame:
    """Polygon edges under the few ``node`` s of their area's strip tree that tile the edge's height
    together: two of each size at most, so an area of n edges makes some n log n rows, however long they are."""
    edges = (
        ring_edges(poly_vertex)
        .withColumns({"ylo": F.least("y1", "y2"), "yhi": F.greatest("y1", "y2"), "xhi": F.greatest("x1", "x2")})
        .join(areas.select("geo_id", "ymin", "ymax", "halvings").hint("merge"), "geo_id")
        .withColumns({"_from": _lowest_strip("ylo"), "_to": _lowest_strip("yhi") + 1})
    )
    # Halved k times, the range still to tile is [first, end); an odd bound is a node of its own.
    first, end = "shiftright(_from + shiftleft(1L, k) - 1, k)", "shiftright(_to, k)"
    tiles = f"""flatten(transform(sequence(0, halvings), k -> array(
        if({first} % 2 = 1 AND {first} < {end}, {first}, NULL),
        if({end} % 2 = 1 AND {first} < {end}, {end} - 1, NULL))))"""
    return edges.withColumn("node", F.explode(F.array_compact(F.expr(tiles)))).select(
        "geo_id", "node", "x1", "y1", "x2", "y2", "ylo", "yhi", "xhi"
    )


def points_in_polygons(points: DataFrame, poly_vertex: DataFrame, point_id: str = "point_id") -> DataFrame:
    """(point, geo_id) for every point inside or on the boundary of an area.

    Points meet areas through grid cells of the area's own size, so a large area fills as few cells as a
    small one; a point looks into one cell for each size that occurs.  Then it meets only those edges
    of the area that pass its height: it looks up the path from its lowest strip to the root of the area's
    tree of halved strips, where each edge is stored once for each height.  Edges crossed to the right
    decide by parity.  Crowded cells and strips are dealt over several tasks.
    """
    areas = _area_grid(poly_vertex)
    levels = [r.level for r in areas.select("level").distinct().collect()] or [0]  # one per power of two
    size = F.pow(F.lit(2.0), F.col("level"))

    def cell(c):
        return F.floor(F.col(c) / size)

    box_cells = areas.withColumn("_cx", F.explode(F.sequence(cell("xmin"), cell("xmax")))).withColumn(
        "_cy", F.explode(F.sequence(cell("ymin"), cell("ymax")))
    )
    placed = (
        points.select(F.col(point_id), F.col("x").alias("px"), F.col("y").alias("py"))
        .withColumn("level", F.explode(F.array(*[F.lit(level) for level in levels])))
        .withColumns({"_cx": cell("px"), "_cy": cell("py")})
    )
    path = F.expr("transform(sequence(0, halvings), k -> shiftright(_strip, k))")
    candidates = land(
        salted_join(placed, box_cells, ["level", "_cx", "_cy"])
        .filter(F.col("px").between(F.col("xmin"), F.col("xmax")))
        .filter(F.col("py").between(F.col("ymin"), F.col("ymax")))
        .withColumn("_strip", _lowest_strip("py"))
        .select(point_id, "px", "py", "geo_id", F.explode(path).alias("node")),
        "candidates",
    )
    met = salted_join(candidates, edges_by_strip(poly_vertex, areas), ["geo_id", "node"]).filter(
        (F.col("xhi") >= F.col("px")) & F.col("py").between(F.col("ylo"), F.col("yhi"))
    )
    side = (F.col("x2") - F.col("x1")) * (F.col("py") - F.col("y1")) - (F.col("px") - F.col("x1")) * (
        F.col("y2") - F.col("y1")
    )
    straddles = (F.col("y1") > F.col("py")) != (F.col("y2") > F.col("py"))
    crossed = straddles & F.when(F.col("y2") > F.col("y1"), side > 0).otherwise(side < 0)
    on_edge = (side == 0) & F.col("px").between(F.least("x1", "x2"), F.col("xhi"))
    verdict = met.groupBy(point_id, "geo_id").agg(
        F.count_if(crossed).alias("n"), F.bool_or(on_edge).alias("edge")
    )
    return verdict.filter((F.col("n") % 2 == 1) | F.col("edge")).select(point_id, "geo_id")


def contiguity(poly_vertex: DataFrame, snap: float = 0.0) -> DataFrame:
    """Directed edges (src, dst) between areas sharing a boundary vertex, within ``snap``."""
    corners = land(poly_vertex.select("geo_id", "x", "y").distinct(), "corners")
    if snap > 0:
        pairs = near_pairs(corners, corners, snap)
    else:
        pairs = salted_join(corners, corners.withColumnRenamed("geo_id", "geo_id_2"), ["x", "y"])
    return (
        pairs.filter(F.col("geo_id") != F.col("geo_id_2"))
        .select(F.col("geo_id").alias("src"), F.col("geo_id_2").alias("dst"))
        .distinct()
    )
