"""Neighbour graphs over points and spatial lags over edges (src, dst, ...)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from areaindex.functions.expr import idw, proportional_change
from areaindex.operators.pairs import lookup_join, near_pairs, near_pairs_bound, salted_join
from areaindex.sources.landing import land

# Places that a leaf of the quadtree holds at most.
LEAF_PLACES = 16
# The finest level: cells of the extent over 2^40, whose numbers doubles still tell apart.
FINEST = 40
# Of a cell's side, what counts as near: partners that near are in the 3 x 3 cells around, rounding included.
REACH = 0.99
# For so few items a group, a maximum for each place in the order is cheaper than a list.
FEW_LOWEST = 8
# So few open places may look far at once: each meets at most all places.
FEW_OPEN = 1000


def _lowest(df: DataFrame, by: Sequence[str], item: str, k: int, name: str) -> DataFrame:
    """The k lowest items per group as a sorted array; groups shrink to k rows before the shuffle."""
    if k == 1:
        return df.groupBy(*by).agg(F.array(F.min(item)).alias(name))
    order = F.row_number().over(W.partitionBy(*by).orderBy(item))
    lowest = df.withColumn("_order", order).filter(F.col("_order") <= k).groupBy(*by)
    if k <= FEW_LOWEST and not isinstance(df.schema[item].dataType, StructType):
        # Numbers and dates aggregate in a hash table, lists in objects that are sorted beyond a few groups.
        placed = [F.max(F.when(F.col("_order") == i, F.col(item))) for i in range(1, k + 1)]
        return lowest.agg(F.array_compact(F.array(*placed)).alias(name))
    return lowest.agg(F.array_sort(F.collect_list(item)).alias(name))


class Quadtree:
    """Cells over the box of some places: those of level t have the side extent / 2^t, so each cell of a
    level has four halves on the next."""

    def __init__(self, places: DataFrame):
        self.box = places.agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("xmin"),
            F.max("x").alias("xmax"),
            F.min("y").alias("ymin"),
            F.max("y").alias("ymax"),
        ).first()
        self.extent = max(self.box.xmax - self.box.xmin, self.box.ymax - self.box.ymin) if self.box.n else 0.0
        self.start = min(FINEST, max(0, math.ceil(math.log2(max(1.0, self.box.n / LEAF_PLACES)) / 2) + 1))
        #: No cell of the start level is crowded, so all leaves are cells of that level.
        self.even = False

    def cell(self, axis: str, level: Column) -> Column:
        low = self.box[f"{axis}min"]
        return F.floor((F.col(axis) - F.lit(low)) * F.pow(F.lit(2.0), level) / F.lit(self.extent))

    def side(self, level: Column) -> Column:
        return F.lit(self.extent) / F.pow(F.lit(2.0), level)

    def leaves(self, places: DataFrame) -> DataFrame:
        """The places with the ``level`` of their leaf, the cell where splitting ends as it holds few
        enough.  A crowded cell is split at once to the level that its own count and its own box of places
        ask for, so a dense cluster takes a round more, however small it is, and sparse parts keep
        large cells.  ``places`` are landed."""
        open_places, done = places.withColumn("level", F.lit(self.start)), []
        keys = ["level", "_cx", "_cy"]
        while True:
            placed = open_places.withColumns({f"_c{c}": self.cell(c, F.col("level")) for c in "xy"})
            spread = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
            cells = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), spread.alias("_spread"))
            side = F.col("_spread") / F.sqrt(F.col("_n") / F.lit(float(LEAF_PLACES)))
            finer = F.floor(F.log2(F.lit(self.extent) / side)).cast("int") + 1
            finer = F.least(F.lit(FINEST), F.greatest(F.col("level") + 1, finer))
            crowded = cells.filter((F.col("_n") > LEAF_PLACES) & (F.col("level") < FINEST))
            if crowded.isEmpty():
                break
            state = land(lookup_join(placed, crowded.select(*keys, finer.alias("_finer")), keys).drop("_cx", "_cy"), "split")
            done.append(state.filter("_finer IS NULL").drop("_finer"))
            open_places = state.filter("_finer IS NOT NULL").withColumn("level", F.col("_finer")).drop("_finer")
        self.even = not done
        return open_places if self.even else land(reduce(DataFrame.unionByName, done, open_places), "leaves")

    def near(self, left: DataFrame, right: DataFrame, first: bool) -> DataFrame:
        """Pairs of left rows, which have a ``level``, with the right rows within reach: REACH of a cell of
        that level.  The right rows stand once under each level in use; where leaves differ, or above them, a
        cell may be crowded and is split.  In the ``first`` round left rows have their leaves' levels."""
        levels = [self.start]
        if not first or not self.even:
            levels = [r.level for r in left.select("level").distinct().collect()]  # at most one for each doubling
        around = left
        for c in "xy":
            at = self.cell(c, F.col("level"))
            around = around.withColumn(f"_c{c}", F.explode(F.sequence(at - 1, at + 1)))
        placed = right.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
        placed = placed.withColumns({f"_c{c}": self.cell(c, F.col("level")) for c in "xy"})
        keys = ["level", "_cx", "_cy"]
        placed = placed.withColumnsRenamed({c: f"{c}_2" for c in right.columns})
        plain = first and self.even
        met = around.join(placed.hint("merge"), keys) if plain else salted_join(around, placed, keys, both=True)
        dx, dy = F.col("x") - F.col("x_2"), F.col("y") - F.col("y_2")
        met = met.withColumn("dist", F.sqrt(dx * dx + dy * dy))
        return met.filter(F.col("dist") <= REACH * self.side(F.col("level"))).drop("_cx", "_cy")


def knn(points: DataFrame, k: int = 1, point_id: str = "geo_id") -> DataFrame:
    """Edges (src, dst, dist) to the k nearest other points, ties by id.

    Works on distinct places, so a stack of coincident points never pairs with itself.  Each place
    starts with the cells of its own quadtree leaf's size and is settled once enough partners lie within reach,
    since everything that near is in the 3 x 3 cells around it; the others go up to the parent cell.  A
    place is looked at by the few places of the leaves beside it on each level, and places that go on are far
    from each other, so the candidates of a round stay linear in the number of points.
    """
    ids = points.select(F.col(point_id).alias("id"), "x", "y")
    places = land(
        _lowest(ids, ["x", "y"], "id", k + 1, "ids").withColumn("need", F.lit(k + 1) - F.size("ids")),
        "places",
    )
    tree = Quadtree(places)
    right = places.select("x", "y", F.slice("ids", 1, k).alias("ids"))
    rounds = []
    open_places, left, step = None, 0, 1
    if tree.extent > 0:
        open_places = tree.leaves(places.select("x", "y", "need")).filter(F.col("need") > 0)
        left = open_places.count()
    while left:
        found = (
            tree.near(open_places, right, first=not rounds)
            .filter(F.col("dist") > 0)
            .select("x", "y", "dist", F.explode("ids_2").alias("id"))
            .select("x", "y", F.struct("dist", "id").alias("near"))
        )
        state = land(
            open_places.join(_lowest(found, ["x", "y"], "near", k, "others").hint("merge"), ["x", "y"], "left"),
            "nearest",
        )
        # Beyond twice the extent there is nothing left to find.
        settled = (F.coalesce(F.size("others"), F.lit(0)) >= F.col("need")) | (F.col("level") < -1)
        rounds.append(state.filter(settled).drop("level"))
        open_places = state.filter(~settled).drop("others")
        before, left = left, open_places.count()
        # Nothing near: the empty sizes between are skipped.
        step = 2 * step if left == before and left <= FEW_OPEN else 1
        open_places = open_places.withColumn("level", F.greatest(F.col("level") - step, F.lit(-2)))

    # Places meet their partners first, so that points, of which many may share a place, join once.
    none = F.array().cast(f"array<struct<dist:double,id:{dict(ids.dtypes)['id']}>>")
    known = places.select("x", "y", "ids")
    if rounds:
        partners = reduce(DataFrame.unionByName, rounds).select("x", "y", "others")
        known = known.join(partners.hint("merge"), ["x", "y"], "left").withColumn("others", F.coalesce("others", none))
    else:
        known = known.withColumn("others", none)
    out = ids.join(land(known, "partners").hint("merge"), ["x", "y"])
    stacked = F.transform(
        F.filter("ids", lambda i: i != F.col("id")),
        lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("id")),
    )
    nearest = F.slice(F.array_sort(F.concat(stacked, F.col("others"))), 1, k)
    return out.select(F.col("id").alias("src"), F.explode(nearest).alias("e")).select(
        "src", F.col("e.id").alias("dst"), "e.dist"
    )


def band_width(knn_edges: DataFrame, factor: float = 0.1) -> DataFrame:
    """One row: the factor times the largest nearest-neighbour distance."""
    return knn_edges.agg(F.max("dist").alias("max_nn")).select(
        "max_nn", (F.col("max_nn") * F.lit(factor)).alias("d2")
    )


def band_limit(points: DataFrame, factor: float = 0.1, point_id: str = "geo_id") -> float:
    """``band_width`` as a number, 0 where there are no two points."""
    return band_width(knn(points, 1, point_id), factor).first().d2 or 0.0


def _place_pairs(points: DataFrame, d2: float) -> DataFrame:
    places = land(points.select("x", "y").distinct(), "places")
    if not d2 > 0:
        return near_pairs(places, places, 1.0).filter(F.lit(False))
    return near_pairs(places, places, d2).filter(F.col("dist") > 0)


def band_pairs_bound(points: DataFrame, d2: float) -> int:
    """The most pairs of distinct places that a band can have, counted before any is listed."""
    places = land(points.select("x", "y").distinct(), "places")
    return near_pairs_bound(places, places, d2) if d2 > 0 else 0


def distance_band(points: DataFrame, d2: float, point_id: str = "geo_id") -> DataFrame:
    """Edges (src, dst, dist) with 0 < dist <= d2.  Distinct places are paired, then named."""
    ids = points.select(F.col(point_id).alias("src"), "x", "y")
    named = ids.withColumnsRenamed({"src": "dst", "x": "x_2", "y": "y_2"})
    return (
        _place_pairs(points, d2)
        .join(ids.hint("merge"), ["x", "y"])
        .join(named.hint("merge"), ["x_2", "y_2"])
        .select("src", "dst", "dist")
    )


def idw_weights(edges: DataFrame, power: int = 2) -> DataFrame:
    """Inverse-distance weights, row-standardised."""
    return row_standardise(edges.withColumn("w", idw("dist", power)))


def row_standardise(edges: DataFrame) -> DataFrame:
    """Weights summing to 1 per source; without a ``w`` column all neighbours weigh the same.  Totals
    are aggregated and joined back, a hub's edges dealt over several tasks; the edges are landed for
    the passes this takes."""
    weighted = land(edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0)), "edges")
    totals = weighted.groupBy("src").agg(F.sum("w").alias("_total"))
    joined = salted_join(weighted, totals, ["src"])
    return joined.withColumn("w", F.try_divide("w", "_total")).drop("_total")


def _lag_columns(cols: Sequence[str], zero_policy: bool, on_null: str) -> dict:
    out = {}
    for c in cols:
        missing = F.col(f"_nulls_{c}") > 0
        gone = F.lit(None)
        if on_null == "error":
            gone = F.raise_error(F.lit(f"missing value in the lag of {c}"))
        value = F.when(missing, gone.cast("double")).otherwise(F.try_divide(f"_sum_{c}", "_weight"))
        isolated = F.lit(0.0) if zero_policy else F.lit(None).cast("double")
        out[f"{c}_lag"] = F.when(F.col("_weight").isNull(), isolated).otherwise(value)
    return out


def spatial_lag(
    areas: DataFrame,
    edges: DataFrame,
    cols: Sequence[str],
    area_id: str = "geo_id",
    zero_policy: bool = True,
    on_null: str = "null",
    default: float | None = None,
) -> DataFrame:
    """Weighted mean over neighbours for all columns in one pass, as ``<col>_lag``.  An area without
    neighbours gets 0 (missing without ``zero_policy``); a missing neighbour value, also of a neighbour
    that has no row, is ``default``, and without one makes the lag missing, or raises with
    ``on_null="error"``."""
    weighted = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1.0))
    values = areas.select(F.col(area_id).alias("dst"), *cols)
    met = lookup_join(weighted.select("src", "dst", "w"), values, ["dst"])
    if default is not None:
        met = met.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in cols})
    sums = (
        met.groupBy("src")
        .agg(
            F.sum("w").alias("_weight"),
            *[F.sum(F.col("w") * F.col(c)).alias(f"_sum_{c}") for c in cols],
            *[F.count_if(F.col(c).isNull()).alias(f"_nulls_{c}") for c in cols],
        )
        .withColumnRenamed("src", area_id)
    )
    return _with_lags(areas, sums, [area_id], cols, zero_policy, on_null)


def _with_lags(areas, sums, on, cols, zero_policy, on_null) -> DataFrame:
    out = areas.join(sums.hint("merge"), on, "left").withColumns(_lag_columns(cols, zero_policy, on_null))
    return out.drop("_weight", *[f"_{part}_{c}" for part in ("sum", "nulls") for c in cols])


def band_lag(
    areas: DataFrame,
    d2: float,
    cols: Sequence[str],
    power: int = 2,
    zero_policy: bool = True,
    on_null: str = "null",
) -> DataFrame:
    """Inverse-distance lag over the distance band for areas with coordinates x, y: the result of
    ``spatial_lag`` over ``idw_weights(distance_band(...))`` without listing pairs of areas.  Values
    are summed per place first, so coincident areas cost one pair, and the weights are never
    stored; the sums per place are landed, so that a crowded place can be split when areas join."""
    places = land(
        areas.groupBy("x", "y").agg(
            F.count(F.lit(1)).cast("double").alias("n"),
            *[F.sum(c).alias(f"sum_{c}") for c in cols],
            *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in cols],
        ),
        "places",
    )
    pairs = _place_value_pairs(places, d2).withColumn("w", idw("dist", power))
    sums = pairs.groupBy("x", "y").agg(
        F.sum(F.col("w") * F.col("n_2")).alias("_weight"),
        *[F.sum(F.col("w") * F.col(f"sum_{c}_2")).alias(f"_sum_{c}") for c in cols],
        *[F.sum(f"nulls_{c}_2").alias(f"_nulls_{c}") for c in cols],
    )
    return _with_lags(areas, land(sums, "lags"), ["x", "y"], cols, zero_policy, on_null)


def _place_value_pairs(places: DataFrame, d2: float) -> DataFrame:
    left = places.select("x", "y")
    if not d2 > 0:
        return near_pairs(left, places, 1.0).filter(F.lit(False))
    return near_pairs(left, places, d2).filter(F.col("dist") > 0)


def neighbour_share(areas: DataFrame, edges: DataFrame, flag: str, area_id: str = "geo_id") -> DataFrame:
    """Share of an area's neighbours carrying a 0/1 flag, as ``<flag>_lag``.  A neighbour without a row
    or value counts as one without the flag."""
    return spatial_lag(areas, edges.select("src", "dst"), [flag], area_id, default=0.0)


def lag_change(df: DataFrame, new: str, old: str, name: str) -> DataFrame:
    """Proportional change between the lags of two vintages."""
    return df.withColumn(name, proportional_change(f"{new}_lag", f"{old}_lag"))
