"""Polygon layers as GeoJSON lines (one feature per line) <-> attribute table + vertex table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RING = "array<array<double>>"
POLYGON = f"array<{RING}>"
MULTIPOLYGON = f"array<{POLYGON}>"


def read_polygons(
    spark: SparkSession, path: str, properties: T.StructType, id_field: str = "geo_id"
) -> tuple[DataFrame, DataFrame]:
    """(attributes, vertices) of a layer of Polygon and MultiPolygon features."""
    schema = T.StructType(
        [
            T.StructField("properties", properties),
            T.StructField(
                "geometry",
                T.StructType(
                    [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
                ),
            ),
        ]
    )
    raw = spark.read.schema(schema).json(path)
    attributes = raw.select("properties.*")
    text = F.col("geometry.coordinates")
    parts = F.when(
        F.col("geometry.type") == "Polygon", F.array(F.from_json(text, POLYGON))
    ).otherwise(F.from_json(text, MULTIPOLYGON))
    vertices = (
        raw.select(F.col(f"properties.{id_field}").alias("geo_id"), parts.alias("parts"))
        .select("geo_id", F.posexplode("parts").alias("part_no", "rings"))
        .select("geo_id", "part_no", F.posexplode("rings").alias("ring_no", "ring"))
        .select("geo_id", "part_no", "ring_no", F.posexplode("ring").alias("vertex_no", "xy"))
        .select(
            "geo_id",
            "part_no",
            "ring_no",
            "vertex_no",
            F.col("xy")[0].alias("x"),
            F.col("xy")[1].alias("y"),
        )
    )
    return attributes, vertices


def _ordered(order: str, item: str) -> F.Column:
    pairs = F.array_sort(F.collect_list(F.struct(order, item)))
    return F.transform(pairs, lambda p: p.getField(item))


def feature_lines(df: DataFrame, poly_vertex: DataFrame, geo_id: str = "geo_id") -> DataFrame:
    """One JSON feature text per row of ``df``; every column but the id stays beside it, and all
    columns become properties; an area without vertices has a null geometry.  A feature is one value by its format, so its vertices meet in one
    row; areas are spread over tasks by id, and one shuffle serves all three nesting levels."""
    rings = (
        poly_vertex.repartition("geo_id")
        .withColumn("xy", F.array("x", "y"))
        .groupBy("geo_id", "part_no", "ring_no")
        .agg(_ordered("vertex_no", "xy").alias("ring"))
    )
    parts = rings.groupBy("geo_id", "part_no").agg(_ordered("ring_no", "ring").alias("part"))
    shapes = parts.groupBy("geo_id").agg(_ordered("part_no", "part").alias("coordinates"))
    joined = df.join(shapes.withColumnRenamed("geo_id", geo_id).hint("merge"), geo_id, "left")
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates"))
    feature = F.to_json(
        F.struct(
            F.lit("Feature").alias("type"),
            F.struct(*df.columns).alias("properties"),
            F.when(F.col("coordinates").isNotNull(), shape).alias("geometry"),
        ),
        {"ignoreNullFields": "false"},
    )
    return joined.select(*df.columns, feature.alias("feature"))


def write_features(df: DataFrame, poly_vertex: DataFrame, path: str, geo_id: str = "geo_id") -> None:
    feature_lines(df, poly_vertex, geo_id).select("feature").write.mode("overwrite").text(path)
