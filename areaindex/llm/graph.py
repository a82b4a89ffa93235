"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import join_small, land


def components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): node and ``component``, the smallest id it is linked to over any
    number of steps.  Each round hangs every node on its smallest neighbour, shortens the paths by
    pointer jumping and contracts the links to roots, so rounds grow with the logarithm of the longest
    chain.  All of it is joins and map-side combined aggregates, broadcast only where a count
    allows it; a hub is only a repeated join key of the larger side.  Links to itself or with a null end are ignored."""
    ends = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = land(ends.filter("hi > lo").distinct(), "edges")
    labels = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        hooks = land(edges.groupBy("hi").agg(F.min("lo").alias("parent")), "hooks")
        moved = True
        while moved:
            above = hooks.select(F.col("hi").alias("parent"), F.col("parent").alias("grand"))
            for _ in range(2):  # two jumps a job: paths are a third as long
                hooks = join_small(hooks.select("hi", "parent"), above, ["parent"], "left")
                hooks = hooks.select("hi", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))
            hooks = land(hooks, "hooks")
            moved = not hooks.filter("moved").isEmpty()
        root = hooks.select(F.col("hi").alias("component"), "parent")
        labels = join_small(labels, root, ["component"], "left").select("node", F.coalesce("parent", "component").alias("component"))
        for end in ("hi", "lo"):
            named = hooks.select(F.col("hi").alias(end), "parent")
            edges = join_small(edges, named, [end], "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        edges = land(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).filter("hi > lo").distinct(), "edges")
    return land(labels, "labels")
