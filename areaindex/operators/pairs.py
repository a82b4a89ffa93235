"""Equi-joins that meet many rows per key: hot keys are found first and split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.operators.joins import natural_left_join
from areaindex.sources.landing import land

# Rows of one key and side that one task may hold.
CHUNK = 20_000
# The same where each left row meets a single right row.
LOOKUP_CHUNK = 1_000_000
# Group tables of up to this many cells (rows times columns) are broadcast, some 16 MB.
BROADCAST_CELLS = 500_000


def key_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key on both sides, ``_left`` and ``_right``, in one pass over each."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = left.select(*keys, one.alias("_left"), none.alias("_right")).unionByName(
        right.select(*keys, none.alias("_left"), one.alias("_right"))
    )
    return sides.groupBy(*keys).agg(F.sum("_left").alias("_left"), F.sum("_right").alias("_right"))


def pair_count(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> int:
    """Pairs that an inner join on ``keys`` lists, from the counts of the keys alone."""
    counts = key_counts(left, right, keys).dropna(subset=list(keys))
    pairs = F.sum(F.col("_left").cast("decimal(38,0)") * F.col("_right"))
    return int(counts.agg(pairs).first()[0] or 0)


def _deal(left: DataFrame, right: DataFrame, keys: Sequence[str], chunk: int, both: bool = False):
    """Both sides with ``_block`` and ``_block_2``, or None where no key has more than ``chunk`` rows on the
    left, or with ``both`` on a side.  A hot key's rows are dealt over ``rows / chunk`` blocks, and copied
    to each block of the other side, so a task holds one block of each and every pair meets once."""
    if both:
        counts = key_counts(left, right, keys)
    else:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_left")).withColumn("_right", F.lit(1))

    def blocks(c):
        return F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(chunk)).cast("int"))

    hot = counts.filter((F.col("_left") > chunk) | (F.col("_right") > chunk)).select(
        *keys, blocks("_left").alias("_blocks"), blocks("_right").alias("_blocks_2")
    )
    most = hot.agg(F.max("_blocks"), F.max("_blocks_2")).first()
    if most[0] is None:
        return None
    hot = land(hot, "hot-keys")

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        # By a number that is landed with the row, not by its content, as equal rows are dealt out too, nor by
        # its place in a plan, which another run of the same task need not find again.
        if most[own == "_block_2"] > 1:
            side = land(side.withColumn("_number", F.monotonically_increasing_id()), "dealt")
        else:
            side = side.withColumn("_number", F.lit(0).cast("long"))
        many, others = (F.coalesce(c.replace("_block", "_blocks"), F.lit(1)) for c in (own, other))
        return (
            natural_left_join(side, hot, keys, "broadcast")  # one key for each ``chunk`` rows at most
            .withColumn(own, F.pmod(F.xxhash64("_number"), many).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), others - 1)))
            .drop("_number", "_blocks", "_blocks_2")
        )

    return dealt(left, "_block", "_block_2"), dealt(right, "_block_2", "_block")


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], chunk: int = CHUNK, both: bool = False
) -> DataFrame:
    """Inner join on ``keys``, the left rows of hot keys split, with ``both`` the right rows too, which costs a
    count of them; without a hot key a plain join.  No pair is lost either way."""
    sides = _deal(left, right, keys, chunk, both)
    if sides is None:
        return left.join(right.hint("merge"), list(keys))
    return sides[0].join(sides[1].hint("merge"), [*keys, "_block", "_block_2"]).drop("_block", "_block_2")


def join_strategy(stats: DataFrame, broadcast_cells: int = BROADCAST_CELLS) -> str:
    """How rows meet the landed ``stats``, by its cells as counted: the size of its files says little, as they
    are compressed."""
    return "broadcast" if stats.count() * len(stats.columns) <= broadcast_cells else "merge"


def lookup_join(
    left: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    broadcast_cells: int = BROADCAST_CELLS,
    chunk: int = LOOKUP_CHUNK,
) -> DataFrame:
    """Natural left join to a table with one row per group, for groups of any size.

    The group table is landed and counted.  A small one is broadcast, so the rows are not shuffled;
    for a larger one the hot groups are split.
    """
    stats = land(groups, "groups")
    if join_strategy(stats, broadcast_cells) == "broadcast":
        return natural_left_join(left, stats, on, "broadcast")
    sides = _deal(left, stats, on, chunk)
    if sides is None:
        return natural_left_join(left, stats, on)
    return natural_left_join(sides[0], sides[1], [*on, "_block", "_block_2"]).drop("_block", "_block_2")


def _cells(left: DataFrame, right: DataFrame, radius: float):
    """Both sides with the grid cells in which partners within ``radius`` meet."""
    size = F.lit(float(radius))
    home = {"_cx": "x", "_cy": "y"}
    for cell, c in home.items():
        at = F.floor(F.col(c) / size)
        left = left.withColumn(cell, at)
        right = right.withColumn(cell, F.explode(F.sequence(at - 1, at + 1)))
    return left, right


def near_pairs_bound(left: DataFrame, right: DataFrame, radius: float) -> int:
    """How many pairs ``near_pairs`` looks at, from the counts of the cells: no pair is listed for it, and
    no more than these lie within the radius."""
    return pair_count(*_cells(left.select("x", "y"), right.select("x", "y"), radius), ["_cx", "_cy"])


def near_pairs(left: DataFrame, right: DataFrame, radius: float, chunk: int = CHUNK) -> DataFrame:
    """Row pairs with planar distance at most ``radius``: all left columns, all right columns with
    the suffix ``_2``, and ``dist``.  Cells have the radius as side, so partners lie in the 3 x 3
    cells around a row, to which the right rows are copied.  A crowded cell is split into blocks of left
    by blocks of right rows."""
    one, two = _cells(left, right, radius)
    two = two.withColumnsRenamed({c: f"{c}_2" for c in right.columns})
    keys = ["_cx", "_cy"]
    joined = salted_join(one, two, keys, chunk, both=True)
    dx, dy = F.col("x") - F.col("x_2"), F.col("y") - F.col("y_2")
    return joined.drop(*keys).withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= float(radius))
