"""Join operators.  Tables that grow with the areas meet by sort-merge, with AQE skew splitting, which is
asked for by a hint: Catalyst takes a landed table for as small as its compressed files and would send
millions of rows through the driver.  Only tables that were counted are broadcast.  ``operators.pairs`` has the
joins that count, and that look for hot keys themselves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.operators.columns import ids


def natural_left_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] | None = None, strategy: str | None = "merge"
) -> DataFrame:
    """Left join on all shared columns (or ``on``); a missing key matches a missing key.  ``strategy``
    "broadcast" is for a right side that is known to be small, None leaves the choice to Catalyst, for
    tables of a row per group."""
    keys = [c for c in left.columns if c in right.columns] if on is None else list(on)
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    if strategy is not None:
        renamed = renamed.hint(strategy)
    return left.join(renamed, cond, "left").drop(*[f"_right_{k}" for k in keys])


def left_join(
    left: DataFrame, right: DataFrame, on: str | Sequence[str], suffix: tuple[str, str] = ("_x", "_y")
) -> DataFrame:
    """Left join on named keys; other columns present on both sides get the suffixes."""
    keys = [on] if isinstance(on, str) else list(on)
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    return left.withColumnsRenamed({c: c + suffix[0] for c in clash}).join(
        right.withColumnsRenamed({c: c + suffix[1] for c in clash}).hint("merge"), keys, "left"
    )


def reduce_left_join(frames: Sequence[DataFrame], on: Sequence[str] | None = None) -> DataFrame:
    return reduce(lambda a, b: natural_left_join(a, b, on), frames)


def flag_in(
    df: DataFrame, members: DataFrame, on: str, name: str, if_in: int = 1, if_out: int = 0
) -> DataFrame:
    """Membership flag: ``if_in`` where the id occurs in ``members``, else ``if_out``."""
    marks = ids(members, on).withColumn(name, F.lit(if_in))
    return df.join(marks.hint("merge"), on, "left").withColumn(name, F.coalesce(name, F.lit(if_out)))


def union_layers(layers: dict[str, DataFrame]) -> DataFrame:
    """Stack frames of the same columns under a ``layer`` name."""
    named = [df.withColumn("layer", F.lit(name)) for name, df in layers.items()]
    return reduce(lambda a, b: a.unionByName(b), named)
