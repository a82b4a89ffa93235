"""Exact order statistics for groups of any size, by one path.

Equal values of a group become one row with a count.  These rows are dealt over range partitions of
(group, value), whose number follows the session's shuffle partitions and not the group, so a large group
is spread over many tasks and a repeated value is one row.  Positions are running counts inside a range,
offset by the counts of the group's earlier ranges.  Every exact answer comes from these positions: no
sketch, no size switch.  The positions are landed when the function is called.

``approx_group_quantiles`` is the one function beside that path, for callers that ask for it: a mergeable
sketch per group, whose rank error is bounded by a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areaindex.operators.joins import natural_left_join
from areaindex.operators.pairs import lookup_join
from areaindex.sources.landing import land

# Parts over which the missing values of a frame are dealt when ranks are joined back.
NULL_PARTS = 1024


def _number(c: str) -> Column:
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value)


def _long(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    values = df.select(*by, *[_number(c).alias(c) for c in cols])
    if len(cols) == 1:
        long = values.select(*by, F.lit(cols[0]).alias("_m"), F.col(cols[0]).alias("_v"))
    else:
        long = values.unpivot(list(by), list(cols), "_m", "_v")
    return long.filter(F.col("_v").isNotNull())


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    h = (n - 1) * F.lit(float(p))
    return F.floor(h) + 1, F.ceil(h) + 1, h - F.floor(h)


def _positions(long: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Distinct values per key with _c, how many rows hold the value, _upto, how many hold it or a
    smaller one, and _n, how many values the key has."""
    counts = long.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = [*keys, "_v"]
    dealt = counts.repartitionByRange(ranges, *order) if ranges else counts.repartitionByRange(*order)
    ranged = land(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    # A row per key and range: as many rows as there are keys and range partitions.
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("_c").alias("_in_range"))
        .select(
            *keys,
            "_range",
            F.coalesce(F.sum("_in_range").over(before), F.lit(0)).alias("_offset"),
            F.sum("_in_range").over(W.partitionBy(*keys)).alias("_n"),
        )
    )
    within = W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    running = ranged.withColumn("_upto", F.sum("_c").over(within))
    placed = natural_left_join(running, totals, [*keys, "_range"], strategy=None)
    return placed.select(*keys, "_v", "_c", (F.col("_offset") + F.col("_upto")).alias("_upto"), "_n")


def _quantiles(
    long: DataFrame, keys: Sequence[str], probs: Sequence[float], ranges: int | None = None
) -> DataFrame:
    """One row per key with columns _q0, _q1, ... in the order of ``probs``."""
    return _picked(_positions(long, keys, ranges), keys, probs)


def _picked(placed: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    picks = []
    for i, p in enumerate(probs):
        lo, hi, _ = _ranks(F.col("_n"), p)
        for side, rank in (("lo", lo), ("hi", hi)):
            hit = (F.col("_upto") - F.col("_c") < rank) & (F.col("_upto") >= rank)
            picks.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    picked = placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for i, p in enumerate(probs):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((lo + (hi - lo) * _ranks(F.col("_n"), p)[2]).alias(f"_q{i}"))
    return picked.select(*keys, *out)


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    probs: Sequence[float],
    ranges: int | None = None,
) -> DataFrame:
    """Exact quantiles (linear interpolation) skipping missing values, long form: by, measure,
    q0, q1, ...  A (group, measure) without values has no row.  ``ranges`` sets the number of range
    partitions; results don't depend on it."""
    out = _quantiles(_long(df, by, cols), [*by, "_m"], probs, ranges)
    return out.withColumnsRenamed({"_m": "measure", **{f"_q{i}": f"q{i}" for i in range(len(probs))}})


def approx_group_quantiles(
    df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: Sequence[float], error: float = 0.001
) -> DataFrame:
    """``group_quantiles`` by a mergeable sketch per group and column: by, measure, q0, q1, ...

    Each answer is a value of the group whose rank is off by at most ``error`` times the group's number of
    values.  One shuffle of sketches of some 1 / ``error`` entries, which map-side merging makes as many as
    there are groups and tasks; nothing is landed and no row is sorted.  Missing values are skipped, a
    (group, measure) without values has no row; values are not interpolated."""
    if not 0 < error <= 1:
        raise ValueError("error is a share of the rows, above 0 and at most 1")
    ps = F.array(*[F.lit(float(p)) for p in probs])
    sketched = (
        _long(df, by, cols)
        .groupBy(*by, F.col("_m").alias("measure"))
        .agg(F.percentile_approx("_v", ps, math.ceil(1 / error)).alias("_qs"))
    )
    return sketched.select(*by, "measure", *[F.col("_qs")[i].alias(f"q{i}") for i in range(len(probs))])


def group_medians(
    df: DataFrame, by: Sequence[str], outputs: dict[str, str], ranges: int | None = None
) -> DataFrame:
    """One row per group that has any value, ``{output name: column}``, all columns in one pass."""
    cols = list(dict.fromkeys(outputs.values()))
    return _median_columns(_positions(_long(df, by, cols), [*by, "_m"], ranges), by, outputs)


def _median_columns(placed: DataFrame, by: Sequence[str], outputs: dict[str, str]) -> DataFrame:
    exact = _picked(placed, [*by, "_m"], [0.5])
    return exact.groupBy(*by).agg(
        *[F.max(F.when(F.col("_m") == c, F.col("_q0"))).alias(name) for name, c in outputs.items()]
    )


def rank_share(df: DataFrame, by: str, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """Ascending rank (ties share their average) over the group's row count, missing values counted
    in the denominator and themselves unranked.

    Ranks are joined back on (group, value): a value that many rows share is dealt over tasks, and
    missing values are spread, as they meet no rank."""
    rows = df.select(F.col(by).alias("_g"), _number(value).alias("_v"))
    placed = _positions(rows.filter(F.col("_v").isNotNull()), ["_g"], ranges)
    return _with_ranks(df, placed, by, value, name)


def with_medians_and_rank(
    df: DataFrame,
    by: str,
    outputs: dict[str, str],
    ranked: str,
    name: str,
    ranges: int | None = None,
) -> DataFrame:
    """``rank_share`` of ``ranked`` and the group medians ``outputs``, written back on every row, from one
    positions table of all columns."""
    cols = list(dict.fromkeys([*outputs.values(), ranked]))
    placed = _positions(_long(df, [by], cols), [by, "_m"], ranges)
    own = placed.filter(F.col("_m") == ranked).withColumnRenamed(by, "_g").drop("_m")
    medians = _median_columns(placed.filter(F.col("_m").isin(*outputs.values())), [by], outputs)
    return lookup_join(_with_ranks(df, own, by, ranked, name), medians, [by])


def _with_ranks(df: DataFrame, placed: DataFrame, by: str, value: str, name: str) -> DataFrame:
    sizes = df.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("_size"))
    average = F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / F.lit(2.0)
    ranks = natural_left_join(placed, sizes, ["_g"], strategy=None).select(
        F.col("_g").alias(by),
        F.col("_v").alias("_rank_key"),
        F.lit(0).cast("long").alias("_spread"),
        (average / F.col("_size")).alias(name),
    )
    # By content, so that a task that runs again deals its rows as before.
    spread = F.when(
        F.col("_rank_key").isNull(), F.pmod(F.xxhash64(*df.columns), F.lit(NULL_PARTS)) + 1
    ).otherwise(F.lit(0).cast("long"))
    keyed = df.withColumn("_rank_key", _number(value)).withColumn("_spread", spread)
    return lookup_join(keyed, ranks, [by, "_rank_key", "_spread"]).drop("_rank_key", "_spread")
