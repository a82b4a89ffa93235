"""Aggregations and group-relative operators.

Group results are aggregated once (map-side combined), landed, and joined back on the group key: no
window runs over a whole group, and the rows are not shuffled to meet a small group table.  Calls
that write group results back therefore run a job; land a frame that is costly to evaluate first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions.expr import above, row_sum0, share, sum0
from areaindex.operators.order_stats import group_medians, group_quantiles
from areaindex.operators.pairs import lookup_join


def attach_group(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Write group-level columns back on every row; a missing group key is a group of its own."""
    return lookup_join(df, stats, by)


def group_sums(df: DataFrame, by: Sequence[str], outputs: dict[str, str]) -> DataFrame:
    return df.groupBy(*by).agg(*[sum0(c).alias(name) for name, c in outputs.items()])


def with_group_sum(df: DataFrame, by: Sequence[str], outputs: dict[str, str]) -> DataFrame:
    return attach_group(df, group_sums(df, by, outputs), by)


def with_group_median(df: DataFrame, by: Sequence[str], outputs: dict[str, str]) -> DataFrame:
    return attach_group(df, group_medians(df, by, outputs), by)


def group_share(df: DataFrame, by: Sequence[str], num: str, den: str, name: str) -> DataFrame:
    stats = df.groupBy(*by).agg(share(F.sum(num), F.sum(den)).alias(name))
    return attach_group(df, stats, by)


# Income limits as fractions of the group's median income.
INCOME_LIMITS = {"LI": 0.8, "VLI": 0.5, "ELI": 0.3}


def income_limits(
    df: DataFrame,
    by: Sequence[str],
    income: str,
    median_name: str = "co_mhhinc",
    fractions: dict[str, float] = INCOME_LIMITS,
) -> DataFrame:
    """A ``median_name`` that the rows already carry is taken as the group's median."""
    out = df if median_name in df.columns else with_group_median(df, by, {median_name: income})
    return out.withColumns(
        {f"co_{k}_val": F.col(median_name) * F.lit(f) for k, f in fractions.items()}
    )


def impute_group_median(df: DataFrame, by: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """``{output: column}``: the column with missing values replaced by the group's median of the
    raw column; a group without values stays missing."""
    medians = group_medians(df, by, {f"_median_{out}": c for out, c in cols.items()})
    filled = attach_group(df, medians, by).withColumns(
        {out: F.coalesce(F.col(c), F.col(f"_median_{out}")) for out, c in cols.items()}
    )
    return filled.drop(*[f"_median_{out}" for out in cols])


def above_group(df: DataFrame, by: Sequence[str], value: str, median_name: str, flag_name: str) -> DataFrame:
    out = with_group_median(df, by, {median_name: value})
    return out.withColumn(flag_name, above(value, median_name))


def subset_share(
    df: DataFrame,
    by: str,
    predicate: Column,
    total: str = "n_all",
    hits: str = "n_subset",
    ratio: str = "share",
) -> DataFrame:
    """Rows and qualifying rows per category and their ratio.  A category without a qualifying row
    has a missing count and ratio, not 0."""
    counted = df.groupBy(by).agg(
        F.count(F.lit(1)).alias(total), F.nullif(F.count_if(predicate), F.lit(0)).alias(hits)
    )
    return counted.withColumn(ratio, share(hits, total)).orderBy(F.desc(total), by)


def collapse(df: DataFrame, c: str, groups: dict[str, Sequence[str]], name: str) -> DataFrame:
    """Replace each listed category by its group; others keep their own value."""
    out = F
    for group, members in groups.items():
        out = out.when(F.col(c).isin(*members), group)
    return df.withColumn(name, out.otherwise(F.col(c)))


def strict_agg(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row: ``p<name>`` mean and ``m<name>`` median of each ``{name: column}``, missing as soon
    as one value is."""
    names = list(dict.fromkeys(cols.values()))
    totals = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(c).alias(f"_avg_{c}") for c in names],
        *[F.count(c).alias(f"_n_{c}") for c in names],
    )
    medians = group_medians(df, [], {f"_med_{c}": c for c in names}).select(
        F.struct(*[f"_med_{c}" for c in names])
    )
    median = medians.scalar()
    out = []
    for name, c in cols.items():
        complete = F.col("_rows") == F.col(f"_n_{c}")
        out.append(F.when(complete, F.col(f"_avg_{c}")).alias(f"p{name}"))
        out.append(F.when(complete, median.getField(f"_med_{c}")).alias(f"m{name}"))
    return totals.select(*out)


def describe_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "measure", "_v"
    )
    basics = long.groupBy("measure").agg(
        F.min("_v").alias("min"),
        F.avg("_v").alias("mean"),
        F.max("_v").alias("max"),
        F.count_if(F.col("_v").isNull()).alias("n_missing"),
    )
    quartiles = group_quantiles(df, [], cols, [0.25, 0.5, 0.75])
    return basics.join(quartiles, "measure", "left").select(
        "measure",
        "min",
        F.col("q0").alias("q1"),
        F.col("q1").alias("median"),
        "mean",
        F.col("q2").alias("q3"),
        "max",
        "n_missing",
    )


def zscore(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns standardised to mean 0 and sample s.d. 1 over the whole frame, or per group of
    ``by``.  Missing values are skipped and stay missing; a constant column becomes missing."""
    moments = [
        F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd")).alias(f"_z_{c}") for c in cols
    ]
    if by:
        scaled = attach_group(df, df.groupBy(*by).agg(*moments), by)
        at = {c: F.col(f"_z_{c}") for c in cols}
    else:
        scaled = df
        row = df.agg(*moments).select(F.struct(*[f"_z_{c}" for c in cols])).scalar()
        at = {c: row.getField(f"_z_{c}") for c in cols}
    return scaled.withColumns(
        {c: F.try_divide(F.col(c) - at[c].getField("mean"), at[c].getField("sd")) for c in cols}
    ).drop(*[f"_z_{c}" for c in cols])


def zscore_index(
    df: DataFrame, id_cols: Sequence[str], periods: dict[str, Sequence[str]], by: Sequence[str] = ()
) -> DataFrame:
    """Per period the sum of standardised columns, missing scores skipped."""
    cols = list(dict.fromkeys(c for members in periods.values() for c in members))
    scored = zscore(df.select(*dict.fromkeys([*id_cols, *by, *cols])), cols, by)
    return scored.select(
        *id_cols,
        *[row_sum0(*members).cast("double").alias(name) for name, members in periods.items()],
    )
