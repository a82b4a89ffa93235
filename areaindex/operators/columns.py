"""Projection, selection, cleaning and id-set operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions.expr import null_if


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Column names from ``first`` to ``last`` in the frame's own order."""
    names = df.columns
    return names[names.index(first) : names.index(last) + 1]


def cols_starting(df: DataFrame, prefixes: Iterable[str]) -> list[str]:
    """Names starting with a prefix, ignoring case, grouped by prefix and each name once."""
    hits = [c for p in prefixes for c in df.columns if c.lower().startswith(p.lower())]
    return list(dict.fromkeys(hits))


def cols_ending(df: DataFrame, suffix: str) -> list[str]:
    return [c for c in df.columns if c.lower().endswith(suffix.lower())]


def with_columns_seq(df: DataFrame, steps: Iterable[tuple[str, Column] | dict[str, Column]]) -> DataFrame:
    """Add computed columns in order; a later step may use an earlier one.  A dict is one step
    whose columns do not depend on each other."""
    for step in steps:
        df = df.withColumns(step if isinstance(step, dict) else dict([step]))
    return df


def map_cols(df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def fill_zero(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.fillna(0, subset=list(cols))


def sentinel_to_null(df: DataFrame, cols: Iterable[str], sentinel: float = -999.0) -> DataFrame:
    return map_cols(df, cols, lambda c: null_if(c, sentinel))


def scale_col(df: DataFrame, name: str, factor: float) -> DataFrame:
    return df.withColumn(name, F.col(name) * F.lit(factor))


SEPARATORS = "[^A-Za-z0-9]+"


def separate(df: DataFrame, name: str, into: list[str], sep: str = SEPARATORS) -> DataFrame:
    """Split a composite text column; surplus pieces are dropped, absent ones are NULL.  The pattern runs once
    a row, not once a piece.  The usual one is brought to a single separator first, as a replacement compiles its
    pattern once and a split for each row."""
    pieces = "_pieces"
    while pieces in df.columns:
        pieces += "_"
    if sep == SEPARATORS:
        text, sep = F.regexp_replace(F.col(name), sep, "_"), "_"  # no piece holds one
    else:
        text = F.col(name)
    split = df.withColumn(pieces, F.split(text, sep))
    return split.withColumns({new: F.get(pieces, F.lit(i)) for i, new in enumerate(into)}).drop(
        pieces, *({name} - set(into))
    )


def ids(df: DataFrame, name: str) -> DataFrame:
    """Distinct values of one column, kept distributed."""
    return df.select(name).distinct()


def semi_filter(df: DataFrame, members: DataFrame, on: str) -> DataFrame:
    return df.join(members.select(on).hint("merge"), on, "left_semi")
