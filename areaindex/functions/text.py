"""Display formats and text building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from areaindex.functions.expr import ColumnLike, col_of


def fmt_comma(c: ColumnLike) -> Column:
    """Thousands separators, no decimals; missing stays missing."""
    return F.format_number(col_of(c).cast("double"), 0)


def fmt_percent(c: ColumnLike, digits: int = 1) -> Column:
    """0.2158 -> 21.6%; missing stays missing."""
    return F.concat(F.format_number(col_of(c).cast("double") * 100, digits), F.lit("%"))


def fmt_dollar(c: ColumnLike, digits: int = 0) -> Column:
    """-1234.4 -> -$1,234; missing stays missing."""
    value = col_of(c).cast("double")
    amount = F.format_number(F.abs(value), digits)
    sign = F.when(F.regexp_like(amount, F.lit("[1-9]")) & (value < 0), "-").otherwise("")
    return F.concat(sign, F.lit("$"), amount)


def yes_no(flag: ColumnLike) -> Column:
    return F.when(col_of(flag) == 1, "Yes").otherwise("No")


def _part(p) -> Column:
    return p.cast("string") if isinstance(p, Column) else F.lit(p)


def str_c(*parts) -> Column:
    """Concatenate literals (str) and columns; one missing part makes the text missing."""
    return F.concat(*[_part(p) for p in parts])


def paste0(*parts) -> Column:
    """Concatenate literals (str) and columns; a missing part is written as NA."""
    return F.concat(*[F.coalesce(_part(p), F.lit("NA")) for p in parts])
