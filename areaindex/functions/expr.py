"""Column expressions with explicit missing-value rules.

NULL is the only missing value: ratios go through ``try_divide`` so neither NaN nor Inf nor an ANSI
error can arise, and comparisons with NULL fall through to the next case.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Digits kept of shares of interpolated counts, above the noise of adding in another order.
SHARE_DIGITS = 12


def col_of(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def case_when(cases: Iterable[tuple[Column, object]], default: object = None) -> Column:
    """First matching case wins; an unknown condition is no match."""
    out = F
    for cond, value in cases:
        out = out.when(cond, _value(value))
    return out.otherwise(_value(default))


def row_sum(*cols: ColumnLike) -> Column:
    """Sum across columns; any missing part makes the sum missing."""
    return reduce(add, [col_of(c) for c in cols])


def row_sum0(*cols: ColumnLike) -> Column:
    """Sum across columns skipping missing parts; all missing gives 0."""
    return reduce(add, [F.coalesce(col_of(c), F.lit(0)) for c in cols])


def share(num: ColumnLike, den: ColumnLike) -> Column:
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def residual_share(
    total: ColumnLike,
    parts: Iterable[ColumnLike],
    skip_missing: bool = False,
    clip: bool = False,
) -> Column:
    """(total - parts) / total; ``clip`` lifts negatives to 0 and leaves missing alone."""
    summed = row_sum0(*parts) if skip_missing else row_sum(*parts)
    out = share(col_of(total) - summed, total)
    return F.when(out < 0, F.lit(0.0)).otherwise(out) if clip else out


def change(new: ColumnLike, old: ColumnLike) -> Column:
    return col_of(new) - col_of(old)


def proportional_change(new: ColumnLike, old: ColumnLike) -> Column:
    return share(change(new, old), old)


def gap(own: ColumnLike, nearby: ColumnLike) -> Column:
    return col_of(nearby) - col_of(own)


def proportional_gap(own: ColumnLike, nearby: ColumnLike) -> Column:
    """Gap relative to the mean of both values."""
    return share(gap(own, nearby), (col_of(own) + col_of(nearby)) / F.lit(2.0))


def above(value: ColumnLike, benchmark: ColumnLike) -> Column:
    return F.when(col_of(value) > col_of(benchmark), 1).otherwise(0)


def flag_not_in(c: ColumnLike, labels: Iterable[object]) -> Column:
    """0 for the listed labels, 1 for everything else, missing included."""
    return F.when(col_of(c).isin(*labels), 0).otherwise(1)


def null_if(c: ColumnLike, sentinel: object) -> Column:
    return F.nullif(col_of(c), F.lit(sentinel))


def parent_id(c: ColumnLike, length: int = 5) -> Column:
    return F.substring(col_of(c), 1, length)


def idw(distance: ColumnLike, power: int = 2) -> Column:
    d = col_of(distance)
    return F.try_divide(F.lit(1.0), reduce(lambda a, b: a * b, [d] * power))


def to_double(c: ColumnLike) -> Column:
    return col_of(c).try_cast("double")


def to_text(c: ColumnLike) -> Column:
    return col_of(c).cast("string")


def sum0(c: ColumnLike) -> Column:
    """Aggregate sum skipping missing values; nothing to sum gives 0."""
    return F.coalesce(F.sum(col_of(c)), F.lit(0))
