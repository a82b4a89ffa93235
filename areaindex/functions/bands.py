"""Income and rent-burden bands: bounds, lookup, and share of a band under a threshold."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from areaindex.functions.expr import ColumnLike, col_of

# Household income bands, variable name -> upper bound.
INCOME_BANDS = {
    "HHInc_10": 9999,
    "HHInc_15": 14999,
    "HHInc_20": 19999,
    "HHInc_25": 24999,
    "HHInc_30": 29999,
    "HHInc_35": 34999,
    "HHInc_40": 39999,
    "HHInc_45": 44999,
    "HHInc_50": 49999,
    "HHInc_60": 59999,
    "HHInc_75": 74999,
    "HHInc_100": 99999,
    "HHInc_125": 124999,
    "HHInc_150": 149999,
    "HHInc_200": 199999,
    "HHInc_250": 249999,
}

# Household income bands, upper bound -> lower bound.  The published rules give the
# 60000-74999 band a lower bound of 50000; ``fix_band_75`` uses 60000.
INCOME_BAND_FLOORS = {
    9999: 0,
    14999: 10000,
    19999: 15000,
    24999: 20000,
    29999: 25000,
    34999: 30000,
    39999: 35000,
    44999: 40000,
    49999: 45000,
    59999: 50000,
    74999: 50000,
    99999: 75000,
    124999: 100000,
    149999: 125000,
    199999: 150000,
    249999: 200000,
}

# Renter income bands, code -> (lower bound, upper bound).
BURDEN_BANDS = {
    9999: (0, 9999),
    19999: (10000, 19999),
    34999: (20000, 34999),
    49999: (35000, 49999),
    74999: (50000, 74999),
    99999: (75000, 99999),
    100000: (100000, 200000),
}


def recode(c: ColumnLike, mapping: dict) -> Column:
    """Literal dictionary lookup; a key that is not listed gives NULL."""
    literal_map = F.create_map(*[F.lit(v) for v in chain.from_iterable(mapping.items())])
    return F.element_at(literal_map, col_of(c))


def band_floors(fix_band_75: bool = False) -> dict[int, int]:
    return {**INCOME_BAND_FLOORS, 74999: 60000} if fix_band_75 else INCOME_BAND_FLOORS


def band_floor(hi: ColumnLike, fix_band_75: bool = False) -> Column:
    return recode(col_of(hi).cast("int"), band_floors(fix_band_75)).cast("double")


def band_bounds(code: ColumnLike) -> tuple[Column, Column]:
    """Lower and upper bound of a renter income band; an unknown code has no lower bound and is its
    own upper bound."""
    key = col_of(code).cast("int")
    lo = recode(key, {k: v[0] for k, v in BURDEN_BANDS.items()}).cast("double")
    hi = recode(key, {k: v[1] for k, v in BURDEN_BANDS.items()}).cast("double")
    return lo, F.coalesce(hi, col_of(code).cast("double"))


def band_fraction(threshold: ColumnLike, lo: ColumnLike, hi: ColumnLike) -> Column:
    """Share of the band [lo, hi] lying under the threshold, assuming an even spread inside it.
    A missing threshold gives 0."""
    t, lo, hi = col_of(threshold), col_of(lo), col_of(hi)
    inside = F.try_divide(t - lo, hi - lo)
    return F.when(t >= hi, F.lit(1.0)).when(t >= lo, inside).otherwise(F.lit(0.0))


def count_under(threshold: str, bands: dict[str, int], fix_band_75: bool = False) -> Column:
    """Count under a threshold column from one count column per band (name -> upper bound); missing
    counts are skipped.  Written as one SQL expression, since the terms are many and alike."""
    floors = band_floors(fix_band_75)
    terms = [
        f"coalesce(`{name}` * CASE WHEN `{threshold}` >= {hi} THEN 1D WHEN `{threshold}` >= {floors[hi]} "
        f"THEN (`{threshold}` - {floors[hi]}) / {hi - floors[hi]}D ELSE 0D END, 0D)"
        for name, hi in bands.items()
    ]
    return F.expr(" + ".join(terms))
