"""Long <-> wide."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_WORD = 62


def _repeated_key(position: Column, n_keys: int) -> Column:
    """True where some key occurs twice in the group: more rows than distinct keys, the latter
    counted from bit sets so the state stays a few words per group."""
    distinct = reduce(
        lambda a, b: a + b,
        [
            F.bit_count(
                F.coalesce(
                    F.bit_or(
                        F.when(
                            (position >= start) & (position < start + BITS_PER_WORD),
                            F.call_function("shiftleft", F.lit(1).cast("bigint"), position - start),
                        )
                    ),
                    F.lit(0).cast("bigint"),
                )
            )
            for start in range(0, n_keys, BITS_PER_WORD)
        ],
    )
    return F.count(F.lit(1)) > distinct


def spread(
    df: DataFrame,
    id_cols: Sequence[str],
    key: str,
    values: str | dict[str, str],
    keys: Sequence[str],
    on_duplicate: str = "error",
) -> DataFrame:
    """Long to wide over an explicit key list, absent cells NULL.

    ``values`` is one column, or ``{suffix: column}`` for several (``v1_e``, ``v1_m``).  One
    conditional aggregation, so one shuffle with map-side combine.  A repeated (id, key) raises
    unless ``on_duplicate="max"``.
    """
    keys = list(keys)
    parts = {"": values} if isinstance(values, str) else values
    known = df.filter(F.col(key).isin(*keys))
    cells = [
        F.max(F.when(F.col(key) == k, F.col(source))).alias(f"{k}{suffix}")
        for k in keys
        for suffix, source in parts.items()
    ]
    if on_duplicate != "error":
        return known.groupBy(*id_cols).agg(*cells)
    position = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col(key)) - 1
    repeated = _repeated_key(position.cast("int"), len(keys)).alias("_repeated")
    wide = known.groupBy(*id_cols).agg(*cells, repeated)
    stop = F.raise_error(F.lit(f"spread: a {key} occurs more than once for one id"))
    names = [c for c in wide.columns if c not in id_cols and c != "_repeated"]
    types = dict(wide.dtypes)
    return wide.select(
        *id_cols,
        *[F.when(F.col("_repeated"), stop.cast(types[c])).otherwise(F.col(c)).alias(c) for c in names],
    )


def gather(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str], key: str, value: str) -> DataFrame:
    """Wide to long; missing cells are kept."""
    return df.unpivot(list(id_cols), list(cols), key, value)
