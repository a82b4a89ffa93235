"""Data quality and households under the income limits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.functions.bands import INCOME_BANDS, count_under
from areaindex.functions.expr import SHARE_DIGITS, row_sum0, share
from areaindex.operators.groups import INCOME_LIMITS, income_limits


def low_quality(
    estimates: DataFrame, variable: str = "totrent", threshold: float = 0.6, area_id: str = "geoid"
) -> DataFrame:
    """Ids whose margin is at least ``threshold`` of the estimate, or whose estimate is missing.  A
    zero estimate with a margin is poor; 0/0 and a missing margin are not."""
    est, moe = F.col("estimate"), F.col("moe")
    ratio = F.try_divide(moe, est)
    poor = est.isNull() | ((est == 0) & (moe > 0)) | (ratio >= threshold)
    return estimates.filter((F.col("variable") == variable) & poor).select(area_id).distinct()


def income_shares(
    df: DataFrame,
    area_id: str = "geoid",
    by: Sequence[str] = ("county",),
    income: str = "mhhinc",
    bands: dict[str, int] = INCOME_BANDS,
    fractions: dict[str, float] = INCOME_LIMITS,
    fix_band_75: bool = False,
) -> DataFrame:
    """Per area the group's median income, the limits, and count and share of households under each
    limit.  ``df`` has one column per band, so the sum over bands is a row expression and the only
    shuffle is the group median, which a ``co_mhhinc`` already on the rows replaces."""
    known = [c for c in ["co_mhhinc"] if c in df.columns]
    out = income_limits(df.select(area_id, *by, income, *known, *bands), by, income, fractions=fractions)
    total = row_sum0(*bands).cast("double")
    counts = {f"tr_{k}_count": count_under(f"co_{k}_val", bands, fix_band_75) for k in fractions}
    shares = {
        f"tr_{k}_prop": F.round(share(f"tr_{k}_count", "tr_totinc_count"), SHARE_DIGITS) for k in fractions
    }
    out = out.withColumns({"tr_totinc_count": total, **counts}).withColumns(shares)
    return out.drop(*bands)
