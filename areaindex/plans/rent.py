"""Rent burden by income, and rent levels over two vintages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions.bands import band_bounds, band_fraction
from areaindex.functions.expr import (
    SHARE_DIGITS,
    above,
    change,
    proportional_change,
    share,
    sum0,
)
from areaindex.operators.columns import separate
from areaindex.operators.groups import INCOME_LIMITS, with_group_median
from areaindex.operators.joins import natural_left_join
from areaindex.operators.pairs import lookup_join
from areaindex.sources.landing import land

# Burden classes of at least 30 % and at least 50 % of income.
BURDEN_30 = ["349", "399", "499", "5plus"]
BURDEN_50 = ["5plus"]


def split_cells(cells: DataFrame) -> DataFrame:
    """Composite variable names into ir_type, rb and income."""
    return separate(cells, "variable", ["ir_type", "rb", "income"])


def split_landed_cells(cells: DataFrame) -> DataFrame:
    """``split_cells`` of a landed table: each name is split once, however many areas have it."""
    names = cells.select("variable").distinct().withColumn("_name", F.col("variable"))
    split = split_cells(names).withColumnRenamed("_name", "variable")
    return lookup_join(cells, split, ["variable"]).drop("variable")


def burden_totals(split: DataFrame, area_id: str = "geoid") -> DataFrame:
    total = split.filter((F.col("rb") == "tot") & (F.col("income") == "tot"))
    return total.groupBy(area_id).agg(sum0("estimate").alias("tot_ir"))


def rent_burden_cells(
    split: DataFrame,
    group_income: DataFrame,
    area_id: str = "geoid",
    fractions: dict[str, float] = INCOME_LIMITS,
) -> DataFrame:
    """Income x burden cells with the share and count of renters under each income limit.
    ``group_income`` has the area id and co_mhhinc (and may carry the group id)."""
    cells = natural_left_join(split.filter(F.col("income") != "tot").drop("ir_type"), group_income, [area_id])
    cells = cells.withColumn("income", F.col("income").try_cast("double"))
    lo, hi = band_bounds("income")
    cells = cells.withColumns({"bottom_inccat": lo, "top_inccat": hi}).withColumns(
        {f"co_{k}_val": F.col("co_mhhinc") * F.lit(f) for k, f in fractions.items()}
    )
    cells = cells.withColumns(
        {k: band_fraction(f"co_{k}_val", "bottom_inccat", "top_inccat") for k in fractions}
    )
    return cells.withColumns({f"tr_{k}_ir_count": F.col(k) * F.col("estimate") for k in fractions})


def _qualified_sum(qualifies: Column, value: str) -> Column:
    """Sum over qualifying rows: missing without any, 0 when they hold only missing values."""
    total = F.coalesce(F.sum(F.when(qualifies, F.col(value))), F.lit(0.0))
    return F.when(F.count_if(qualifies) > 0, total)


def rent_burden_measures(
    cells: DataFrame,
    totals: DataFrame,
    by: Sequence[str] = ("county",),
    area_id: str = "geoid",
    fix_50: bool = False,
) -> DataFrame:
    """Four measures per area with the group median and flag of each, from one conditional
    aggregation over the cells and one pass for all medians.

    ``totals`` has the area id, the group and tot_ir.  As published, the 50 % measures qualify cells
    by the other income limit than the one they sum; ``fix_50`` uses the same limit for both.

    The measures are sums of fractions, whose last digit depends on the order of addition.  Shares
    are rounded well above that digit, so equal areas compare as equal, and landed, so the medians
    do not evaluate the cells again.
    """
    li, vli = F.col("LI") > 0, F.col("VLI") > 0
    at_30, at_50 = F.col("rb").isin(*BURDEN_30), F.col("rb").isin(*BURDEN_50)
    qualified = {
        "LI_30": (li & at_30, "LI"),
        "LI_50": ((li if fix_50 else vli) & at_50, "LI"),
        "VLI_30": (vli & at_30, "VLI"),
        "VLI_50": ((vli if fix_50 else li) & at_50, "VLI"),
    }
    sums = cells.groupBy(area_id).agg(
        *[_qualified_sum(q, f"tr_{k}_ir_count").alias(f"tr_ir{m}rb_ct") for m, (q, k) in qualified.items()]
    )
    out = natural_left_join(totals, sums, [area_id]).withColumns(
        {f"tr_ir{m}p": F.round(share(f"tr_ir{m}rb_ct", "tot_ir"), SHARE_DIGITS) for m in qualified}
    )
    out = land(out, "burden-measures")
    out = with_group_median(out, by, {f"co_ir{m}_med": f"tr_ir{m}p" for m in qualified})
    return out.withColumns({f"v_rb{m}rb": above(f"tr_ir{m}p", f"co_ir{m}_med") for m in qualified})


def rent_medians(new: str = "medrent", old: str = "medrent12") -> dict[str, str]:
    """The group medians that ``rent_change`` needs, name -> column."""
    return {"_median_new": new, f"co_{old}": old}


def rent_change(
    df: DataFrame, new: str = "medrent", old: str = "medrent12", by: Sequence[str] = ("county",)
) -> DataFrame:
    """Both rents with missing values imputed by the group median, their change, and the group
    median of the imputed old rent.  That median is the one imputed: copies of a median, put among
    the values, leave it where it is.  So one pass serves all, which is left out where the rows already
    carry both medians (``rent_medians``)."""
    medians = rent_medians(new, old)
    out = df if set(medians) <= set(df.columns) else with_group_median(df, by, medians)
    out = out.withColumns(
        {new: F.coalesce(F.col(new), F.col("_median_new")), f"tr_{old}": F.coalesce(F.col(old), F.col(f"co_{old}"))}
    )
    return out.drop("_median_new").withColumns(
        {
            "tr_chrent": change(new, f"tr_{old}"),
            "tr_pchrent": proportional_change(new, f"tr_{old}"),
        }
    )
