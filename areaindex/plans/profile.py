"""Area profiles: shares per area, group benchmarks, variant formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.functions.expr import (
    gap,
    proportional_gap,
    residual_share,
    row_sum,
    row_sum0,
    share,
)
from areaindex.operators.groups import with_group_median
from areaindex.operators.joins import flag_in
from areaindex.operators.order_stats import with_medians_and_rank

RACES = ["White", "Black", "Asian", "Latinx"]


def rent_gap(df: DataFrame, own: str = "medrent", nearby: str = "medrent_lag") -> DataFrame:
    return df.withColumns({"tr_rentgap": gap(own, nearby), "tr_rentgapprop": proportional_gap(own, nearby)})


def area_profile(df: DataFrame) -> DataFrame:
    """Indicator columns from the named estimates of one area per row; no shuffle."""
    return df.withColumns(
        {
            "tr_population": F.col("race_tot"),
            "tr_households": F.col("totten"),
            "tr_pstudents": share(row_sum0("st_colenroll", "st_proenroll"), "st_totenroll"),
            "tr_povstudents": row_sum0("st_pov_under", "st_pov_grad"),
            "tr_prenters": share("totrent", "totten"),
            "tr_rb": share(row_sum0("rb_34_9", "rb_39_9", "rb_49_9", "rb_55"), "rb_tot"),
            **{f"tr_p{r}": share(f"race_{r}", "race_tot") for r in RACES},
            "tr_pOther": residual_share("race_tot", [f"race_{r}" for r in RACES]),
            "tr_pPOC": F.lit(1.0) - share("race_White", "race_tot"),
            "tr_pwelf": share("welf", "welf_tot"),
            "tr_ppoverty": share(row_sum0("pov_famh", "pov_nonfamh"), "pov_tot"),
            "tr_punemp": share("unemp", "unemp_tot"),
            "tr_pfemhhch": share(row_sum0("fhh_famheadch", "fhh_nonfamheadch"), "fhh_tot"),
        }
    )


def quality_flag(df: DataFrame, low_quality_ids: DataFrame, area_id: str = "geoid") -> DataFrame:
    """tr_dq: 0 for an area of poor data quality, else 1."""
    return flag_in(df, low_quality_ids, area_id, "tr_dq", if_in=0, if_out=1)


# Benchmarks, name -> column whose group median it is.
BENCHMARKS = {
    "co_rentgap": "tr_rentgap",
    "co_rentgapprop": "tr_rentgapprop",
    "co_pstudents": "tr_pstudents",
    "co_irVLI_50p": "tr_irVLI_50p",
    "co_pchrent": "tr_pchrent",
    "co_prenters": "tr_prenters",
    "co_pPOC": "tr_pPOC",
    "co_LI_prop": "tr_LI_prop",
    "co_VLI_prop": "tr_VLI_prop",
    "co_ELI_prop": "tr_ELI_prop",
}


def group_benchmarks(
    df: DataFrame, by: str = "county", benchmarks: dict[str, str] = BENCHMARKS, ranked: str = "tr_pPOC"
) -> DataFrame:
    """Percent rank of one share within the group, and the group medians, from one positions table."""
    return with_medians_and_rank(df, by, benchmarks, ranked, "tr_POC_rank")


AGES = ["under5", "fiveto9", "tento14", "fiftto17"]
CHILD_CELLS = [f"{sex}{age}" for sex in "MF" for age in AGES]
ELDER_CELLS = [f"{sex}el{i}" for sex in "MF" for i in range(1, 7)]
PRIVATE_SCHOOL_CELLS = [f"pschl{sex}{i}" for sex in "MF" for i in range(1, 6)]


def gentrification_profile(df: DataFrame) -> DataFrame:
    """Shares per area; here a missing part makes a sum missing, and a negative residual is 0."""
    return df.withColumns(
        {
            **{f"p{r}": share(r, "totrace") for r in RACES},
            "Other": F.col("totrace") - row_sum(*RACES),
            "pOther": residual_share("totrace", RACES, clip=True),
            "pWelf": share("welf", "totwelf"),
            "pPov": share(row_sum("povfamh", "povnonfamh"), "totpov"),
            "pUnemp": share("unemp", "totunemp"),
            "pFemhh": share(row_sum("femfamhh", "femnonfamhh"), "totfemhh"),
            "pFemhhCh": share(row_sum("femfamheadch", "femnonfamheadch"), "totfhc"),
            "pChild": share(row_sum(*CHILD_CELLS), "totage"),
            "pEld": share(row_sum(*ELDER_CELLS), "totage"),
            "pCol": share(row_sum("bach", "mas", "pro", "doc"), "toted"),
            "pRent": share("rent", "totten"),
            "pOwn": share("own", "totten"),
            "pManagers": share(row_sum("Mmgr", "Fmgr"), "totoccupation"),
            "pPrivSchl": share(row_sum(*PRIVATE_SCHOOL_CELLS), "totschool"),
        }
    )


def variant_flags(
    df: DataFrame,
    by: Sequence[str] = ("county",),
    renters_at_least: float = 0.4,
    students_below: float = 0.2,
) -> DataFrame:
    """Alternative rules: renters at or above a share; very-low-income share above the group median
    where students are few."""
    out = with_group_median(df, by, {"co_VLI_propmed": "tr_VLI_prop"})
    return out.withColumns(
        {
            "v_renters_40p": F.when(F.col("tr_prenters") >= renters_at_least, 1).otherwise(0),
            "v_VLI_med": F.when(
                (F.col("tr_pstudents") < students_below) & (F.col("tr_VLI_prop") > F.col("co_VLI_propmed")), 1
            ).otherwise(0),
        }
    )
