"""Flags, scenarios and tiers: row rules over the profile, benchmarks and lags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions.expr import above, case_when, row_sum0


@dataclass(frozen=True)
class Thresholds:
    # Published thresholds.
    students: float = 0.2
    vli: float = 0.2
    renters: float = 0.4
    poc: float = 0.5
    population: float = 500
    poc_rank: float = 0.95
    poc_high: float = 0.9
    neighbours: float = 0.6


DEFAULT = Thresholds()

# Columns that the rules below read, but for the group benchmarks and their own results.
FLAG_INPUTS = [
    "tr_pstudents", "tr_population", "tr_VLI_prop", "tr_prenters", "tr_pPOC", "tr_pchrent", "tr_pchrent_lag",
    "tr_rentgapprop", "big_city", "tr_dq",
    *[c for k in ("LI_30", "LI_50", "VLI_30", "VLI_50") for c in (f"tr_ir{k}p", f"co_ir{k}_med")],
]
TIER_INPUTS = [
    "tr_pstudents", "tr_population", "big_city", "tr_dq", "v_VLI", "v_Renters", "v_RB50VLI", "v_POC",
    "scen1_VLI50RB", "scen3_VLI50RB",
]

# Tier labels.
POOR_QUALITY = "Poor Data Quality"
HEIGHTENED = "Heightened Sensitivity"
VULNERABLE = "Vulnerable"
SOME_VULNERABILITY = "Tier 3: Some Vulnerability"


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def vulnerability_flags(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    few_students = F.col("tr_pstudents") < t.students
    return df.withColumns(
        {
            "v_VLI": _flag(few_students & (F.col("tr_VLI_prop") > t.vli)),
            "v_Renters": _flag(F.col("tr_prenters") > t.renters),
            "v_RB30LI": above("tr_irLI_30p", "co_irLI_30_med"),
            "v_RB50LI": above("tr_irLI_50p", "co_irLI_50_med"),
            "v_RB30VLI": above("tr_irVLI_30p", "co_irVLI_30_med"),
            "v_RB50VLI": above("tr_irVLI_50p", "co_irVLI_50_med"),
            "v_POC": _flag(F.col("tr_pPOC") > t.poc),
        }
    )


def pressure_flags(df: DataFrame) -> DataFrame:
    """Rent pressure: own rise above the group's, or the neighbours' change above it (which need not
    be a rise); rent gap positive and above the group's."""
    own, nearby, group = F.col("tr_pchrent"), F.col("tr_pchrent_lag"), F.col("co_pchrent")
    gap = F.col("tr_rentgapprop")
    return df.withColumns(
        {
            "dp_PChRent": case_when([((own > 0) & (own > group), 1), (nearby > group, 1)], 0),
            "dp_RentGap": _flag((gap > 0) & (gap > F.col("co_rentgapprop"))),
        }
    )


def _eligible(t: Thresholds) -> Column:
    return (F.col("tr_pstudents") < t.students) & (F.col("tr_population") >= t.population)


def _vulnerable(t: Thresholds) -> Column:
    return (
        _eligible(t) & (F.col("v_VLI") == 1) & (row_sum0("v_Renters", "v_RB50VLI", "v_POC") >= 2)
    )


def _pressures() -> Column:
    return row_sum0("dp_PChRent", "dp_RentGap")


def scenario_one(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    mostly_poc = (F.col("tr_POC_rank") >= t.poc_rank) | (F.col("tr_pPOC") >= t.poc_high)
    three_of_four = row_sum0("v_VLI", "v_Renters", "v_RB50VLI", "v_POC") >= 3
    routes = _vulnerable(t) | (mostly_poc & _eligible(t) & three_of_four)
    return df.withColumn("scen1_VLI50RB", _flag(routes & (_pressures() >= 1)))


def scenario_three(df: DataFrame, t: Thresholds = DEFAULT) -> DataFrame:
    """In a big city scenario one, elsewhere vulnerable under both pressures."""
    elsewhere = (F.col("big_city") == 0) & _vulnerable(t) & (_pressures() == 2)
    return df.withColumn(
        "scen3_VLI50RB",
        case_when([(F.col("big_city") == 1, F.col("scen1_VLI50RB")), (elsewhere, 1)], 0),
    )


def tiers(df: DataFrame, t: Thresholds = DEFAULT, neighbours: str = "scen1_VLI50RB_lag") -> DataFrame:
    poor = F.col("tr_dq") == 0
    vulnerable = _vulnerable(t)
    surrounded = (F.col("big_city") == 1) & (F.col(neighbours) >= t.neighbours)
    some = (F.col("v_VLI") == 1) | (
        (F.col("v_POC") == 1) & ((F.col("v_RB50VLI") == 1) | (F.col("v_Renters") == 1))
    )
    return df.withColumns(
        {
            "tier1": case_when(
                [
                    (poor, POOR_QUALITY),
                    (F.col("scen3_VLI50RB") == 1, HEIGHTENED),
                    (surrounded & vulnerable, HEIGHTENED),
                ]
            ),
            "tier2": case_when([(poor, None), (vulnerable, VULNERABLE)]),
            "tier3": case_when([(poor, None), (some, SOME_VULNERABILITY)]),
        }
    )
