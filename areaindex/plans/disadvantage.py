"""Standardised disadvantage index over periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.functions.expr import row_sum, share
from areaindex.operators.columns import fill_zero, semi_filter, sentinel_to_null
from areaindex.operators.groups import zscore_index
from areaindex.operators.joins import reduce_left_join


# Counts per share and period, share -> (numerator columns, total column).
INPUTS_2009 = {
    "PChi00": (
        [
            "RKYE003", "RKYE004", "RKYE005", "RKYE006", "RKYE027", "RKYE028", "RKYE029", "RKYE030", "RKYE031",
        ],
        "RKYE001",
    ),
    "PFem00": (["RL4E006"], "RL4E001"),
    "PWel00": (["ROAE002"], "ROAE001"),
    "PPov00": (["R1HE002"], "R1HE001"),
    "PUne00": (
        [
            "R5CE008", "R5CE015", "R5CE022", "R5CE029", "R5CE036", "R5CE043", "R5CE050", "R5CE057", "R5CE064",
            "R5CE071", "R5CE076", "R5CE081", "R5CE086", "R5CE094", "R5CE101", "R5CE108", "R5CE115", "R5CE122",
            "R5CE129", "R5CE136", "R5CE143", "R5CE150", "R5CE157", "R5CE162", "R5CE167", "R5CE172",
        ],
        "R5CE001",
    ),
}
INPUTS_2014 = {
    "PChi14": (
        [
            "ABAQE003", "ABAQE004", "ABAQE005", "ABAQE006", "ABAQE027", "ABAQE028", "ABAQE029", "ABAQE030", "ABAQE031",
        ],
        "ABAQE001",
    ),
    "PFem14": (["ABBYE006"], "ABBYE001"),
    "PWel14": (["ABEIE002"], "ABEIE001"),
    "PPov14": (["ABTBE002"], "ABTBE001"),
    "PUne14": (["ABGFE005"], "ABGFE001"),
}

# Share names and source columns by census year.
CENSUS_COLUMNS = {
    "80": {"welf": "WELFARE8", "pov": "POVRAT8", "unemp": "UNEMPRT8", "femh": "FFH8", "child": "CHILD8"},
    "90": {"welf": "WELFARE9", "pov": "POVRAT9", "unemp": "UNEMPRT9", "femh": "FFH9", "child": "CHILD9"},
    "00": {"welf": "WELFARE0", "pov": "POVRAT0", "unemp": "UNEMPRT0", "femh": "FFH0", "child": "CHILD0"},
    "10": {"welf": "WELFAR1AR", "pov": "POVRAT1A", "unemp": "UNEMPRT1A", "femh": "FFH1A", "child": "CHILD1A"},
}
CENSUS_PERIODS = {
    f"dis{'19' if year in ('80', '90') else '20'}{year}": [f"{name}{year}" for name in columns]
    for year, columns in CENSUS_COLUMNS.items()
}
SURVEY_PERIODS = {"dis09": list(INPUTS_2009), "dis14": list(INPUTS_2014)}


def census_shares(df: DataFrame, area_id: str = "GEO2010") -> DataFrame:
    """Select the census columns under their period names; -999 is missing."""
    renamed = df.select(
        area_id,
        *[
            F.col(source).alias(f"{name}{year}")
            for year, columns in CENSUS_COLUMNS.items()
            for name, source in columns.items()
        ],
    )
    return sentinel_to_null(renamed, renamed.columns[1:])


def disadvantage_inputs(
    tables: DataFrame | Sequence[DataFrame],
    spec: dict[str, tuple[Sequence[str], str]],
    area_id: str = "GISJOIN",
) -> DataFrame:
    """Shares per area.  Missing counts become 0 before the ratio; a zero total gives a missing
    share.  Counts spread over several tables are left-joined to the first."""
    frames = [tables] if isinstance(tables, DataFrame) else list(tables)
    counts = reduce_left_join(frames, [area_id])
    used = list(dict.fromkeys(c for num, den in spec.values() for c in [*num, den]))
    filled = fill_zero(counts.select(area_id, *used), used)
    return filled.select(area_id, *[share(row_sum(*num), den).alias(name) for name, (num, den) in spec.items()])


def disadvantage_index(
    shares: DataFrame,
    periods: dict[str, Sequence[str]],
    subset_ids: DataFrame | None = None,
    area_id: str = "geoid",
    sentinel: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """Per period the sum of z-scores over the subset's own mean and s.d., or per region ``by``."""
    cols = list(dict.fromkeys(c for members in periods.values() for c in members))
    clean = shares if sentinel is None else sentinel_to_null(shares, cols, sentinel)
    subset = clean if subset_ids is None else semi_filter(clean, subset_ids, area_id)
    return zscore_index(subset, [area_id], periods, by)
