"""Variable dictionaries: name -> source code."""

from __future__ import annotations

# Area indicators, name -> source table code.  Dots in names are underscores.
AREA_VARIABLES = {
    "HHInc_Total": "B19001_001",
    "HHInc_10": "B19001_002",
    "HHInc_15": "B19001_003",
    "HHInc_20": "B19001_004",
    "HHInc_25": "B19001_005",
    "HHInc_30": "B19001_006",
    "HHInc_35": "B19001_007",
    "HHInc_40": "B19001_008",
    "HHInc_45": "B19001_009",
    "HHInc_50": "B19001_010",
    "HHInc_60": "B19001_011",
    "HHInc_75": "B19001_012",
    "HHInc_100": "B19001_013",
    "HHInc_125": "B19001_014",
    "HHInc_150": "B19001_015",
    "HHInc_200": "B19001_016",
    "HHInc_250": "B19001_017",
    "totten": "B25003_001",
    "totrent": "B25003_003",
    "race_tot": "B03002_001",
    "race_White": "B03002_003",
    "race_Black": "B03002_004",
    "race_Asian": "B03002_006",
    "race_Latinx": "B03002_012",
    "medrent": "B25064_001",
    "st_totenroll": "B14007_001",
    "st_colenroll": "B14007_017",
    "st_proenroll": "B14007_018",
    "st_pov_under": "B14006_009",
    "st_pov_grad": "B14006_010",
    "rb_tot": "B25070_001",
    "rb_34_9": "B25070_007",
    "rb_39_9": "B25070_008",
    "rb_49_9": "B25070_009",
    "rb_55": "B25070_010",
    "welf_tot": "B19057_001",
    "welf": "B19057_002",
    "pov_tot": "B17017_001",
    "pov_famh": "B17017_003",
    "pov_nonfamh": "B17017_020",
    "unemp_tot": "B23025_001",
    "unemp": "B23025_005",
    "fhh_tot": "B11005_001",
    "fhh_famheadch": "B11005_007",
    "fhh_nonfamheadch": "B11005_010",
    "mhhinc": "B19013_001",
}

# The variable of the older vintage.
OLD_RENT_VARIABLES = {"medrent12": "B25064_001"}

# Renters by income band and rent burden.  The source table lists the total, then for
# each income band its total followed by the burden classes; names are ir_<burden>_<income>.
BURDEN_TABLE = "B25074"
BURDEN_CLASSES = ["tot", "19", "249", "299", "349", "399", "499", "5plus", "x"]
BURDEN_INCOMES = ["9999", "19999", "34999", "49999", "74999", "99999", "100000"]


def burden_variables() -> dict[str, str]:
    names = ["ir_tot_tot"]
    names += [f"ir_{burden}_{income}" for income in BURDEN_INCOMES for burden in BURDEN_CLASSES]
    return {name: f"{BURDEN_TABLE}_{position:03d}" for position, name in enumerate(names, start=1)}
