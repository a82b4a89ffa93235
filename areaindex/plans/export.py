"""Final table, summaries, popup text and map layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaindex.functions.expr import col_of, to_text
from areaindex.functions.text import fmt_comma, fmt_dollar, fmt_percent, paste0, str_c, yes_no
from areaindex.operators.columns import cols_starting
from areaindex.operators.groups import attach_group, collapse, strict_agg, subset_share
from areaindex.operators.joins import union_layers
from areaindex.operators.order_stats import group_medians
from areaindex.plans.scoring import HEIGHTENED
from areaindex.sources.features import feature_lines

# Broad groups of neighbourhood types; types not listed keep their own name.
TYPE_GROUPS = {
    "Mostly White": ["White-Shared", "All White"],
    "Mostly POC": [
        "Asian-Shared",
        "Black-Asian-Latinx-Other",
        "Black-Latinx-Other",
        "Black-Shared",
        "Asian-Latinx-Other",
        "Asian-Black",
        "All Other",
        "All Asian",
        "Black-Other",
        "Latinx-Other",
        "Other-Shared",
    ],
    "Diverse": [
        "White-Asian-Latinx-Other",
        "Integrated",
        "White-Black-Latinx-Other",
        "White-Other",
        "White-Asian-Other",
        "White-Black-Asian",
        "White-Black",
        "White-Black-Other",
        "White-Black-Asian-Other",
    ],
}
# Transit layers, name -> label.
TRANSIT_LABELS = {"Bus": "High-Quality Bus Corridor Buffer", "Rail": "Fixed Transit Stop Buffer"}

# Layer colours; no tier is transparent.
TIER_COLOURS = {"Heightened Sensitivity": "#FF6633", "Poor Data Quality": "#CCCCCC"}
VULNERABLE_COLOURS = {"Vulnerable": "#6699FF"}
TRANSIT_COLOUR = "#CCCCCC"
NO_COLOUR = "transparent"

ID_COLUMNS = ["geoid", "county", "neigh_type", "big_city"]
RESULT_PREFIXES = ["tr_", "co_", "v_", "dp_", "scen", "tier"]


def collapse_types(df: DataFrame, c: str = "neigh_type", name: str = "nt2") -> DataFrame:
    return collapse(df, c, TYPE_GROUPS, name)


def palette(c: str, colours: dict[str, str]) -> Column:
    out = F
    for label, colour in colours.items():
        out = out.when(col_of(c) == label, colour)
    return out.otherwise(NO_COLOUR)


def final_projection(df: DataFrame) -> DataFrame:
    """Ids, every result column by its prefix, and the label and popup texts."""
    ids = [c for c in ID_COLUMNS if c in df.columns]
    shown = [c for c in cols_starting(df, RESULT_PREFIXES) if c not in ids]
    return df.select(*ids, *shown, label_text().alias("text"), popup().alias("popup_text"))


def label_text(area: str = "geoid") -> Column:
    return paste0("Tract: ", F.col(area))


def _pct(c: str) -> Column:
    return fmt_percent(c, 1)


def _yes(flag: str) -> Column:
    return yes_no(flag)


# Wording and markup of the popup, each line a heading with the parts that follow it.
def _popup_parts() -> list:
    br = "<br>"
    return [
        "<h3>Tract: ", F.col("geoid"), "</h3>",
        "<b>Total population</b><br>", fmt_comma("tr_population"), br,
        "<b>Total households</b><br>", fmt_comma("tr_households"), br, br,
        "<b><i><u>Vulnerable Population Measures Met</b></i></u>", br,
        "<b>Very low income</b><br>", _yes("v_VLI"),
        "<br>(<i>", _pct("tr_VLI_prop"), " tract VLI, ", _pct("co_VLI_prop"), " county VLI, & ",
        _pct("tr_pstudents"), " students</i>)", br,
        "<b>Persons of color</b><br>", _yes("v_POC"),
        " (<i>", _pct("tr_pPOC"), " tract & ", _pct("co_pPOC"), " county</i>)", br,
        "<b>Renting household percentage</b><br>    ", _yes("v_Renters"),
        " (<i>", _pct("tr_prenters"), " tract & ", _pct("co_prenters"), " county</i>)", br,
        "<b>Very low income renters paying<br>over 50% of income to rent</b><br>    ", _yes("v_RB50VLI"),
        " (<i>", _pct("tr_irVLI_50p"), " tract & ", _pct("co_irVLI_50p"), " county</i>)", br, br,
        "<b><i><u>Displacement Pressures Met</b></i></u>", br,
        "<b>Change in rent</b><br>    ", _yes("dp_PChRent"),
        " (<i>", _pct("tr_pchrent"), " tract, ", _pct("tr_pchrent_lag"), " nearby, & ",
        _pct("co_pchrent"), " county</i>)", br,
        "<b>Rent gap</b><br>     ", _yes("dp_RentGap"),
        " (<i>", fmt_dollar("tr_rentgap"), " tract & ", fmt_dollar("co_rentgap"), " county</i>)", br, br,
        "<b><i><u>Rent</b></i></u>", br,
        "<b>Local</b>", br, fmt_dollar("tr_medrent"), br,
        "<b>Nearby</b>", br, fmt_dollar("tr_medrent_lag"), br, br,
        "<b><i><u>Racial composition</b></i></u>", br,
        "<b>Neighborhood Type</b>", br, F.col("neigh_type"), br,
        "<b>White alone</b>", br, _pct("tr_pWhite"), br,
        "<b>Black or African American alone</b>", br, _pct("tr_pBlack"), br,
        "<b>Asian alone</b>", br, _pct("tr_pAsian"), br,
        "<b>Latinx</b>", br, _pct("tr_pLatinx"), br,
        "<b>Other</b>", br, _pct("tr_pOther"), br,
    ]


POPUP_COLUMNS = (
    "geoid", "neigh_type", "tr_population", "tr_households", "v_VLI", "tr_VLI_prop", "co_VLI_prop", "tr_pstudents",
    "v_POC", "tr_pPOC", "co_pPOC", "v_Renters", "tr_prenters", "co_prenters", "v_RB50VLI", "tr_irVLI_50p", "co_irVLI_50p",
    "dp_PChRent", "tr_pchrent", "tr_pchrent_lag", "co_pchrent", "dp_RentGap", "tr_rentgap", "co_rentgap",
    "tr_medrent", "tr_medrent_lag", "tr_pWhite", "tr_pBlack", "tr_pAsian", "tr_pLatinx", "tr_pOther",
)


def popup() -> Column:
    """Popup HTML; missing as soon as one part is."""
    return str_c(*_popup_parts())


def transit_layers(df: DataFrame, labels: dict[str, str] = TRANSIT_LABELS) -> DataFrame:
    """Rows of the listed labels under their layer name, label as text."""
    return union_layers(
        {
            name: df.filter(F.col("label") == label).withColumn("label", to_text("label"))
            for name, label in labels.items()
        }
    )


def feature_layers(
    result: DataFrame,
    poly_vertex: DataFrame,
    transit: DataFrame | None = None,
    transit_vertex: DataFrame | None = None,
    labels: dict[str, str] = TRANSIT_LABELS,
    area_id: str = "geoid",
    popup_column: Column | None = None,
) -> DataFrame:
    """One JSON feature per area and layer: all areas by tier 1, tier 2 areas, transit buffers by
    label.  Columns area id, label, color, popup, layer, feature.  One pass over the result gives
    both tier layers."""
    text = popup() if popup_column is None else popup_column

    def layer(name, tier, colours):
        return F.struct(
            F.col(tier).alias("label"), palette(tier, colours).alias("color"), F.lit(name).alias("layer")
        )

    shown = F.array_compact(
        F.array(
            layer("Heightened Sensitivity", "tier1", TIER_COLOURS),
            F.when(F.col("tier2").isNotNull(), layer("Vulnerable", "tier2", VULNERABLE_COLOURS)),
        )
    )
    layers = result.select(area_id, text.alias("popup"), F.explode(shown).alias("shown")).select(
        area_id, "shown.label", "shown.color", "popup", "shown.layer"
    )
    out = feature_lines(layers, poly_vertex, area_id)
    if transit is None:
        return out
    buffers = transit_layers(transit, labels).select(
        F.col("geo_id").alias(area_id),
        "label",
        F.lit(TRANSIT_COLOUR).alias("color"),
        F.lit(None).cast("string").alias("popup"),
        "layer",
    )
    return out.unionByName(feature_lines(buffers, transit_vertex, area_id))


def tier_summary(result: DataFrame) -> DataFrame:
    """Means and medians over areas of heightened sensitivity, missing values propagating."""
    return strict_agg(
        result.filter(F.col("tier1") == HEIGHTENED),
        {
            "POC": "tr_pPOC",
            "Renter": "tr_prenters",
            "VLI": "tr_VLI_prop",
            "VLI_50RB": "tr_irVLI_50p",
            "pChRent": "tr_pchrent",
        },
    )


def type_shares(result: DataFrame, by: str = "neigh_type", digits: int = 1) -> DataFrame:
    """Areas and areas of heightened sensitivity per type, with the share as text."""
    out = subset_share(result, by, F.col("tier1") == HEIGHTENED, "count_ca", "count_sc", "p")
    return out.withColumn("p", fmt_percent("p", digits))


def type_group_shares(result: DataFrame) -> DataFrame:
    """The same over the broad groups of types, as ``nt2``."""
    return type_shares(collapse_types(result), "nt2")


def tier_medians(result: DataFrame, c: str = "tr_VLI_prop", tier: str = "tier1") -> DataFrame:
    """Areas per tier and the median of one share, missing values skipped; areas without a tier are
    a tier of their own."""
    counted = result.groupBy(tier).agg(F.count(F.lit(1)).alias("n"))
    return attach_group(counted, group_medians(result, [tier], {f"median_{c}": c}), [tier])


def tier_counts(result: DataFrame, population_from: float = 500) -> DataFrame:
    return (
        result.filter(F.col("tr_population") >= population_from)
        .groupBy("tier1")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def small_areas(result: DataFrame, population_below: float = 500) -> DataFrame:
    return result.filter(F.col("tr_population") < population_below).agg(F.count(F.lit(1)).alias("n"))
