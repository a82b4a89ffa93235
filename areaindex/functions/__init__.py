from areaindex.functions.bands import (
    BURDEN_BANDS,
    INCOME_BANDS,
    band_bounds,
    band_floor,
    band_fraction,
    count_under,
    recode,
)
from areaindex.functions.expr import (
    above,
    case_when,
    change,
    col_of,
    flag_not_in,
    gap,
    idw,
    null_if,
    parent_id,
    proportional_change,
    proportional_gap,
    residual_share,
    row_sum,
    row_sum0,
    share,
    sum0,
    to_double,
    to_text,
)
from areaindex.functions.text import (
    fmt_comma,
    fmt_dollar,
    fmt_percent,
    paste0,
    str_c,
    yes_no,
)

__all__ = [name for name in dir() if not name.startswith("_")]
