from areaindex.operators.columns import (
    cols_between,
    cols_ending,
    cols_starting,
    fill_zero,
    ids,
    map_cols,
    scale_col,
    semi_filter,
    separate,
    sentinel_to_null,
    with_columns_seq,
)
from areaindex.operators.groups import (
    above_group,
    attach_group,
    collapse,
    describe_cols,
    group_share,
    group_sums,
    impute_group_median,
    income_limits,
    strict_agg,
    subset_share,
    with_group_median,
    with_group_sum,
    zscore,
    zscore_index,
)
from areaindex.operators.joins import (
    flag_in,
    left_join,
    natural_left_join,
    reduce_left_join,
    union_layers,
)
from areaindex.operators.order_stats import (
    approx_group_quantiles,
    group_medians,
    group_quantiles,
    rank_share,
    with_medians_and_rank,
)
from areaindex.operators.reshape import gather, spread

__all__ = [name for name in dir() if not name.startswith("_")]
