from areaindex.sources.catalogue import fetched_once, release
from areaindex.sources.csv import read_csv_clean, write_table
from areaindex.sources.estimates import (
    apply_dict,
    estimates_from,
    read_estimates,
    write_estimates,
)
from areaindex.sources.features import feature_lines, read_polygons, write_features
from areaindex.sources.landing import drop_landed, land, scratch_dir

__all__ = [name for name in dir() if not name.startswith("_")]
