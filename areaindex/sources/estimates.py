"""Survey estimates: landed long tables, read by state, year and variable dictionary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areaindex.functions.bands import recode
from areaindex.operators import pairs
from areaindex.operators.reshape import spread
from areaindex.sources.catalogue import fetched_once
from areaindex.sources.landing import land

ESTIMATES_SCHEMA = T.StructType(
    [
        T.StructField("geoid", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("variable", T.StringType()),
        T.StructField("estimate", T.DoubleType()),
        T.StructField("moe", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("state", T.StringType()),
    ]
)


def apply_dict(df: DataFrame, names_to_codes: dict[str, str] | DataFrame, on: str = "variable") -> DataFrame:
    """Keep the listed codes and replace each by its name; a code with several names gives a row for
    each.  A dictionary of literals reaches the scan as a membership test, and no join is planned.  A table
    (name, code) may have any size: it is landed and counted, a small one is broadcast, and for a larger
    one the rows of a code that most rows have are dealt over several tasks."""
    if isinstance(names_to_codes, DataFrame):
        return _apply_table(df, names_to_codes, on)
    names: dict[str, list[str]] = {}
    for name, code in names_to_codes.items():
        names.setdefault(code, []).append(name)
    kept = df.filter(F.col(on).isin(*names))
    if len(names) == len(names_to_codes):
        return kept.withColumn(on, recode(on, {code: own[0] for code, own in names.items()}))
    entries = [x for code, own in names.items() for x in (F.lit(code), F.array(*map(F.lit, own)))]
    return kept.withColumn(on, F.explode(F.element_at(F.create_map(*entries), F.col(on))))


def _apply_table(df: DataFrame, dictionary: DataFrame, on: str, broadcast_cells: int | None = None) -> DataFrame:
    limit = pairs.BROADCAST_CELLS if broadcast_cells is None else broadcast_cells
    named = dictionary.filter("name IS NOT NULL AND code IS NOT NULL").select(
        F.col("code").alias(on), F.col("name").alias("_name")
    )
    named = land(named.distinct(), "dictionary")
    small = named.count() * len(named.columns) <= limit
    met = df.join(F.broadcast(named), on) if small else pairs.salted_join(df, named, [on])
    return met.withColumn(on, F.col("_name")).select(*df.columns)


def _as_data(names_to_codes: dict[str, str] | DataFrame):
    """What tells one dictionary from another: its entries, or the count and hashes of a table's rows."""
    if not isinstance(names_to_codes, DataFrame):
        return list(names_to_codes.items())
    row = F.xxhash64("name", "code")
    return list(map(str, names_to_codes.distinct().agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()))


def estimates_from(
    df: DataFrame,
    names_to_codes: dict[str, str] | DataFrame,
    output: str = "tidy",
    keep_moe: bool = False,
    id_cols: Sequence[str] = ("geoid", "name"),
) -> DataFrame:
    """Named estimates of a long frame, tidy or one row per area.  Wide with margins has the
    suffixes ``_e`` and ``_m``; without margins the plain variable names.  Columns come from listed names,
    so a dictionary table gives tidy rows only."""
    if output != "tidy" and isinstance(names_to_codes, DataFrame):
        raise ValueError("a wide result needs its names listed")
    named = apply_dict(df, names_to_codes)
    if output == "tidy":
        return named
    values = {"_e": "estimate", "_m": "moe"} if keep_moe else "estimate"
    return spread(named, list(id_cols), "variable", values, list(names_to_codes))


def read_estimates(
    spark: SparkSession,
    path: str,
    names_to_codes: dict[str, str] | DataFrame,
    state: str | Sequence[str],
    year: int,
    output: str = "tidy",
    keep_moe: bool = False,
    cache: bool = False,
) -> DataFrame:
    """Estimates from a table partitioned by year and state; both filters prune partitions.  ``cache``
    fetches the selection once: a later call with the same arguments reads the copy, whatever session
    made it, until a file of these states and year changes or ``release`` drops it."""
    states = [state] if isinstance(state, str) else list(state)

    def read() -> DataFrame:
        df = spark.read.schema(ESTIMATES_SCHEMA).parquet(path)
        df = df.filter((F.col("year") == year) & F.col("state").isin(*states))
        return estimates_from(df, names_to_codes, output, keep_moe)

    if not cache:
        return read()
    folders = [f"{path.rstrip('/')}/year={year}/state={s}" for s in sorted(set(states))]
    selection = {
        "variables": _as_data(names_to_codes), "states": sorted(set(states)), "year": year, "output": output, "moe": keep_moe
    }
    return fetched_once(spark, path, folders, selection, read)


def write_estimates(df: DataFrame, path: str) -> None:
    """Landing copy in the layout ``read_estimates`` prunes on.  Rows are rebalanced by partition and
    a dominant state is split over as many tasks as its size asks for."""
    df.hint("rebalance", "year", "state").write.partitionBy("year", "state").parquet(path)
