"""Delimited text in and out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NA_TOKENS = ("NA", " ", "")


def read_csv_clean(
    spark: SparkSession, path: str, schema: T.StructType, na: Sequence[str] = NA_TOKENS
) -> DataFrame:
    """Header CSV, plain or compressed (codec by suffix), blanks trimmed, NA tokens missing.

    Every field is read as text so that a token never counts as a malformed number; ids keep their
    leading zeros and numbers are cast afterwards, unreadable ones becoming missing.
    """
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.csv(
        path, schema=as_text, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True
    )
    tokens = sorted({t.strip() for t in na})
    columns = []
    for field in schema:
        text = F.trim(F.col(field.name))
        known = F.when(~text.isin(*tokens), text)
        columns.append(known.try_cast(field.dataType).alias(field.name))
    return raw.select(*columns)


def write_table(df: DataFrame, path: str, compression: str = "bzip2") -> None:
    df.write.mode("overwrite").csv(path, header=True, compression=compression, nullValue="NA", emptyValue="")
