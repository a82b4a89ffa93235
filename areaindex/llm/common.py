"""Helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.sources.landing import land

#: Landed frames of at most this many cells (rows, or list entries of rows) are broadcast, some 64 MB;
#: beyond it a shuffle join does the same.
BROADCAST_CELLS = 1_000_000

#: A-Z to a-z; every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: The same, and each byte that no benchmark word holds becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Words between white space (0x20, 0x09 to 0x0D), A-Z in lower case."""
    return text.translate(LOWER).split()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def numbered(docs: DataFrame, name: str = "numbered") -> tuple[DataFrame, str]:
    """The documents with a number for each row, which every scan finds again, and the column's name.  Stages
    that drop rows go by it, as rows may share a doc_id or have none.  Rows of a file scan are numbered by
    their place in its files, without a copy; other frames are landed."""
    number = "_row"
    while any(c.startswith(number) for c in docs.columns):
        number = "_" + number
    file, place = f"{number}_file", f"{number}_place"
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:
        return land(docs.withColumn(number, F.monotonically_increasing_id()), name), number
    # A number for each file; the list is no longer than the one that Spark plans the scan from.
    files = land(placed.select(file).distinct().coalesce(1).withColumn(number, F.monotonically_increasing_id()), "files")
    row = F.shiftleft(number, 40) + F.col(place)
    return join_small(placed, files, [file]).withColumn(number, row).drop(file, place), number


def without(rows: DataFrame, number: str, gone: DataFrame) -> DataFrame:
    """The numbered rows but for those whose number is in the landed ``gone`` (doc_id), without it."""
    return join_small(rows, gone.withColumnRenamed("doc_id", number), [number], "left_anti").drop(number)


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", cells=None) -> DataFrame:
    """Join a landed ``small`` frame to ``big``: broadcast when its cells, one a row or as counted by
    ``cells``, are at most BROADCAST_CELLS, else by a shuffle, so what is sent never grows with the data."""
    size = small.agg(F.sum(cells if cells is not None else F.lit(1)).alias("n")).first()["n"] or 0
    return big.join(F.broadcast(small) if size <= BROADCAST_CELLS else small, on, how)


def release_memory() -> None:
    """Give freed memory of this process back, as reused workers otherwise keep the most they ever had."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def rebatch(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most_bytes``, at least one row each.  What earlier tasks of
    this worker process have freed goes back to the system first, and what was freed here at the end."""
    release_memory()
    batch = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
    del batch
    release_memory()


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task's function; once it has ended, what it held goes back to the system.  ``rebatch`` alone
    gives back while the function still holds its last batch and what it made of it, which an idle worker then keeps."""
    yield from batches
    release_memory()


__all__ = ["BROADCAST_CELLS", "LOWER", "WORD_BYTES", "crc_of_id", "documents", "join_small", "land", "numbered", "rebatch", "space_words", "texts", "trimmed", "without"]
