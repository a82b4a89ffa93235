"""Landed copies that are found again: fetched once, reused by every later call on the same source.

A copy's place follows from what it is a copy of: the source's path, the versions of the files it is made
from (path, length, time of change) and the selection.  So there is no index to keep in step, any session that
shares the folder finds the copy, and a changed source leads to another place.  A copy is written beside its place
and moved there when whole; of two sessions that make the same copy at once, one copy stays.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from areaindex.sources.landing import shared_root


def _path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_versions(spark: SparkSession, folders: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of all files below the folders, sorted; a folder that is not there has none."""
    found = []
    for folder in folders:
        path, fs = _path(spark, folder)
        if not fs.exists(path):
            continue
        files = fs.listFiles(path, True)
        while files.hasNext():
            status = files.next()
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(found)


def _digest(value) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def _source_folder(spark: SparkSession, source: str) -> str:
    path, fs = _path(spark, source)
    return f"{shared_root(spark)}/catalogue/{_digest(fs.makeQualified(path).toString())}"


def fetched_once(
    spark: SparkSession, source: str, folders: Sequence[str], selection: dict, build: Callable[[], DataFrame]
) -> DataFrame:
    """The copy of this selection of ``source``; ``build`` is called only where none is there yet.
    ``folders`` are the parts of the source that the selection reads, ``selection`` is plain data that tells
    one selection from another."""
    place = f"{_source_folder(spark, source)}/{_digest([file_versions(spark, folders), selection])}"
    path, fs = _path(spark, place)
    if not fs.exists(path):
        part = f"{place}.{uuid.uuid4().hex}.part"
        build().write.parquet(part)
        moved = not fs.exists(path) and fs.rename(_path(spark, part)[0], path)
        if not moved or fs.exists(_path(spark, f"{place}/{part.rsplit('/')[-1]}")[0]):
            # Another session was first; a late move may have put this copy inside that one.
            for late in (part, f"{place}/{part.rsplit('/')[-1]}"):
                fs.delete(_path(spark, late)[0], True)
    return spark.read.parquet(place)


def release(spark: SparkSession, source: str | None = None) -> None:
    """Remove the copies made of ``source``, or all of them.  Frames that read them are of no use afterwards."""
    path, fs = _path(spark, _source_folder(spark, source) if source else f"{shared_root(spark)}/catalogue")
    fs.delete(path, True)
