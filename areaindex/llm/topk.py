"""Exact top-k by inner product with a three-phase uniform threshold.

Vectors are cut into SEGMENTS groups of components; a list is one segment of one chunk of vectors, and a
score is the sum over segments of partial scores.  For each query:

1. every list gives its k highest partial scores; the exact scores of these vectors give a cutoff, the
   k-th highest, that no result can be below;
2. the cutoff is shared out to thresholds that sum to it, the mean partial score of each segment plus an
   equal part of the rest.  A vector below the threshold in every segment is below the cutoff, so every
   list gives only its entries from there on;
3. vectors whose known parts and thresholds for the unknown ones can still reach the cutoff are scored
   exactly, and the k best stay, ties to the smaller id.

Queries are sent in blocks of QUERY_BLOCK, so a broadcast never grows with the data.  Of equal vectors in
a chunk only the k + 1 smallest ids can be in any result; the others leave when the chunk is made, so
one very common vector doesn't flood the lists.

Defined cases: vectors that are null, or hold a null or a non-finite component, and rows with a null
id take no part; rows that repeat an id are one vector (the smallest); a shorter vector counts as zero
in the missing components; scores are exact while they fit 64 bits; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaindex.llm.common import land

SCALE = 1024
SEGMENTS = 2
CHUNK = 4096
QUERY_BLOCK = 2048


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as floor(scale * x)."""
    x = F.col("embedding")
    number = lambda e: e.cast("double").isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf"))
    usable = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, number))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def _bounds(width: int, segments: int) -> list[tuple[int, int]]:
    cuts = [width * s // segments for s in range(segments + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _chunks(batches, width, segments, k, chunk):
    for batch in batches:
        for i in range(0, batch.num_rows, chunk):
            part = batch.slice(i, chunk)
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, all_of = ids[order], _matrix(part.column("v").to_pylist(), width)[order]
            if width:
                _, which = np.unique(all_of, axis=0, return_inverse=True)
                by_class = np.argsort(which, kind="stable")
                first = np.concatenate([[0], np.flatnonzero(np.diff(which[by_class])) + 1])
                place = np.empty(len(ids), np.int64)
                place[by_class] = np.arange(len(ids)) - np.repeat(first, np.diff(np.concatenate([first, [len(ids)]])))
                ids, all_of = ids[place <= k], all_of[place <= k]
            for s, (a, b) in enumerate(_bounds(width, segments)):
                yield pa.RecordBatch.from_pydict(
                    {"segment": pa.array([s], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "parts": pa.array([np.ascontiguousarray(all_of[:, a:b]).tobytes()], pa.binary())}
                )


def _products(queries: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where every partial sum fits its 53 bits."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(parts).max(initial=0)) * max(1, parts.shape[1])
    if most < 1 << 53:
        return (queries.astype(np.float64) @ parts.astype(np.float64).T).astype(np.int64)
    return queries @ parts.T


def _each_list(batches, queries, width, segments):
    """(segment, query ids, vector ids, partial scores with the query's own vector marked) of each list."""
    query_ids = np.array([q for q, _ in queries], np.int64)
    matrix, bounds = _matrix([v for _, v in queries], width), _bounds(width, segments)
    for batch in batches:
        for s, ids, parts in zip(*(batch.column(c).to_pylist() for c in ("segment", "ids", "parts")), strict=True):
            ids, (a, b) = np.frombuffer(ids, np.int64), bounds[s]
            scores = _products(matrix[:, a:b], np.frombuffer(parts, np.int64).reshape(len(ids), b - a))
            yield s, query_ids, ids, scores, ids[None, :] == query_ids[:, None]


def _entries(s, query_ids, ids, scores, rows, columns):
    return pa.RecordBatch.from_pydict(
        {"query_id": query_ids[rows], "vec_id": ids[columns], "segment": pa.array(np.full(len(rows), s, np.int32)), "part": scores[rows, columns]}
    )


def _local_tops(batches, queries, width, segments, k):
    for s, query_ids, ids, scores, own in _each_list(batches, queries, width, segments):
        ranked = np.where(own, np.iinfo(np.int64).min, scores)
        n = min(k, len(ids))
        top = np.argpartition(-ranked.astype(np.float64), n - 1, axis=1)[:, :n]
        rows, columns = np.repeat(np.arange(len(query_ids)), n), top.ravel()
        other = ~own[rows, columns]
        yield _entries(s, query_ids, ids, scores, rows[other], columns[other])


def _above(batches, queries, thresholds, width, segments):
    floor = np.array([thresholds[q] for q, _ in queries], np.int64)
    for s, query_ids, ids, scores, own in _each_list(batches, queries, width, segments):
        rows, columns = np.nonzero((scores >= floor[:, s : s + 1]) & ~own)
        for i in range(0, len(rows), 1 << 18):
            yield _entries(s, query_ids, ids, scores, rows[i : i + (1 << 18)], columns[i : i + (1 << 18)])


ENTRY = "query_id long, vec_id long, segment int, part long"


def _exact(pairs: DataFrame, vectors: DataFrame, queries: list[tuple[int, list[int]]], spark) -> DataFrame:
    """The pairs with their scores."""
    asked = F.broadcast(spark.createDataFrame(queries, "query_id long, q array<long>"))  # one block
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda t, x: t + x)
    return pairs.join(vectors.hint("merge"), "vec_id").join(asked, "query_id").select("query_id", "vec_id", product.alias("score"))


def exact_top_k(rows: DataFrame, is_query, k: int, segments: int = SEGMENTS, scale: int = SCALE, query_block: int = QUERY_BLOCK, chunk: int = CHUNK) -> DataFrame:
    """For the rows where ``is_query`` holds (a condition on vec_id): query_id, rank from 1, vec_id, score."""
    spark = rows.sparkSession
    vectors = land(integer_vectors(rows, scale), "vectors")
    n, width = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sums = land(vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg((F.sum("x") / n).alias("mean")), "means")
    mean = np.zeros(width)
    for r in sums.collect():  # a row per component
        mean[r["at"]] = r["mean"]
    chunks = land(
        vectors.mapInArrow(lambda it: _chunks(it, width, segments, k, chunk), "segment int, ids binary, parts binary"), "chunks"
    )
    asked = vectors.filter(is_query)
    blocks = max(1, -(-asked.count() // query_block))
    parts = []
    for block in range(blocks):
        taken = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()  # about query_block
        queries = sorted((r["vec_id"], list(r["v"])) for r in taken)
        sent = spark.sparkContext.broadcast(queries)

        tops = chunks.mapInArrow(lambda it, sent=sent: _local_tops(it, sent.value, width, segments, k), ENTRY)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k a list, then few
        first = _exact(tops.select("query_id", "vec_id").distinct(), vectors, queries, spark)
        cutoff = dict(first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query_id", "score").collect())

        lowest = -(1 << 62)
        thresholds = {}
        for query_id, v in queries:
            if query_id not in cutoff:  # fewer than k others: all of them are results
                thresholds[query_id] = [lowest] * segments  # every entry is over it, in each segment
                continue
            q = _matrix([v], width)[0]
            means = [int(np.floor(q[a:b] @ mean[a:b])) for a, b in _bounds(width, segments)]
            share, odd = divmod(cutoff[query_id] - sum(means), segments)
            thresholds[query_id] = [m + share + (s < odd) for s, m in enumerate(means)]
        limits = spark.sparkContext.broadcast(thresholds)
        enough = chunks.mapInArrow(lambda it, sent=sent, limits=limits: _above(it, sent.value, limits.value, width, segments), ENTRY)

        floors = [(q, s, t if q in cutoff else None) for q, ts in thresholds.items() for s, t in enumerate(ts)]
        sure = spark.createDataFrame(floors, "query_id long, segment int, floor long")
        above = enough.join(F.broadcast(sure), ["query_id", "segment"]).groupBy("query_id", "vec_id")
        known = above.agg(F.sum(F.col("part") - F.col("floor")).alias("over"), F.count("*").alias("known"))
        # The floors sum to the cutoff, and an unknown part is at least one below its floor.
        able = known.filter(F.col("over").isNull() | (F.col("over") >= segments - F.col("known"))).select("query_id", "vec_id")
        last = _exact(land(able, "able"), vectors, queries, spark)
        ranked = last.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        parts.append(land(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
