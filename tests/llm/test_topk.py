import math
import random

import pytest
from pyspark.sql import functions as F

from areaindex.llm import topk


def brute(rows, k, scale=1024):
    vectors = {}
    for vec_id, e in rows:
        if vec_id is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        v = [math.floor(scale * x) for x in e]
        vectors[vec_id] = min(v, vectors.get(vec_id, v))
    out = []
    for q in vectors:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def result(spark, rows, k, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("?") for c in ("v", "segment", "ids", "rank", "score")})
    got = topk.exact_top_k(df.repartition(3), F.col("vec_id") % 100 == 0, k, **options)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("options", [{}, {"segments": 4, "chunk": 50}, {"segments": 1}, {"query_block": 2}])
def test_against_brute_force(spark, options):
    draw = random.Random(1)
    centres = [[draw.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(600):
        c = centres[draw.randrange(4)]
        rows.append((i, [float(int(1000 * (x + draw.gauss(0, 0.3)))) / 1024 for x in c]))
    assert result(spark, rows, 10, **options) == brute(rows, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [9.0, 9.0])]
    rows += [(100, [1.0]), (5, []), (6, [-1.5, 0.25]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (200, [0.0, 0.0])]
    assert result(spark, rows, 3) == brute(rows, 3)
    assert result(spark, rows, 50) == brute(rows, 50)


def test_one_very_common_vector(spark):
    rows = [(i, [0.5, 0.25, 0.125]) for i in range(900)] + [(900 + i, [float(i % 7), -1.0, 0.5]) for i in range(150)]
    assert result(spark, rows, 10, chunk=200) == brute(rows, 10)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**21 + i), float(-(2**20) + 3 * i)]) for i in range(0, 300, 25)]
    assert result(spark, rows, 5) == brute(rows, 5)


def test_empty_table_and_no_queries(spark):
    assert result(spark, [], 10) == []
    assert result(spark, [(1, [1.0]), (2, [1.0])], 10) == []
    assert result(spark, [(100, [1.0])], 10) == []
