import math
import random

import pytest
from pyspark.sql import functions as F

from areaindex.llm import resample
from areaindex.llm.near_dedup import WordHashes


@pytest.fixture(scope="module")
def labels(spark, odd_rows):
    rows = [(d, int(i % 3 > 0), int(i % 5 == 0)) for i, (d, _) in enumerate(odd_rows[:15])]
    rows += [(odd_rows[0][0], 0, None), (None, 1, 0), (odd_rows[3][0], None, None), (10**9, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("good", F.lit("?"))


def brute(rows, labels, buckets, keep):
    good = {}
    for doc_id, quality, toxic in labels:
        if doc_id is not None and (quality is not None or toxic is not None):
            ok = quality == 1 and not toxic if quality is not None else not toxic or False
            ok = True if quality is None and not toxic else ok
            good[doc_id] = good.get(doc_id, True) and ok
    seen = WordHashes()
    grams = [resample.grams((t or "").encode(), seen, buckets) for _, t in rows]
    raw, target = [0] * buckets, [0] * buckets
    for (d, _), g in zip(rows, grams, strict=True):
        for b in g:
            raw[b] += 1
            target[b] += good.get(d, False)
    share = sum(target) / max(1, sum(raw))
    k = resample.SMOOTHING
    return [sum(math.log((target[b] + k) / (raw[b] * share + k)) for b in g) if sum(target) else 0.0 for g in grams]


def test_weights_against_brute_force(odd_documents, odd_rows, labels):
    got = resample.resample(odd_documents, labels, buckets=512).collect()
    plain = [tuple(r)[:3] for r in labels.collect()]
    want = dict(zip((d for d, _ in odd_rows), brute(odd_rows, plain, 512, 0.8), strict=True))
    assert len(got) == len(odd_rows)
    for r in got:
        assert r.log_weight == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-6)
    assert any(want.values())


def test_the_largest_keys_are_kept(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('w', id % 37, ' v', id % 11) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 37 < 20 as int) as quality", "0 as toxic").filter("doc_id % 2 = 0")
    for keep in (0.25, 0.8):
        rows = resample.resample(docs, labels, keep).collect()
        ranked = sorted(rows, key=lambda r: (-r.key, r.doc_id))
        assert {r.doc_id for r in rows if r.kept} == {r.doc_id for r in ranked[: math.ceil(keep * 3000)]}
        good = [r.kept for r in rows if r.doc_id % 37 < 20]
        assert sum(good) / len(good) > keep


def test_keys_are_weights_plus_gumbel_noise(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "'same words' as text")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    noise = [r.key - r.log_weight for r in resample.resample(docs, labels).collect()]
    mean = sum(noise) / len(noise)
    assert mean == pytest.approx(0.5772, abs=0.05)
    assert sum((x - mean) ** 2 for x in noise) / len(noise) == pytest.approx(math.pi**2 / 6, rel=0.1)


@pytest.mark.parametrize("values", ["spread", "ties", "one"])
def test_kth_largest(spark, values):
    draw = random.Random(6)
    data = {"spread": [draw.gauss(0, 1e3) for _ in range(2000)], "ties": [float(i % 3) for i in range(2000)], "one": [2.5] * 50}[values]
    df = spark.createDataFrame([(v,) for v in data], "v double")
    for k in (1, 7, len(data) // 2, len(data)):
        assert resample.kth_largest(df, "v", k, bins=16, few=20) == sorted(data, reverse=True)[k - 1]


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = resample.resample(docs, labels, keep=1.0).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, False), (1, True), (1, True), (2, True)]


def test_empty_tables(spark, odd_documents, no_documents, odd_rows, labels):
    assert resample.resample(no_documents, labels).count() == 0
    got = resample.resample(odd_documents, labels.limit(0)).collect()
    assert len(got) == len(odd_rows) and {r.log_weight for r in got} == {0.0}
