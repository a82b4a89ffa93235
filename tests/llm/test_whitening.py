import numpy as np
import pytest

from areaindex.llm import whitening
from areaindex.llm.common import documents, land
from conftest import SF


def expected(vectors, components=32):
    """n, exact deviations, eigenvalues, their share, and whitened rows by the library's solver."""
    x = np.floor(64 * np.array(vectors, float)).astype(object).astype(int) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    c = x - sums / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:components] > 1e-9 * max(values[0], 1e-300)).sum())
    deviations = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return n, deviations, values[:kept] / values.sum(), c @ axes[:, :kept] / np.sqrt(values[:kept])


def check(rows, ids, vectors, components=32):
    n, deviations, share, white = expected(vectors, components)
    assert len(rows) == len(ids) * len(share)
    assert {r.n for r in rows} <= {n} and len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    rows = sorted(rows, key=lambda r: (r.component, repr(r.vec_id), r.deviation, r.whitened))
    for k in range(len(share)):
        mine = [r for r in rows if r.component == k + 1]
        assert mine[0].explained == pytest.approx(share[k], rel=1e-9)
        order = sorted(range(len(ids)), key=lambda i: (repr(ids[i]), deviations[i], white[i, k]))
        got = np.array([r.whitened for r in mine])
        turned = sorted(range(len(ids)), key=lambda i: (repr(ids[i]), deviations[i], -white[i, k]))
        assert np.abs(got - white[order, k]).max() < 1e-7 or np.abs(got + white[turned, k]).max() < 1e-7
        assert [r.deviation for r in mine] == [deviations[i] for i in order]


def test_given_table(spark):
    df = documents(spark, SF, "embeddings")
    table = df.toPandas()
    check(whitening.whiten(df).collect(), table.vec_id.tolist(), table.embedding.tolist())


def test_odd_rows_take_no_part(spark):
    draw = np.random.default_rng(4)
    good = [(int(i % 17) if i % 5 else None, draw.normal(size=6).tolist()) for i in range(60)]
    good += [good[3], good[3]]
    bad = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [float("nan")] * 6), (904, [1.0] * 5 + [float("-inf")]), (905, [3.0, 4.0])]
    data = [(i, v, 1, "?", 2.0) for i, v in good + bad]
    df = spark.createDataFrame(data, "vec_id int, embedding array<float>, n int, vector string, component double").repartition(3)
    vectors = [np.float32(v).tolist() for _, v in good]
    check(whitening.whiten(df).collect(), [i for i, _ in good], vectors)


def test_fewer_components_and_lower_rank(spark):
    draw = np.random.default_rng(5)
    flat = np.round(draw.normal(size=(40, 3)) * 8) @ np.round(draw.normal(size=(3, 8)) * 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], "vec_id long, embedding array<double>")
    check(whitening.whiten(df).collect(), list(range(40)), flat.tolist())
    assert {r.component for r in whitening.whiten(df, components=2).collect()} == {1, 2}


def test_no_spread_and_no_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [0.5]), (2, [0.5])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_deviations_are_exact_or_an_error(spark):
    schema = "vec_id long, embedding array<double>"
    near = [(1, [1e6, 0.0]), (2, [-1e6, 5e5]), (3, [7.0, 0.0])]
    check(whitening.whiten(spark.createDataFrame(near, schema)).collect(), [1, 2, 3], [v for _, v in near])
    far = spark.createDataFrame([(1, [3e7, 0.0]), (2, [-3e7, 1.0])] * 8, schema)
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whiten(far).collect()
    with pytest.raises(Exception, match="beyond 2"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], schema)).collect()


def turned(values, seed):
    draw = np.random.default_rng(seed)
    axes, _ = np.linalg.qr(draw.normal(size=(len(values), len(values))))
    matrix = axes @ np.diag(values) @ axes.T
    return (matrix + matrix.T) / 2


@pytest.mark.parametrize(
    "values",
    [[1.0], [2.0, 2.0], [5.0, 5.0, 5.0, 1.0, 0.0, 0.0], np.arange(20.0), 10.0 ** -np.arange(12), [1 + 1e-13, 1.0, 1 - 1e-13, 0.5], [7.0] * 9, [0.0, 0.0]],
)
def test_spectrum(values):
    matrix = turned(np.array(values), 1)
    found, axes = whitening.leading_spectrum(matrix, 32)
    true = np.sort(values)[::-1]
    scale = max(true[0], 1e-300)
    assert len(found) == (true > 1e-11 * scale).sum() or len(found) >= (true > 1e-13 * scale).sum()
    assert np.abs(found - true[: len(found)]).max(initial=0) < 1e-13 * scale * len(true)
    assert np.abs(axes @ axes.T - np.eye(len(found))).max(initial=0) < 1e-13
    assert np.abs(matrix @ axes.T - axes.T * found).max(initial=0) < 1e-12 * scale


@pytest.mark.parametrize("seed", range(5))
def test_inertia_counts(seed):
    draw = np.random.default_rng(seed)
    matrix = turned(draw.normal(size=int(draw.integers(1, 30))), seed)
    matrix[0, 0] = 0.0  # blocks of two rows are needed where the diagonal is small
    true = np.linalg.eigvalsh(matrix)
    for shift in np.append(draw.normal(size=20), [0.0, *(true + 1e-10), *(true - 1e-10)]):
        assert whitening.inertia_above(matrix, float(shift)) == (true > shift).sum()
    assert whitening.inertia_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
