import math
import zlib
from collections import Counter

from llm import brute
import numpy as np
import pyarrow as pa
import pytest

from areaindex.llm import recurrent_lm as lm
from areaindex.llm.queries import QUERIES
from areaindex.llm.wordblocks import pack
from conftest import SF


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def base_scores(rows):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)}."""
    tokens = lambda t: [*brute.space_words(t), None]
    counts = Counter(w for d, t in rows if d is not None and not held_out(d) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for d, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own)
        out[d] = (held_out(d), len(own), sum(counts[w] > 0 for w in own), total, pytest.approx(base, rel=1e-9))
    return out


def test_base_against_brute_force(odd_documents, odd_rows):
    got = lm.score_documents(odd_documents).collect()
    assert len(got) == len(odd_rows)
    want = base_scores(odd_rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == want[r.doc_id]
        assert r.score < 0 and math.isfinite(r.score)


def test_held_out_documents_score_better_than_the_base(spark):
    rows = QUERIES["op7_recurrent_lm"](spark, SF).filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nothing_to_learn_from(spark, no_documents):
    assert lm.score_documents(no_documents).count() == 0
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score_documents(df).collect())
    assert got == [(1, 0, 0, 0.0), (3, 0, 0, 0.0)]


def test_every_training_document_teaches(spark, monkeypatch):
    """Each document has a word of its own; its input row must have moved, and its neighbours be counted."""
    words = [b"", b"the", *(f"w{i}".encode() for i in range(40))]
    docs = spark.createDataFrame([(i, f"the w{i} the w{i}") for i in range(40)], "doc_id long, text string").repartition(3)
    counted, cluster = [], lm.cluster
    monkeypatch.setattr(lm, "cluster", lambda cells, *rest: counted.extend(cells // (2 * len(words))) or cluster(cells, *rest))
    _, w = lm.train(docs, words, lambda which: np.full(lm.CLASSES, 1 / lm.CLASSES))
    start = lm.start_weights(len(words) + lm.ENDINGS, np.full(lm.CLASSES, 1 / lm.CLASSES))
    moved = (w["input"] != start["input"]).any(1)
    assert moved[1 : len(words)].all() and not moved[len(words) : -1].any()  # an end is never read
    assert set(counted) == set(range(len(words)))


def test_the_last_tokens_of_the_lanes_are_learned():
    start = lm.start_weights(60, np.array([0.5, 0.5]), 4)
    rows = [np.arange(40) for _ in range(100)] + [np.array([50, 51, 52])]
    w, n = lm.learn(start, rows, np.arange(60) % 2)
    assert n == 4003 and (w["input"][[50, 51]] != start["input"][[50, 51]]).any(1).all()


def test_counts_beyond_32_bits_come_back_whole():
    counts = [3, (1 << 32) - 1, (1 << 33) + 5, 0]
    words = pa.record_batch({"word": pa.array([b"a", b"b", b"c", b"d"]), "c": pa.array(counts), "blocks": [[5]] * 4, "codes": pa.array([[0], [1], [2], [3]], pa.list_(pa.int32()))})
    (packed,) = lm._send_back([words], [b"a", b"b", b"c", b"d"])
    sequences = pa.table({"doc_id": [1], "words": pa.array([pack(np.array([0, 1, 2], np.uint32))])})
    w = lm.start_weights(4, np.ones(1), 4)
    model = {"classes": np.zeros(4, np.int64), "weights": w, "sums": np.array([1 << 40])}
    (row,) = lm._score_block(sequences, pa.Table.from_batches([packed]), model, 0, 0).to_pylist()
    assert row["n_known"] == 3 and row["base_score"] == pytest.approx(sum(math.log10(c + 1) for c in counts), rel=1e-12)


def weights(n_items=7, classes=3, hidden=4):
    draw = np.random.default_rng(2)
    w = lm.start_weights(n_items, np.array([0.5, 0.3, 0.2]), hidden)
    return {k: (v + draw.standard_normal(v.shape) * 0.5).astype(np.float64) for k, v in w.items()}


def plain_loss(w, inputs, targets):
    """Sum over one stream, a step at a time."""
    state, loss = np.zeros((1, w["new"].shape[0])), 0.0
    for i, c in zip(inputs, targets, strict=True):
        if i == len(w["input"]) - 1:
            state = np.zeros_like(state)
        state, _ = lm.step(w, state, np.array([i]))
        loss -= lm.log_classes(w, state)[0, c]
    return loss


def test_gradients_against_differences(monkeypatch):
    """Whole-window backpropagation, read off the update of a step with a plain rule."""
    w = weights()
    inputs, targets = [7, 2, 3, 7, 1, 0], [0, 2, 1, 1, 0, 2]
    before = {k: v.copy() for k, v in w.items()}
    memory = {k: np.full_like(v, 1e12) for k, v in w.items()}  # dividing by a constant 1e6
    state = np.zeros((1, 4))
    lm._learn_window(w, memory, state, np.array(inputs)[:, None], np.array(targets)[:, None], 1.0)
    scale = 1e6 * math.sqrt(len(targets))
    for k in before:
        step = (before[k] - w[k]) * scale
        for at in list(np.ndindex(before[k].shape))[:: max(1, before[k].size // 12)]:
            high, low = ({n: v.copy() for n, v in before.items()} for _ in range(2))
            high[k][at] += 1e-5
            low[k][at] -= 1e-5
            slope = (plain_loss(high, inputs, targets) - plain_loss(low, inputs, targets)) / 2e-5
            assert step[at] == pytest.approx(slope, rel=2e-3, abs=1e-4), (k, at)


def test_scores_of_a_batch_equal_single_documents():
    w = weights()
    classes = np.array([0, 1, 2, 0, 1, 2, 0])
    draw = np.random.default_rng(4)
    sizes = np.array([1, 9, 3, 3, 200, 1])
    items = draw.integers(0, 7, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    got = lm.class_scores(w, classes, items, starts, sizes)
    for g, a, n in zip(got, starts, sizes, strict=True):
        own = items[a : a + n]
        want = -plain_loss(w, [7, *own[:-1]], classes[own]) / math.log(10)
        assert g == pytest.approx(want, rel=1e-6)


def test_classes_are_a_distribution():
    w = weights()
    state, _ = lm.step(w, np.zeros((5, 4)), np.arange(5))
    assert np.exp(lm.log_classes(w, state)).sum(1) == pytest.approx(np.ones(5))


def test_learning_lowers_the_loss():
    classes = np.array([0, 1, 2])
    rows = [np.array([0, 1, 2] * 40) for _ in range(30)]
    start = lm.start_weights(3, np.array([1 / 3] * 3), 8)
    w, n = lm.learn(start, rows, classes)
    sizes = np.array([120])
    one, two = (lm.class_scores(x, classes, rows[0], np.array([0]), sizes)[0] for x in (start, w))
    assert n > 3000 and two > 0.6 * one


def test_neighbours_stay_in_their_document(spark):
    docs = spark.createDataFrame([("a b",), ("",), ("b a b",), ("z",)], "text string").coalesce(1)
    words = [lm.END, b"a", b"b"]
    rows = docs.mapInArrow(lambda it: lm._neighbours(it, words), "cell long, times long").collect()
    items, counts = lm.Items(words), {}
    for r in docs.collect():
        row = items.row((r.text or "").encode()).tolist()
        for x, y in zip(row, row[1:]):
            for item, side, other in ((y, 0, x), (x, 1, y)):
                if other < 3:
                    cell = item * 6 + side * 3 + other
                    counts[cell] = counts.get(cell, 0) + 1
    assert {r.cell: r.times for r in rows} == counts


def test_one_class_of_each_state():
    w = lm.start_weights(3, np.array([0.2, 0.3, 0.5]), 4)
    state, classes = np.random.default_rng(1).standard_normal((5, 4)).astype(np.float32), np.array([0, 2, 1, 1, 0])
    assert np.allclose(lm.log_class(w, state, classes), lm.log_classes(w, state)[np.arange(5), classes], atol=1e-6)
