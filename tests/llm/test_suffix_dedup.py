import random
import weakref

from llm import brute
import pyarrow as pa
import pytest

from areaindex.llm import common, suffix_dedup

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def digests(df, **options):
    return sorted(tuple(r) for r in suffix_dedup.dedup_digests(df, **options).select(*COLUMNS).collect())


def test_against_brute_force(odd_documents, odd_rows):
    want = sorted(brute.repeats(odd_rows))
    assert any(r[2] for r in want) and any(not r[2] for r in want)
    assert digests(odd_documents) == want


def test_by_a_shuffle_join_as_well(odd_documents, odd_rows, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_CELLS", -1)
    assert digests(odd_documents) == sorted(brute.repeats(odd_rows))


@pytest.mark.parametrize("seed", range(4))
def test_edges_of_repeats(spark, seed):
    """Passages of 380 to 460 bytes, cut and joined at random, over few and many letters."""
    draw = random.Random(seed)
    letters = "ab" if seed == 0 else "abcdefghijklmnopqrstuvwxyz é"
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    shared = [text(draw.randint(380, 460)) for _ in range(6)]
    rows = []
    for i in range(30):
        parts = []
        for _ in range(draw.randint(0, 3)):
            s = draw.choice(shared)
            a = draw.randint(0, 30)
            parts += [text(draw.randint(0, 50)), s[a : len(s) - draw.randint(0, 30)]]
        rows.append((i, "".join(parts) + text(draw.randint(0, 300))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert digests(df) == sorted(brute.repeats(rows))


def test_rows_without_an_id_or_with_a_repeated_one(spark):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("abcdefghijklmnop ") for _ in range(n))
    one, two, three = text(430), text(500), text(410)
    rows = [(1, text(90) + one), (None, one + text(70)), (None, text(20) + two), (None, two), (7, three + text(30)), (7, text(600) + three), (7, text(450)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(brute.repeats(rows), key=repr)
    assert sum(r[2] > 0 for r in want) == 6
    assert sorted((tuple(r) for r in suffix_dedup.dedup_digests(df).select(*COLUMNS).collect()), key=repr) == want
    kept = [brute.cut((t or "").encode(), s).decode() if t is not None else None for (_, t), s in zip(rows, brute.spans([(t or "").encode() for _, t in rows]), strict=True)]
    got = [(r.doc_id, r.text) for r in suffix_dedup.remove_repeats(df).collect()]
    assert sorted(got, key=repr) == sorted(((d, k) for (d, _), k in zip(rows, kept, strict=True)), key=repr)


def test_anchors_depend_on_the_window_alone():
    import numpy as np

    draw = np.random.default_rng(1)
    body = draw.integers(97, 100, 1500).astype(np.uint8)
    one = suffix_dedup.anchors_of_windows(body)
    two = suffix_dedup.anchors_of_windows(np.concatenate([draw.integers(97, 100, 777).astype(np.uint8), body]))
    assert (two[777:] - 777 == one).all()


def test_long_texts_are_cut_in_slices(monkeypatch, odd_documents, odd_rows):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    assert digests(odd_documents) == sorted(brute.repeats(odd_rows))


def test_empty_table(no_documents):
    assert digests(no_documents) == []


def test_removal_keeps_columns_and_rows(odd_documents, odd_rows):
    got = suffix_dedup.remove_repeats(odd_documents)
    assert got.dtypes == odd_documents.dtypes
    texts = [(t or "").encode() for _, t in odd_rows]
    want = {d: brute.cut(b, s).decode("utf-8", "ignore") if t is not None else None for (d, t), b, s in zip(odd_rows, texts, brute.spans(texts), strict=True)}
    assert {r.doc_id: r.text for r in got.collect()} == want and got.count() == len(odd_rows)


def test_texts_are_cut_a_few_at_a_time():
    """A batch of Spark's is cut in parts of bounded size, whose texts and copies a worker holds."""
    n, text = 64, "x" * (suffix_dedup.CUT_BYTES // 16)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [text] * n, "_spans": [[{"a": 0, "b": i}] for i in range(n)]})
    cut = list(suffix_dedup._kept_texts(iter([batch]), "_spans"))
    assert len(cut) > 2 and max(b.nbytes for b in cut) < 2 * suffix_dedup.CUT_BYTES
    assert [t for b in cut for t in b.column("text").to_pylist()] == [text[i:] for i in range(n)]
    assert [i for b in suffix_dedup._digests(iter([batch.rename_columns(["doc_id", "text", "spans"])])) for i in b.column("doc_id").to_pylist()] == list(range(n))


def test_memory_goes_back_once_a_task_has_dropped_its_own(monkeypatch):
    class Held:
        pass

    def task():
        held = Held()
        gone.append(weakref.ref(held))
        yield 1

    gone, left = [], []
    monkeypatch.setattr(common, "release_memory", lambda: left.append(gone[0]()))
    assert list(common.trimmed(task())) == [1] and left == [None]
