import math
import zlib
from collections import Counter

import pytest

from areaindex.llm import language_id
from areaindex.llm.queries import QUERIES
from conftest import SF


def code_length(text, teaching, order):
    """Plain PPM with escapes of method C, frozen."""
    counts = {}
    for t in teaching:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                counts.setdefault(t[i - k : i], Counter())[t[i]] += 1

    def bits(context, byte):
        if (own := counts.get(context)) is not None:
            n, d = sum(own.values()), len(own)
            if own[byte]:
                return -math.log2(own[byte] / (n + d))
            escape = -math.log2(d / (n + d))
        else:
            escape = 0.0
        return escape + (bits(context[1:], byte) if context else 8.0)

    return sum(bits(text[max(0, i - order) : i], text[i]) for i in range(len(text)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_code_lengths_are_exact(spark, order):
    rows = [(1, "the cat and the hat", "en"), (2, "das ist der Hut", "de"), (3, "a", "en"), (4, "", "de"), (5, None, "en"), (6, "über", "de"), (7, "le chat", None)]
    counts = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), order, 10**9)
    coder = language_id.Coder(counts, order)
    assert coder.langs == ["de", "en"]
    texts = [b"the hat", b"der Hut", b"", "ä\x00z".encode(), b"t", b"that that"]
    bits = coder.code_lengths(texts)
    for text, row in zip(texts, bits, strict=True):
        for lang, got in zip(coder.langs, row, strict=True):
            teaching = [t.encode() for _, t, l in rows if l == lang and t]
            assert got == pytest.approx(code_length(text, teaching, order), rel=1e-5, abs=1e-5)


def test_held_out_accuracy(spark):
    got = QUERIES["op3_language_id"](spark, SF)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = got.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(rows) == len(langs) and sum(held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_do_not_see_the_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = language_id.train(docs)
    one = language_id.predict(docs, counts).collect()
    other = language_id.predict(docs.select("doc_id", "text"), counts).collect()
    assert sorted(one) == sorted(other)


def test_odd_documents(odd_documents, odd_rows):
    got = {r.doc_id: r for r in language_id.language_predictions(odd_documents).collect()}
    for doc_id, text in odd_rows:
        und = not any(map(str.isalpha, text or ""))
        assert (got[doc_id].lang_pred == "und") == und and (got[doc_id].score == 0) == und


def test_nothing_to_learn_from(spark, no_documents):
    assert language_id.language_predictions(no_documents).count() == 0
    df = spark.createDataFrame([(1, "text", None), (None, "more", "en")], "doc_id long, text string, lang string")
    assert {(r.held_out, r.lang_pred, r.score) for r in language_id.language_predictions(df).collect()} == {(False, "und", 0.0)}


def test_ties_go_to_the_smallest_name(spark):
    df = spark.createDataFrame([(1, "same", "b"), (2, "same", "a")], "doc_id long, text string, lang string")
    counts = language_id.train(df)
    assert {(r.lang_pred, r.score) for r in language_id.predict(df, counts).collect()} == {("a", 0.5)}


def test_training_is_a_bounded_sample(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'w' as text", "'en' as lang")
    total = sum(n for _, _, n in language_id.train(df, 3, 100))
    assert 50 <= total <= 170


def test_every_language_teaches(spark):
    df = spark.range(10_050).selectExpr("id as doc_id", "'w' as text", "concat('l', id) as lang")
    assert len({lang for lang, _, _ in language_id.train(df)}) == 10_050


def test_rejection_keeps_the_rest(odd_documents, odd_rows):
    got = language_id.keep_known_languages(odd_documents)
    assert got.columns == odd_documents.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(d for d, t in odd_rows if any(map(str.isalpha, t or "")))
