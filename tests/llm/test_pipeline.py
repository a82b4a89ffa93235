"""The stages against the brute-force contracts, over the odd documents and the table."""

import hashlib

from llm import brute
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from areaindex.llm import byte_bpe
from areaindex.sources import scratch_dir
from conftest import SF


def plain(docs, items):
    docs = [(d, t) for d, t in docs if any(map(str.isalpha, t or ""))]
    groups = {}
    for i, (n, component, _) in brute.near_duplicates([(i, t) for i, (_, t) in enumerate(docs)]).items():
        groups.setdefault(component if n else (i,), []).append(i)
    docs = [docs[min(g, key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))] for g in groups.values()]
    texts = [t.encode() for _, t in docs]
    docs = [(d, brute.cut(b, s).decode("utf-8", "ignore")) for (d, _), b, s in zip(docs, texts, brute.spans(texts), strict=True)]
    bad = {r[0] for r in brute.contamination([(i, t) for i, (_, t) in enumerate(docs)], items) if r[5]}
    docs = [(d, t) for i, (d, t) in enumerate(docs) if i not in bad]
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t in docs:
        ids = library.encode_ordinary(t)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((d, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    return sorted(out, key=repr)


def folder(spark, documents, items):
    path = scratch_dir(spark, "tables")
    documents.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_odd_documents(spark, odd_documents, odd_rows):
    items = [(1, "word " * 20), (2, None)]
    got = corpus_pipeline.run(spark, folder(spark, odd_documents, items))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(odd_rows, items)


@pytest.mark.parametrize("turn", [1, -1])
def test_rows_that_share_an_id_or_have_none(spark, odd_rows, turn):
    """Each row goes by its own text, in any order of the rows."""
    texts = [t for _, t in odd_rows if t and len(t) > 300][:4]
    rows = [(1, texts[0]), (2, texts[0] + " more"), (1, "123 456"), (1, "hello world"), (None, "456"), (None, "789 x"), (None, None)]
    rows += [(5, "one two three"), (5, "other words"), (None, "one two three"), (7, texts[1]), (None, texts[1]), (7, texts[2]), (None, texts[3])]
    items = [(1, "one two three")]
    df = spark.createDataFrame(rows[::turn], "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    got = corpus_pipeline.run(spark, folder(spark, df.repartition(3), items))
    want = plain(rows, items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want and len(want) >= 6


def test_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, SF).collect()), key=repr)
    want = plain(docs, items)
    assert got == want and 0 < len(want) < len(docs)


def test_stages_keep_the_columns_and_take_the_rows_of_the_one_before(spark, odd_documents):
    path = folder(spark, odd_documents, [(1, "one two")])
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == odd_documents.columns, name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert {r.doc_id for r in out.select("doc_id").collect()} <= ids, name
        docs = out


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_empty_tables(spark, odd_documents, no_documents, empty):
    path = folder(spark, no_documents if empty == "documents" else odd_documents, [])
    assert (corpus_pipeline.run(spark, path).count() == 0) == (empty == "documents")
