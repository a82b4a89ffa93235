from llm import brute
import pytest

from areaindex.llm import decontaminate

COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"]


@pytest.fixture(scope="module")
def items(odd_rows):
    long = next(t for _, t in odd_rows if t and len(t.split()) == 120)
    return [
        (1, " ".join(long.split()[10:40])),
        (2, " ".join(long.split()[30:60]).upper()),
        (2, "one two"),
        (3, "x"),
        (4, None),
        (5, " ... "),
        (None, "12 13 25"),
        (6, "word " * 20),
        (7, " ".join(long.split()[10:40])),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_against_brute_force(spark, odd_documents, odd_rows, items, block_bytes):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = odd_documents if block_bytes > 200 else odd_documents.dropDuplicates(["doc_id"])
    rows = odd_rows if block_bytes > 200 else list(dict.fromkeys(odd_rows))
    got = sorted(tuple(r) for r in decontaminate.contamination(docs, benchmark, block_bytes=block_bytes).select(*COLUMNS).collect())
    assert got == sorted(brute.contamination(rows, items))


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_rows_without_an_id_or_with_a_repeated_one(spark, odd_documents, odd_rows, items, block_bytes):
    """Each row stays one, of equal and of different texts, whatever the number of passes."""
    more = [(None, t) for _, t in odd_rows] + [(3, t) for _, t in odd_rows]
    docs = odd_documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark, block_bytes=block_bytes).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute.contamination(odd_rows + more, items), key=repr)


def test_matches_tell_their_places(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "a b " + " ".join(words[5:35]) + " c")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    (row,) = decontaminate.benchmark_matches(docs, benchmark).collect()
    assert [tuple(m) for m in row.matches] == [("9", 2, 5, 30)]


def test_empty_tables(spark, odd_documents, no_documents, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_documents, none).count() == 0
    got = decontaminate.contamination(odd_documents, none)
    assert got.count() == len(odd_rows) and got.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0


def test_removal_keeps_columns_and_clean_rows(spark, odd_documents, odd_rows, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.remove_contaminated(odd_documents, benchmark)
    assert kept.columns == odd_documents.columns
    bad = {r[0] for r in brute.contamination(odd_rows, items) if r[5]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in odd_rows if d not in bad)
