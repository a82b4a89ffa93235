import random

from llm import brute
import pytest

from areaindex.llm import near_dedup
from areaindex.llm.graph import components


def result(df, **options):
    return [(r.doc_id, (r.n_shingles, r.component_id, r.kept)) for r in near_dedup.near_duplicates(df, **options).collect()]


def test_against_brute_force(odd_documents, odd_rows):
    got, want = result(odd_documents), brute.near_duplicates(odd_rows)
    assert len(got) == len(odd_rows) and dict(got) == want
    assert any(not kept for _, _, kept in want.values())


@pytest.mark.parametrize("seed", range(2))
def test_chains_of_edited_copies(spark, seed):
    """Copies of copies, so that the ends of a chain are far apart, beside a passage that all share."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    common = [word() for _ in range(60)]
    rows = []
    for chain in range(4):
        words = [word() for _ in range(160)]
        for step in range(9):
            rows.append((len(rows), " ".join(words + (common if chain % 2 else []))))
            for _ in range(draw.randint(1, 5)):
                words[draw.randrange(len(words))] = word()
    rows += [(len(rows) + i, " ".join([word() for _ in range(20)] + common)) for i in range(40)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert dict(result(df)) == brute.near_duplicates(rows)


def test_similar_only_to_a_member_that_never_led(spark):
    """Everything shares values, links are few: rounds of more leaders must find them."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    rows = []
    for i in range(30):
        own = list(base)
        for k in draw.sample(range(0, 100, 7), 6):
            own[k] = word()
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(result(df)) == brute.near_duplicates(rows)


def test_texts_contained_in_longer_ones(spark):
    """Sets of some 240 to 560 shingles, whose retained hashes reach past the middle of the range."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(7))
    rows = []
    for n in range(240, 570, 10):
        words = [word() for _ in range(n + 4)]
        inside = -(-n * draw.choice([751, 770, 800]) // 1000)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[: inside + 4]))]
    want = brute.near_duplicates(rows)
    assert sum(not kept for _, _, kept in want.values()) == len(rows) // 2
    assert dict(result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == want


def test_least_common_is_safe():
    need = near_dedup.least_common(64, 75)
    assert 20 <= need <= 32
    assert near_dedup.least_common(64, 100) == 64


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50, 90)] + [(7, i) for i in range(100, 160)] + [(3, 3), (None, 4), (160, 12), (12, 159)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 50 for i in range(50, 91)}, **{i: 7 for i in [7, 12, *range(100, 161)]}}


def test_empty_table(no_documents):
    assert result(no_documents) == []


def test_one_of_each_group_stays(odd_documents, odd_rows):
    got = near_dedup.remove_near_duplicates(odd_documents)
    kept = {d for d, (_, _, k) in brute.near_duplicates(odd_rows).items() if k}
    assert got.columns == odd_documents.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)  # of rows that share an id, one
