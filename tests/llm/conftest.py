import random

import pytest

#: Columns of the odd documents beyond those of the table: names that operators use inside.
CLASHING = ["block", "code", "word", "words", "ids", "node", "core", "span", "spans", "_spans", "anchor", "value", "doc", "key", "good", "matches", "a", "b", "component_id", "kept", "n", "check"]


def prose(draw, n, vocabulary=300):
    names = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(vocabulary)]
    return " ".join(draw.choice(names) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty, blank and long texts, copies, near copies, shared passages, marks."""
    draw = random.Random(11)
    passage = prose(draw, 120)
    base = prose(draw, 300, 900).split()
    near = [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (20, 150, 290)]
    far = " ".join(base[:200] + prose(draw, 200).split())
    texts = [
        None,
        "",
        " \n\t\r ",
        "x",
        "One two",
        "one TWO",
        passage,
        "start " + passage + " end " + prose(draw, 30),
        prose(draw, 50) + "\n" + passage + "\n" + passage,
        " ".join(base),
        *near,
        far,
        far,
        prose(draw, 9000, 4000),
        "ab" * 700,
        "é́ü ß 日本語 😀 x\x1cy\x85z​" * 30,
        "1 2 3 !!! ... ---",
        "a" * 3000,
        "word " * 900,
        "The  quick\n\nbrown   fox's 12345 'll <|endoftext|> don't\t\tstop \n x ",
        "12 + 13 = 25",
    ]
    rows = [(10 * i + 3, t) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7], (9001, passage)]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    """The rows as a table on disk, with extra columns of clashing names."""
    from areaindex.sources import land

    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    data = [(d, t, "en" if i % 3 else None, None, None, *["?"] * len(CLASHING)) for i, (d, t) in enumerate(odd_rows)]
    df = spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")
    return land(df.repartition(3), "odd")


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    from areaindex.sources import land

    return land(odd_documents.limit(0), "none")
