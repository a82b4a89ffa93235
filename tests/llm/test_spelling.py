import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from areaindex.llm import spelling
from areaindex.llm.common import land
from llm.brute import LOWER


def near(a, b):
    """One code point inserted, deleted or replaced, told by the plain definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    around = defaultdict(list)
    for a in words:
        for b in words:
            if near(a, b):
                around[a].append(b)
    forms = {}
    for w in words:
        best = min(around[w], key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(around[w]), words.get(forms.get(w))))
    return sorted(out)


def counts_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for word in re.findall("[A-Za-z\u00c0-\u00ff]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return counts


@pytest.fixture
def grouped(spark):
    def run(counts):
        words = land(spark.createDataFrame(sorted(counts.items()), "word string, n long"), "words")
        return sorted(map(tuple, spelling.group_variants(words).collect()), key=lambda r: r[0])

    return run


@pytest.mark.parametrize("seed", range(4))
def test_every_pair_is_found(grouped, seed):
    """Few letters, so that words are repetitive and bigrams common."""
    draw = random.Random(seed)
    letters = ["ab", "abc", "abcdefghij", "a\u00e9\u00d7z"][seed]
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(7, 10))) for _ in range(150)}
    for word in list(words):
        i, c = draw.randrange(len(word)), draw.choice(letters)
        words |= {w for w in (word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]) if len(w) >= 7}
    words |= {"a" * n for n in (7, 8, 9, 3000, 3001)}
    counts = {w: draw.choice((2, 3, 20, 30, 300, 4000)) for w in words}
    assert grouped(counts) == variants(counts)


def test_every_edit_of_a_word(grouped):
    for word in ("abcdefgh", "aaaaaaa", "abababab", "aabbaabb"):
        words = {word}
        for i in range(len(word) + 1):
            for c in "abx":
                words |= {word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]}
        counts = {w: 2 + 30 * (w == word) for w in words if len(w) >= 7}
        assert grouped(counts) == variants(counts)


def test_forms_and_roots_are_followed_to_the_last(grouped):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20_000, "abcdefx": 3, "abcdefy": 19}
    got = {r[0]: r for r in grouped(counts)}
    assert got["abcdefg"][:3] == ("abcdefg", "abcdefgh", "abcdefghijk") and got["abcdefy"][1] is None
    assert grouped(counts) == variants(counts)


def test_ties_take_the_first_in_code_point_order(grouped):
    got = {r[0]: r[1] for r in grouped({"abcdefg": 2, "abcdefz": 50, "abcdefgh": 50, "\u00e9bcdefg": 50, "bcdefgh": 2})}
    assert got["abcdefg"] == "abcdefgh"


def test_pivots_are_disjoint_and_rare():
    order = {"ab": (0, 1), "bc": (1, 2), "cd": (2, 3), "de": (3, 9), "ef": (4, 9), "fg": (5, 9)}
    assert spelling.pivots("abcdefg", order) == ([0, 1, 2], [0, 2], (2 << 32) + 2)
    assert spelling.pivots("aaaaaaa", {"aa": (0, 6)}) == ([0, 1, 2, 3], [0, 2], 2)


def test_counts_of_odd_documents(spark, odd_documents, odd_rows):
    got = {r.word: r.n for r in spelling.count_words(odd_documents).collect()}
    assert got == {w: n for w, n in counts_of(odd_rows).items() if len(w) >= 7 and n >= 2}


def test_variants_of_odd_documents(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdef\u00e9") for _ in range(draw.randint(6, 11))) for _ in range(60)]
    rows = [(None if i % 9 == 0 else i % 40, " ".join(draw.choice(words) for _ in range(60))) for i in range(200)]
    rows += [(None, None), (3, ""), (4, "LETTERS\u00c9 letters\u00c9 letters\u00e9 letters\u00e9 \u00d7\u00f7\u00d7\u00f7\u00d7\u00f7\u00d7 \u00d7\u00f7\u00d7\u00f7\u00d7\u00f7\u00d7"), (5, "\U0001f600letters1letters")]
    df = land(spark.createDataFrame([(d, t, "?", "?") for d, t in rows], "doc_id long, text string, word string, n string"), "odd")
    assert sorted(map(tuple, spelling.spelling_variants(df).collect()), key=lambda r: r[0]) == variants(counts_of(rows))


def test_counts_handed_on_early(spark, odd_documents, monkeypatch):
    want = {r.word: r.n for r in spelling.count_words(odd_documents).collect()}
    monkeypatch.setattr(spelling, "HELD", 3)
    assert {r.word: r.n for r in spelling.count_words(odd_documents).collect()} == want


def test_empty_tables(no_documents, grouped):
    assert spelling.spelling_variants(no_documents).count() == 0
