import hashlib
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from areaindex.llm import pair_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def spec():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def library(spec):
    return Tokenizer.from_str(spec)


def encoder_of(spec):
    return pair_bpe.PairEncoder(pair_bpe.Vocabulary(spec))


def ids_of(encoder, docs):
    return encoder.encode(pa.array(docs)).to_pylist()


def test_ids_and_text_equal_the_library(odd_documents, odd_rows, library):
    decoded = pair_bpe.decode(pair_bpe.encode(odd_documents, PATH), PATH)
    got = sorted((r.doc_id, tuple(r.ids), r.decoded) for r in decoded.collect())
    want = [(d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t in odd_rows]
    assert got == sorted((d, ids, library.decode(list(ids), skip_special_tokens=False)) for d, ids in want)


def test_digests(odd_documents, odd_rows, library):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    want = []
    for doc_id, text in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, pair_bpe.encoding_digests(odd_documents, PATH).collect())) == sorted(want)


def test_every_character_beside_letters_and_marks(spec, library):
    docs = ["a{0}b {0}! x{0}'{0} {0}'s".format(chr(c)) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    got = ids_of(encoder_of(spec), docs)
    assert [d for d, g, e in zip(docs, got, library.encode_batch(docs, add_special_tokens=False), strict=True) if g != e.ids] == []


def test_random_texts(spec, library):
    draw = random.Random(3)
    pool = "aA\u0130\u00e9\u01c5\u00dfsK\u03a3\u03c3'sStT\u0307\u0345\u4e00 12\u00bd   \x85\x1c\n.,!?<|>\ufb01\ud55c\u200d\U0001f600"
    docs = ["".join(draw.choice(pool) for _ in range(draw.randint(0, 40))) for _ in range(10_000)]
    docs += ["x<|endoftext|>\u0130! <|STARTOFTEXT|>y <|startoftext|><|endoftext|>", "a" * 5000, "ab" * 3000]
    encoder = encoder_of(spec)
    got = ids_of(encoder, docs[:100]) + ids_of(encoder, docs[100:])
    assert got == [e.ids for e in library.encode_batch(docs, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(6))
def test_any_order_of_merges(spec, seed):
    """Vocabularies whose merges come before those that made their parts, or that make a token twice."""
    draw = random.Random(seed)
    own = json.loads(spec)
    tokens, merges = list("abc") + [c + "</w>" for c in "abc"], []
    for _ in range(40):
        a, b = draw.choice(tokens), draw.choice(tokens)
        if not a.endswith("</w>") and len(a + b) < 14 and [a, b] not in merges:
            merges.append([a, b])
            tokens += [a + b] if a + b not in tokens else []
    draw.shuffle(merges)
    own["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
    own["added_tokens"] = []
    docs = ["".join(draw.choice("aabbc ") for _ in range(60)) for _ in range(300)]
    want = [e.ids for e in Tokenizer.from_str(json.dumps(own)).encode_batch(docs, add_special_tokens=False)]
    assert ids_of(encoder_of(json.dumps(own)), docs) == want


def test_remembered_words_are_bounded(spec, library, monkeypatch):
    monkeypatch.setattr(pair_bpe, "REMEMBERED", 3)
    encoder = encoder_of(spec)
    for text in ("one two three four", "five one", "two, two", ""):
        assert ids_of(encoder, [text]) == [library.encode(text, add_special_tokens=False).ids]


def test_unfit_vocabularies_are_an_error(spark, spec, tmp_path, odd_documents):
    own = json.loads(spec)
    own["model"]["dropout"] = 0.1
    (tmp_path / "own.json").write_text(json.dumps(own))
    with pytest.raises(ValueError, match="dropout"):
        pair_bpe.encode(odd_documents, str(tmp_path / "own.json"))


def test_unknown_and_null_ids(spark):
    df = spark.createDataFrame([(1, [999_999, 320]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in pair_bpe.decode(df, PATH).collect()} == {1: "a</w>", 2: ""}


def test_empty_table(no_documents):
    assert pair_bpe.encode(no_documents, PATH).count() == 0
