import base64
import hashlib
import weakref
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from areaindex.llm import byte_bpe, wordblocks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    with open(PATH, "rb") as file:
        assert ranks == {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block_words", [wordblocks.BLOCK_WORDS, 50])
def test_ids_equal_the_library(odd_documents, odd_rows, ranks, library, block_words):
    encoded = byte_bpe.encode(odd_documents, ranks, public_tokenizers.PATTERN, block_words)
    got = sorted(((r.doc_id, tuple(r.ids)) for r in encoded.collect()))
    assert got == sorted((d, tuple(library.encode_ordinary(t or ""))) for d, t in odd_rows)


def test_round_trip(odd_documents, odd_rows, ranks):
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(odd_documents, ranks, public_tokenizers.PATTERN), ranks).collect()}
    assert got == {d: (t or "").encode() for d, t in odd_rows}


def test_digests(odd_documents, odd_rows, ranks, library):
    got = {tuple(r) for r in byte_bpe.encoding_digests(odd_documents, ranks, public_tokenizers.PATTERN).collect()}
    want = set()
    for doc_id, text in odd_rows:
        ids = library.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.add((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert got == want


def test_units_of_every_kind_of_character(ranks, library):
    """The twin of the pattern must give the same matches, whatever the characters."""
    split = byte_bpe.splitter(public_tokenizers.PATTERN)
    encode = tiktoken.Encoding("one", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    marks = [chr(c) for c in [*range(1, 0xE80), *range(0x1680, 0x1690), *range(0x2000, 0x2190), 0x3000, 0x3021, 0xA6E6, 0x10107, 0x1F100, 0x3007, 0x4E00, 0xFEFF, 0x1D7D8, 0x1F600, 0x10FFFF]]
    for mark in marks:
        text = f"a{mark}b {mark}c  {mark}{mark} 1{mark}2{mark}\n x'{mark}s 's{mark}"
        ids = [i for w in split(text.encode()) for i in encode(w)]
        assert ids == library.encode_ordinary(text), hex(ord(mark))


def test_unknown_ids_are_an_error(spark, ranks):
    df = spark.createDataFrame([(1, [5]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.decoded) for r in byte_bpe.decode(df, ranks).collect()}[2] == b""
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>"), ranks).collect()


def test_empty_table(no_documents, ranks):
    assert byte_bpe.encode(no_documents, ranks, public_tokenizers.PATTERN).count() == 0


def test_packing():
    for values in ([], [0], [1, 70_000, 3, 2**31]):
        row = np.array(values, np.uint32)
        assert [c.tolist() for c in wordblocks.unpack(wordblocks.pack(row, row[::-1]))] == [values, values[::-1]]


def test_passes_over_different_documents_do_not_mix(spark, ranks):
    import pyarrow as pa

    from areaindex.llm import byte_bpe as bpe

    sequences = pa.table({"block": [1], "doc_id": [1], "words": [wordblocks.pack(np.array([0, 1], np.uint32))]})
    none = pa.table({"block": pa.array([], pa.int64()), "columns": pa.array([], pa.binary())})
    with pytest.raises(ValueError, match="repeatable"):
        bpe._put_together(sequences, none)


def test_a_worker_holds_one_block_at_a_time(monkeypatch):
    held = []

    class Watched(wordblocks.Block):
        def __init__(self):
            super().__init__()
            held.append(weakref.ref(self))

        def add(self, *document):
            assert sum(block() is not None for block in held) == 1
            super().add(*document)

    monkeypatch.setattr(wordblocks, "Block", Watched)
    monkeypatch.setattr(wordblocks.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(30)), "text": [f"a b c{i}" for i in range(30)]})
    for part in (wordblocks._dictionary, wordblocks._sequences):
        held.clear()
        rows = sum(b.num_rows for b in part(iter([batch]), bytes.split, wordblocks._never, 9))
        assert len(held) > 5 and rows >= 30
