import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from areaindex.llm import token_files
from areaindex.sources import scratch_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


def test_files_hold_the_ids_in_order(spark, odd_documents, odd_rows):
    manifest = token_files.write_token_files(odd_documents, scratch_dir(spark, "tokens"), PATH)
    assert {r.path.rsplit(".")[-1] for r in manifest.collect()} == {"pfor"}
    got = sorted((r.doc_id, r.start, list(r.ids)) for r in token_files.read_token_files(manifest).collect())
    assert got == expected(odd_rows)


def test_digests(odd_documents, odd_rows):
    got = sorted(tuple(r) for r in token_files.token_file_digests(odd_documents, PATH).collect())
    assert got == [(d, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, ids in expected(odd_rows)]


def test_null_ids_come_first(spark):
    df = spark.createDataFrame([(4, "b"), (None, "a a"), (None, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.token_file_digests(df, PATH).collect())
    assert [g[1] for g in got] == [None, None, 4] and sum(g[2] for g in got) == 6


def test_empty_table(no_documents):
    assert token_files.token_file_digests(no_documents, PATH).count() == 0


def test_every_letter_before_every_mark():
    """The ids of words must be the library's, whatever the letter and the mark behind it."""
    with open(PATH, encoding="utf-8") as file:
        words = token_files.WordIds(file.read())
    library = Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(0x20000) if chr(c).isalpha()]
    docs = [" ".join(f"a{c}{m} {c}{m}{m} {c}{m}b" for m in token_files.MARKS + "'\u0307") for c in letters]
    draw = random.Random(2)
    pool = "aAZ\u0130\u00e9\u01c5\u00dfsK\u03a3'stT\u0307\u0345\u4e00 12\u00bd   \x85\x1c\n.,!?<|>\ufb01\ud55c\u200d\U0001f600"
    docs += ["".join(draw.choice(pool) for _ in range(draw.randint(0, 40))) for _ in range(10_000)]
    sizes, ids = words.encode([d.encode() for d in docs], token_files.END_ID)
    ends = np.cumsum(sizes)
    got = [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    want = [[*e.ids, token_files.END_ID] for e in library.encode_batch(docs, add_special_tokens=False)]
    assert [d for d, g, w in zip(docs, got, want, strict=True) if g != w] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=400), st.sampled_from([0, 50, 90, 100]))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    data = token_files.pack_block(ids, percentile)
    assert token_files.unpack_block(b"xyz" + data, 3).tolist() == values


def test_outliers_are_exceptions_and_do_not_widen_the_block():
    ids = np.full(1000, 7, np.uint32)
    ids[::50] = 4_000_000_000
    assert len(token_files.pack_block(ids)) < 20 * 6 + 64


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_any_range_of_ids_can_be_read(block):
    ids = (np.arange(1000) * 7919 % 50_000).astype(np.uint32)
    out = Memory()
    writer = token_files.ShardWriter(out, block)
    writer.write([5, None], np.array([300, 0]), ids[:300])
    writer.write([9], np.array([700]), ids[300:])
    assert writer.close() == (3, 1000)
    shard = token_files.ShardReader(out, block)
    assert (shard.doc_ids.tolist(), shard.nulls.tolist(), shard.ends.tolist()) == ([5, 0, 9], [False, True, False], [300, 300, 1000])
    for a, b in ((0, 1000), (0, 0), (299, 301), (999, 1000), (123, 777)):
        assert shard.ids(a, b).tolist() == ids[a:b].tolist()


def test_runs_of_marks_are_units_that_words_share(monkeypatch):
    with open(PATH, encoding="utf-8") as file:
        words = token_files.WordIds(file.read())
    alone, each = [], words._encode_each
    monkeypatch.setattr(words, "_encode_each", lambda w: alone.extend(w) or each(w))
    docs = ["ating### the%%% he%%% (no) don't x's. a<|endoftext|> <|endoftext|>. end,, **", "!", "\"it\" \u0130x. \u01c5,,"]
    sizes, ids = words.encode([d.encode() for d in docs], token_files.END_ID)
    tokenizer = Tokenizer.from_file(PATH)
    wanted = [[*tokenizer.encode(d, add_special_tokens=False).ids, token_files.END_ID] for d in docs]
    assert sizes.tolist() == list(map(len, wanted)) and ids.tolist() == sum(wanted, [])
    assert not {"ating###", "the%%%", "he%%%", "end,,"} & set(alone) and alone.count("%%%") == 1
