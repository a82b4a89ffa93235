"""Byte-level BPE by a shuffle of distinct words.

Every text is cut into pre-tokens, and a document becomes a row of ranks in its block's dictionary (see
wordblocks.py), its positions.  The distinct pre-tokens of all blocks meet in one shuffle by word, where
each distinct one is encoded once; the ids go back to the blocks, and documents are put together
by position.  Decoding joins the token-byte table, whose size the vocabulary bounds.

Defined cases: a null text is empty and has no ids; every row of the input gives one row, also with a
null or repeated doc_id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import rebatch, release_memory, trimmed
from areaindex.llm.wordblocks import (
    BLOCK_WORDS,
    PACKED,
    by_word,
    gather,
    need_words,
    pack_by_block,
    unpack,
    unpack_block,
    whole_words,
    word_blocks,
)

#: Characters with the property White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def splitter(pattern: str):
    """A function that cuts text bytes into the matches of ``pattern``.

    The usual pattern has a twin for the faster standard library, whose classes say the same where a text
    has no number beyond decimal digits and no character beyond 16 bits; other texts, and other patterns, take the pattern itself."""

    def compiled(state={}):  # noqa: B006
        if not state:
            state["whole"] = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
            if pattern == public_tokenizers.PATTERN:
                odd = [c for c in range(1 << 16) if unicodedata.category(chr(c)) in ("Nl", "No")]
                state["far"] = re.compile(b"[\xf0-\xf4]").search  # beyond 16 bits
                state["odd"] = re.compile("[" + "".join(map(chr, odd)) + "]").search
                state["twin"] = re.compile(
                    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w{_SPACE}]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
                ).findall
        return state

    def split(text: bytes) -> list[str]:
        state, data, text = compiled(), text, text.decode("utf-8")
        if "twin" not in state or state["far"](data) or state["odd"](text):
            return state["whole"](text)
        return state["twin"](text)

    return split


def _encode_words(batches, ranks):
    """Ids of each distinct word, once, packed by the blocks that hold it."""
    # A word is one match of the caller's pattern already; here a match is the whole word.
    encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for table, firsts in whole_words(batches):
        words = table.column("word").take(pa.array(firsts)).to_pylist()
        ids = [encode(w.decode("utf-8")) for w in words]
        size = np.array([len(i) for i in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32)
        times = np.diff(np.concatenate([firsts, [table.num_rows]]))
        word = np.repeat(np.arange(len(ids)), times)
        lists, _ = gather(flat, np.cumsum(size) - size, size, word)
        yield pack_by_block(table.column("block").to_numpy(), table.column("code").to_numpy(), sizes=size[word], flat=lists)


ENCODED = "doc_id long, ids array<int>"
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _put_together(sequences, packed):
    """Documents of a block from the ids of its words.  Each call first gives back what the block before it
    and earlier tasks of this worker have freed."""
    release_memory()
    size, flat = unpack_block(packed.column("columns").to_pylist(), 0, True)
    starts = np.cumsum(size) - size
    ids, rows, out = sequences.column("doc_id").to_pylist(), sequences.column("words").to_pylist(), []
    for i in range(0, len(rows), 2000):
        parts = [unpack(r)[0].astype(np.int64) for r in rows[i : i + 2000]]
        need_words(parts, len(size))
        codes = np.concatenate(parts)
        joined, stops = gather(flat, starts, size, codes)
        bounds = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(joined.astype(np.int32)))
        out.append(pa.RecordBatch.from_arrays([pa.array(ids[i : i + 2000], pa.int64()), lists], schema=_ENCODED))
    return pa.Table.from_batches(out, schema=_ENCODED)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id and ``ids``, array of int, without special tokens."""
    dictionary, sequences = word_blocks(docs, splitter(pattern), size=block_words)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary, not data
    words = by_word(dictionary.select("block", "code", "word"))
    packed = words.mapInArrow(lambda it: trimmed(_encode_words(it, sent.value)), PACKED)

    def put_together(s: pa.Table, w: pa.Table) -> pa.Table:
        return _put_together(s, w)

    return sequences.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(put_together, ENCODED)


def _decode_batches(batches, table):
    """Bytes of the ids, gathered from the bytes of all tokens."""
    size = np.zeros(max(table, default=0) + 1, np.int64)
    size[list(table)] = [len(t) for t in table.values()]
    start = np.cumsum(size) - size
    flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(len(size))), np.uint8)
    for batch in rebatch(batches, 1 << 20):
        lists = batch.column("ids").fill_null([])
        ids = lists.flatten().to_numpy().astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(size) or not size[ids].all()):
            raise KeyError("an id that the vocabulary lacks")
        decoded, stops = gather(flat, start, size, ids)
        ends = np.concatenate([[0], stops])[np.cumsum(pc.list_value_length(lists).to_numpy())]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(decoded)])
        yield batch.append_column("decoded", column)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids; a null id list is empty, an unknown id an error."""
    table = {rank: token for token, rank in ranks.items()}
    sent = encoded.sparkSession.sparkContext.broadcast(table)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(lambda it: trimmed(_decode_batches(it, sent.value)), f"{names}, decoded binary")


def encoding_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 of the decimal ids joined by a space, decoded_sha256."""
    return decode(encode(docs, ranks, pattern), ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
