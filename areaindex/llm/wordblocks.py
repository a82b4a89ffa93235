"""Blocks of documents with a dictionary each: the compact form of exploding words with positions.

A block is a run of documents of one input partition, about BLOCK_WORDS words long.  Its distinct words
have codes by first appearance, so frequent words have small ones; a document's words are a row of codes, in
order.  So the word shuffle moves each word once per block, not once per occurrence, and positions never leave
the block.  Two passes derive the same blocks from the same input partitions; a block's key is a hash
of its place and its dictionary, so blocks that differ between the passes don't meet, which is an
error and never a wrong result.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from areaindex.llm.common import rebatch, release_memory, texts

BLOCK_WORDS = 4_000_000

#: Rows of the word shuffle that a task works on at a time.
CHUNK_ROWS = 1 << 20

DICTIONARY = "block long, code int, word binary, learned long"
SEQUENCES = "block long, doc_id long, words binary"
PACKED = "block long, columns binary"


def pack(*columns: np.ndarray) -> bytes:
    """Byte planes of unsigned 32-bit columns, compressed: high bytes are mostly zero and cost next to nothing."""
    head = struct.pack(f"<{len(columns) + 1}I", len(columns), *map(len, columns))
    planes = b"".join(np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return head + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    sizes = struct.unpack_from(f"<{n}I", data, 4)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 + 4 * n :], max_output_size=4 * sum(sizes)), np.uint8)
    out, at = [], 0
    for size in sizes:
        out.append(np.ascontiguousarray(planes[at : at + 4 * size].reshape(4, size).T).view("<u4").ravel())
        at += 4 * size
    return out


class Block:
    """Documents of one block as codes of their words, by first appearance."""

    def __init__(self):
        self.codes: dict = defaultdict(count().__next__)
        self.ids: list = []
        self.rows: list[np.ndarray] = []
        self.learned: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, words: list, learned: bool) -> None:
        row = np.fromiter(map(self.codes.__getitem__, words), np.uint32, len(words))
        self.ids.append(doc_id)
        self.rows.append(row)
        if learned:
            self.learned.append(row)
        self.size += len(row) + 1

    def words(self, place: int) -> tuple[int, list[bytes]]:
        """Key of the block, and its words by code."""
        words = [w if isinstance(w, bytes) else w.encode("utf-8") for w in self.codes]
        return xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=place) - (1 << 63), words

    def counts(self, n: int) -> np.ndarray:
        """How often each word stands in learned documents."""
        return np.bincount(np.concatenate([*self.learned, np.zeros(0, np.uint32)]).astype(np.int64), minlength=n)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``values[starts[r] : starts[r] + sizes[r]]`` of all ``rows``, joined, and where each ends."""
    n = sizes[rows]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts[rows] - (ends - n), n)], ends


def _blocks(batches, split, learns, size):
    """(place, [Block]) of this partition's blocks.  The caller takes the block out of its list and drops it
    before it asks for the next one, so a worker holds one block at a time."""
    part, number, block = TaskContext.get().partitionId(), 0, Block()
    for batch in rebatch(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            block.add(doc_id, split(text), learns(doc_id))
            if block.size >= size:
                place, whole, block = (part << 24) + number, [block], Block()
                number += 1
                yield place, whole
    if block.ids:
        yield (part << 24) + number, [block]


def _dictionary(batches, split, learns, size):
    for place, whole in _blocks(batches, split, learns, size):
        block = whole.pop()
        key, words = block.words(place)
        learned = block.counts(len(words))
        del block
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(part), key, np.int64)),
                    pa.array(np.arange(i, i + len(part), dtype=np.int32)),
                    pa.array(part, pa.binary()),
                    pa.array(learned[i : i + len(part)]),
                ],
                names=["block", "code", "word", "learned"],
            )
        del words, learned, part
    release_memory()


def _sequences(batches, split, learns, size):
    for place, whole in _blocks(batches, split, learns, size):
        block = whole.pop()
        key = block.words(place)[0]
        block.codes = {}
        for i in range(0, len(block.ids), 500):
            rows = [pack(r) for r in block.rows[i : i + 500]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), key, np.int64)), pa.array(block.ids[i : i + 500], pa.int64()), pa.array(rows, pa.binary())],
                names=["block", "doc_id", "words"],
            )
        del block, rows
    release_memory()


def _never(doc_id) -> bool:
    return False


def word_blocks(docs: DataFrame, split, learns=_never, size: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Two lazy frames over ``docs`` (doc_id, text): the dictionaries, one row per block and distinct
    word, and the sequences, one row per document.

    ``split`` cuts the bytes of a text into words, ``learns`` tells by doc_id whose words also count as
    ``learned``.  ``docs`` must be a file scan, possibly filtered and projected, so that both passes meet
    the same partitions."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return (
        rows.mapInArrow(lambda it: _dictionary(it, split, learns, size), DICTIONARY),
        rows.mapInArrow(lambda it: _sequences(it, split, learns, size), SEQUENCES),
    )


def by_word(dictionary: DataFrame) -> DataFrame:
    """All rows of a word in one partition, next to each other.  A word has a row per block at most."""
    return dictionary.repartition("word").sortWithinPartitions("word")


def whole_words(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``rows`` rows, cut between words, with the place of each word's first row."""
    held: list[pa.RecordBatch] = []
    n = 0
    release_memory()
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        firsts = _firsts(table)
        last = int(firsts[-1])
        if last:
            yield table.slice(0, last), firsts[:-1]
        held, n = table.slice(last).to_batches(), table.num_rows - last
    if n:
        table = pa.Table.from_batches(held)
        yield table, _firsts(table)


def _firsts(table: pa.Table) -> np.ndarray:
    words = table.column("word").combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    new = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def pack_by_block(blocks: np.ndarray, codes: np.ndarray, *columns: np.ndarray, sizes: np.ndarray | None = None, flat: np.ndarray | None = None) -> pa.RecordBatch:
    """A row per block: its codes in order, as steps, and the columns; with ``sizes``, row i also has that
    many entries of ``flat``."""
    order = np.lexsort((codes, blocks))
    blocks, codes = blocks[order], codes[order].astype(np.int64)
    columns = [c[order] for c in columns]
    if sizes is not None:
        starts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        ends = np.cumsum(sizes)
        flat, _ = gather(flat, starts, sizes, np.arange(len(sizes)))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
    keys, packed = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = [np.diff(codes[a:b], prepend=0), *(c[a:b] for c in columns)]
        if sizes is not None:
            own += [sizes[a:b], flat[ends[a] - sizes[a] : ends[b - 1]]]
        keys.append(int(blocks[a]))
        packed.append(pack(*own))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], names=["block", "columns"])


def unpack_block(rows: list[bytes], n_columns: int, lists: bool) -> list[np.ndarray]:
    """Columns of a block in code order, from all its packed rows; with ``lists`` the last two are the
    sizes and their entries."""
    parts = [unpack(r) for r in rows]
    if not parts:
        return [np.zeros(0, np.int64) for _ in range(n_columns + 2 * lists)]
    codes = np.concatenate([np.cumsum(p[0].astype(np.int64)) for p in parts])
    order = np.argsort(codes, kind="stable")
    if not np.array_equal(codes[order], np.arange(len(codes))):
        raise ValueError("a block's words are not whole")
    out = [np.concatenate([p[1 + i] for p in parts])[order].astype(np.int64) for i in range(n_columns)]
    if lists:
        sizes = np.concatenate([p[1 + n_columns] for p in parts]).astype(np.int64)
        flat = np.concatenate([p[2 + n_columns] for p in parts])
        out += [sizes[order], gather(flat, np.cumsum(sizes) - sizes, sizes, order)[0].astype(np.int64)]
    return out


def need_words(sequences: list[np.ndarray], n_words: int) -> None:
    """Stop where the documents' words are not those of the dictionary."""
    most = max((int(s.max()) for s in sequences if len(s)), default=-1)
    if most >= n_words:
        raise ValueError("blocks differ between the passes: the documents must be a repeatable file scan")
