"""Token-id files of patched frame-of-reference blocks.

A shard file holds the ids of one range of documents, in ascending doc_id order:

* blocks of BLOCK ids.  The block minimum is subtracted; ``width`` is the bit length of the PERCENTILE-th
  percentile of what is left; low bits are packed at that width; ids that need more are exceptions, a
  list of places and high bits;
* an index: the byte place of each block's start, so any id is found without reading what is before it;
* the documents: id, whether it is null, and the place after its last token.

All numbers are little-endian.  A shard is written under a temporary name and moved when complete, so
a task that is run again replaces whole files only.

Defined cases: a null text is empty and is written as the end id alone; null doc_ids come first;
rows that repeat an id keep a place each; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib
from collections import defaultdict
from itertools import chain, count, islice
from types import ModuleType

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areaindex.llm.common import LOWER, land, rebatch, texts
from areaindex.llm.wordblocks import gather
from areaindex.sources.landing import scratch_dir

BLOCK = 4096
PERCENTILE = 90
END_ID = 1
MAGIC = b"PFOR0001"

#: Marks that stand behind words, one or more: a run of them is a unit of its own for the tokenizer.  No apostrophe,
#: as it may start a unit with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: Letters below this one stay single letters in lower case, and no later standard changes them; the one
#: exception, a capital I with a dot, becomes two characters.  Words with others go whole to the library.
FAR, DOTTED = "\u0180", "\u0130"
HEAD = "<IBHH"  # minimum, width, ids, exceptions
FOOT = "<QQQ8s"  # blocks, documents, place of the index, magic

#: Distinct words whose ids a task remembers before it starts anew.
REMEMBERED = 1 << 20


def pack_block(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    low = int(ids.min())
    left = (ids - low).astype(np.uint32)
    width = int(np.partition(left, k := (len(left) - 1) * percentile // 100)[k]).bit_length()
    odd = np.flatnonzero(left >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    bits = (left[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8), axis=None, bitorder="little").tobytes() if width else b""
    high = (left[odd] >> np.uint32(width)).astype("<u4")
    return struct.pack(HEAD, low, width, len(ids), len(odd)) + packed + odd.astype("<u2").tobytes() + high.tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    low, width, n, n_odd = struct.unpack_from(HEAD, data, at)
    at += struct.calcsize(HEAD)
    size = (n * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
    left = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)) if width else np.zeros(n, np.uint32)
    at += size
    odd = np.frombuffer(data, "<u2", n_odd, at)
    left[odd] |= np.frombuffer(data, "<u4", n_odd, at + 2 * n_odd) << np.uint32(width)
    return left + np.uint32(low)


class ShardWriter:
    """Writes one shard; ids may come in pieces of any length."""

    def __init__(self, out, block: int = BLOCK, percentile: int = PERCENTILE):
        self.out, self.block, self.percentile = out, block, percentile
        self.rest, self.starts, self.at, self.total = np.zeros(0, np.uint32), [], 0, 0
        self.doc_ids, self.nulls, self.ends = [], [], []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def write(self, doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.ends.append(self.total + np.cumsum(sizes, dtype=np.int64))
        self.doc_ids.append(np.array([d or 0 for d in doc_ids], np.int64))
        self.nulls.append(np.array([d is None for d in doc_ids], np.uint8))
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // self.block * self.block
        for i in range(0, whole, self.block):
            self._flush(ids[i : i + self.block])
        self.rest = ids[whole:]

    def _flush(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        self._put(pack_block(ids, self.percentile))

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        if len(self.rest):
            self._flush(self.rest)
        index, docs = self.at, sum(map(len, self.doc_ids))
        self._put(np.array(self.starts, "<u8").tobytes())
        for column, kind in ((self.doc_ids, "<i8"), (self.nulls, "u1"), (self.ends, "<i8")):
            self._put(b"".join(c.astype(kind).tobytes() for c in column))
        self._put(struct.pack(FOOT, len(self.starts), docs, index, MAGIC))
        return docs, self.total


class ShardReader:
    """Reads a shard through a seekable file: the index first, then any range of ids."""

    def __init__(self, file, block: int = BLOCK):
        self.file, self.block = file, block
        size = file.size()
        blocks, docs, index, magic = struct.unpack(FOOT, file.read_at(struct.calcsize(FOOT), size - struct.calcsize(FOOT)))
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        tail = file.read_at(size - struct.calcsize(FOOT) - index, index)
        self.starts = np.concatenate([np.frombuffer(tail, "<u8", blocks), [index]]).astype(np.int64)
        at = 8 * blocks
        self.doc_ids = np.frombuffer(tail, "<i8", docs, at)
        self.nulls = np.frombuffer(tail, "u1", docs, at + 8 * docs).astype(bool)
        self.ends = np.frombuffer(tail, "<i8", docs, at + 9 * docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of the places [start, stop) of this shard."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = self.starts[first]
        data = self.file.read_at(int(self.starts[last + 1] - begin), int(begin))
        parts = [unpack_block(data, int(s - begin)) for s in self.starts[first : last + 1]]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


def _open(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class WordIds:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never merges over it or between
    letters and marks: each distinct word is encoded once, documents are gathered from their words."""

    #: Words of letters that one call encodes; their ids part after each token that ends a word.
    JOINED = 400

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.codes: dict[bytes, int] = defaultdict(count().__next__)
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the words."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return size, np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))

    def _encode_letters(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for words of letters, JOINED at a time, in one call; one by one where the parts are not as many
        as the words."""
        groups = [words[i : i + self.JOINED] for i in range(0, len(words), self.JOINED)]
        found, out = self.tokenizer.encode_batch_fast(list(map(" ".join, groups)), add_special_tokens=False), []
        for group, encoding in zip(groups, found, strict=True):
            ids = np.array(encoding.ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            whole = len(ends) == len(group) and ends[-1] == len(ids)
            out.append((np.diff(ends, prepend=0), ids) if whole else self._encode_each(group))
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words not met before.  A word is letters and at most one run of marks that the tokenizer parts
        from them, two units, or else a unit of its own."""
        letters: dict[str, int] = defaultdict(count().__next__)
        marks: dict[str, int] = defaultdict(count().__next__)
        others, first, second = [], [], []
        for word in words:
            text = word.decode("utf-8")
            body = text.rstrip(MARKS)
            if body.isalpha() and (body.isascii() or (max(body) < FAR and DOTTED not in body)):
                first.append(letters[body])
                second.append(marks[text[len(body) :]] if len(body) < len(text) else -1)
            else:
                first.append(-1 - len(others))
                second.append(-1)
                others.append(text)
        plain = list(letters)
        parts = self._encode_letters(plain)
        parts += [self._encode_each(list(marks)), self._encode_each(others)]
        size, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
        first, second = np.array(first, np.int64), np.array(second, np.int64)
        first = np.where(first < 0, len(plain) + len(marks) - 1 - first, first)
        units = np.stack([first, len(plain) + second], 1)
        units = units[np.stack([first >= 0, second >= 0], 1)]
        joined, _ = gather(flat, np.cumsum(size) - size, size, units)
        whole = size[first]
        whole[second >= 0] += size[len(plain) + second[second >= 0]]
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(whole) - whole])
        self.size = np.concatenate([self.size, whole])
        self.flat = np.concatenate([self.flat, joined])

    def encode(self, docs: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the documents, each with its end id."""
        if len(self.codes) > REMEMBERED:
            self._clear()
        # Marks of special tokens are told by their case too; other texts have fewer words in lower case.
        split = [(d if b"<|" in d else d.translate(LOWER)).split() for d in docs]
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64)
        if len(self.codes) > len(self.size):
            self._learn(list(islice(self.codes, len(self.size), None)))
        ids, stops = gather(self.flat, self.start, self.size, codes)
        doc_ends = np.concatenate([[0], stops])[np.cumsum([len(w) for w in split])]
        sizes = np.diff(np.concatenate([[0], doc_ends])) + 1
        return sizes, np.insert(ids, doc_ends, end_id)


def _word_ids(tokenizer_json: str) -> WordIds:
    """The words that this worker process has met already: tasks that it runs later start with them."""
    held = sys.modules.setdefault("areaindex_worker_words", ModuleType("areaindex_worker_words")).__dict__
    key = xxhash.xxh3_128_hexdigest(tokenizer_json)
    if held.get("key") != key:
        held.update(key=key, words=WordIds(tokenizer_json))
    return held["words"]


MANIFEST = "path string, shard int, docs long, tokens long"


def _write_shard(batches, folder, tokenizer_json, end_id, block, percentile):
    words, writer, shard = _word_ids(tokenizer_json), None, TaskContext.get().partitionId()
    final = f"{folder}/shard-{shard:06d}.pfor"
    part = f"{folder}/.{uuid.uuid4().hex}.part"
    filesystem, part_path = _open(part)
    for batch in rebatch(batches, 8 << 20):
        if writer is None:
            filesystem.create_dir(os.path.dirname(part_path), recursive=True)
            out = filesystem.open_output_stream(part_path)
            writer = ShardWriter(out, block, percentile)
        writer.write(batch.column("doc_id").to_pylist(), *words.encode(texts(batch), end_id))
    if writer is not None:
        docs, tokens = writer.close()
        out.close()
        filesystem.move(part_path, _open(final)[1])
        yield pa.RecordBatch.from_pydict(
            {"path": [final], "shard": pa.array([shard], pa.int32()), "docs": [docs], "tokens": [tokens]}
        )


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, block: int = BLOCK, percentile: int = PERCENTILE) -> DataFrame:
    """Encode ``docs`` and write one shard per range of doc_ids to ``folder``, which all executors
    share.  Returns the manifest: path, shard, docs, tokens, and ``start``, the ids of all earlier shards."""
    with open(tokenizer_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary, not data
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    manifest = land(rows.mapInArrow(lambda it: _write_shard(it, folder, sent.value, end_id, block, percentile), MANIFEST), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_shards(batches, block, digest):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            filesystem, at = _open(path)
            with filesystem.open_input_file(at) as file:
                shard = ShardReader(file, block)
                ends, begin = shard.ends, 0
                while begin < len(ends):
                    first = int(ends[begin - 1]) if begin else 0
                    stop = max(begin + 1, int(np.searchsorted(ends, first + (1 << 20), "right")))
                    ids = shard.ids(first, int(ends[stop - 1])).astype("<u4")
                    bounds = np.concatenate([[first], ends[begin:stop]]) - first
                    columns = {
                        "doc_id": pa.array(shard.doc_ids[begin:stop], pa.int64(), mask=shard.nulls[begin:stop]),
                        "start": pa.array(start + first + bounds[:-1]),
                        "n_tokens": pa.array(np.diff(bounds)),
                    }
                    if digest:
                        columns["ids_crc32"] = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())
                    else:
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)
                    begin = stop


def read_token_files(manifest: DataFrame, block: int = BLOCK, digest: bool = False) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens and ``ids``; with ``digest`` their crc32 as
    little-endian unsigned 32-bit integers instead."""
    last = "ids_crc32 long" if digest else "ids array<int>"
    shards = manifest.select("path", "start").repartition(max(1, manifest.count()), "path")
    return shards.mapInArrow(lambda it: _read_shards(it, block, digest), f"doc_id long, start long, n_tokens long, {last}")


def token_file_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back: doc_id, start,
    n_tokens, ids_crc32."""
    folder = scratch_dir(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer_path), digest=True)
