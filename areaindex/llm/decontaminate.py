"""Benchmark decontamination with suffix arrays of the training words.

Each shard (one Arrow batch of documents) becomes a word-id sequence and a suffix array; every test
suffix is looked up in it by binary search, and runs of hits along one diagonal give the longest
verbatim matches with their places.  Nothing of the documents is shuffled: only the test side is sent
to the tasks, in blocks of bounded size.

Defined cases: null and empty texts have no words; an item of fewer than thirteen words, but not
none, is one window; rows that repeat an item id are one item; items with a null id mark words, yet
are not listed; rows that repeat a doc_id, or have none, each keep a row of their own; an empty benchmark or table gives no hits or no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import WORD_BYTES, land, numbered, rebatch, without

WINDOW = 13

#: Test text of this many bytes is sent to the tasks at a time; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20

MATCHES = "array<struct<item_id:string,doc_start:int,item_start:int,n_words:int>>"
SCHEMA = f"doc_id long, n_words long, matches {MATCHES}"

#: With the number of the row, by which the passes of a larger benchmark meet.
NUMBERED = f"number long, {SCHEMA}"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class TestSuffixes:
    """The windows of a block of test items, as word ids and as sorted-search keys."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.places: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.ids = [i for i, _ in items]
        starts = set()
        for k, (_, text) in enumerate(items):
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            width = min(window, len(codes))
            for j in range(len(codes) - width + 1 if codes else 0):
                cut = codes[j : j + width]
                self.places[np.array(cut, ">u4").tobytes()].append((k, j))
                starts.add(tuple((cut + [0, 0])[:3]))
        self.starts = np.unique(self.hashed(*np.array(sorted(starts) or np.zeros((0, 3)), np.uint64).reshape(-1, 3).T))
        self.short = np.array(sorted({s[0] for s in starts if not s[2]}), np.uint64)
        self.table = np.zeros(1 << 22, bool)
        self.table[self.starts] = True

    @staticmethod
    def hashed(a, b, c) -> np.ndarray:
        mixed = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)
        return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(42)

    def suffix_array(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``codes`` sorted by the words that start there, and those words as keys.  Places
        whose first three words start no test suffix can't match and are left out."""
        padded = np.concatenate([codes, np.zeros(self.window, codes.dtype)])
        n = len(codes)
        wide = padded.astype(np.uint64)
        near = self.table[self.hashed(wide[:n], wide[1 : n + 1], wide[2 : n + 2])]
        if len(self.short):
            near |= np.isin(wide[:n], self.short)
        at = np.flatnonzero(near & (codes > 0))
        keys = np.lib.stride_tricks.sliding_window_view(padded, self.window)[at].astype(">u4")
        keys = np.ascontiguousarray(keys).view(f"S{4 * self.window}").ravel()
        order = np.argsort(keys, kind="stable")
        return at[order], keys[order]

    def search(self, codes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(place, item, offset in the item, width) of every window found in ``codes``."""
        at, keys = self.suffix_array(codes)
        if not len(at) or not self.places:
            return []
        windows = list(self.places)
        size = 4 * self.window
        low = np.searchsorted(keys, np.array(windows, f"S{size}"), "left")
        high = np.searchsorted(keys, np.array([w + b"\xff" * (size - len(w)) for w in windows], f"S{size}"), "right")
        return [
            (int(p), k, j, len(windows[i]) // 4)
            for i in np.flatnonzero(high > low)
            for p in at[low[i] : high[i]]
            for k, j in self.places[windows[i]]
        ]


def longest(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Join window hits that follow each other on one diagonal: (item, place, offset, words)."""
    out: list[list[int]] = []
    for p, k, j, width in sorted(hits, key=lambda h: (h[1], h[0] - h[2], h[0])):
        if out and out[-1][0] == k and out[-1][1] - out[-1][2] == p - j and p <= out[-1][1] + out[-1][3] - width + 1:
            out[-1][3] = p + width - out[-1][1]
        else:
            out.append([k, p, j, width])
    return [tuple(x) for x in out]


def _search_batches(batches, items, window):
    test = TestSuffixes(items, window)
    get = test.vocabulary.get
    for batch in rebatch(batches):
        split = [words(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        sizes = np.array([len(w) for w in split])
        ends = np.cumsum(sizes + 1)
        codes = np.zeros(int(ends[-1]), np.uint32)
        for w, end in zip(split, ends, strict=True):
            codes[end - 1 - len(w) : end - 1] = [get(x, 0) for x in w]
        by_doc = defaultdict(list)
        for hit in test.search(codes):
            by_doc[int(np.searchsorted(ends, hit[0], "right"))].append(hit)
        found = []
        for d in range(len(split)):
            first = int(ends[d]) - 1 - len(split[d])
            found.append(
                [
                    {"item_id": test.ids[k], "doc_start": p - first, "item_start": j, "n_words": n}
                    for k, p, j, n in longest(by_doc.get(d, []))
                ]
            )
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())]))
        names = [c for c in ("number", "doc_id") if c in batch.schema.names]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).cast(pa.int64()) for c in names), pa.array(sizes, pa.int64()), pa.array(found, kind)],
            names=[*names, "n_words", "matches"],
        )


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, and ``matches``, its maximal verbatim matches with test items
    of at least a window.  A benchmark beyond ``block_bytes`` is searched in several passes over the
    documents, landed with a number for each row, by which the matches are joined."""
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    tests = tests.filter(F.length("text") > 0).distinct()
    total = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = docs.select("doc_id", "text")
    if blocks > 1:
        rows = land(rows.withColumn("number", F.monotonically_increasing_id()), "numbered")
    passes = []
    for block in range(blocks):
        part = tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [(r.item_id, bytes(r.text)) for r in part.collect()]  # about block_bytes
        items.sort(key=lambda r: (r[0] is None, r[0] or "", r[1]))
        sent = docs.sparkSession.sparkContext.broadcast(items)
        found = rows.mapInArrow(lambda it, sent=sent: _search_batches(it, sent.value, window), NUMBERED if blocks > 1 else SCHEMA)
        passes.append(found.filter(F.size("matches") > 0) if block else found)  # the first pass has every row
    if blocks == 1:
        return passes[0]
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    merged = out.groupBy("number").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    return merged.drop("number")


def hit_words(matches):
    """Number of document words inside any match: walk the matches by start, counting what reaches
    past the furthest end so far."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(m.doc_start.alias("a"), (m.doc_start + m.n_words).alias("b"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, m: F.struct(
        F.greatest(s.end, m.b).alias("end"),
        (s.n + F.greatest(F.lit(0), m.b - F.greatest(s.end, m.a))).cast("long").alias("n"),
    )
    return F.aggregate(spans, zero, step, lambda s: s.n)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    found = benchmark_matches(docs, benchmark, **options)
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m.item_id), lambda i: i.isNotNull())))
    n_hit = hit_words(F.col("matches"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.n_words)), F.lit(0)).cast("long").alias("longest"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, without the contaminated ones.  Each row goes by its own text, whether
    its doc_id is null, repeated or neither."""
    rows, number = numbered(docs)
    found = contamination(rows.select(F.col(number).alias("doc_id"), "text"), benchmark, **options)
    return without(rows, number, land(found.filter("contaminated").select("doc_id"), "contaminated"))
