"""Removal of long repeated passages by ranking positions over growing lengths.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.  Plain prefix
doubling ranks every byte position in every round; here the positions that are ranked are chosen by
content, so that equal strings choose equal positions: each window of ``length`` bytes is held by the
leftmost smallest hash of GRAM bytes in it, its anchor.  The windows of an anchor, by their offset
from it, form the nodes of a fixed tree (half the range, then STEP offsets, then one).  In each round
Spark ranks (anchor, node) pairs by the string that all windows of the node share, which grows from
round to round up to the whole ``length``:

* a pair whose shared string is unique leaves: none of its windows is repeated;
* a pair whose covering string (the union of its windows) is not unique is done: all are repeated;
* the others are ranked again in the next, finer round.  A class of equal pairs sends one member.

The last round compares whole windows, so the result is exact.  Ranks are two independent 64-bit hashes.

Defined cases: null texts are empty; texts shorter than ``length`` keep all bytes; every row is a text
of its own, under an internal number, whether its doc_id is null, repeated or neither; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import join_small, land, rebatch, texts, trimmed

LENGTH = 400
GRAM = 17
STEP = 16
SLICE = 1 << 17

#: Bytes of documents that a task cuts at a time: a batch of Spark's, with the texts as objects and their copies,
#: takes several times as much.
CUT_BYTES = 4 << 20

# Of all rows of a round, a key that holds over one in so many is hot.
HOT_KEYS = 256
RANKED = "node int, core long, span long, row long, anchor int, low int, high int, fresh boolean"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes that start at each place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    mixed = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed += eight[8 : 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed += raw[16 : 16 + n].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


def anchors_of_windows(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each window of ``length`` bytes, the place of its leftmost smallest gram hash."""
    n, width = len(data) - length + 1, length - GRAM + 1
    out = np.empty(max(n, 0), np.int64)
    low = np.uint64((1 << 18) - 1)
    for i in range(0, n, SLICE):
        m = min(SLICE, n - i)
        h = gram_hashes(data[i : i + m + length - 1])
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            v = np.minimum(v[:-size], v[size:])
            size *= 2
        if size < width:
            v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
        out[i : i + m] = (v[:m] & low).astype(np.int64) + i
    return out


def nodes(length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Offset ranges of the rounds: two halves, then STEP offsets each, then one."""
    width = length - GRAM + 1
    half = -(-width // 2)
    fine = [(i, min(i + STEP, end) - 1) for start, end in ((0, half), (half, width)) for i in range(start, end, STEP)]
    return [[(0, half - 1), (half, width - 1)], fine, [(i, i) for i in range(width)]]


def _signature(kind: int, view, at: int, begin: int, stop: int, low: int, high: int, length: int) -> tuple[int, int]:
    """Signed ranks of a node at anchor ``at``: of what all its windows share, and of what they cover."""
    core = xxhash.xxh3_64_intdigest(view[at - low : at - high + length], seed=kind)
    a, b = max(begin, at - high), min(stop, at - low + length)
    span = xxhash.xxh64_intdigest(view[a:b], seed=at - a)
    return core - (1 << 63), span - (1 << 63)


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 8
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["node", "core", "span", "row", "anchor", "low", "high", "fresh"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _first_round(batches, length):
    ranges = nodes(length)[0]
    for batch in rebatch(batches, 1 << 20):
        docs, ids = texts(batch), batch.column("row").to_pylist()
        data = b"".join(docs)
        if len(data) < length:
            continue
        ends = np.cumsum([len(d) for d in docs])
        starts = ends - [len(d) for d in docs]
        at = anchors_of_windows(np.frombuffer(data, np.uint8), length)
        new = np.ones(len(at) + 1, bool)
        new[1:-1] = at[1:] != at[:-1]
        long = ends - starts >= length
        new[starts[starts <= len(at)]] = True
        new[(ends - length + 1)[long]] = True
        runs = np.flatnonzero(new)
        doc = np.searchsorted(ends, runs[:-1], "right")
        inside = (runs[:-1] < len(at)) & long[np.minimum(doc, len(docs) - 1)] & (runs[:-1] + length <= ends[np.minimum(doc, len(docs) - 1)])
        view, rows = memoryview(data), []
        for first, last, d in zip(runs[:-1][inside].tolist(), (runs[1:][inside] - 1).tolist(), doc[inside].tolist(), strict=True):
            a, begin, stop = int(at[first]), int(starts[d]), int(ends[d])
            for node, (low, high) in enumerate(ranges):
                lo, hi = max(low, a - last), min(high, a - first)
                if lo <= hi:
                    rows.append((node, *_signature(node, view, a, begin, stop, low, high, length), ids[d], a - begin, lo, hi, True))
            if len(rows) >= 20_000:
                yield _emit(rows)
                rows = []
        if rows:
            yield _emit(rows)


SNIPPET = "row long, anchor int, before int, bytes binary, low int, high int, fresh boolean"


def _snippets(batches, length):
    """Cut the surroundings of the listed anchors out of their documents."""
    reach = length - GRAM
    for batch in rebatch(batches, 4 << 20):
        rows = []
        for row, text, wanted in zip(batch.column("row").to_pylist(), texts(batch), batch.column("wanted").to_pylist(), strict=True):
            for w in wanted:
                a = w["anchor"]
                begin = max(0, a - reach)
                rows.append((row, a, a - begin, text[begin : a + length], w["low"], w["high"], w["fresh"]))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
            names = ["row", "anchor", "before", "bytes", "low", "high", "fresh"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _next_round(batches, ranges, kind, length):
    lows = np.array([low for low, _ in ranges])
    for batch in rebatch(batches, 4 << 20):
        rows = []
        for r in batch.to_pylist():
            view = memoryview(r["bytes"])
            first = int(np.searchsorted(lows, r["low"], "right")) - 1
            for node in range(first, len(ranges)):
                low, high = ranges[node]
                if low > r["high"]:
                    break
                lo, hi = max(low, r["low"]), min(high, r["high"])
                if lo <= hi:
                    signature = _signature(kind + node, view, r["before"], 0, len(view), low, high, length)
                    rows.append((node, *signature, r["row"], r["anchor"], lo, hi, r["fresh"]))
            if len(rows) >= 20_000:
                yield _emit(rows)
                rows = []
        if rows:
            yield _emit(rows)


def _members(rows: DataFrame, keys: list[str], listed: DataFrame, total: int) -> DataFrame:
    """The rows whose keys are ``listed``, with how many ``n`` of all ``total`` rows hold each.  Fewer than
    ``HOT_KEYS`` keys can hold over 1 / ``HOT_KEYS`` of all rows each: these are broadcast, so their rows
    stay where they are, and only rows of the others cross a shuffle, by sort-merge."""
    is_hot = F.col("n") > total / HOT_KEYS
    hot = F.broadcast(listed.filter(is_hot).select(*keys))
    other = listed.filter(~is_hot).select(*keys).hint("merge")
    return rows.join(hot, keys, "left_semi").unionByName(
        rows.join(hot, keys, "left_anti").join(other, keys, "left_semi")
    )


def _rank(ranked: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Split a landed round: the covered byte ranges of its repeated pairs, and the pairs to rank again.

    Pairs are first counted by class, (core, span), on the map side, so a passage in any number of
    documents is one row when classes meet by core.  The way back to the members of a repeated class is
    a join on a key that may be hot: see ``_members``."""
    total = ranked.count()
    often = land(ranked.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    kept = land(_members(ranked, ["core"], often, total), "repeated")
    classes = land(
        kept.groupBy("core", "span").agg(
            F.count("*").alias("n"), F.min(F.struct("row", "anchor", "low", "high")).alias("one"), F.bool_or("fresh").alias("fresh")
        ),
        "classes",
    )
    same = _members(kept.filter("fresh"), ["core", "span"], classes.filter("n > 1"), total)
    covered = same.select("row", (F.col("anchor") - F.col("high")).alias("a"), (F.col("anchor") - F.col("low") + length).alias("b"))
    open_cores = land(classes.filter("n = 1 and fresh").select("core").distinct(), "open")
    # Members of a class have the same offsets too, as a window's text alone decides its anchor.
    again = classes.join(open_cores.hint("merge"), "core", "left_semi").select("one.*", ((F.col("n") == 1) & F.col("fresh")).alias("fresh"))
    return covered, again


def _merged(batches):
    for batch in rebatch(batches, CUT_BYTES):
        ids, out = batch.column("row"), []
        for spans in batch.column("spans").to_pylist():
            merged: list[list[int]] = []
            for s in sorted((s["a"], s["b"]) for s in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            out.append([{"a": a, "b": b} for a, b in merged])
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, kind)], names=["row", "spans"])


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The documents, landed with a number ``name`` for each row, which later scans find again."""
    return land(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """From landed rows (row, text), ``row`` being the number of each: per row with repeats its number
    and ``spans``, its maximal runs [a, b) of bytes that lie in a repeated string of ``length`` bytes, in
    order.  Landed."""
    rounds = nodes(length)
    ranked = land(rows.mapInArrow(lambda it: trimmed(_first_round(it, length)), RANKED), "ranked")
    covered, again = _rank(ranked, length)
    parts = [land(covered, "covered")]
    kind = len(rounds[0])
    wanted = land(
        again.groupBy("row").agg(F.collect_list(F.struct("anchor", "low", "high", "fresh")).alias("wanted")), "wanted"
    )
    with_text = join_small(rows, wanted, ["row"], cells=F.size("wanted")).select("row", "text", "wanted")
    snippets = land(with_text.mapInArrow(lambda it: trimmed(_snippets(it, length)), SNIPPET), "snippets")
    surroundings = snippets.select("row", "anchor", "before", "bytes").dropDuplicates(["row", "anchor"])
    for k, ranges in enumerate(rounds[1:]):
        source = snippets if k == 0 else land(again, "again").join(surroundings, ["row", "anchor"])
        source = source.select("row", "anchor", "before", "bytes", "low", "high", "fresh")
        ranked = land(source.mapInArrow(lambda it, r=ranges, kind=kind: trimmed(_next_round(it, r, kind, length)), RANKED), "ranked")
        covered, again = _rank(ranked, length)
        parts.append(land(covered, "covered"))
        kind += len(ranges)
    spans = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return land(spans.mapInArrow(lambda it: trimmed(_merged(it)), "row long, spans array<struct<a:int,b:int>>"), "spans")


def _cut(text: bytes, spans) -> bytes:
    kept, at = [], 0
    for s in spans or ():
        kept.append(text[at : s["a"]])
        at = s["b"]
    kept.append(text[at:])
    return b"".join(kept)


def _digests(batches):
    for batch in rebatch(batches, CUT_BYTES):
        docs, spans = texts(batch), batch.column("spans").to_pylist()
        kept = [_cut(t, s) for t, s in zip(docs, spans, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t) for t in docs], pa.int64()),
                pa.array([len(t) - len(k) for t, k in zip(docs, kept, strict=True)], pa.int64()),
                pa.array([len(s or ()) for s in spans], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def dedup_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay."""
    rows = _numbered(docs.select("doc_id", "text"), "row")
    spans = repeated_spans(rows.select("row", "text"), length)
    joined = join_small(rows, spans, ["row"], "left", F.size("spans")).drop("row")
    return joined.mapInArrow(lambda it: trimmed(_digests(it)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept_texts(batches, name):
    for batch in rebatch(batches, CUT_BYTES):
        spans = batch.column(name).to_pylist()
        out = [
            None if not ok else _cut(t, s).decode("utf-8", "ignore")
            for ok, t, s in zip(batch.column("text").is_valid().to_pylist(), texts(batch), spans, strict=True)
        ]
        place = batch.schema.get_field_index("text")
        yield batch.set_column(place, batch.schema.field("text"), pa.array(out, batch.schema.field("text").type)).drop_columns([name])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, all their columns, with every repeated passage cut out of ``text``.  A character
    of which only some bytes are cut goes too; a document that is cut whole keeps an empty text."""
    name, number = "_spans", "_row"
    while name in docs.columns:
        name += "_"
    while number in docs.columns:
        number += "_"
    rows = _numbered(docs, number)
    spans = repeated_spans(rows.select(F.col(number).alias("row"), "text"), length)
    spans = spans.withColumnsRenamed({"row": number, "spans": name})
    joined = join_small(rows, spans, [number], "left", F.size(name)).select(*docs.columns, name)
    return joined.mapInArrow(lambda it: trimmed(_kept_texts(it, name)), docs.schema)
