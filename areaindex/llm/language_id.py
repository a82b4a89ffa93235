"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ORDER bytes with counts of the byte that follows.
A byte costs -log2 of its share under the longest known context, with the escape probability of
method C, d / (n + d) for d distinct bytes in n, down to shorter contexts and at last to 1/256.
Statistics are frozen after training, so the exact code length of a text is a sum of table entries:
contexts become nodes of one table over all languages, and tasks look costs up.  The language of
the shortest code wins; ties go to the smallest name.

Training takes SAMPLE documents a language as an expected bound, picked by a hash of their id; a
language with fewer gives all.  Statistics are counted by Spark and summed on the map side.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled
text everything is ``und``; rows with a null language or text don't teach; a null id is in no
training set; other columns, ``lang`` and ``source`` of the predicted rows included, are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import crc_of_id, join_small, land, numbered, rebatch, texts, without

ORDER = 3

#: Expected number of training documents of each language, at most.
SAMPLE = 2000


def _count_grams(batches, order):
    """Counts of (language, gram) with the grams of order + 1 bytes, and shorter ones at text starts."""
    counts: dict[str, Counter] = {}
    for batch in rebatch(batches, 4 << 20):
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            raw = np.frombuffer(text, np.uint8).astype(np.uint64)
            if not len(raw):
                continue
            own = counts.setdefault(lang, Counter())
            gram = np.zeros(len(raw), np.uint64)
            for k in range(order + 1):  # the length in the lowest byte, then the bytes, last one first
                gram[k:] |= raw[: len(raw) - k] << np.uint64(8 * (k + 1))
            gram |= np.minimum(np.arange(1, len(raw) + 1), order + 1).astype(np.uint64)
            values, times = np.unique(gram, return_counts=True)
            own.update(dict(zip(values.tolist(), times.tolist(), strict=True)))
        if sum(map(len, counts.values())) > 1_000_000:
            yield from _emit(counts)
            counts = {}
    yield from _emit(counts)


def _emit(counts):
    for lang, own in counts.items():
        yield pa.RecordBatch.from_pydict(
            {"lang": [lang] * len(own), "gram": pa.array(list(own), pa.int64()), "times": pa.array(list(own.values()), pa.int64())}
        )


def train(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> list[tuple[str, int, int]]:
    """(language, gram, count) over a sample of about ``sample`` documents of each language."""
    if not 1 <= order <= 5:
        raise ValueError("order is 1 to 5")
    rows = docs.filter("lang is not null and text is not null")
    sizes = land(rows.groupBy("lang").agg(F.count("*").alias("size")), "sizes")
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("size"))
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    taken = join_small(rows, sizes, ["lang"]).filter(place < share).select("lang", "text")
    grams = taken.mapInArrow(lambda it: _count_grams(it, order), "lang string, gram long, times long")
    summed = land(grams.groupBy("lang", "gram").agg(F.sum("times").alias("times")), "grams")
    return [tuple(r) for r in summed.collect()]  # bounded by the sample


class Coder:
    """Code lengths of all languages: ``node`` maps the bytes before to a context, ``cost`` a context
    and a byte to bits."""

    def __init__(self, counts: list[tuple[str, int, int]], order: int = ORDER):
        self.order = order
        self.langs = sorted({lang for lang, _, _ in counts})
        known = sorted({(gram >> 8) & 255 for _, gram, _ in counts})
        self.classes = np.zeros(256, np.int64)  # 0: a byte that no text taught, or no byte
        self.classes[known] = np.arange(1, len(known) + 1)
        size, n_langs = len(known) + 1, len(self.langs)
        number = {lang: i for i, lang in enumerate(self.langs)}
        tables: dict[tuple[int, ...], np.ndarray] = {}
        for lang, gram, times in counts:
            length = gram & 255
            seen = [int(self.classes[(gram >> (8 * (k + 1))) & 255]) for k in range(length)]
            for k in range(min(order, length - 1) + 1):  # context: the k bytes before, nearest first
                context = tuple(seen[1 : k + 1])
                table = tables.get(context)
                if table is None:
                    table = tables[context] = np.zeros((size, n_langs), np.float32)
                table[seen[0], number[lang]] += times
        contexts = sorted(tables, key=lambda c: (len(c), c))
        self.cost = np.empty((len(contexts), size, max(1, n_langs)), np.float32)
        place = {c: i for i, c in enumerate(contexts)}
        for i, c in enumerate(contexts):
            table = tables.pop(c).astype(np.float64)
            n, distinct = table.sum(0), (table > 0).sum(0)
            shorter = self.cost[place[c[:-1]]].astype(np.float64) if c else np.full((size, n_langs), 8.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, -np.log2(distinct / (n + distinct)), 0.0)
                self.cost[i] = np.where(table > 0, -np.log2(table / (n + distinct)), escape + shorter)
        # A walk from the nearest byte outwards: child[node, class], or stay where no longer context is known.
        self.child = np.zeros((len(contexts) or 1, size), np.int32)
        for c, i in place.items():
            if c:
                self.child[place[c[:-1]], c[-1]] = i

    def code_lengths(self, docs: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(docs), len(self.langs)))
        if not self.langs:
            return out
        gap = b"\x00" * self.order
        raw = np.frombuffer(gap + gap.join(docs), np.uint8)
        sizes = np.array([len(d) for d in docs])
        starts = self.order + np.cumsum(sizes + self.order) - sizes - self.order
        symbols = self.classes[raw]
        inside = np.zeros(len(raw) + 1, np.int32)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + sizes, -1)
        symbols[np.cumsum(inside[:-1]) == 0] = 0
        n = len(raw) - self.order
        node, going = np.zeros(n, np.int32), np.ones(n, bool)
        for k in range(1, self.order + 1):
            further = self.child[node, symbols[self.order - k : self.order - k + n]]
            going &= further > 0
            node = np.where(going, further, node)
        bits = self.cost[node, symbols[self.order :]]
        whole = np.flatnonzero(sizes > 0)
        bounds = np.stack([starts[whole], starts[whole] + sizes[whole]], 1).ravel() - self.order
        if len(whole):
            padded = np.concatenate([bits, np.zeros((1, bits.shape[1]), np.float32)])
            out[whole] = np.add.reduceat(padded, bounds, axis=0, dtype=np.float64)[::2]
        return out


def _predict(batches, counts, order):
    coder = Coder(counts, order)
    for batch in rebatch(batches, 1 << 20):
        docs = texts(batch)
        bits = coder.code_lengths(docs)
        langs, scores = [], []
        for text, row in zip(docs, bits, strict=True):
            if not len(row) or not any(map(str.isalpha, text.decode("utf-8"))):
                langs.append("und")
                scores.append(0.0)
            else:
                langs.append(coder.langs[int(row.argmin())])
                scores.append(float(1 / np.exp2(np.maximum(row.min() - row, -1000)).sum()))
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column("doc_id").cast(pa.int64()), "lang_pred": langs, "score": pa.array(scores, pa.float64())}
        )


def predict(docs: DataFrame, counts: list[tuple[str, int, int]], order: int = ORDER) -> DataFrame:
    """Per row: doc_id, lang_pred, and score, the share of the language among all under equal priors."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # bounded by the training sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda it: _predict(it, sent.value, order), "doc_id long, lang_pred string, score double")


def language_predictions(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    held_out = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    counts = train(docs.filter(crc_of_id() % 4 != 2))
    return predict(docs, counts).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, that have a letter and so a language; the others are rejected.  Each
    row goes by its own text, whether its doc_id is null, repeated or neither."""
    rows, number = numbered(docs)
    counts = train(docs.filter(crc_of_id() % 4 != 2))
    predicted = predict(rows.select(F.col(number).alias("doc_id"), "text"), counts)
    return without(rows, number, land(predicted.filter("lang_pred = 'und'").select("doc_id"), "rejected"))
