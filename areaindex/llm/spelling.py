"""Spelling variants by pivotal grams.

Bigrams are ordered by how many words' places they fill, rare ones first.  A word's prefix is its three rarest
places, and two of them that do not overlap, chosen by dynamic programming for the shortest lists, are its pivots.
One edit destroys at most one of two disjoint bigrams.  So of two near words, one whose prefix ends no later in
the order than the other's has a pivot that is in the other's prefix too, shifted by at most one place; the prefix
takes in one further place of its last bigram, if that is the next one, as a shift may move a pivot there.

Position limits: the edit lies behind the surviving pivot, whose place from the front is then the same in both
words, or before it, whose place from the end is the same.  The side without the edit agrees wholly, and of
the other side one half.  All of that is in the key of the index, with the length of the shorter word, so lists
stay short though there are few different bigrams.  Every candidate is verified.

Defined cases: a null text has no words, a null doc_id is written as the empty text before the colon; rows that
repeat a doc_id are texts of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import LOWER, land, rebatch, texts

#: Fixed values of the contract.
RUNS = "[A-Za-zÀ-ÿ]+"
DAMAGED = 31
SHORTEST, FEWEST, RATIO = 7, 2, 10

#: Words whose counts a task holds before it hands them on.
HELD = 500_000

#: A key of at least so many letters beside the edit is not parted further.
KEY_LETTERS = 6

WORDS = "word string, n long"
INDEX = "key long, word string, n long, short int, last long, pivot boolean"


def _count(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    runs = re.compile(RUNS.replace("A-Z", "").replace("+", f"{{{shortest},}}")).findall
    held: Counter = Counter()

    def hand_on() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        held.clear()
        return out

    for batch in rebatch(batches):
        for doc, text in zip(texts(batch, "doc"), texts(batch), strict=True):
            start = zlib.crc32(doc + b":")
            for word, n in Counter(runs(text.translate(LOWER).decode("utf-8"))).items():
                h = zlib.crc32(word.encode("utf-8"), start)
                if h % DAMAGED == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < shortest:
                        continue
                held[word] += n
            if len(held) >= HELD:
                yield hand_on()
    yield hand_on()


def count_words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """word, n: runs of letters, some of them damaged as the contract has it, that are long and frequent
    enough.  Tasks count before the shuffle."""
    rows = docs.select(docs["doc_id"].cast("string").alias("doc"), "text")
    counts = rows.mapInArrow(lambda it: _count(it, shortest), WORDS)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Place in the order and number of places of each bigram.  The alphabet bounds their number: 90 letters
    make 8 100."""
    places = F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")
    found = words.select(F.explode(places).alias("gram")).groupBy("gram").count().collect()
    ordered = sorted((r["count"], r["gram"]) for r in found)
    return {gram: (place, n) for place, (n, gram) in enumerate(ordered)}


def pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[list[int], list[int], int]:
    """Places of the prefix, places of the two pivots, and the place in the order where the prefix ends."""
    grams = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    third = sorted((g[0], i) for i, g in enumerate(grams))[:3]
    last, end = third[-1]
    prefix = sorted(i for _, i in third)
    # Least sums of one gram and of two disjoint ones among those that start at a place or before it.
    one, two, best_one, best_two = (), (), [], []
    for i in prefix:
        cost = grams[i][1]
        before = [b for b in best_one if b[-1] + 2 <= i]
        if before:
            two = min([two, (before[-1][0] + cost, before[-1][1], i)] if two else [(before[-1][0] + cost, before[-1][1], i)])
        one = min(one, (cost, i)) if one else (cost, i)
        best_one.append((one[0], one[1], i))
        best_two.append(two)
    further = [end + 1] if end + 1 < len(grams) and grams[end + 1][0] == last else []
    return sorted({*prefix, *further}), list(best_two[-1][1:]), (last << 32) + end


def keys(word: str, at: int, short: int) -> Iterator[tuple]:
    """Keys of the bigram at a place, for pairs whose shorter word has ``short`` letters."""
    n, front, back = len(word), at + 2, len(word) - at
    if front <= short:  # the edit is behind the bigram
        half = (short - front) // 2
        if front >= KEY_LETTERS:
            yield "front", front, word[:front]
        else:
            yield "front, then near", front, word[: front + half]
            yield "front, then far", front, word[:front], word[n - (short - front - half) :]
    if back <= short:  # the edit is before it
        half = (short - back) // 2
        if back >= KEY_LETTERS:
            yield "back", back, word[at:]
        else:
            yield "back, then far", back, word[:half], word[at:]
            yield "back, then near", back, word[at - (short - back - half) :]


def _index(batches: Iterator[pa.RecordBatch], order: dict[str, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in rebatch(batches, 256 << 10):
        columns: tuple[list, ...] = ([], [], [], [], [])
        rows: list[int] = []
        for row, word in enumerate(batch.column("word").to_pylist()):
            prefix, own, last = pivots(word, order)
            for at in prefix:
                pivot = at in own
                for short in (len(word) - 1, len(word)):
                    for key in keys(word, at, short):
                        hashed = xxhash.xxh3_64_intdigest("\x00".join((key[0], f"{key[1]} {short}", *key[2:]))) - (1 << 63)
                        rows.append(row)
                        for column, value in zip(columns, (hashed, short, last, pivot), strict=False):
                            column.append(value)
        words = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int64()),
                words.column("word"),
                words.column("n"),
                pa.array(columns[1], pa.int32()),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.bool_()),
            ],
            names=["key", "word", "n", "short", "last", "pivot"],
        )


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: pairs of distinct words that differ by one inserted, deleted or replaced code
    point, in both orders.  ``words`` has word and n, is landed, and its words have seven letters or more."""
    order = words.sparkSession.sparkContext.broadcast(gram_order(words))
    index = words.select("word", "n").mapInArrow(lambda it: _index(it, order.value), INDEX)
    a = index.where("pivot").select(*(F.col(c).alias(f"a_{c}") for c in ("key", "word", "n", "short", "last")))
    b = index.select(*(F.col(c).alias(f"b_{c}") for c in ("key", "word", "n", "last")))
    met = a.join(b, F.col("a_key") == F.col("b_key")).where(
        (F.col("a_last") <= F.col("b_last"))
        & (F.col("a_word") != F.col("b_word"))
        & (F.least(F.length("a_word"), F.length("b_word")) == F.col("a_short"))
        & (F.levenshtein("a_word", "b_word", 1) == 1)
    )
    first = F.col("a_word") < F.col("b_word")
    pairs = met.select(
        F.when(first, F.col("a_word")).otherwise(F.col("b_word")).alias("word"),
        F.when(first, F.col("a_n")).otherwise(F.col("b_n")).alias("n"),
        F.when(first, F.col("b_word")).otherwise(F.col("a_word")).alias("other"),
        F.when(first, F.col("b_n")).otherwise(F.col("a_n")).alias("other_n"),
    ).distinct()
    turned = "named_struct('word', other, 'n', other_n, 'other', word, 'other_n', n)"
    return pairs.selectExpr(f"inline(array(struct(word, n, other, other_n), {turned}))")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: each word's last form.  A form is RATIO times as frequent as its word, so chains are no longer
    than the digits of the largest count, and each round doubles the steps that are followed."""
    roots = forms.select("word", F.col("form").alias("root"))
    longest = len(str(forms.agg(F.max("form_n")).first()[0] or 0))
    steps = 1
    while steps < longest:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = roots.join(further, "root", "left")
        roots = land(joined.select("word", F.coalesce("further", "root").alias("root")), "roots")
        steps *= 2
    return roots


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for a landed frame of word and n.  A word's form is its near word of
    largest n, ties to the smallest in code-point order, if that n is at least ``ratio`` (10 or more) times its own."""
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))
    is_form = F.col("form_n") >= ratio * F.col("n")
    near = land(near.select("word", "n_near", *(F.when(is_form, F.col(c)).alias(c) for c in ("form", "form_n"))), "near")
    roots = _roots(near.where("form IS NOT NULL"))
    out = words.select("word", "n").join(near, "word", "left").join(roots, "word", "left")
    return out.select(
        "word",
        "form",
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n",
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Count the words of ``docs`` and group their spelling variants: word, form, root, n, n_near, form_n."""
    return group_variants(land(count_words(docs), "words"))
