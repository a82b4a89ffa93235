"""Near-duplicate groups by bottom-k sketches of one hash function.

1. Every document becomes the set of its shingle hashes, and a sketch: the SKETCH smallest of them.
   Documents of equal sets are one class from here on, under their smallest id.
2. Inverted lists of the sketch values find the classes that may have a partner.  Two sets of the wanted
   similarity share at least ``least_common`` retained values but for a chance below MISS, so a class
   enters only the lists of its rarest values, all but ``least_common - 1``: a passage of many
   documents then has no list.  The classes that stay in a list are sketched again with FINE values, whose
   bound is tighter, and listed anew.
3. Inside a list no pairs are enumerated.  The member with the most common values leads; the others
   are compared with it, links are contracted, and only members of other components go on with the next
   leaders, whose number grows from round to round.  It ends when each list is one component, or
   lists are so short that all members lead, so no link between components is lost.
   Lists are taken in two parts, first one in PICK; pairs that share one of these meet only once.
4. Two members meet if their sizes and signatures allow the similarity: which of RANGES ranges of
   hashes are filled (exact), and a bit of the smallest hash in each of BITS ranges (but for a chance
   below MISS).  A pair passes when the union sketch estimates enough, and is a link when the full sets say so.

Defined cases: a null or empty text has an empty set and is linked with nothing; with fewer words
than a shingle the whole sequence is one; doc_id names a document, so rows that repeat one get the
same decision; a null id is its own class of row and is never linked; other columns are ignored.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import BROADCAST_CELLS, join_small, land, numbered, rebatch, space_words, texts, trimmed, without
from areaindex.llm.graph import components

SHINGLE = 5
PERCENT = 75
SKETCH = 64
FINE = 256
RANGES = 1024
BITS = 256

#: One list in so many is picked.
PICK = 8

#: Members of a list that each of its members may meet on average in the last round, or in a first one.
PAIRS_EACH = 1024
PAIRS_FIRST = 4

#: Chance at which a pair exactly at the threshold may fail one of the bounds.
MISS = 1e-8

#: Words whose hash a task remembers before it starts anew.
REMEMBERED = 1 << 18

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _few(n: int, p: float) -> int:
    """The largest number that a binomial count of ``n`` at ``p`` stays below with a chance below MISS."""
    chance = 0.0
    for i in range(n + 1):
        chance += comb(n, i) * p**i * (1 - p) ** (n - i)
        if chance > MISS:
            return i
    return n


def least_common(sketch: int = SKETCH, percent: int = PERCENT) -> int:
    """Retained values that a pair at the threshold shares at least."""
    return max(1, _few(sketch, percent / 100))


def most_different(bits: int = BITS, percent: int = PERCENT) -> int:
    """Signature bits in which a pair at the threshold differs at most: a bit agrees where the smallest
    hashes do, and half the time elsewhere."""
    return bits - _few(bits, (1 + percent / 100) / 2)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(words: list[bytes], seen: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
    for j in range(width):
        mixed = h[j : j + len(out)] * _FACTORS[j % 5]
        out += mixed ^ (mixed >> np.uint64(29 + j // 5))
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return np.unique(out ^ (out >> np.uint64(33)))


def retained(full: np.ndarray, sketch: int) -> np.ndarray:
    """The ``sketch`` smallest hashes as signed longs of the same order, as Spark sorts signed."""
    return (full[:sketch] ^ np.uint64(1 << 63)).view(np.int64)


SKETCHES = "doc_id long, n_shingles long, print1 long, print2 long, sketch array<long>"


def _sketches(batches, size, sketch):
    seen = WordHashes()
    for batch in rebatch(batches):
        rows = []
        for text in texts(batch):
            full = shingles(space_words(text), seen, size)
            print_ = xxhash.xxh3_128_digest(full.tobytes())
            rows.append((len(full), *np.frombuffer(print_, np.int64).tolist(), retained(full, sketch)))
        n, p1, p2, values = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in (n, p1, p2)), pa.array(values, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "print1", "print2", "sketch"],
        )


#: Columns of a signature: which of RANGES equal ranges of hashes have any, and a bit of the smallest
#: hash in each of BITS ranges, 64 to a column.
SIGNATURE = [f"s{i}" for i in range((RANGES + BITS) // 64)]


def signature(full: np.ndarray) -> np.ndarray:
    """The words of a set's signature."""
    some, bit = np.zeros(RANGES, np.uint8), np.zeros(BITS, np.uint8)
    some[(full >> np.uint64(64 - (RANGES - 1).bit_length())).astype(np.int64)] = 1
    ranges, first = np.unique(full >> np.uint64(64 - (BITS - 1).bit_length()), return_index=True)
    bit[ranges.astype(np.int64)] = ((full[first] * _FACTORS[0]) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(np.concatenate([some, bit])).view(np.int64)


FINER = "doc long, n_shingles long, sketch array<long>, " + ", ".join(f"{c} long" for c in SIGNATURE)


def _finer(batches, size, sketch):
    seen = WordHashes()
    for batch in rebatch(batches):
        sets = [shingles(space_words(t), seen, size) for t in texts(batch)]
        words = np.stack([signature(s) for s in sets])
        columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([retained(s, sketch) for s in sets], pa.list_(pa.int64()))]
        columns += [pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(SIGNATURE))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_shingles", "sketch", *SIGNATURE])


def _linked(batches, size, percent):
    seen, kept = WordHashes(), {}

    def full(doc_id, text):
        if doc_id not in kept:
            if len(kept) > 64:
                kept.clear()
            kept[doc_id] = shingles(space_words(text), seen, size)
        return kept[doc_id]

    for batch in rebatch(batches):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        yes = []
        for x, y, s, t in zip(a, b, texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
            left, right = full(x, s), full(y, t)
            common = len(np.intersect1d(left, right, assume_unique=True))
            yes.append(100 * common >= percent * (len(left) + len(right) - common))
        yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))


def _is_picked(value):
    return F.pmod(F.xxhash64(value), F.lit(PICK)) == 0


def _entries(classes: DataFrame, need: int, percent: int) -> DataFrame:
    """(value, doc, weight, picked): every class in the lists of its rarest values that others are in
    too, with those of its lists that are picked."""
    rows = classes.select("doc", "n_shingles", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    often = land(rows.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1"), "often")
    shared = rows.join(often.hint("merge"), "value")
    lists = shared.groupBy("doc").agg(
        F.first("n_shingles").alias("n"), F.first("kept").alias("kept"), F.sort_array(F.collect_list(F.struct("often", "value"))).alias("lists"), F.sum("often").alias("weight")
    )
    wanted = F.least(F.lit(need), F.ceil(F.col("n") * percent / 100).cast("int"))
    rarest = F.col("kept") - wanted + 1 - (F.col("kept") - F.size("lists"))  # values of one class only come first
    listed = lists.filter(rarest > 0).withColumn("rarest", F.slice("lists", 1, rarest))
    picked = F.transform(F.filter("rarest", lambda e: _is_picked(e.value)), lambda e: e.value)
    listed = listed.select("doc", "weight", picked.alias("picked"), F.explode("rarest").alias("e"))
    listed = land(listed.select("e.value", "doc", "weight", "picked"), "listed")
    others = listed.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1").select("value")
    return listed.join(others.hint("merge"), "value", "left_semi")


def _confirm(pairs: DataFrame, classes: DataFrame, rows: DataFrame, need: int, size: int, percent: int, sketch: int) -> DataFrame:
    """The pairs whose union sketch estimates enough and whose full sets are similar."""
    one, two = (classes.select(F.col("doc").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, sketch)
    both = both.withColumn("u", union).withColumn("c", F.size(F.array_intersect(F.array_intersect("u", "sa"), "sb")))
    likely = both.filter(F.when(F.size("u") < sketch, 100 * F.col("c") >= percent * F.size("u")).otherwise(F.col("c") >= need)).select("a", "b")
    with_text = likely.join(rows.toDF("a", "text_a"), "a").join(rows.toDF("b", "text_b"), "b")
    return land(with_text.mapInArrow(lambda it: trimmed(_linked(it, size, percent)), "a long, b long"), "links")


def _can_link(percent: int):
    """Sizes and signatures allow the similarity.  A range that only one set has a hash in holds a
    shingle of that set alone, and similar sets have few of these for their sizes; in large sets,
    whose ranges are all filled, few of the smallest hashes differ."""

    def differ(columns):
        return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"led_{c}"))) for c in columns), F.lit(0))

    n, m, filled = F.col("n_shingles"), F.col("led_shingles"), RANGES // 64
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    few_alone = (100 + percent) * differ(SIGNATURE[:filled]) <= (100 - percent) * (n + m)
    return sizes & few_alone & (differ(SIGNATURE[filled:]) <= most_different(BITS, percent))


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links; ``links`` are between documents."""
    if labels is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), "component")
        ends = join_small(ends, named, [end], "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = components(ends).select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = join_small(labels, merged, ["component"], "left").select("node", F.coalesce("into", "component").alias("component"))
    fresh = merged.select(F.col("component").alias("node"), F.col("into").alias("component"))
    return land(old.unionByName(join_small(fresh, labels.select("node"), ["node"], "left_anti")), "labels")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, sketch: int = SKETCH, fine: int = FINE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = land(rows.mapInArrow(lambda it: trimmed(_sketches(it, size, sketch)), SKETCHES), "sketches")
    same = ["n_shingles", "print1", "print2"]
    usable = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = land(usable.groupBy(*same).agg(F.min("doc_id").alias("doc"), F.min_by("sketch", "doc_id").alias("sketch")), "classes")
    able = _entries(classes, least_common(sketch, percent), percent).select(F.col("doc").alias("doc_id")).distinct()
    able = land(able, "able")
    texts_of = land(join_small(rows, able, ["doc_id"], "left_semi").dropDuplicates(["doc_id"]), "texts")
    finer = land(texts_of.mapInArrow(lambda it: trimmed(_finer(it, size, fine)), FINER), "finer")
    need = least_common(fine, percent)
    entries = _entries(finer, need, percent).join(finer.drop("sketch"), "doc")

    labels = None
    for phase in ("picked", "other"):
        picked = _is_picked(F.col("value"))
        open_lists = entries.filter(picked if phase == "picked" else ~picked)
        leaders_each, last = 1, False
        while not last:
            if labels is None:
                members = open_lists.withColumn("component", F.col("doc"))
            else:
                named = labels.withColumnRenamed("node", "doc")
                members = join_small(open_lists.drop("component"), named, ["doc"], "left").withColumn("component", F.coalesce("component", "doc"))
            lists = members.groupBy("value").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("n"))
            mixed = land(lists.filter("c1 < c2"), "mixed")
            n, pairs = mixed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()
            if not n:
                break
            members = land(join_small(members, mixed.select("value"), ["value"], "left_semi"), "open")
            # Short lists: all their members lead at once; a first round of single leaders joins most of a group.
            last = pairs <= (PAIRS_FIRST if leaders_each == 1 else PAIRS_EACH) * n
            part = F.col("doc") if last else F.pmod(F.xxhash64("doc"), F.lit(leaders_each))
            top = F.max(F.struct("weight", -F.col("doc"), "component", "n_shingles", "picked", *SIGNATURE)).alias("top")
            leaders = members.groupBy("value", part.alias("part")).agg(top).select(
                "value",
                (-F.col("top.col2")).alias("leader"),
                F.col("top.component").alias("leading"),
                F.col("top.n_shingles").alias("led_shingles"),
                *[F.col(f"top.{c}").alias(f"led_{c}") for c in SIGNATURE],
                F.col("top.picked").alias("led_picked"),
            )
            leaders = land(leaders, "leaders")
            can = (members["value"] == leaders["value"]) & (F.col("component") != F.col("leading")) & _can_link(percent)
            if last:
                can = can & (F.col("doc") < F.col("leader"))
            # Two documents share many lists and meet in one: the first that both have picked, or any other without.
            if phase == "picked":
                can = can & (members["value"] == F.array_min(F.array_intersect("picked", "led_picked")))
            else:
                can = can & ~F.arrays_overlap("picked", "led_picked")
            few = leaders.agg(F.sum(F.size("led_picked") + len(SIGNATURE))).first()[0] <= BROADCAST_CELLS
            met = members.join(F.broadcast(leaders) if few else leaders.hint("merge"), can).select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b"))
            found = _confirm(met.distinct(), finer, texts_of, need, size, percent, fine)
            if not found.isEmpty():
                labels = _relabel(labels, found)
            # A leader has met all its list; its component is still there if another member is of it.
            open_lists = join_small(members, leaders.select("value", F.col("leader").alias("doc")), ["value", "doc"], "left_anti")
            leaders_each *= 8

    named = classes.select(*same, "doc")
    if labels is not None:
        named = named.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component_id", F.coalesce("component", "doc"))
    else:
        named = named.withColumn("component_id", F.col("doc"))
    named = land(named.select(*same, "component_id"), "named").hint("merge")
    out = sketches.drop("sketch").join(named, same, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def remove_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents, all their columns, one of each group: that of the smallest doc_id, a null one last, and
    of rows that share it any one.  Each row is a document of its own, whether its doc_id is null,
    repeated or neither; rows without a word stay."""
    rows, number = numbered(docs)
    found = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), **options)
    # Only groups of several rows need their ids compared.
    found = land(found.filter("n_shingles > 0").select("doc_id", "component_id"), "groups")
    groups = found.filter("doc_id <> component_id").select("component_id").distinct()
    members = found.join(land(groups, "several").hint("merge"), "component_id", "left_semi").withColumnRenamed("doc_id", number)
    named = members.join(rows.select(number, F.col("doc_id").cast("long").alias("_id")).hint("merge"), number)
    place = F.struct(F.col("_id").isNull(), "_id", number)
    stays = land(named.groupBy("component_id").agg(F.min(place).alias("p")).select(F.col(f"p.{number}").alias("doc_id")), "stays")
    gone = land(members.select(F.col(number).alias("doc_id")).join(stays.hint("merge"), "doc_id", "left_anti"), "gone")
    return without(rows, number, gone)
