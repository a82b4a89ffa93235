"""Scores of a gated recurrent language model over whole documents.

Tokens are white-space words and one end.  The output is factored by class:

    P(word | past) = P(class | past) * P(word | class)

* The state of a gated recurrent unit gives the class by a softmax; state runs over the whole document,
  through every window, so the score is the log-likelihood of the complete text.
* Inside a class the softmax has the frozen counts of the corpus as weights: (c + 1) over the class's
  counts plus its distinct words plus one, the last for all words that training never saw.

The ITEMS most frequent words are items of their own; other words are items by a hash of their last two
bytes.  Items with like neighbours form a class (spherical k-means of their neighbour counts).  Counts,
class sums, the unigram base and the neighbours cover all training documents.  The unit is trained by
truncated backpropagation in numpy on all of them, each in one of ROUNDS rounds: in a round every task
starts from the same weights and learns from its own part, and the results are averaged by tokens.

Defined cases: a null text is empty and has the end alone; a null id is never in training, nor held
out; without training documents every word is unknown; every row gives a row, repeated ones too; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areaindex.llm.common import crc_of_id, land, rebatch, space_words, texts
from areaindex.llm.wordblocks import (
    CHUNK_ROWS,
    PACKED,
    by_word,
    need_words,
    pack_by_block,
    unpack,
    unpack_block,
    whole_words,
    word_blocks,
)

END = b""
ITEMS = 4096
ENDINGS = 1024
CLASSES = 64
HIDDEN = 24
FEATURES = 256
WINDOW = 16
LANES = 32
#: With many tokens, more lanes make larger steps: a lane for so many, up to MOST_LANES.
LANE_TOKENS = 8192
MOST_LANES = 128
ROUNDS = 3
RATE = 0.08


def tokens(text: bytes) -> list[bytes]:
    return [*space_words(text), END]


def learns(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


class Items(dict):
    """Item of a word: its place among the frequent ones, else by its ending."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.frequent = len(words)

    def __missing__(self, word: bytes) -> int:
        return self.frequent + xxhash.xxh3_64_intdigest(word[-2:]) % ENDINGS

    def row(self, text: bytes) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens(text)), np.int64)


# --- classes ---------------------------------------------------------------------------------------


def _neighbours(batches, words):
    """Counts of (item, feature): which frequent items stand before and after it."""
    items = Items(words)
    n, features = len(words) + ENDINGS, min(FEATURES, len(words))
    counts = np.zeros(n * 2 * features, np.int32)
    for batch in rebatch(batches):
        rows = [items.row(text) for text in texts(batch)]
        flat = np.concatenate(rows)
        inside = np.ones(max(0, len(flat) - 1), bool)
        inside[np.cumsum([len(r) for r in rows])[:-1] - 1] = False  # neighbours stand in one document
        for side, (item, other) in enumerate(((flat[1:], flat[:-1]), (flat[:-1], flat[1:]))):
            near = inside & (other < features)
            cells, times = np.unique(item[near] * 2 * features + side * features + other[near], return_counts=True)
            counts[cells] += times.astype(np.int32)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_pydict({"cell": at, "times": counts[at].astype(np.int64)})


def cluster(cells: np.ndarray, times: np.ndarray, n_items: int, features: int, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of every item by spherical k-means; items without neighbours share class 0."""
    matrix = np.zeros((n_items, max(1, 2 * features)), np.float32)
    matrix[cells // max(1, 2 * features), cells % max(1, 2 * features)] = times
    weight = matrix.sum(1)
    total = max(1.0, float(weight.sum()))
    expected = np.outer(weight, matrix.sum(0)) / total
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = np.where(matrix > 0, np.maximum(0, np.log(matrix / expected)), 0).astype(np.float32)
    matrix /= np.maximum(1e-9, np.linalg.norm(matrix, axis=1, keepdims=True))
    order = np.argsort(-weight, kind="stable")
    centres = matrix[order[: min(classes, n_items)]].copy()
    which = np.zeros(n_items, np.int64)
    for _ in range(rounds):
        which = (matrix @ centres.T).argmax(1)
        for c in range(len(centres)):
            mean = (matrix[which == c] * np.log1p(weight[which == c])[:, None]).sum(0)
            if (norm := np.linalg.norm(mean)) > 0:
                centres[c] = mean / norm
    return which


# --- the unit ---------------------------------------------------------------------------------------


def start_weights(n_items: int, class_share: np.ndarray, hidden: int = HIDDEN, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the output starts as the shares of the classes."""
    draw = np.random.default_rng(seed)
    normal = lambda *shape: (draw.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "input": normal(n_items + 1, 3 * hidden),  # the last row starts a document
        "gates": normal(hidden, 2 * hidden) * 2,
        "new": normal(hidden, hidden) * 2,
        "out": normal(hidden, len(class_share)),
        "bias": np.log(class_share).astype(np.float32),
    }


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def step(w, state, items):
    """State after reading ``items``, and what the backward pass needs."""
    hidden = state.shape[1]
    x = w["input"][items]
    gates = _sigmoid(x[:, : 2 * hidden] + state @ w["gates"])
    keep, reset = gates[:, :hidden], gates[:, hidden:]
    gated = reset * state
    new = np.tanh(x[:, 2 * hidden :] + gated @ w["new"])
    return keep * state + (1 - keep) * new, (items, state, keep, reset, gated, new)


def _logits(w, state):
    """Of every class, the largest being 0."""
    logits = state @ w["out"] + w["bias"]
    logits -= logits.max(1, keepdims=True)
    return logits


def log_classes(w, state):
    """Log probability of every class, natural logarithm."""
    logits = _logits(w, state)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def log_class(w, state, classes):
    """Log probability of one class for each state."""
    logits = _logits(w, state)
    own = logits[np.arange(len(logits)), classes]
    return own - np.log(np.exp(logits, out=logits).sum(1))


def _learn_window(w, memory, state, inputs, targets, rate):
    """One truncated pass over a window of (steps, lanes); a target below 0 doesn't count."""
    trail, states, grads = [], [], {k: np.zeros_like(v) for k, v in w.items() if k != "input"}
    for t in range(len(inputs)):
        start = inputs[t] == len(w["input"]) - 1
        if start.any():
            state = np.where(start[:, None], np.float32(0), state)
        state, back = step(w, state, inputs[t])
        trail.append(back)
        states.append(state)
    flow, rows, row_grads, before_all = np.zeros_like(state), [], [], []
    hidden, wanted = state.shape[1], targets.ravel()
    after = np.concatenate(states)
    error = _logits(w, after)
    np.exp(error, out=error)
    error /= error.sum(1, keepdims=True)
    error[np.arange(len(error)), np.maximum(wanted, 0)] -= 1
    error[wanted < 0] = 0
    grads["out"] += after.T @ error
    grads["bias"] += error.sum(0)
    from_out = (error @ w["out"].T).reshape(len(inputs), *state.shape)
    for t in reversed(range(len(inputs))):
        flow = flow + from_out[t]
        items, before, keep, reset, gated, new = trail[t]
        d_new = flow * (1 - keep) * (1 - new * new)
        d_gated = d_new @ w["new"].T
        d_keep = flow * (before - new) * keep * (1 - keep)
        d_reset = d_gated * before * reset * (1 - reset)
        d_gates = np.concatenate([d_keep, d_reset], 1)
        rows.append(items)
        row_grads.append(np.concatenate([d_gates, d_new], 1))
        before_all.append((gated, before))
        flow = flow * keep + d_gated * reset + d_gates @ w["gates"].T
        flow[items == len(w["input"]) - 1] = 0
    row_grads = np.concatenate(row_grads)
    gated, before = (np.concatenate(x) for x in zip(*before_all, strict=True))
    grads["new"] += gated.T @ row_grads[:, 2 * hidden :]
    grads["gates"] += before.T @ row_grads[:, : 2 * hidden]
    scale = np.float32(1 / max(1, int((targets >= 0).sum())) ** 0.5)
    for k, g in grads.items():
        g *= scale
        memory[k] += g * g
        w[k] -= rate * g / np.sqrt(memory[k] + 1e-6)
    rows = np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    items, firsts = np.unique(rows[order], return_index=True)
    g = np.add.reduceat(row_grads[order], firsts) * scale
    memory["input"][items] += g * g
    w["input"][items] -= rate * g / np.sqrt(memory["input"][items] + 1e-6)
    return state


def learn(w, rows: list[np.ndarray], classes: np.ndarray, rate: float = RATE, window: int = WINDOW, lanes: int = LANES):
    """Train on documents (item rows): they are laid end to end in ``lanes`` streams, or more where
    there are many tokens."""
    if not rows:
        return w, 0
    first = len(w["input"]) - 1
    inputs = np.concatenate([np.concatenate([[first], r[:-1]]) for r in rows])
    targets = classes[np.concatenate(rows)]
    lanes = max(1, min(lanes, len(inputs) // (4 * window)), min(MOST_LANES, len(inputs) // LANE_TOKENS))
    learned = len(inputs)
    n = -(-learned // lanes)
    inputs, targets = (np.pad(x, (0, n * lanes - learned), constant_values=v).reshape(lanes, n).T for x, v in ((inputs, first), (targets, -1)))
    w = {k: v.copy() for k, v in w.items()}
    memory = {k: np.full_like(v, 1e-2) for k, v in w.items()}
    state = np.zeros((lanes, w["new"].shape[0]), np.float32)
    for i in range(0, n, window):
        state = _learn_window(w, memory, state, inputs[i : i + window], targets[i : i + window], rate)
    return w, learned


def _learn_part(batches, words, classes, weights):
    """Weights after this task's part, times its tokens."""
    items, rows, held, part = Items(words), [], 0, TaskContext.get().partitionId()
    w, total, learned = weights, {k: np.zeros_like(v, np.float64) for k, v in weights.items()}, 0
    for batch in rebatch(batches):
        for text in texts(batch):
            rows.append(items.row(text))
            held += len(rows[-1])
        if held > 2_000_000:  # what is in memory at a time
            w, n = learn(w, rows, classes)
            learned, rows, held = learned + n, [], 0
    w, n = learn(w, rows, classes)
    learned += n
    if learned:
        for k in sorted(w):
            total[k] += w[k].astype(np.float64) * learned
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [k], "tokens": [learned], "weights": pa.array([total[k].tobytes()], pa.binary())})


def _sum_parts(key, table):
    total = None
    for data in table.column("weights").to_pylist():
        part = np.frombuffer(data, np.float64)
        total = part.copy() if total is None else total + part
    return pa.table(
        {
            "part": pa.array([key[1].as_py()], pa.int32()),
            "name": [key[0].as_py()],
            "tokens": [sum(table.column("tokens").to_pylist())],
            "weights": pa.array([total.tobytes()], pa.binary()),
        }
    )


PARTS = "part int, name string, tokens long, weights binary"

#: Parts that one task sums at a time.
FAN = 16


def _average(parts: DataFrame, weights):
    """Mean of the weights over tasks, weighted by tokens.  Parts are summed FAN at a time, level by
    level, so no task ever holds more, however many tasks there were."""
    most = parts.agg(F.max("part")).first()[0]
    while most is not None and most > 0:
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("name", "part").applyInArrow(_sum_parts, PARTS)
        most //= FAN
    out = dict(weights)
    for r in parts.collect():  # one row per weight matrix
        mean = np.frombuffer(r["weights"], np.float64) / r["tokens"]
        out[r["name"]] = mean.reshape(weights[r["name"]].shape).astype(np.float32)
    return out


def train(docs: DataFrame, words: list[bytes], class_counts, hidden: int = HIDDEN, classes: int = CLASSES, rounds: int = ROUNDS):
    """(class of each item, weights) from all training documents (doc_id, text), which are scanned once
    for the neighbours and once a round; ``class_counts`` gives the corpus counts of the classes."""
    spark = docs.sparkSession
    dealt = docs.select(F.pmod(F.xxhash64(F.lit("round"), "doc_id"), F.lit(rounds)).alias("round"), "text")
    features, n_items = min(FEATURES, len(words)), len(words) + ENDINGS
    near = docs.select("text").mapInArrow(lambda it: _neighbours(it, words), "cell long, times long")
    cells = near.groupBy("cell").agg(F.sum("times").alias("times")).toArrow()  # at most items x features
    which = cluster(cells["cell"].to_numpy(), cells["times"].to_numpy(), n_items, features, classes)
    weights = start_weights(n_items, class_counts(which), hidden)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((words, which, weights))
        own = dealt.filter(F.col("round") == k).select("text")
        parts = land(own.mapInArrow(lambda it, sent=sent: _learn_part(it, *sent.value), PARTS), "weights")
        weights = _average(parts, weights)
    return which, weights


# --- scoring ----------------------------------------------------------------------------------------


def class_scores(w, classes: np.ndarray, items: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the log10 class probabilities of each document.  All documents step together, the longest
    first, and those that have ended leave; the state of each runs to its last token."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    out = np.zeros(len(sizes))
    longest = int(sizes[0]) if len(sizes) else 0
    # Documents still running at step t: sizes are sorted, so a prefix.
    running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")
    state = np.zeros((len(sizes), w["new"].shape[0]), np.float32)
    first = len(w["input"]) - 1
    read = np.full(len(sizes), first, np.int64)
    for t in range(longest):
        n = int(running[t])
        state, _ = step(w, state[:n], read[:n])
        read = items[starts[:n] + t]
        out[:n] += log_class(w, state, classes[read])
    back = np.empty(len(out))
    back[order] = out
    return back / np.log(10)


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score_block(sequences, packed, model, total: int, distinct: int):
    which, weights, class_sums = model["classes"], model["weights"], model["sums"]
    low, high, item = unpack_block(packed.column("columns").to_pylist(), 3, False)
    c = low + (high << 32)
    base = np.log10((c + 1) / (total + distinct + 1))
    inside = np.log10((c + 1) / class_sums[which[item]])
    ids = sequences.column("doc_id").to_pylist()
    rows = [unpack(r)[0] for r in sequences.column("words").to_pylist()]
    need_words(rows, len(c))
    sizes = np.array([len(r) for r in rows], np.int64)
    codes = np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int64)
    starts = np.cumsum(sizes) - sizes  # every document has its end, so none is empty
    add = lambda x: np.add.reduceat(x[codes], starts) if len(rows) else np.zeros(0, x.dtype)
    score = add(inside) + class_scores(weights, which, item[codes], starts, sizes)
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(add((c > 0).astype(np.int64))), pa.array(add(base)), pa.array(score)], schema=_SCORES)


WORDS = "word binary, c long, blocks array<long>, codes array<int>"


def _count_words(batches):
    """A row per distinct word: its count in training documents, and the blocks that hold it."""
    for table, firsts in whole_words(batches):
        learned = np.add.reduceat(table.column("learned").to_numpy(), firsts)
        offsets = pa.array(np.concatenate([firsts, [table.num_rows]]), pa.int32())
        blocks, codes = (table.column(k).combine_chunks() for k in ("block", "code"))
        blocks, codes = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (blocks, codes))
        columns = [
            table.column("word").combine_chunks().take(pa.array(firsts)),
            pa.array(learned),
            pa.ListArray.from_arrays(offsets, blocks),
            pa.ListArray.from_arrays(offsets, codes),
        ]
        whole = pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["word", "c", "blocks", "codes"])
        yield from whole.to_batches(max_chunksize=50_000)


def _send_back(batches, words):
    """Count and item of each word, packed by the blocks that hold it."""
    items = Items(words)

    def packed(held):
        item = np.fromiter((items[w] for b in held for w in b.column("word").to_pylist()), np.int64)
        c = np.concatenate([b.column("c").to_numpy() for b in held])
        times = np.concatenate([pc.list_value_length(b.column("blocks")).to_numpy() for b in held])
        blocks, codes = (np.concatenate([b.column(k).flatten().to_numpy() for b in held]) for k in ("blocks", "codes"))
        return pack_by_block(blocks, codes, *(np.repeat(x, times) for x in (c & 0xFFFFFFFF, c >> 32, item)))

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch.column("blocks").flatten())
        if rows >= CHUNK_ROWS:
            yield packed(held)
            held, rows = [], 0
    if held:
        yield packed(held)


def _class_of_counts(batches, words, which, classes):
    items = Items(words)
    n, v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for batch in rebatch(batches):
        item = np.fromiter(map(items.__getitem__, batch.column("word").to_pylist()), np.int64, batch.num_rows)
        np.add.at(n, which[item], batch.column("c").to_numpy())
        np.add.at(v, which[item], 1)
    yield pa.RecordBatch.from_pydict({"class": np.arange(classes), "n": n, "v": v})


def score_documents(docs: DataFrame, items: int = ITEMS, classes: int = CLASSES, hidden: int = HIDDEN) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary, sequences = word_blocks(rows, tokens, learns=learns)
    counts = land(by_word(dictionary).mapInArrow(_count_words, WORDS), "words")
    known = counts.filter("c > 0").select("word", "c")
    total, distinct = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = [bytes(r["word"]) for r in known.orderBy(F.desc("c"), "word").limit(items).select("word").collect()]

    def class_table(which):
        sums = np.zeros((2, classes), np.int64)
        per = known.mapInArrow(lambda it: _class_of_counts(it, words, which, classes), "class long, n long, v long")
        for r in per.groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # a row per class
            sums[:, r["class"]] = r["n"], r["v"]
        return sums

    tables = []

    def class_share(which):
        tables.append(class_table(which))
        n = tables[-1][0] + 1.0
        return n / n.sum()

    which, weights = train(rows.filter(F.coalesce(crc_of_id() % 7 != 2, F.lit(False))), words, class_share, hidden, classes)
    model = {"words": words, "classes": which, "weights": weights, "sums": tables[-1].sum(0) + 1}
    sent = spark.sparkContext.broadcast(model)
    back = counts.mapInArrow(lambda it: _send_back(it, sent.value["words"]), PACKED)

    def score(s: pa.Table, w: pa.Table) -> pa.Table:
        return _score_block(s, w, sent.value, total, distinct)

    scored = sequences.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, SCORES)
    held_out = F.coalesce(crc_of_id() % 7 == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
