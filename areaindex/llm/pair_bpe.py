"""BPE by an index of pair occurrences.

A task cuts the texts of its partition, block by block, into words at white space.  Words not met before go
through the tokenizer's own normalizer and pre-tokenizer, many a call, into units; the symbols of all new units
stand in one array, and an index maps the rank of each adjacent pair to all its places.  Active ranks are applied
in ascending order: all places of a rank merge at once, and only the lists of the pairs beside them
change.  So a merge costs its occurrences, however many units the partition has.  Documents are then gathered
from the ids of their units.

Where a vocabulary has a merge that outranks one of those its parts came from, only the leftmost
place of each unit merges at a time, so the order is the library's own in any vocabulary.

Defined cases: a null text is empty and has no ids; every row of the input gives one row, also with a null or
repeated doc_id; other columns are ignored; an empty table gives no rows.  Special tokens in a text are single
ids, as the library has it.  Symbols that the vocabulary lacks are left out.  Decoding is the library's:
unknown ids are left out, and without a decoder the tokens are joined by a space.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areaindex.llm.common import LOWER, rebatch
from areaindex.llm.wordblocks import gather

#: Words that a task remembers before it starts anew.
REMEMBERED = 1 << 19

#: Words of one call that cuts them.
JOINED = 1000

#: A pattern of units, and a faster twin for characters below _FAR, which normalizing only lower-cases.  The one
#: exception, a capital I with a dot, becomes two characters.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FAR, _DOTTED = "\u0180", "\u0130"


#: Byte tables: white space to a space, and that with A-Z to a-z.  All other bytes stay.
_SPACE = np.array([32 if 9 <= b <= 13 else b for b in range(256)], np.uint8)
_FOLD = np.frombuffer(LOWER, np.uint8)[_SPACE]


def _is_near(text: str) -> bool:
    return text.isascii() or (max(text) < _FAR and _DOTTED not in text)


def _near(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(ord(_FAR)) if unicodedata.category(chr(c))[0] == kind)


#: Each match is a unit, or the line end that parts words.
_NEAR_UNITS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{_near('L')}]+|[{_near('N')}]|[^\t-\r \x85\xa0{_near('L')}{_near('N')}]+|\n"
).findall


def _byte_characters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable Latin-1 ones stand for
    themselves, the others follow 255 in order."""
    own = [c for c in range(256) if 0x21 <= c <= 0x7E or (c >= 0xA1 and c != 0xAD)]
    others = {c: 256 + i for i, c in enumerate(c for c in range(256) if c not in own)}
    return [chr(others.get(c, c)) for c in range(256)]


def _steps(spec: dict | None, name: str) -> list[dict]:
    """The steps of a sequence, or the one step, or none."""
    return [] if spec is None else spec.get(name, [spec])


class Merges:
    """The merge list of a vocabulary, searchable by pairs of symbols."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.width = max(vocabulary.values(), default=0) + 1
        self.left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        self.result = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        keys = self.left * self.width + self.right
        self.rank_of_key = np.argsort(keys, kind="stable")
        self.keys = np.concatenate([keys[self.rank_of_key], [-1]])
        self.rank_type = np.uint16 if len(pairs) <= 1 << 16 else np.int64
        # The last rank that makes a symbol: a merge that uses the symbol at a lower rank comes late.
        made = np.full(self.width, -1)
        np.maximum.at(made, self.result, np.arange(len(pairs)))
        late = np.zeros(len(pairs), bool)
        for part in (self.left, self.right):
            makers = made[part]
            late[makers[makers > np.arange(len(pairs))]] = True
        self.one_by_one = bool(late.any())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        if len(self.keys) == 1:
            return np.full(len(left), -1)
        keys = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys[:-1], keys)
        found = self.keys[at] == keys
        return np.where(found, self.rank_of_key[np.where(found, at, 0)], -1)

    def apply(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units whose symbols stand in a row, ``sizes`` of them each."""
        n = len(symbols)
        if n < 2:
            return sizes, symbols
        # Place n stands for no neighbour; it holds a symbol that no merge has.
        symbol = np.append(symbols.astype(np.int64), self.width)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = n
        before[ends - sizes[sizes > 0]] = n
        after[n] = before[n] = n
        merged = np.zeros(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(places: np.ndarray) -> None:
            """Put the pairs that start at ``places`` into the index."""
            ranks = self.ranks(symbol[places], symbol[after[places]])
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks.astype(self.rank_type), kind="stable")  # by digits where 16 bits hold a rank
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else [], np.split(places, cuts), strict=False):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(active, rank)

        add(np.flatnonzero(after[:n] < n))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            places = np.sort(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self.left[rank], self.right[rank]
            places = places[(symbol[places] == a) & (symbol[after[places]] == b)]
            if a == b and len(places) > 1:
                # In a run of one symbol every second pair merges, from the left.
                new_run = np.append(True, after[places[:-1]] != places[1:])
                start = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - start) % 2 == 0]
            if self.one_by_one and len(places) > 1:
                first = np.append(True, unit[places[1:]] != unit[places[:-1]])
                if not first.all():
                    index[rank] = [places[~first]]
                    heapq.heappush(active, rank)
                    places = places[first]
            if not len(places):
                continue
            gone = after[places]
            symbol[places] = self.result[rank]
            symbol[gone] = -1
            further = after[gone]
            after[places] = further
            before[further] = places
            before[n] = n
            lefts = before[places]
            merged[places] = True  # a left neighbour that merged too is listed once, by itself
            add(np.concatenate([lefts[(lefts < n) & ~merged[lefts]], places[further < n]]))
            merged[places] = False
        kept = symbol[:n] >= 0
        return np.bincount(unit[kept], minlength=len(sizes)), symbol[:n][kept]


class Vocabulary:
    """A tokenizer file with byte symbols: what all tasks read and none changes."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        unfit = [k for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token") if model.get(k)]
        if model["type"] != "BPE" or unfit:
            raise ValueError(f"not a plain BPE vocabulary: {model['type']} {unfit}")
        kinds = [n["type"] for n in _steps(spec["normalizer"], "normalizers")]
        if not set(kinds) <= {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"normalizers {kinds} may join words")
        cuts = _steps(spec["pre_tokenizer"], "pretokenizers")
        if not cuts or cuts[-1]["type"] != "ByteLevel" or cuts[-1].get("add_prefix_space"):
            raise ValueError("the last pre-tokenizer must give bytes, without a space before them")
        self.spec, self.library = tokenizer_json, None
        self.lower = "Lowercase" in kinds
        self.twin = self.lower and [c.get("pattern", {}).get("Regex") for c in cuts] == [_PATTERN, None]
        self.merges = Merges(model["vocab"], model["merges"])
        # Symbol of each byte inside and at the end of a unit.
        suffix = model.get("end_of_word_suffix") or ""
        self.inner, self.last = (np.array([model["vocab"].get(c + s, -1) for c in _byte_characters()]) for s in ("", suffix))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = {i: t for t, i in {**model["vocab"], **self.special}.items()}
        self.tokens = [known.get(i) for i in range(max(known, default=0) + 1)]
        self.plain_join = spec["decoder"] is None

    def tokenizer(self):
        """The library's own, made when first needed."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        return self.library

    def __getstate__(self):
        return {**self.__dict__, "library": None}

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Text of each list: its tokens without unknown ids, joined by a space where the file has no decoder."""
        flat, offsets = ids.flatten(), np.append(0, np.cumsum(pc.list_value_length(ids).to_numpy()))
        tokens = pa.array([*self.tokens, None], pa.string())
        at = flat.to_numpy()
        known = (at >= 0) & (at < len(self.tokens))
        found = tokens.take(pa.array(np.where(known, at, len(self.tokens))))
        if found.null_count:
            kept = found.is_valid().to_numpy(zero_copy_only=False)
            found, offsets = found.drop_null(), np.append(0, np.cumsum(kept))[offsets]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)
        if self.plain_join:
            return pc.binary_join(lists, " ")
        return pa.array(map(self.tokenizer().decoder.decode, lists.to_pylist()), pa.string())


def _translate(text: pa.LargeStringArray, as_is: np.ndarray) -> pa.LargeStringArray:
    """White space of one byte becomes a space, and A-Z a-z but for the rows ``as_is``."""
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out = _FOLD[data]
    for row in np.flatnonzero(as_is).tolist():
        place = slice(offsets[row], offsets[row + 1])
        out[place] = _SPACE[data[place]]
    return pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets), pa.py_buffer(out))


class PairEncoder:
    """Ids of texts by the pair index; words and units met before are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.special = vocabulary, vocabulary.special
        longest_first = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(longest_first) + ")").split if self.special else lambda text: [text]
        self.clear()

    def clear(self) -> None:
        """Forget all words and units."""
        self.words: dict[str, int] = defaultdict(count().__next__)
        self.units: dict[str, int] = defaultdict(count().__next__)
        # Ids of the units, and units of the words, as flat lists with their sizes.  A special token is a
        # unit by its own text behind a space, which no other unit holds.
        self.unit_ids, self.unit_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.word_units, self.word_size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and units of plain words, by the library: one call for many."""
        tokenizer = self.vocabulary.tokenizer()
        joined = list(map(tokenizer.normalizer.normalize_str, words)) if tokenizer.normalizer else words
        start = np.cumsum([0] + [len(w) + 1 for w in joined])
        text = " ".join(joined)
        spans = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        units = np.fromiter((self.units[text[a:b]] for a, b in spans), np.int64, len(spans))
        word = np.searchsorted(start, np.fromiter((a for a, _ in spans), np.int64, len(spans)), "right") - 1
        return np.bincount(word, minlength=len(words)), units

    def _cut_near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the twin of the pattern, for words of near characters."""
        found = _NEAR_UNITS("\n".join([*words, ""]).lower())
        units = np.fromiter(map(self.units.__getitem__, found), np.int64, len(found))
        end = units == self.units["\n"]
        return np.diff(np.flatnonzero(end) - np.arange(len(words)), prepend=0), units[~end]

    def _cut_special(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that hold special tokens."""
        sizes, units = [], []
        for word in words:
            parts = [p for p in self.split_special(word) if p]
            found = [np.array([self.units[" " + p]]) if p in self.special else self._cut([p])[1] for p in parts]
            sizes.append(sum(map(len, found)))
            units += found
        return np.array(sizes, np.int64), np.concatenate(units)

    def _learn(self, words: list[str], special: bool) -> None:
        """Ids of words not met before; ``special`` tells that some may hold special tokens."""
        order, sizes, units = [], [], []
        for first in range(0, len(words), JOINED):
            held = words[first : first + JOINED]
            every = np.arange(first, first + len(held))
            if self.vocabulary.twin and not special and _is_near("".join(held)):
                kinds = [(self._cut_near, every)]
            else:
                odd = np.array([special and len(self.split_special(w)) > 1 for w in held])
                near = np.array([self.vocabulary.twin and _is_near(w) for w in held]) & ~odd
                kinds = [(self._cut_special, every[odd]), (self._cut_near, every[near]), (self._cut, every[~odd & ~near])]
            for cut, places in kinds:
                if len(places):
                    size, found = cut([held[i - first] for i in places.tolist()])
                    order.append(places)
                    sizes.append(size)
                    units.append(found)
        size, flat, order = np.concatenate(sizes), np.concatenate(units), np.argsort(np.concatenate(order))
        self.word_units = np.concatenate([self.word_units, gather(flat, np.cumsum(size) - size, size, order)[0]])
        self.word_size = np.concatenate([self.word_size, size[order]])
        self._merge(list(islice(self.units, len(self.unit_size), None)))

    def _merge(self, units: list[str]) -> None:
        """Ids of units not met before."""
        special = np.array([self.special.get(u[1:], -1) if u[0] == " " else -1 for u in units], np.int64)
        data = [u.encode("utf-8") if s < 0 else b"" for u, s in zip(units, special.tolist(), strict=True)]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        values = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.vocabulary.inner[values]
        ends = np.cumsum(sizes)[sizes > 0] - 1
        symbols[ends] = self.vocabulary.last[values[ends]]
        unit = np.repeat(np.arange(len(units)), sizes)[symbols >= 0]
        sizes, ids = self.vocabulary.merges.apply(symbols[symbols >= 0], np.bincount(unit, minlength=len(units)))
        own = np.flatnonzero(special >= 0)
        self.unit_ids = np.concatenate([self.unit_ids, np.insert(ids, np.cumsum(sizes)[own], special[own])])
        self.unit_size = np.concatenate([self.unit_size, np.where(special >= 0, 1, sizes)])

    def encode(self, text: pa.StringArray) -> pa.ListArray:
        """Ids of each text; null is empty."""
        if len(self.words) > REMEMBERED:
            self.clear()
        # Special tokens are told by their case; other texts have fewer words in lower case.
        text = text.fill_null("").cast(pa.large_string())
        special = np.zeros(len(text), bool)
        for mark in self.special:
            special |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(_translate(text, special if self.vocabulary.lower else np.ones(len(text), bool)), " ")
        words = split.flatten().dictionary_encode()
        held = words.dictionary.to_pylist()
        code = np.fromiter(map(self.words.__getitem__, held), np.int64, len(held))
        if len(self.words) > len(self.word_size):
            self._learn(list(islice(self.words, len(self.word_size), None)), bool(special.any()))
        # From words of this call to their units, and on to ids.
        own_units, own_ends = gather(self.word_units, np.cumsum(self.word_size) - self.word_size, self.word_size, code)
        own, own_unit_ends = gather(self.unit_ids, np.cumsum(self.unit_size) - self.unit_size, self.unit_size, own_units)
        ends = np.append(0, own_unit_ends)[own_ends]
        sizes = np.diff(ends, prepend=0)
        ids, word_ends = gather(own.astype(np.int32), ends - sizes, sizes, words.indices.to_numpy())
        doc_words = np.cumsum(pc.list_value_length(split).to_numpy())
        bounds = np.append(0, np.append(0, word_ends)[doc_words])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))


_FIELDS = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
ENCODED = "doc_id long, ids array<int>"


def _encode_batches(batches, vocabulary, decoded):
    encoder = PairEncoder(vocabulary)
    for batch in rebatch(batches):
        ids = encoder.encode(batch.column("text"))
        columns = [batch.column("doc_id"), ids] + ([vocabulary.decode(ids)] if decoded else [])
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(_FIELDS[: len(columns)]))


def _vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(Vocabulary(file.read()))  # bounded by the tokenizer, not by data


def encode(docs: DataFrame, tokenizer_path: str, decoded: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id and ``ids``, as the tokenizer file's library gives them without added
    special tokens, truncation or padding; with ``decoded`` also the text that these ids decode to."""
    sent = _vocabulary(docs.sparkSession, tokenizer_path)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    schema = ENCODED + ", decoded string" * decoded
    return rows.mapInArrow(lambda it: _encode_batches(it, sent.value, decoded), schema)


def _decode_batches(batches, vocabulary):
    for batch in rebatch(batches):
        lists = batch.column("ids").fill_null([])
        yield batch.append_column("decoded", vocabulary.decode(lists))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that the library decodes its ids to, special tokens kept."""
    sent = _vocabulary(encoded.sparkSession, tokenizer_path)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(lambda it: _decode_batches(it, sent.value), f"{names}, decoded string")


def encoding_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 of the decimal ids joined by a space, decoded_sha256."""
    return encode(docs, tokenizer_path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
