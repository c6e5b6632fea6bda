"""Evaluation passages inside training documents by spaced seeds (problem 9), losing nothing that counts.

A seed is three words with up to SKIP - 1 words ignored after each of the first two: nine masks, taken of both sides,
so that words left out of a passage, put in or replaced shift nothing. Of the words that a passage repeats in order, at
most so many neighbours can be further apart than the masks reach, in the item or in the text; the other triples are
shared seeds, `shared_seeds` of them at least. So of an item only the seeds at its rarest places are joined with the
documents' seeds; where MEET of them meet within a passage's length, the words around are aligned in order and judged.
A solid mask of RUN words finds words in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.llm.words import END, batch_words
from molquarry.runtime import Scratch

#: Words in a row, and share of an item's words (as a fraction) within a passage of at most STRETCH times its length, that count.
RUN, SHARE, STRETCH = 16, (4, 5), (5, 4)
#: The masks: the second and third word of a seed stand 1 to SKIP places after the one before.
SKIP = 3
#: Places of shared seeds that must meet in a passage, or all that it must share if these are fewer. It decides the work, not the result.
MEET = 10
#: Words of the items that are joined at once: some 200 bytes each. More items take more blocks of the same size.
BLOCK_WORDS = 200_000
#: Bits of the filter before the join; words of documents that are joined at once; word hashes that a task remembers.
FILTER_BITS, AT_ONCE, REMEMBERED = 24, 1_000_000, 1_000_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D))


def width(n: int) -> int:
    """The longest passage that can repeat an item of n words."""
    return n * STRETCH[0] // STRETCH[1]


def least_words(n: int) -> int:
    """Words of an item of n words that a passage must repeat."""
    return -(-n * SHARE[0] // SHARE[1])


def shared_seeds(n: int) -> int:
    """Seeds, beginning at different places of item and text, that a passage with SHARE of an item's n words has at least.

    Of the m words in order, m - 2 triples are neighbours. A gap is too wide if it skips SKIP places or more, so the
    words left out allow (n - m) / SKIP such gaps and the words put in (width - m) / SKIP; each spoils two triples.
    Items of one and two words have one seed of their own.
    """
    m = least_words(n)
    return 1 if n < 3 else m - 2 - 2 * ((n - m) // SKIP + (width(n) - m) // SKIP)


class WordHashes(dict):
    """Word to its 64-bit hash, the same in every task; 0 ends a text."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word) or 1
        return h

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, each text closed by 0; where each text begins and all end)."""
        if len(self) > REMEMBERED:
            self.clear()
            self[END] = 0
        words, begin = batch_words(texts)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words)), begin


def seeds(h: np.ndarray, short: tuple[bool, bool] = (False, False)) -> Iterator[tuple[np.ndarray, int]]:
    """(hash of the seed from each place, places that it spans) for each mask; short: also of single words and of neighbours."""
    with np.errstate(over="ignore"):
        if short[0]:
            yield _mixed(h * _ODD[1]), 1
        for a in range(1, SKIP + 1):
            two = max(len(h) - a, 0)
            pair = _mixed(h[:two] * _ODD[0] + h[a : a + two]) * _ODD[1]
            if a == 1 and short[1]:
                yield _mixed(pair), 2
            for b in range(1, SKIP + 1):
                three = max(two - b, 0)
                yield _mixed(pair[:three] + h[a + b : a + b + three]), a + b + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _ODD[0]
    return x ^ (x >> np.uint64(32))


class Passage:
    """An item that passages are judged by."""

    def __init__(self, words: np.ndarray):
        self.n, self.words = len(words), words
        self.at: dict[int, int] = {}
        for p, w in enumerate(words.tolist()):
            self.at[w] = self.at.get(w, 0) | 1 << p
        self.runs = set(_runs(words).tolist())

    def in_order(self, words: list[int]) -> int:
        """The longest common subsequence with the item, its whole state in the bits of one number."""
        full = (1 << self.n) - 1
        state = full
        for w in words:
            match = self.at.get(w)
            if match:
                both = state & match
                state = ((state + both) | (state - both)) & full
        return self.n - state.bit_count()

    def repeats(self, words: np.ndarray) -> bool:
        """Whether these RUN words stand in the item in a row."""
        return any(np.array_equal(self.words[p : p + RUN], words) for p in range(self.n - RUN + 1))

    def stands_in(self, text: np.ndarray) -> bool:
        """Whether a passage of the text repeats the item."""
        words = text.tolist()
        if len(words) == RUN and self.repeats(text):
            return True
        need, wide = least_words(self.n), width(self.n)
        if not self.n or self.in_order(words) < need:
            return False
        there = np.fromiter((w in self.at for w in words), bool, len(words))
        upto = np.concatenate([[0], np.cumsum(there)])
        start = np.flatnonzero(there)  # a passage may as well begin with a word of the item
        enough = upto[np.minimum(start + wide, len(words))] - upto[start]
        start, enough = start[enough >= need], enough[enough >= need]
        return any(self.in_order(words[s : s + wide]) >= need for s in start[np.argsort(-enough, kind="stable")].tolist())


def _runs(words: np.ndarray) -> np.ndarray:
    """A hash of the RUN words from each place that has so many."""
    key, size = words * _ODD[0], 1
    with np.errstate(over="ignore"):
        while size < RUN:
            n = max(len(key) - size, 0)
            key = _mixed(key[:n]) * _ODD[1] + key[size : size + n]
            size *= 2
    return key


class SeedIndex:
    """The seeds of a block of items, sorted for the join: each seed once, with the items that have it at a rare place."""

    def __init__(self, ids: list[int], items: list[np.ndarray]):
        self.ids = np.asarray(ids, np.int64)
        self.passages = [Passage(x) for x in items]
        self.widths = np.asarray([width(len(x)) for x in items], np.int64)
        self.needs = np.asarray([min(MEET, shared_seeds(len(x))) for x in items], np.int64)
        self.short = any(len(x) == 1 for x in items), any(len(x) == 2 for x in items)
        own = [[(k, span) for k, span in seeds(x, (len(x) == 1, len(x) == 2)) if len(x) > 2 or span == len(x)] for x in items]
        every, code = np.unique(_joined([k for x in own for k, _ in x]), return_inverse=True)
        begin = np.cumsum([0, *(len(k) for x in own for k, _ in x)])
        mask = iter(zip(begin[:-1], begin[1:]))
        coded = [[code[slice(*next(mask))] for _ in x] for x in own]
        frequent = np.bincount(_joined([np.unique(_joined(x)) for x in coded]).astype(np.int64), minlength=len(every))
        word, item = [], []
        for i, (x, masks) in enumerate(zip(items, coded)):
            starts = max(len(x) - 2, 1)
            cost = np.zeros(starts)
            for c in masks:
                cost[: len(c)] += frequent[c]
            # Of any `starts - shared + need` places of an item a passage that counts shares a seed at `need`.
            rare = np.zeros(starts, bool)
            rare[np.argsort(cost, kind="stable")[: starts - shared_seeds(len(x)) + self.needs[i]]] = True
            chosen = np.unique(_joined([c[rare[: len(c)]] for c in masks]))
            word.append(chosen), item.append(np.full(len(chosen), i))
        word, item = _joined(word).astype(np.int64), _joined(item).astype(np.int64)
        order = np.argsort(word, kind="stable")
        used, first = np.unique(word[order], return_index=True)
        self.keys, self.first, self.holders = every[used], np.append(first, len(word)), item[order]
        self.runs = np.unique(_joined([_runs(x) for x in items]))
        self.bits = _bit_table(self.keys), _bit_table(self.runs)

    def meets(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last + 1): stretches of the words h, texts closed by 0, with all passages where enough seeds meet."""
        ended = np.concatenate([[0], np.cumsum(h == 0)])
        place, key = [], []
        for own, span in seeds(h, self.short):
            at = _known(self.bits[0], own)
            at = at[ended[at + span] == ended[at]]
            place.append(at), key.append(own[at])
        place, key = np.concatenate(place), np.concatenate(key)
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        same = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        place, at = place[same], at[same]
        n = self.first[at + 1] - self.first[at]
        item = self.holders[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        both = np.unique(item * len(h) + np.repeat(place, n))
        item, place = both // max(len(h), 1), both % max(len(h), 1)
        last = np.arange(len(both)) + self.needs[item] - 1
        inside = np.minimum(last, max(len(both) - 1, 0))
        met = (last == inside) & (item[inside] == item) & (place[inside] - place < self.widths[item]) & (ended[place[inside]] == ended[place])
        first, last, item = place[met], place[inside[met]], item[met]
        ends = np.append(np.flatnonzero(h == 0), len(h))
        text = ended[first]
        lo, hi = np.maximum(np.where(text > 0, ends[text - 1] + 1, 0), last - self.widths[item] + 1), np.minimum(ends[text], first + self.widths[item])
        new = np.ones(len(first), bool)
        new[1:] = (item[1:] != item[:-1]) | (lo[1:] > hi[:-1]) | (text[1:] != text[:-1])
        begins = np.flatnonzero(new)
        finals = np.append(begins[1:], len(first))[: len(begins)] - 1
        yield from zip(item[begins].tolist(), lo[begins].tolist(), hi[finals].tolist())
        run = _runs(h)
        at = _known(self.bits[1], run)
        at = at[np.isin(run[at], self.runs)] if len(at) else at
        for a in at.tolist():
            words = h[a : a + RUN]
            yield from ((i, a, a + RUN) for i, p in enumerate(self.passages) if int(run[a]) in p.runs and p.repeats(words))

    def found(self, h: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of all passages that count. Words are joined AT_ONCE at a time, with the longest passage beyond."""
        got: set[tuple[int, int]] = set()
        for s in range(0, len(h), AT_ONCE):
            for i, a, z in self.meets(h[s : s + AT_ONCE + max(int(self.widths.max()), RUN)]):
                pair = int(np.searchsorted(begin, s + a, "right")) - 1, i
                if pair not in got and self.passages[i].stands_in(h[s + a : s + z]):
                    got.add(pair)
        return got


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _bit_table(keys: np.ndarray) -> np.ndarray:
    """A bit for the upper FILTER_BITS bits of each key."""
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def _known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the keys that the table of bits may know."""
    slot = keys >> np.uint64(64 - FILTER_BITS)
    return np.flatnonzero(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key): each document with each item of which it holds a passage; documents are read whole.

    A passage is RUN words of the item in a row, or SHARE of its words in order within at most STRETCH times its
    length. Case, punctuation, white space, markup, invisible characters and look-alikes don't matter. Null, empty
    and blank texts hold nothing, and items without words are held by none; null keys are left out, of repeated keys
    each text counts. The items are the query set: blocks of BLOCK_WORDS of them are broadcast, each joined with all
    documents where these are, so nothing is shuffled but the pairs. With several blocks the documents' words are
    hashed once and written.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark)
    schema = f"{key} long, {item_key} long"

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                h, begin = hashes.of(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a : z - 1].tobytes() for a, z in zip(begin[:-1], begin[1:])], pa.binary())], names=["k", "words"])

    texts = lambda df, k, t: df.filter(F.col(t).isNotNull() & F.col(k).isNotNull()).select(F.col(k).cast("long").alias("k"), F.col(t).cast("string").alias("t"))
    own = scratch.keep(texts(items, item_key, item_text).mapInArrow(hashed, "k long, words binary").filter("length(words) > 0"))
    total = own.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    blocks = int(-(-total // BLOCK_WORDS))
    wanted = texts(documents, key, text)
    if blocks > 1:
        wanted = scratch.keep(wanted.mapInArrow(hashed, "k long, words binary"))

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(SeedIndex([r["k"] for r in block], [np.frombuffer(r["words"], np.uint64) for r in block]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: SeedIndex = shared.value
            hashes = WordHashes()
            for b in batches:
                for start in range(0, b.num_rows, 2000):
                    part = b.slice(start, 2000)
                    if pa.types.is_binary(part.schema.field(1).type):
                        words = [np.frombuffer(w, np.uint64) for w in part.column(1).to_pylist()]
                        begin = np.cumsum([0, *(len(w) + 1 for w in words)])
                        h = np.concatenate([x for w in words for x in (w, np.zeros(1, np.uint64))])
                    else:
                        h, begin = hashes.of(part.column(1).to_pylist())
                    pairs = sorted(index.found(h, begin))
                    t, i = ([p[x] for p in pairs] for x in (0, 1))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t, pa.int64())), pa.array(index.ids[i] if i else [], pa.int64())], names=[key, item_key])

        return wanted.mapInArrow(run, schema)

    found = spark.createDataFrame([], schema)
    for n in range(blocks):
        block = own.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == n).orderBy("k", "words").collect()
        if block:
            found = found.unionByName(search(block))
    return found.distinct()


def leakage_report(found: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """Each item with its suite and the number of documents that hold it, 0 among them."""
    return items.select(item_key, "suite").join(found.groupBy(item_key).agg(F.count("*").alias("n_documents")), item_key, "left").fillna(0, ["n_documents"])
