"""Byte-level BPE ids of whole texts, by speculation and verification (problem 8).

A word is cut greedily into the longest tokens; that guess is what merging would give if every token merges to
itself and every two neighbours are compatible, that is, if merging their joint bytes would never bind across their
border. All neighbours of all new words are checked at once; only words that fail are merged exactly.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless another path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_END = "\x00"
_NUL = "\x00N"  # remembers the character itself as a word; no word looks like this
#: The words of the vocabulary's pre-tokenizer (fixed values); texts of a batch are parted by END, which is in no class.
_WORDS = regex.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}\x00]+|\p{White_Space}+(?![^\p{White_Space}\x00])|\p{White_Space}+")
_ASCII_WORDS = re.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9\x00]+|\s+(?![^\s\x00])|\s+", re.ASCII)
_WORDS_ALONE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Words remembered by a task, at most; then its memory starts anew.
REMEMBERED = 500_000
_BATCH = 1000


def _byte_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable ones themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the tables that verify guesses; built once on the driver, of the vocabulary's fixed size."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.single = np.zeros(256, np.int64)
        for b in range(256):
            self.single[b] = ids[bytes([b])]
        n = max(ids.values()) + 1
        # rank: when a token comes to be, bytes at -1; left and right: what it is merged from, itself for bytes.
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = (bytes(letters[c] for c in x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            t, pair = ids[a + b], (ids[a], ids[b])
            if pair not in self.merges:
                self.merges[pair] = (r, t)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, *pair
        keys = np.fromiter((a << 20 | b for a, b in self.merges), np.int64, len(self.merges))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.fromiter((r for r, _ in self.merges.values()), np.int64, len(keys))[order]
        # Only tokens that merging their own bytes gives can stand in a guess.
        self.tokens = {t: i for t, i in ids.items() if len(t) == 1 or (self.rank[i] >= 0 and self.merged(t) == [i])}
        self.longest: dict[bytes, int] = {}
        for t in self.tokens:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 0), len(t))

    def merged(self, word: bytes) -> list[int]:
        """The exact merge: always the pair of lowest rank, of equal ones the first."""
        n = len(word)
        token = [int(self.single[b]) for b in word]
        if n < 2:
            return token
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((token[i], token[j]))):
                heap.append((m[0], i, token[i], token[j], m[1])) if building else heapq.heappush(heap, (m[0], i, token[i], token[j], m[1]))

        building = True
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        building = False
        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = t, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t in token if t >= 0]

    def guess(self, word: bytes) -> list[int]:
        """The longest tokens from the left."""
        out, i, n, tokens, longest = [], 0, len(word), self.tokens, self.longest
        while i < n:
            for j in range(min(n, i + longest.get(word[i : i + 2], 1)), i, -1):
                t = tokens.get(word[i:j])
                if t is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair whether merging the two tokens' bytes keeps the border between them.

        The merges are undone from the last one on: of the two tokens at the border, the one that came later was not
        there before. At each step the two must not bind earlier than what was just undone.
        """
        n = len(left)
        fine = np.ones(n, bool)
        live = np.arange(n)
        a, b = left.copy(), right.copy()
        # A pair across the border must not merge before the younger of its neighbours' next merges (limit, exclusive).
        limit = np.full(n, np.iinfo(np.int64).max)
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            at = np.minimum(np.searchsorted(self.pair_keys, x << 20 | y), len(self.pair_keys) - 1)
            binds = (self.pair_keys[at] == (x << 20 | y)) & (self.pair_ranks[at] < lim)
            fine[live[binds]] = False
            rx, ry = self.rank[x], self.rank[y]
            going = ~binds & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[going], x[going], y[going], rx[going], ry[going]
            undo_left = rx > ry
            # The left token was made at rank rx: a border pair of equal rank lies to its right and comes after it.
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return fine

    def encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        raw = [w.encode("utf-8", "replace") for w in words]
        guesses = [self.guess(w) for w in raw]
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guesses)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else owner
        wrong = inner[~self.compatible(flat[inner], flat[inner + 1])]
        for i in np.unique(owner[wrong]).tolist():
            guesses[i] = self.merged(raw[i])
        return guesses


class _Memory(dict):
    """Numbers words as they come; keeps those that are new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    """Encodes batches of texts, remembering words."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.memory = _Memory()
        self.flat, self.start, self.size = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.total = 0

    def _numbers(self, words: list[str]) -> np.ndarray:
        memory = self.memory
        numbers = np.fromiter((memory[w] for w in words), np.int64, len(words))
        if memory.new:
            got = self.vocabulary.encoded(["" if w == _END else _END if w == _NUL else w for w in memory.new])
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            self.start.append(self.total + np.cumsum(sizes) - sizes)
            self.size.append(sizes)
            self.flat.append(np.fromiter((t for g in got for t in g), np.int32, int(sizes.sum())))
            self.total += int(sizes.sum())
            memory.new.clear()
            self.flat, self.start, self.size = ([np.concatenate(x)] for x in (self.flat, self.start, self.size))
        return numbers

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """A list of ids for each text; null and empty texts have none."""
        if len(self.memory) > REMEMBERED:
            self._forget()
        lots: list[list[int]] = [[], [], []]
        for i, t in enumerate(texts):
            if t:
                lots[2 if _END in t else 0 if t.isascii() else 1].append(i)
        sizes = np.zeros(len(texts), np.int64)
        order, parts = [], []
        for kind, lot in enumerate(lots):
            if not lot:
                continue
            if kind == 2:
                words, counts = [], []
                for i in lot:
                    own = _WORDS_ALONE.findall(texts[i])
                    words += own
                    counts.append(len(own))
                counts = np.asarray(counts)
            else:
                words = (_ASCII_WORDS if kind == 0 else _WORDS).findall(_END.join(texts[i] for i in lot) + _END)
                counts = None
            if kind == 2:  # here END is a word of the text
                words = [_NUL if w == _END else w for w in words]
            numbers = self._numbers(words)
            if counts is None:
                ends = np.flatnonzero(numbers == self.memory[_END])
                counts = np.diff(ends, prepend=-1)
            start, size, flat = self.start[0][numbers], self.size[0][numbers], self.flat[0]
            upto = np.concatenate([[0], np.cumsum(size)])
            edge = np.concatenate([[0], np.cumsum(counts)])
            sizes[lot] = upto[edge[1:]] - upto[edge[:-1]]
            parts.append(flat[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])])
            order += lot
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        # Back into the order of the texts.
        rank = np.asarray(order, np.int64)
        begin = np.zeros(len(texts), np.int64)
        begin[rank] = np.cumsum(sizes[rank]) - sizes[rank]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[np.repeat(begin - offsets[:-1], sizes) + np.arange(offsets[-1])]))


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of each row's whole text, without special tokens.

    Null and empty texts have an empty list. Strings of special tokens are ordinary text. Repeated rows and null
    keys stay as they are. Nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            for start in range(0, b.num_rows, _BATCH):
                part = b.slice(start, _BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], names=[key, "ids"])

    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string")).mapInArrow(run, f"{key} long, ids array<int>")
