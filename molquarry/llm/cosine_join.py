"""Join of texts between two tables, lossless for a bounded edit distance, with their weighted cosine (problem 1).

An edit destroys at most one of several grams that don't overlap. So of any k + 1 such grams of a text one stands whole
in every text within k edits, moved by at most k places:

* each text of the right table asks for its k + 1 grams that are rarest together;
* what is asked for is a filter of fixed size, broadcast, and only those grams of the left table that pass it are shuffled;
* a candidate must meet in such a gram, at nearly the same place, with nearly the same length and signature;
* then the edit distance itself decides, and pairs found get the cosine of their grams' vectors, rare grams weighing more.

Texts too short to have so many grams are joined by the pigeonhole principle: one of k + 1 pieces stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.runtime import Scratch

#: Gram frequencies are counted in so many slots, whatever the size of the corpus: 4 MB of counts.
SLOTS = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JoinPlan:
    """edits: the largest edit distance; gram: characters of a gram. Texts shorter than `short` take the piece join."""

    edits: int = 3
    gram: int = 16

    @property
    def short(self) -> int:
        return (self.edits + 2) * self.gram


def gram_hashes(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position) of every gram of q characters, in order."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.maximum(sizes - q + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    pos = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = (np.cumsum(sizes) - sizes)[owner] + pos
    n = max(len(codes) - q + 1, 0)
    h, done, part, size = np.zeros(n, np.uint64), 0, codes * _MULT, 1  # part: hashes of `size` characters, joined as the bits of q ask
    with np.errstate(over="ignore"):
        while size <= q:
            if q & size:
                h = (h ^ (h >> np.uint64(29))) * _MULT + part[done : done + n]
                done += size
            m = max(len(part) - size, 0)
            part = (part[:m] ^ (part[:m] >> np.uint64(31))) * np.uint64(0x5851F42D4C957F2D) + part[size : size + m]
            size *= 2
        h = (h ^ (h >> np.uint64(29))) * _MULT
        h ^= h >> np.uint64(32)
    return h[start], owner, pos


def signatures(texts: list[str]) -> np.ndarray:
    """64 bits of each text: whether an odd number of its character pairs fell on each. An edit flips four at most."""
    h, owner, _ = gram_hashes(texts, 2)
    bits = np.zeros((len(texts), 64), np.uint8)
    np.bitwise_xor.at(bits, (owner, (h & np.uint64(63)).astype(np.int64)), np.uint8(1))
    return np.packbits(bits, axis=1).view(">i8").ravel().astype(np.int64)


def _blocks(texts: list[str], cells: int = 2_000_000) -> Iterator[list[int]]:
    """Numbers of texts of like length, so that padding stays small."""
    block: list[int] = []
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        if block and (len(block) + 1) * len(texts[i]) > cells:
            yield block
            block = []
        block.append(i)
    if block:
        yield block


def rarest_apart(cost: np.ndarray, q: int, k: int) -> np.ndarray:
    """For each row the places of k grams, q apart at least, that cost least together; cost: of the gram at each place, inf where none is."""
    best, steps = np.zeros((len(cost), cost.shape[1] + q)), []  # best: of the grams up to a place, from -q
    for _ in range(k):
        own = cost + best[:, : cost.shape[1]]
        least = np.minimum.accumulate(own, axis=1)
        steps.append(np.maximum.accumulate(np.where(own == least, np.arange(cost.shape[1]), 0), axis=1))
        best = np.concatenate([np.full((len(cost), q), np.inf), least], axis=1)
    at, end = [], np.full(len(cost), cost.shape[1] - 1)
    for step in reversed(steps):
        at.append(step[np.arange(len(cost)), end])
        end = at[-1] - q
    return np.stack(at[::-1], axis=1)


def weights_of(hashes: np.ndarray, counts: np.ndarray, total: float) -> np.ndarray:
    """Squared weight of grams: the rarer their slot, the more."""
    idf = np.log((total + 1) / (counts[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.float64) + 1.0))
    return np.maximum(idf, 0.05) ** 2


#: Places are cut into buckets of so many positions; a bucket and the next cover edits of both ends.
_REACH = 8
#: Lengths are cut into bands too, so that a gram that a whole series shares is split by length.
_BAND = 8
_MIX, _MIX_2 = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
#: Keys that are asked for are two bits each in so many: 33 MB, whatever the size of the corpus.
_ASKED = 1 << 28
_CHUNK = 4096  # bytes of a bitmap of Spark's


def _keys(h: np.ndarray, place: np.ndarray, band: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return h.view(np.int64) ^ ((place.astype(np.int64) + 1) * np.int64(_MIX) + (band.astype(np.int64) + 1) * np.int64(_MIX_2))


def _bit(keys: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys.view(np.uint64) * (_MULT, np.uint64(0xD6E8FEB86659FD93))[turn]) >> np.uint64(64 - _ASKED.bit_length() + 1)


def slot_counts(texts: DataFrame, plan: JoinPlan) -> np.ndarray:
    """How many grams of all texts fall on each slot: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            h, _, _ = gram_hashes(b.column(0).to_pylist(), plan.gram)
            total += np.bincount((h & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["slot", "n"])

    few = texts.select("text").coalesce(texts.sparkSession.sparkContext.defaultParallelism)  # a task gives up to SLOTS rows
    found = few.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # columns: as rows a million slots are 500 MB in the driver
    counts = np.zeros(SLOTS, np.float32)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def _asked(texts: DataFrame, shared, plan: JoinPlan) -> DataFrame:
    """key, id, pos, size, sig: the rarest grams of texts(id, text) in all buckets of places and lengths within reach."""
    k, q = plan.edits, plan.gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, every = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for block in _blocks(every):
                own = [every[i] for i in block]
                h, owner, pos = gram_hashes(own, q)
                if not len(h):
                    continue
                cost, hashes = np.full((len(own), int(pos.max()) + 1), np.inf), np.zeros((len(own), int(pos.max()) + 1), np.uint64)
                cost[owner, pos], hashes[owner, pos] = shared.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)], h
                at = rarest_apart(cost, q, k + 1)
                h, pos, t = np.take_along_axis(hashes, at, 1).ravel(), at.ravel(), np.repeat(np.arange(len(own)), k + 1)
                size, sig, name = np.fromiter(map(len, own), np.int64, len(own))[t], signatures(own)[t], ids[block][t]
                place, band = (np.maximum(x - k, 0) // w for x, w in ((pos, _REACH), (size, _BAND)))
                for turn in range(4):
                    at, of = ((pos + k) // _REACH if turn & 1 else place), ((size + k) // _BAND if turn & 2 else band)
                    use = (at != place if turn & 1 else np.ones(len(t), bool)) & (of != band if turn & 2 else True)
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(h, at, of)[use]), pa.array(name[use]), pa.array(pos[use].astype(np.int32)), pa.array(size[use].astype(np.int32)), pa.array(sig[use])], names=["key", "id", "pos", "size", "sig"])

    return texts.select("id", "text").mapInArrow(run, "key long, id long, pos int, size int, sig long")


def asked_bits(asked: DataFrame) -> np.ndarray:
    """The filter of the keys: two bits of each are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(_ASKED // 8, np.uint8)
        for b in batches:
            for turn in (0, 1):
                at = _bit(b.column(0).to_numpy(), turn)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        chunks = bits.reshape(-1, _CHUNK)
        for some in np.array_split(np.flatnonzero(chunks.any(axis=1)), 16):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([chunks[i].tobytes() for i in some.tolist()], pa.binary())], names=["c", "bits"])

    few = asked.select("key").coalesce(asked.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(run, "c int, bits binary").groupBy("c").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    bits = np.zeros((_ASKED // 8 // _CHUNK, _CHUNK), np.uint8)
    for c, own in zip(found["c"].to_pylist(), found["bits"]):
        bits[c] = np.frombuffer(own.as_buffer(), np.uint8)
    return bits.ravel()


def _let_through(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the keys that the filter has; a few others pass too."""
    use = np.arange(len(keys))
    for turn in (0, 1):
        at = _bit(keys[use], turn)
        use = use[bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0]
    return use


def _known(texts: DataFrame, shared) -> DataFrame:
    """The rows of texts(id, text) whose id the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(_let_through(shared.value, b.column(0).to_numpy())))

    return texts.select("id", "text").mapInArrow(run, "id long, text string")


def _answers(texts: DataFrame, shared, plan: JoinPlan) -> DataFrame:
    """key, id, pos, size, sig: the grams of texts(id, text), each in its bucket, that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 2048):
                part = b.slice(start, 2048)
                own = part.column(1).to_pylist()
                size = np.fromiter(map(len, own), np.int64, len(own))
                h, t, pos = gram_hashes(own, plan.gram)
                key = _keys(h, pos // _REACH, size[t] // _BAND)
                use = _let_through(bits, key)
                t = t[use]
                there, again = np.unique(t, return_inverse=True)
                sig = signatures([own[i] for i in there.tolist()])[again] if len(there) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key[use]), part.column(0).take(pa.array(t)), pa.array(pos[use].astype(np.int32)), pa.array(size[t].astype(np.int32)), pa.array(sig)], names=["key", "id", "pos", "size", "sig"])

    return texts.select("id", "text").mapInArrow(run, "key long, id long, pos int, size int, sig long")


def _cosines(pairs: DataFrame, shared, total: float, plan: JoinPlan) -> DataFrame:
    """pairs(left_text, right_text, ...) with the cosine of their vectors."""
    q = plan.gram

    def vectors(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hash and squared weight of each gram once, by text."""
        h, owner, _ = gram_hashes(texts, q)
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        once = np.ones(len(h), bool)
        once[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[once], owner[once]
        cut = np.searchsorted(owner, np.arange(1, len(texts)))
        return list(zip(np.split(h, cut), np.split(weights_of(h, shared.value, total), cut)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                left, right = (vectors(part.column(part.schema.get_field_index(c)).to_pylist()) for c in ("left_text", "right_text"))
                cosine = [min(float(wa[np.isin(a, b, assume_unique=True)].sum() / np.sqrt(max(wa.sum() * wb.sum(), 1e-300))), 1.0) for (a, wa), (b, wb) in zip(left, right)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cosine, pa.float64())], names=[*part.schema.names, "cosine"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{kinds}, cosine double")


def _pieces(texts: DataFrame, plan: JoinPlan, probe: bool) -> DataFrame:
    """id, key: pieces of which a text within reach shares one, if either is short."""
    k, limit = plan.edits, plan.short

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = len(text)
                found = set()
                for m in range(max(n - k, 0), n + k + 1) if probe else (n,):
                    if min(n, m) >= limit + (0 if probe else k):  # of a listed text, the partner may be the short one
                        continue
                    for piece in range(k + 1):
                        a, z = m * piece // (k + 1), m * (piece + 1) // (k + 1)
                        for shift in range(-k, k + 1) if probe else (0,):
                            if 0 <= a + shift and z + shift <= n:
                                found.add(f"{m}:{piece}:{text[a + shift : z + shift]}")
                ids += [i] * len(found)
                keys += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["id", "key"])

    near = texts.filter(F.length("text") < limit + (k if not probe else 0) + k)
    return near.select("id", "text").mapInArrow(run, "id long, key string")


def near_texts(left: DataFrame, right: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """left_id, right_id, distance, cosine: all pairs of texts of left(id, text) and right(id, text) within plan.edits edits.

    The right table is best the smaller one. Texts are distinct and non-null on each side. Nothing is lost: every bound holds for any text within reach. The
    two tables are read several times and should be written ones. Empty tables give no pairs.
    """
    spark: SparkSession = left.sparkSession
    every = left.select("text").unionByName(right.select("text"))
    counts = slot_counts(every, plan)
    shared, total = spark.sparkContext.broadcast(counts), float(every.count())
    k = plan.edits
    long = F.length("text") >= plan.short
    asked = _asked(right.filter(long), shared, plan)
    answers = _answers(left.filter(long), spark.sparkContext.broadcast(asked_bits(asked)), plan)
    met = answers.join(asked.select("key", *(F.col(c).alias(f"r_{c}") for c in ("id", "pos", "size", "sig"))), "key").filter(
        (F.abs(F.col("pos") - F.col("r_pos")) <= k)
        & (F.abs(F.col("size") - F.col("r_size")) <= k)
        & (F.bit_count(F.col("sig").bitwiseXOR(F.col("r_sig"))) <= 4 * k)
    )
    scratch = Scratch(spark)
    candidates = scratch.keep(met.select(F.col("id").alias("left_id"), F.col("r_id").alias("right_id")).distinct())
    # Few texts are candidates: the others aren't shuffled.
    few = (_known(t.filter(long), spark.sparkContext.broadcast(asked_bits(candidates.select(F.col(f"{side}_id").alias("key"))))).select(F.col("id").alias(f"{side}_id"), F.col("text").alias(f"{side}_text")) for t, side in ((right, "right"), (left, "left")))
    distance = F.levenshtein("left_text", "right_text", k)
    near = candidates.join(next(few), "right_id").join(next(few), "left_id").withColumn("distance", distance).filter("distance >= 0").select("left_id", "right_id", "left_text", "right_text", "distance")
    found = _cosines(near, shared, total, plan).select("left_id", "right_id", "distance", "cosine")
    # Short texts: one piece of the left text stands whole in the right one.
    met = _pieces(left, plan, probe=False).join(_pieces(right, plan, probe=True).withColumnRenamed("id", "r_id"), "key").select(F.col("id").alias("left_id"), F.col("r_id").alias("right_id")).distinct()
    brief = F.length("text") < plan.short + k  # the longer one of a pair with a short text
    short = (
        met.join(left.filter(brief).select(F.col("id").alias("left_id"), F.col("text").alias("left_text")), "left_id")
        .join(right.filter(brief).select(F.col("id").alias("right_id"), F.col("text").alias("right_text")), "right_id")
        .filter((F.length("left_text") < plan.short) | (F.length("right_text") < plan.short))
        .withColumn("distance", distance)
        .filter("distance >= 0")
        .select("left_id", "right_id", "distance", F.lit(None).cast("double").alias("cosine"))
    )
    return found.unionByName(short)
