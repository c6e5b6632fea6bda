"""Distances of sets, bits and vectors, and exact similarity joins.

Set pairs come from a prefix-filtered join: two sets that are similar enough share some of the rarest tokens of each.
Hot tokens are never in a prefix unless a set has nothing rarer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from molquarry.runtime import Scratch

#: Rows of a block whose products are made at once.
BLOCK_ROWS = 2_000
#: Reference vectors that are broadcast at once: 10 MB at 256 dimensions.
REFERENCES = 5_000
#: Token frequencies are counted in so many slots of their hashes, whatever the number of tokens.
SLOTS = 1 << 16
#: Sets whose prefix has at most so many tokens are looked up under pairs of them, 28 at most.
PAIRED = 8
_MIX, _MIX_2 = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


def tanimoto_distance(a: Column, b: Column) -> Column:
    """1 - intersection over union of two sets of bits; 0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return 1 - F.coalesce(F.try_divide(both, F.size(F.array_union(a, b))), F.lit(1.0))


def presence_distance(a: Column, b: Column) -> Column:
    """1 - both over either of two 0/1 arrays; 1 where neither has anything."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct((x * y).alias("both"), F.greatest(x, y).alias("any")))
    total = lambda f: F.aggregate(F.transform(pairs, lambda p: p[f]), F.lit(0), lambda s, x: s + x)
    return F.coalesce(1 - F.try_divide(total("both"), total("any")), F.lit(1.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _postings(rep: DataFrame, counts, threshold: float, probe: bool) -> DataFrame:
    """key, k, n, upto, sig: what rep(k, s, h: hashes of s) is listed or looked up under.

    Of a pair the smaller set is listed, the larger one looks it up. A key is the sets' first common token or, where
    the larger one's size allows it, their first two, which are far rarer. Both stand in the prefix of their set; upto
    is how many tokens the sets can have in common if these are the first. sig has the parity of the tokens that fall
    on each of 64 bits: a token that only one set has flips one at most.
    """
    kind = dict(rep.dtypes)["k"]
    t, share = threshold, threshold if probe else 2 * threshold / (1 + threshold)
    sizes = np.arange(1, int((PAIRED + 2) / (1 - t)) + 3) if t < 1 else np.arange(1, 3)
    paired = sizes[(np.ceil(t * sizes - 1e-9) >= 2) & (sizes - np.ceil(t * sizes - 1e-9) + 2 <= PAIRED)]
    # The larger sets of a pair that is joined by two tokens have these sizes.
    low, high = (int(paired[0]), int(paired[-1]) if t < 1 else np.iinfo(np.int64).max) if len(paired) else (0, -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                h = part.column(1).flatten().to_numpy(zero_copy_only=False)
                n = np.diff(part.column(1).offsets.to_numpy())
                owner, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
                sig = np.bitwise_xor.reduceat(np.int64(1) << ((h >> 32) & 63), begin)
                h = h[np.lexsort((h, counts.value[h & (SLOTS - 1)], owner))]
                least, most = np.ceil(share * n - 1e-9).astype(np.int64), n if probe else np.floor(n / t + 1e-9)
                for together in (1, 2):
                    own = (n <= high) & (most >= low) if together == 2 else (n < low) | (most > high)
                    prefix = np.where(own, n - np.maximum(least, together) + together, 0)
                    for size in np.unique(prefix[own]).tolist():
                        rows = np.flatnonzero(own & (prefix == size))
                        first = h[begin[rows][:, None] + np.arange(size)]
                        i, last = np.triu_indices(size, 1) if together == 2 else (None, np.arange(size))
                        key, upto = first[:, last] * np.int64(_MIX), n[rows, None] - last + together - 1
                        if together == 2:
                            keys = [(key ^ (key >> 29)) + first[:, i]]
                        else:  # sizes of similar sets lie in one band of the logarithm or in neighbouring ones
                            band = (np.log(n[rows]) / -np.log(t) + 1e-9 if t < 1 else n[rows]).astype(np.int64)
                            keys = [key ^ ((band - turn) * np.int64(_MIX_2))[:, None] for turn in range(2 if probe else 1)]
                        at = np.repeat(rows, len(last))
                        for key in keys:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(key.ravel()), part.column(0).take(pa.array(at)), pa.array(n[at].astype(np.int32)), pa.array(upto.ravel().astype(np.int32)), pa.array(sig[at])],
                                names=["key", "k", "n", "upto", "sig"],
                            )

    return rep.select("k", "h").mapInArrow(run, f"key long, k {kind}, n int, upto int, sig long")


def similar_sets(df: DataFrame, key: str, tokens: str, threshold: float) -> DataFrame:
    """left < right, jaccard: all pairs of rows whose token sets are at least that similar.

    Equal sets are joined once through one representative, so copies don't multiply candidates; their pairs with
    the representative are given. Empty and null sets and null keys have no partners. threshold must be above 0.
    Candidates meet under keys of two tokens and must agree in their signatures before anything of them is shuffled,
    so what is written follows the sets and the similar pairs, not the pairs that share a token.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    own = df.filter((F.size(tokens) > 0) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("s"))
    alike = Window.partitionBy("s").orderBy("k")
    sets = scratch.keep(own.select("k", "s", F.first("k").over(alike).alias("r"), (F.row_number().over(alike) == 1).alias("first")))
    rep = sets.filter("first").select("k", "s")
    copies = sets.filter(~F.col("first") & (F.col("k") != F.col("r"))).select(F.col("r").alias("left"), F.col("k").alias("right"), F.lit(1.0).alias("jaccard"))
    hashed = rep.select("k", F.transform("s", lambda x: F.xxhash64(x)).alias("h"))
    found = hashed.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(SLOTS - 1).alias("slot")).agg(F.count("*").alias("f")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[found["slot"].to_numpy()] = found["f"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    low, high = (_postings(hashed, shared, threshold, probe).select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("k", "n", "upto", "sig"))) for side, probe in (("a", False), ("b", True)))
    needed = F.ceil(threshold / (1 + threshold) * (F.col("a_n") + F.col("b_n")) - 1e-9)
    met = low.join(high, "key").filter(
        ((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_k") < F.col("b_k")))) & (F.col("a_n") >= threshold * F.col("b_n") - 1e-9)
        # From their first common tokens on the sets must still have enough.
        & (F.least("a_upto", "b_upto") >= needed)
        & (F.bit_count(F.col("a_sig").bitwiseXOR(F.col("b_sig"))) <= F.col("a_n") + F.col("b_n") - 2 * needed)
    )
    pairs = met.select(F.least("a_k", "b_k").alias("left"), F.greatest("a_k", "b_k").alias("right")).distinct()
    full = pairs.join(rep.select(F.col("k").alias("left"), F.col("s").alias("x")), "left").join(rep.select(F.col("k").alias("right"), F.col("s").alias("y")), "right")
    j = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return full.select("left", "right", j.alias("jaccard")).filter(F.col("jaccard") >= threshold - 1e-9).unionByName(copies)


def first_of_equal(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, tokens (sorted, distinct): of the rows with one token set the one of the smallest key; rows without tokens all.

    Equal sets are near the same rows, so what is decided in order of key by near rows is decided by the first of them.
    Keys must be unique.
    """
    there = F.size(tokens) > 0
    own = df.select(F.when(there, F.array_sort(F.array_distinct(tokens))).alias("s"), F.when(there, None).otherwise(F.col(key)).alias("apart"), F.col(key).alias("k"))
    return own.groupBy("s", "apart").agg(F.min("k").alias(key)).select(key, F.col("s").alias(tokens))


def nearest_reference(df: DataFrame, references: DataFrame, key: str, vector: str, ref_key: str, block: int = REFERENCES) -> DataFrame:
    """key, nearest (the reference of highest cosine, the smallest key of several), similarity; null for zero vectors.

    References are taken `block` at a time: a block is one broadcast matrix, met by Arrow batches of rows, so nothing
    is shuffled but, with several blocks, each row's best of each. Null keys and vectors of references are left out;
    without references there are no rows.
    """
    refs = references.filter(F.col(vector).isNotNull() & F.col(ref_key).isNotNull()).select(F.col(ref_key).alias("r"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    blocks = max(1, -(-refs.count() // block))
    kind, ref_kind = dict(df.dtypes)[key], dict(references.dtypes)[ref_key]
    rows = df.select(F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    spark, best = df.sparkSession, None

    def search(held: list) -> DataFrame:
        unit = np.asarray([r["v"] for r in held], float)
        norm = np.linalg.norm(unit, axis=1)
        shared = spark.sparkContext.broadcast(([r["r"] for r, n in zip(held, norm) if n > 0], unit[norm > 0] / norm[norm > 0, None]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, table = shared.value
            for b in batches:
                for start in range(0, b.num_rows, 1000):
                    part = b.slice(start, 1000)
                    nearest, similarity = [None] * part.num_rows, [None] * part.num_rows
                    there = [i for i, v in enumerate(part.column(1)) if v.is_valid]
                    x = np.asarray(part.column(1).take(pa.array(there, pa.int64())).to_pylist(), float).reshape(len(there), -1)
                    size = np.linalg.norm(x, axis=1) if len(there) else np.zeros(0)
                    if len(names) and len(there):
                        s = x @ table.T / np.maximum(size, 1e-300)[:, None]
                        top = s.max(1)
                        for i, n, t, row in zip(there, size, top, s):
                            if n > 0:  # products that differ by rounding only are alike
                                nearest[i], similarity[i] = names[int(np.flatnonzero(row >= t - 1e-12)[0])], float(t)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nearest, ref_type), pa.array(similarity, pa.float64())], names=["k", "nearest", "similarity"])

        return rows.mapInArrow(run, f"k {kind}, nearest {ref_kind}, similarity double")

    ref_type = to_arrow_type(references.schema[ref_key].dataType)
    for n in range(blocks):
        held = refs.filter(F.pmod(F.xxhash64("r"), F.lit(blocks)) == n).orderBy("r").collect()
        got = search(held) if held else None
        best = got if best is None else best if got is None else best.unionByName(got)
    if best is None:
        return spark.createDataFrame([], f"{key} {kind}, nearest {ref_kind}, similarity double")
    if blocks > 1:
        best = best.groupBy("k").agg(F.min_by(F.struct("nearest", "similarity"), F.struct(-F.round(F.coalesce("similarity", F.lit(-2.0)), 12), F.col("nearest"))).alias("b")).select("k", "b.*")
    return best.withColumnRenamed("k", key)


def is_novel(own: Column, used: Column, limit: float = 0.85) -> Column:
    """Whether a set is less similar than the limit to all sets used; null sets are novel."""
    return F.when(own.isNull(), True).otherwise(F.forall(used, lambda u: 1 - tanimoto_distance(own, u) < limit))


def distance_report(pairs: DataFrame, distance: str, *groups: str) -> DataFrame:
    """mean, min, max of pair distances."""
    return pairs.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(distance).alias("mean"), F.min(distance).alias("min"), F.max(distance).alias("max"))


def within_distances(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """group, n, mean, min and max cosine distance of all pairs of rows of a group.

    Distances are found by matrix products of blocks of about BLOCK_ROWS rows of one group, a pair of blocks a task.
    All pairs are what is asked for, so the groups should be chosen sets, not whole corpora. Zero and null vectors, and
    null keys, take no part; groups of one row have no pair and no row.
    """
    own = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    sizes = own.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1)).cast("int").alias("b"))
    dealt = own.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, own["g"].eqNullSafe(sizes["g"])).drop(sizes["g"]).withColumn("i", F.pmod(F.xxhash64("k"), F.col("b")).cast("int"))
    # Each block meets itself and the later ones of its group: rows are copied once for each partner block.
    pairs = F.transform(F.sequence(F.lit(0), F.col("b") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    spread = dealt.withColumn("p", F.explode(F.array_distinct(pairs))).select("g", "k", "v", "i", "p.lo", "p.hi")
    kind = dict(df.dtypes)[group]

    def measured(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x = np.stack(pdf["v"].to_numpy())
        norm = np.linalg.norm(x, axis=1)
        x, i = x[norm > 0] / norm[norm > 0, None], pdf["i"].to_numpy()[norm > 0]
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a, b = x[i == lo], x[i == hi]
        d = 1 - a @ b.T
        d = d[np.triu_indices(len(a), 1)] if lo == hi else d.ravel()
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [len(d)], "s": [float(d.sum())], "least": [float(d.min()) if len(d) else None], "most": [float(d.max()) if len(d) else None]})

    got = spread.groupBy("g", "lo", "hi").applyInPandas(measured, f"g {kind}, n long, s double, least double, most double")
    return got.groupBy("g").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("mean"), F.min("least").alias("min"), F.max("most").alias("max")).filter("n > 0").withColumnRenamed("g", group)


def centroids(df: DataFrame, group: str, vector: str, size: int) -> DataFrame:
    """group, centroid: mean vectors, from one aggregation of `size` sums."""
    got = df.groupBy(group).agg(*(F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_{i}") for i in range(size)))
    return got.select(group, F.array(*(f"_{i}" for i in range(size))).alias("centroid"))
