"""Group-aware folds and splits, clustering, and picking of varied rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molquarry.runtime import Scratch

#: Groups that are shuffled on the driver as the seeded generator wants it; beyond, a seeded hash gives the order.
MAX_GROUPS = 1_000_000


def _ordered_groups(df: DataFrame, group: str, order: str) -> list[tuple]:
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(order).alias("_o"), F.count("*").alias("_n"))
    got = sizes.orderBy("_o").limit(MAX_GROUPS + 1).collect()
    if len(got) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups: use hashed_folds")
    return [(r[group], r["_n"]) for r in got]


def _balanced(groups: list[tuple], n_folds: int) -> dict:
    """Each group, in order, to the smallest fold; ties to the first."""
    sizes, where = [0] * n_folds, {}
    for name, n in groups:
        fold = sizes.index(min(sizes))
        where[name], sizes[fold] = fold, sizes[fold] + n
    return where


def group_folds(df: DataFrame, group: str, order: str, seeds: list[int], n_folds: int = 5) -> DataFrame:
    """group, seed, fold: groups in order of appearance, shuffled by the seed, each to the fold smallest so far.

    Rows of a group always share a fold; null groups have none. Only the groups' names and sizes come to the driver.
    """
    groups = _ordered_groups(df, group, order)
    rows = []
    for seed in seeds:
        names = list(range(len(groups)))
        np.random.default_rng(seed).shuffle(names)
        where = _balanced([groups[i] for i in names], n_folds)
        rows += [(g, seed, f) for g, f in where.items()]
    return df.sparkSession.createDataFrame(rows, f"{group} {dict(df.dtypes)[group]}, seed long, fold int")


def inner_validation(df: DataFrame, folds: DataFrame, group: str, order: str, seed: int, fold: int, share: float = 0.2) -> DataFrame:
    """group, part of one outer fold: 'outer_val', 'inner_val' (whole groups until the share of outer training rows is reached), 'inner_train'."""
    place = {r[group]: r["fold"] for r in folds.filter(F.col("seed") == seed).collect()}
    groups = _ordered_groups(df, group, order)
    # The outer training rows keep the order in which folds were filled.
    names = list(range(len(groups)))
    np.random.default_rng(seed).shuffle(names)
    outer = [groups[i] for f in sorted(set(place.values())) if f != fold for i in names if place[groups[i][0]] == f]
    quota = int(np.floor(share * sum(n for _, n in outer)))
    inner = list(range(len(outer)))
    np.random.default_rng(seed * 1000 + fold).shuffle(inner)
    part, taken = {g: "outer_val" for g, f in place.items() if f == fold}, 0
    for i in inner:
        name, n = outer[i]
        part[name] = "inner_val" if taken < quota else "inner_train"
        taken += n if taken < quota else 0
    return df.sparkSession.createDataFrame(list(part.items()), f"{group} {dict(df.dtypes)[group]}, part string")


def hashed_folds(df: DataFrame, group: str, n_folds: int = 5, seed: int = 0) -> DataFrame:
    """df with fold from a seeded hash of the group: any number of groups, no shuffle; folds are only nearly even."""
    return df.withColumn("fold", F.when(F.col(group).isNotNull(), F.pmod(F.xxhash64(F.col(group), F.lit(seed)), F.lit(n_folds)).cast("int")))


def group_split(df: DataFrame, group: str, order: str, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """df with part 'test' for whole groups, shuffled by the seed, until the share of rows is reached, else 'train'."""
    groups = _ordered_groups(df, group, order)
    names = list(range(len(groups)))
    np.random.default_rng(seed).shuffle(names)
    quota, taken, test = test_share * sum(n for _, n in groups), 0, []
    for i in names:
        if taken >= quota:
            break
        test.append((groups[i][0],))
        taken += groups[i][1]
    marked = df.sparkSession.createDataFrame(test, f"{group} {dict(df.dtypes)[group]}").withColumn("part", F.lit("test"))
    return df.join(marked, group, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def filled_clusters(sizes: DataFrame, cluster: str, size: str, target: int, seed: int = 0) -> DataFrame:
    """Whole clusters, in seeded order, taken while the total stays within the target; cluster, size, running total.

    Clusters that would pass the target are skipped, so later, smaller ones can still fill it.
    """
    rows = sizes.select(cluster, size).orderBy(F.xxhash64(F.col(cluster), F.lit(seed)), cluster).limit(MAX_GROUPS + 1).toArrow()  # columns: a million rows as objects are hundreds of MB
    if rows.num_rows > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} clusters: merge the smallest or hold out by a hash")
    taken, out = 0, []
    fits = np.flatnonzero(rows.column(1).to_numpy() <= target)
    names, counts = rows.column(0).take(pa.array(fits)), rows.column(1).take(pa.array(fits)).to_pylist()
    for i, n in enumerate(counts):
        if taken + n <= target:
            taken += n
            out.append((names[i].as_py(), n, taken))
    return sizes.sparkSession.createDataFrame(out, f"{cluster} {dict(sizes.dtypes)[cluster]}, {size} long, total long")


# Clustering on a graph of similar pairs ------------------------------------------------------------------------------------------


def sphere_exclusion(keys: DataFrame, pairs: DataFrame, key: str, by_degree: bool = True) -> DataFrame:
    """key, centre: rows in order of falling neighbour number (or of key) become centres unless a centre is near;
    the others join the first centre next to them.

    pairs(left, right) are the near pairs. The order decides all rounds at once: a row is a centre as soon as no
    undecided neighbour comes before it, so chains of rounds are short, and each ends in a written table.
    """
    spark, scratch = keys.sparkSession, Scratch(keys.sparkSession)
    both = pairs.select("left", "right").select(F.explode(F.array(F.struct(F.col("left").alias("k"), F.col("right").alias("o")), F.struct(F.col("right").alias("k"), F.col("left").alias("o")))).alias("e"))
    both = scratch.keep(both.select("e.*").distinct())  # pairs may be a long plan: it runs once
    own = keys.select(F.col(key).alias("k")).distinct()
    degree = both.groupBy("k").agg(F.count("*").alias("d")).join(own, "k", "left_semi")
    order = F.struct((-F.col("d") if by_degree else F.lit(0)).alias("a"), F.col("k").alias("b"))
    # Rows without neighbours are centres; the rounds are for the others only.
    paired = scratch.keep(degree.select("k", order.alias("rank")))
    edges = scratch.keep(both.join(paired.select("k", F.col("rank").alias("rk")), "k").join(paired.select(F.col("k").alias("o"), F.col("rank").alias("ro")), "o").filter("ro < rk").select("k", "o"))
    nodes, last = paired.select("k", F.lit(None).cast("boolean").alias("centre")), None
    while True:
        # Of the neighbours before a row: is one a centre, is one undecided?
        seen = edges.join(nodes.select(F.col("k").alias("o"), F.col("centre").alias("c")), "o").groupBy("k").agg(F.bool_or(F.coalesce("c", F.lit(False))).alias("near"), F.bool_or(F.col("c").isNull()).alias("open"))
        new = F.coalesce("centre", F.when(F.coalesce("near", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True))
        turn = Scratch(spark)
        nodes = turn.keep(nodes.join(seen, "k", "left").select("k", new.alias("centre")))
        if last:
            last.drop()
        last = turn
        if nodes.filter("centre is null").isEmpty():
            break
    first = edges.join(nodes.filter("centre").join(paired, "k").select(F.col("k").alias("o"), "rank"), "o").groupBy("k").agg(F.min_by("o", "rank").alias("c"))
    met = nodes.join(first, "k", "left").select("k", F.when(F.col("centre"), F.col("k")).otherwise(F.col("c")).alias("c"))
    got = scratch.keep(own.join(met, "k", "left").select(F.col("k").alias(key), F.coalesce("c", "k").alias("centre")))
    scratch.drop(but=1)
    last.drop()
    return got


def leaders(keys: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Rows in order of key that have no earlier leader near them."""
    return sphere_exclusion(keys, pairs, key, by_degree=False).filter(F.col(key) == F.col("centre")).select(key)


def cluster_quality(df: DataFrame, cluster: str, vector: str, size: int) -> DataFrame:
    """n_clusters, largest, mean size, skew of sizes, Calinski-Harabasz and Davies-Bouldin indices; null for one cluster.

    Both indices come from sums by cluster; centres are few against rows, and their pairs stay within that.
    """
    from molquarry.operators.similarity import centroids, dot

    own = df.select(cluster, F.col(vector).cast("array<double>").alias("v"))
    mid = centroids(own, cluster, "v", size)
    d2 = lambda a, b: dot(a, a) + dot(b, b) - 2 * dot(a, b)
    spread = own.join(mid, cluster).groupBy(cluster).agg(F.count("*").alias("n"), F.sum(d2(F.col("v"), F.col("centroid"))).alias("w"), F.avg(F.sqrt(F.greatest(d2(F.col("v"), F.col("centroid")), F.lit(0.0)))).alias("s"))
    table = mid.join(spread, cluster)
    whole = centroids(own.withColumn("_g", F.lit(0)), "_g", "v", size).select(F.col("centroid").alias("c0"))
    between = table.join(F.broadcast(whole), F.lit(True)).agg(F.sum(F.col("n") * d2(F.col("centroid"), F.col("c0"))).alias("b"), F.sum("w").alias("w"), F.sum("n").alias("rows"), F.count("*").alias("k"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"), F.skewness("n").alias("size_skew"))
    a, b = table.alias("a"), table.alias("b")
    ratio = F.try_divide(F.col("a.s") + F.col("b.s"), F.sqrt(F.greatest(d2(F.col("a.centroid"), F.col("b.centroid")), F.lit(0.0))))
    bouldin = a.join(b, F.col(f"a.{cluster}") != F.col(f"b.{cluster}")).groupBy(F.col(f"a.{cluster}").alias("g")).agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = F.when(F.col("k") > 1, F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("rows") - F.col("k"))))
    return between.join(F.broadcast(bouldin), F.lit(True)).select(F.col("k").alias("n_clusters"), "largest", "mean_size", "size_skew", ch.alias("calinski_harabasz"), "davies_bouldin")


def silhouette(df: DataFrame, cluster: str, vector: str, size: int) -> DataFrame:
    """silhouette: mean over all rows, by squared Euclidean distance; rows alone in their cluster count 0, null for one cluster.

    A row's mean squared distance to a cluster follows from the cluster's mean vector and mean squared length, so no
    pair of rows is made: each row meets the clusters' table, a row a cluster. Rows with null vector or cluster take no part.
    """
    from molquarry.operators.similarity import centroids, dot

    own = df.filter(F.col(vector).isNotNull() & F.col(cluster).isNotNull()).select(F.col(cluster).alias("c"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    facts = centroids(own, "c", "v", size).join(own.groupBy("c").agg(F.count("*").alias("n"), F.avg(dot(F.col("v"), F.col("v"))).alias("q")), "c")
    facts = Scratch(df.sparkSession).keep(facts)
    table = facts.agg(F.collect_list(F.struct("c", "n", "q", "centroid")).alias("t"))  # one row a cluster
    mean = lambda x: dot(F.col("v"), F.col("v")) + x["q"] - 2 * dot(F.col("v"), x["centroid"])
    every = F.transform("t", lambda x: F.struct((x["c"] == F.col("c")).alias("own"), x["n"].alias("n"), mean(x).alias("d")))
    rows = own.join(F.broadcast(table), F.lit(True)).select(every.alias("e"))
    mine = F.filter("e", lambda x: x["own"])[0]
    a, b = mine["d"] * mine["n"] / (mine["n"] - 1), F.array_min(F.transform(F.filter("e", lambda x: ~x["own"]), lambda x: x["d"]))
    s = F.when(mine["n"] == 1, 0.0).when(F.greatest(a, b) > 0, (b - a) / F.greatest(a, b)).otherwise(0.0)
    return rows.agg(F.avg(F.when(F.size("e") > 1, s)).alias("silhouette"))


def cutoff_sweep(keys: DataFrame, pairs: DataFrame, key: str, cutoffs: list[float], target: int, similarity: str = "jaccard") -> DataFrame:
    """cutoff, n_clusters, largest, singletons, n_held, tightness for each distance cutoff: clusters by sphere exclusion, held out up to the target.

    pairs(left, right, similarity) must hold all pairs within the largest cutoff; each smaller one takes a part of
    them. tightness is the mean similarity of members to their centre, 1 for singletons. One job a cutoff, a few.
    """
    spark, rows = keys.sparkSession, []
    pairs = Scratch(spark).keep(pairs)
    for cut in sorted(cutoffs):
        near = pairs.filter(F.col(similarity) >= 1 - cut - 1e-12)
        got = sphere_exclusion(keys, near, key)
        sizes = got.groupBy("centre").agg(F.count("*").alias("n"))
        held = filled_clusters(sizes, "centre", "n", target).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("held"))
        both = near.select(F.col("left").alias(key), F.col("right").alias("centre"), similarity).unionByName(near.select(F.col("right").alias(key), F.col("left").alias("centre"), similarity))
        tight = got.join(both, [key, "centre"], "left").agg(F.avg(F.coalesce(F.col(similarity), F.lit(1.0))).alias("tightness"))
        r = sizes.agg(F.count("*").alias("k"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons")).join(F.broadcast(held), F.lit(True)).join(F.broadcast(tight), F.lit(True)).first()
        rows.append((float(cut), r["k"], r["largest"], r["singletons"], r["held"], r["tightness"]))
    return spark.createDataFrame(rows, "cutoff double, n_clusters long, largest long, singletons long, n_held long, tightness double")


# Picking by distance ----------------------------------------------------------------------------------------------------------


def _maxmin(x: np.ndarray, k: int) -> list[int]:
    """Each next row is the one farthest from all picked; the first is row 0; ties to the first row."""
    if not len(x):
        return []
    picked, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(k, len(x)):
        j = int(far.argmax())
        picked.append(j)
        far = np.minimum(far, ((x - x[j]) ** 2).sum(1))
        far[picked] = -1
    return picked


def _ward(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """The cluster, from 0, of each row in the k clusters that Ward's merging gives, rows counting by their weight.

    Chains of nearest neighbours find all merges in some order; the lowest are those that the plain method does first.
    """
    n = len(x)
    rows, sizes, live, dead = x.astype(float).copy(), weight.astype(float).copy(), np.arange(n), np.zeros(n, bool)
    at, merges, chain = np.arange(n), [], []  # at: where a cluster stands in rows
    while len(merges) < n - 1:
        if not chain:
            chain = [int(live[np.flatnonzero(~dead)[0]])]
        own = at[chain[-1]]
        d = ((rows - rows[own]) ** 2).sum(1) * (sizes * sizes[own] / (sizes + sizes[own]))
        d[dead] = d[own] = np.inf
        j = int(d.argmin())
        if len(chain) == 1 or d[j] < d[at[chain[-2]]]:
            chain.append(int(live[j]))
            continue
        gone = at[chain[-2]]
        merges.append((float(d[gone]), chain[-1], chain[-2]))
        del chain[-2:]
        total = sizes[own] + sizes[gone]
        rows[own] = (rows[own] * sizes[own] + rows[gone] * sizes[gone]) / total
        sizes[own], dead[gone] = total, True
        if 2 * dead.sum() > len(dead):
            rows, sizes, live, dead = rows[~dead], sizes[~dead], live[~dead], dead[~dead]
            at[live] = np.arange(len(live))
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for _, i, j in sorted(merges, key=lambda m: m[0])[: max(n - k, 0)]:
        i, j = top(i), top(j)
        up[max(i, j)] = min(i, j)
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1].reshape(-1)


def _centres(x: np.ndarray, weight: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and weight of each cluster."""
    total = np.bincount(cluster, weight)
    sums = np.zeros((len(total), x.shape[1]))
    np.add.at(sums, cluster, x * weight[:, None])
    return sums / total[:, None], total


def _central(x: np.ndarray, k: int) -> list[int]:
    """Rows nearest the centres of k clusters that Ward's merging gives."""
    x = x.astype(float)
    cluster = _ward(x, np.ones(len(x)), k)
    centre, _ = _centres(x, np.ones(len(x)), cluster)
    off = ((x - centre[cluster]) ** 2).sum(1)
    return sorted(int(min(np.flatnonzero(cluster == c), key=lambda i: (off[i], i))) for c in range(len(centre)))


_PICKERS = {"maxmin": _maxmin, "ward": _central}


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), np.float64)


def _central_of_many(rows: DataFrame, key: str, k: int, partition_rows: int, last_rows: int) -> DataFrame:
    """key, rank: rows nearest the centres of k clusters; of rows(k, v).

    Each partition hands on the centres of its Ward clusters with the rows they stand for, until what is left can be
    merged as a whole, so every row has its weight in the centres; the nearest row is then looked for among all.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["k"]
    core = max(k, last_rows // 4)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        t = pa.Table.from_batches(got) if got else None
        if t is None or not t.num_rows:
            return
        x, w = _vectors(t.column("v")), t.column("w").to_numpy()
        order = np.lexsort((w, *x.T[::-1]))
        x, w = x[order], w[order]
        centre, total = _centres(x, w, _ward(x, w, core))
        yield pa.RecordBatch.from_arrays([pa.array(centre.tolist(), pa.list_(pa.float64())), pa.array(total)], names=["v", "w"])

    scratch = Scratch(spark)
    left = rows.select(F.col("v").cast("array<double>").alias("v"), F.lit(1.0).alias("w"))
    n = left.count()
    while n > max(last_rows, 2 * core):
        parts = -(-n // max(partition_rows, 4 * core))
        left = scratch.keep(left.repartition(parts, F.xxhash64("v", F.lit(n))).mapInArrow(merged, "v array<double>, w double"))
        n = left.count()
    last = left.toPandas()
    x, w = np.asarray(last["v"].tolist(), np.float64), last["w"].to_numpy()
    order = np.lexsort((w, *x.T[::-1]))
    centre, _ = _centres(x[order], w[order], _ward(x[order], w[order], k))
    shared = spark.sparkContext.broadcast(centre)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1))
            for c, own in enumerate(shared.value if len(x) else []):
                d = ((x - own) ** 2).sum(1)
                # k - 1 rows may be nearer another centre's pick; of equal ones the least keys are wanted
                upto = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
                best = np.flatnonzero(d <= upto)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), c, np.int32)), b.column(0).take(pa.array(best)), pa.array(d[best])], names=["c", "k", "d"])

    nearest = rows.mapInArrow(near, f"c int, k {kind}, d double").withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy("d", "k"))).filter(F.col("_r") <= k)
    taken: dict = {}
    for r in sorted(nearest.collect(), key=lambda r: (r["d"], r["k"], r["c"])):
        if r["c"] not in taken and r["k"] not in taken.values():
            taken[r["c"]] = r["k"]
    scratch.drop()
    return spark.createDataFrame([(x, i) for i, x in enumerate(sorted(taken.values()), 1)], f"{key} {kind}, rank int")


def picked_rows(df: DataFrame, key: str, vector: str, k: int, method: str = "maxmin", partition_rows: int = 20_000, last_rows: int = 20_000) -> DataFrame:
    """key, rank: k rows by 'maxmin' or 'ward'.

    Up to last_rows rows are picked from as a whole. Of more, every partition first picks its k (by maxmin: what is
    far apart in a part stays so), and the picks are picked from again; by 'ward' it hands on centres that stand for
    all its rows. No task holds more than its bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("k") if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        x = np.asarray(t.column("v").to_pylist(), np.float32)
        chosen = _PICKERS[method](x, k)
        yield pa.RecordBatch.from_arrays([t.column("k").combine_chunks().take(pa.array(chosen)), t.column("v").combine_chunks().take(pa.array(chosen)), pa.array(np.arange(1, len(chosen) + 1, dtype=np.int32))], names=["k", "v", "rank"])

    kind = dict(df.dtypes)[key]
    rows = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<float>").alias("v"))
    scratch = Scratch(df.sparkSession)
    schema = f"k {kind}, v array<float>, rank int"
    n = rows.count()
    if method == "ward" and n > max(last_rows, 2 * k):
        return _central_of_many(rows, key, k, partition_rows, last_rows)
    while n > max(last_rows, 2 * k):
        parts = -(-n // max(partition_rows, 4 * k))
        rows = scratch.keep(rows.repartition(parts, F.xxhash64("k", F.lit(n))).mapInArrow(run, schema).select("k", "v"))
        n = rows.count()
    return rows.repartition(1).mapInArrow(run, schema).select(F.col("k").alias(key), "rank")


def greedy_varied(df: DataFrame, key: str, k: int, terms: dict[str, tuple[str, float]], seeds: list | None = None, bound: int = 20_000) -> DataFrame:
    """key, rank, gain: k rows, each the one whose weighted distance to all chosen ones is largest.

    terms: name: (vector column, weight); the gain of a row is the weighted sum over terms of its smallest distance
    to the chosen. seeds are chosen from the start and not given back. More than `bound` rows aren't gathered in one
    task: each pass over all rows brings the best of every partition, from which the same rows are chosen.
    """
    names = list(terms)
    given = set(seeds or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by("k")
        keys = t.column("k").to_pylist()
        xs = []
        for n in names:
            x = np.asarray(t.column(n).to_pylist(), np.float64)
            xs.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
        near = [np.ones(len(keys)) for _ in names]
        open_ = np.ones(len(keys), bool)

        def take(j: int) -> None:
            open_[j] = False
            for i, x in enumerate(xs):
                near[i] = np.minimum(near[i], 1 - x @ x[j])

        for j, key_ in enumerate(keys):
            if key_ in given:
                take(j)
        out = []
        while len(out) < min(k, len(keys)) and open_.any():
            gain = sum(w * near[i] for i, (_, w) in enumerate(terms.values()))
            j = int(np.where(open_, gain, -np.inf).argmax())
            out.append((keys[j], len(out) + 1, float(gain[j])))
            take(j)
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], t.schema.field("k").type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.float64())], names=[key, "rank", "gain"])

    own = df.select(F.col(key).alias("k"), *(F.col(c).cast("array<double>").alias(n) for n, (c, _) in terms.items()))
    if df.count() > bound:
        return _varied_by_passes(own, key, k, names, [w for _, w in terms.values()], list(given))
    return own.repartition(1).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, rank int, gain double")


#: Rows that a partition brings to the driver in one pass of greedy_varied.
BROUGHT = 256


def _varied_by_passes(own: DataFrame, key: str, k: int, names: list[str], weights: list[float], given: list) -> DataFrame:
    """greedy_varied of own(k, a vector for each name) without gathering its rows.

    Gains only fall as rows are chosen. So the best of the rows brought is the best of all as long as it gains more
    than any row left behind did at the pass; the first of a pass always is.
    """
    spark, kind = own.sparkSession, dict(own.dtypes)["k"]

    def units(rows: list) -> list[np.ndarray]:
        xs = [np.asarray([r[n] for r in rows], np.float64) for n in names]
        return [x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in xs]

    seeds = own.filter(F.col("k").isin(given)).collect() if given else []
    chosen = [list(x) for x in units(seeds)] if seeds else [[] for _ in names]
    taken, out = {r["k"] for r in seeds}, []
    while len(out) < k:
        shared = spark.sparkContext.broadcast((chosen, taken))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            chosen, taken = shared.value
            best, behind = [], -np.inf
            for b in batches:
                rows = [r for r in b.to_pylist() if r["k"] not in taken]
                if not rows:
                    continue
                near = [np.ones(len(rows)) for _ in names]
                for i, x in enumerate(units(rows)):
                    for c in chosen[i]:
                        near[i] = np.minimum(near[i], 1 - x @ c)
                gain = sum(w * d for w, d in zip(weights, near))
                best += [(-g, r["k"], r, ds) for g, r, *ds in zip(gain.tolist(), rows, *(d.tolist() for d in near))]
                best.sort(key=lambda t: t[:2])
                if len(best) > BROUGHT:
                    behind = max(behind, -best[BROUGHT][0])
                    del best[BROUGHT:]
            if best:
                got = pa.Table.from_pylist([r for _, _, r, _ in best], b.schema)
                got = got.append_column("near", pa.array([ds for *_, ds in best], pa.list_(pa.float64()))).append_column("behind", pa.array([float(behind)] * len(best)))
                yield from got.combine_chunks().to_batches()

        vectors = ", ".join(f"{n} array<double>" for n in names)
        rows = sorted(own.mapInArrow(run, f"k {kind}, {vectors}, near array<double>, behind double").collect(), key=lambda r: r["k"])
        if not rows:
            break
        xs, near = units(rows), np.asarray([r["near"] for r in rows]).T.copy()
        behind = max(r["behind"] for r in rows) if min(weights) >= 0 else np.inf
        open_, first = np.ones(len(rows), bool), True
        while len(out) < k and open_.any():
            gain = sum(w * d for w, d in zip(weights, near))
            j = int(np.where(open_, gain, -np.inf).argmax())
            if not first and gain[j] <= behind:
                break
            first, open_[j] = False, False
            out.append((rows[j]["k"], len(out) + 1, float(gain[j])))
            taken.add(rows[j]["k"])
            for i, x in enumerate(xs):
                chosen[i].append(x[j])
                near[i] = np.minimum(near[i], 1 - x @ x[j])
        shared.destroy()
    return spark.createDataFrame(out, f"{key} {kind}, rank int, gain double")


def shared_components(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key, component: rows that share a non-null value of any of cols, also through others; component is the least key.

    Labels spread through values: a row takes the least label of its values' rows, until nothing changes; every
    round ends in a written table.
    """
    scratch = Scratch(df.sparkSession)
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols))).alias("s")
    links = scratch.keep(df.select(F.col(key).alias("k"), one).select("k", "s.*").filter("v is not null"))
    labels = scratch.keep(df.select(F.col(key).alias("k")).distinct().withColumn("l", F.col("k")))
    while True:
        value = links.join(labels, "k").groupBy("c", "v").agg(F.min("l").alias("l"))
        best = links.join(value, ["c", "v"]).groupBy("k").agg(F.min("l").alias("n"))
        new = labels.join(best, "k", "left").select("k", F.least("l", "n").alias("m"), "l")
        jump = new.select(F.col("k").alias("m"), F.col("m").alias("mm"))
        labels = scratch.keep(new.join(jump, "m", "left").select("k", F.coalesce("mm", "m").alias("l"), (F.coalesce("mm", "m") < F.col("l")).alias("moved")))
        if labels.filter("moved").isEmpty():
            break
        labels = labels.select("k", "l")
    got = scratch.keep(labels.select(F.col("k").alias(key), F.col("l").alias("component")))
    scratch.drop(but=1)
    return got


def adaptive_cutoff(candidates: DataFrame, target: int, tolerance: float = 0.05) -> DataFrame:
    """Of candidates(cutoff, n_held, silhouette-like measures ...) the best by the mean of min-max scaled measures among
    those near the target size; if none is near, the nearest. Measures are all other numeric columns, higher better."""
    measures = [f.name for f in candidates.schema.fields if f.name not in ("cutoff", "n_held") and f.dataType.typeName() in ("double", "float")]
    w = Window.partitionBy()  # a few cutoffs
    scaled = [F.coalesce(F.try_divide(F.col(m) - F.min(m).over(w), F.max(m).over(w) - F.min(m).over(w)), F.lit(0.5)) for m in measures]
    quality = sum(scaled[1:], scaled[0]) / len(scaled) if scaled else F.lit(0.0)
    off = F.abs(F.col("n_held") - target) / target
    return candidates.withColumns({"quality": quality, "off": off}).orderBy(F.when(off <= tolerance, 0).otherwise(1), F.when(off <= tolerance, -F.col("quality")).otherwise(off), "cutoff").limit(1)
