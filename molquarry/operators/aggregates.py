"""Grouped statistics, distribution summaries and ordered analytics.

Sums and counts combine before the shuffle; exact quantiles keep a value count for each group, not its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molquarry.runtime import Scratch


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """value, n, share of all rows."""
    counted = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_all"))
    return counted.join(F.broadcast(total), F.lit(True)).select("value", "n", (F.col("n") / F.col("_all")).alias("share"))  # one row is broadcast


def describe(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max; NaN is no value."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    q = lambda p: F.percentile(x, p)
    return df.groupBy(*groups).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(x).alias("max")
    )


def describe_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """describe for several columns with missing count and percentage, booleans as 0 and 1."""
    x = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("x")) for c in cols))).alias("s")
    long = df.select(x).select("s.*")
    out = long.groupBy("column").agg(F.count("x").alias("count"), F.count_if(F.col("x").isNull()).alias("n_missing"), (100 * F.count_if(F.col("x").isNull()) / F.count("*")).alias("pct_missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.percentile("x", 0.25).alias("q25"), F.percentile("x", 0.5).alias("q50"), F.percentile("x", 0.75).alias("q75"), F.max("x").alias("max"))
    return out


def spread_report(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """n, mean, population std, min, median, p90, p95, max; all null for a group without values."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    return df.groupBy(*groups).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.9).alias("p90"), F.percentile(x, 0.95).alias("p95"), F.max(x).alias("max"))


#: The quantiles of a prediction summary (fixed values).
SUMMARY_QUANTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)


def quantile_summary(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """count, mean, std (sample), and q01 to q99 from one sketch-free pass."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None))
    got = df.groupBy(*groups).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.percentile(x, list(SUMMARY_QUANTILES)).alias("_q"))
    return got.select(*groups, "count", "mean", "std", *(F.get("_q", F.lit(i)).alias(f"q{int(100 * q):02d}") for i, q in enumerate(SUMMARY_QUANTILES)))


def score_bins(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin (from 0), n: bins of equal width over [0, 1], closed on the left, the last one also on the right.

    Values outside and nulls are left out; empty bins have 0.
    """
    x = F.col(value).cast("double")
    inside = df.filter((x >= 0) & (x <= 1)).select(F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(inside, "bin", "left").fillna(0, ["n"])


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bin, low, high, n for given edges: left-closed, the last bin closed."""
    x = F.col(value).cast("double")
    ladder = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        ladder = F.when((x >= edges[i]) & ((x < edges[i + 1]) | ((i == len(edges) - 2) & (x == edges[i + 1]))), i).otherwise(ladder)
    counted = df.select(ladder.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, low double, high double")
    return every.join(counted, "bin", "left").fillna(0, ["n"])


def weighted_availability(df: DataFrame, keys: list[str], weight: str, in_stock: str, length: Column, alpha: float = 0.95, longest: int = 20) -> DataFrame:
    """keys, availability, score: the share of weight in stock (0 without weight), blended with shortness."""
    from molquarry.functions.scores import blended_availability
    from molquarry.operators.routes import available_share

    got = df.groupBy(*keys).agg(available_share(F.col(weight), F.col(in_stock)).alias("availability"), length.alias("_length"))
    return got.select(*keys, "availability", blended_availability(F.col("availability"), F.coalesce("_length", F.lit(0)), alpha, longest).alias("score"))


def joined_members(df: DataFrame, keys: list[str], member: str, out: str = "members") -> DataFrame:
    """keys, the distinct non-null members in order joined by commas, and their number. Members of a key should be few."""
    own = df.select(*keys, F.col(member).cast("string").alias("_m")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_m")).alias("_a"))
    return own.select(*keys, F.concat_ws(",", "_a").alias(out), F.size("_a").alias(f"n_{out}"))


def percent_within(df: DataFrame, group: str, item: str) -> DataFrame:
    """group, item, n, pct of its group."""
    counted = df.groupBy(group, item).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def pivot_counts(df: DataFrame, row: str, col: str, values: list, rows: list | None = None) -> DataFrame:
    """Counts of row by fixed column values, 0 where there is none; also fixed rows if given."""
    got = df.groupBy(row).pivot(col, values).agg(F.count(F.lit(1)))
    if rows is not None:
        every = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} {dict(df.dtypes)[row]}")
        got = every.join(got, row, "left")
    return got.fillna(0)


def melted(df: DataFrame, keys: list[str], blocks: dict[str, list[str]], names: list[str]) -> DataFrame:
    """Wide to long: for each block its columns under common names, `component` tells the block."""
    rows = F.array(*(F.struct(F.lit(b).alias("component"), *(F.col(c).alias(n) for c, n in zip(cols, names))) for b, cols in blocks.items()))
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def group_sizes(df: DataFrame, key: str, folds: int = 5) -> DataFrame:
    """n_rows, n_groups, largest, median size, singletons, and whether the largest group fits a fold."""
    sizes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.max("n").alias("largest"), F.percentile("n", 0.5).alias("median"), F.count_if(F.col("n") == 1).alias("n_singletons"), (F.max("n") * folds <= F.sum("n")).alias("fits_a_fold"))


def key_overview(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each key column: non-null rows, distinct values, rows beyond the first of their value."""
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("v")) for k in keys))).alias("s")
    counted = df.select(one).select("s.*").filter("v is not null").groupBy("key", "v").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.col("n") - 1).alias("n_repeats"))


def eta_squared(df: DataFrame, targets: list[str], keys: list[str]) -> DataFrame:
    """target, key, n, n_groups, eta2: the share of the target's variance that lies between the key's groups.

    From one pass of group sums; null where the target doesn't vary.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(k).alias("key"), F.col(t).cast("double").alias("x"), F.col(k).cast("string").alias("g")) for t in targets for k in keys))).alias("s")
    long = df.select(pairs).select("s.*").filter("x is not null and not isnan(x) and g is not null")
    groups = long.groupBy("target", "key", "g").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    total = groups.groupBy("target", "key").agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.sum(F.col("n") * F.col("v")).alias("_w"), F.sum(F.col("n") * F.col("m")).alias("_s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"))
    between = F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")
    whole = between + F.col("_w")
    return total.select("target", "key", "n", "n_groups", F.when(whole > 1e-12, between / whole).alias("eta2"))


def leakage(df: DataFrame, folds: DataFrame, key: str, grouped_by: str, others: list[str]) -> DataFrame:
    """grouped_by, leaked_key, seed, fold, share of the fold's rows whose other value also stands outside the fold.

    folds has key, seed, fold: of each seed every row is in one fold, the one that validates it. A value stands
    outside a fold if it has rows in any other of the seed; two counts a value tell, no train side is built.
    """
    one = F.explode(F.array(*(F.struct(F.lit(o).alias("leaked_key"), F.col(o).cast("string").alias("v")) for o in others))).alias("s")
    long = df.join(folds, key).select("seed", "fold", one).select("seed", "fold", "s.*")
    cells = long.groupBy("seed", "leaked_key", "v", "fold").agg(F.count("*").alias("n"))
    spread = cells.groupBy("seed", "leaked_key", "v").agg(F.count("*").alias("n_folds"))
    marked = cells.join(spread.filter("v is not null"), ["seed", "leaked_key", "v"], "left")
    got = marked.groupBy("leaked_key", "seed", "fold").agg(F.sum(F.when(F.col("n_folds") > 1, F.col("n")).otherwise(0)).alias("_seen"), F.sum("n").alias("_all"))
    return got.select(F.lit(grouped_by).alias("grouped_by"), "leaked_key", "seed", "fold", (F.col("_seen") / F.col("_all")).alias("frac_seen"))


def fold_summary(df: DataFrame, keys: list[str], value: str, sample: bool = True) -> DataFrame:
    """keys, mean, std (sample or population), n of finite values."""
    x = F.when(F.abs(F.col(value).cast("double")) < float("inf"), F.col(value).cast("double"))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), (F.stddev_samp if sample else F.stddev_pop)(x).alias("std"), F.count(x).alias("n"))


def fold_frames(df: DataFrame, metrics: list[str], model: str = "model") -> tuple[DataFrame, DataFrame]:
    """(long, wide) of a table of one row for each model, seed and fold: wide has a column model_metric for each.

    cv_cycle numbers the folds over seeds and folds in order.
    """
    cycle = F.dense_rank().over(Window.orderBy("seed", "fold"))  # a few folds
    folds = df.select("seed", "fold").distinct().withColumn("cv_cycle", cycle)
    one = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("s")
    long = df.select(model, "seed", "fold", one).select(model, "seed", "fold", "s.*").join(folds, ["seed", "fold"])
    names = [f"{r[0]}_{m}" for r in df.select(model).distinct().orderBy(model).collect() for m in metrics]
    wide = long.withColumn("_c", F.concat_ws("_", model, "metric")).groupBy("seed", "fold", "cv_cycle").pivot("_c", names).agg(F.first("value"))
    return long, wide


def best_per_metric(df: DataFrame, model: str, metric: str, value: str, lower_better: list[str]) -> DataFrame:
    """metric, model, value of the best model of each metric, ties by name; NaN is no value."""
    x = F.nanvl(F.col(value), F.lit(None))
    signed = F.when(F.col(metric).isin(lower_better), x).otherwise(-x)
    return df.filter(x.isNotNull()).groupBy(metric).agg(F.min_by(F.struct(model, value), F.struct(signed, F.col(model))).alias("_b")).select(metric, "_b.*")


def selection_summary(df: DataFrame, name: str, value: str) -> DataFrame:
    """For each parameter median and quartiles if all its values are numbers, else its commonest value and how often."""
    x = F.col(value).cast("string").try_cast("double")
    number = df.groupBy(name).agg(F.count(value).alias("n"), (F.count(x) == F.count(value)).alias("numeric"), F.percentile(x, 0.5).alias("median"), F.percentile(x, 0.25).alias("q25"), F.percentile(x, 0.75).alias("q75"))
    mode = df.groupBy(name, F.col(value).cast("string").alias("_v")).agg(F.count("*").alias("_k")).groupBy(name).agg(F.min_by(F.struct(F.col("_v").alias("mode"), F.col("_k").alias("n_mode")), F.struct((-F.col("_k")).alias("a"), F.col("_v").alias("b"))).alias("_m"))
    return number.join(mode, name).select(name, "n", "numeric", *(F.when(F.col("numeric"), F.col(c)).alias(c) for c in ("median", "q25", "q75")), F.when(~F.col("numeric"), F.col("_m.mode")).alias("mode"), F.when(~F.col("numeric"), F.col("_m.n_mode")).alias("n_mode"))


def study_summary(df: DataFrame, keys: list[str], value: str, state: str) -> DataFrame:
    """n_trials, pct_pruned, and mean and sample std of the complete trials."""
    done = F.when(F.col(state) == "COMPLETE", F.col(value))
    return df.groupBy(*keys).agg(F.count("*").alias("n_trials"), (100 * F.count_if(F.col(state) == "PRUNED") / F.count("*")).alias("pct_pruned"), F.avg(done).alias("mean"), F.stddev_samp(done).alias("std"))


def term_levels(df: DataFrame, col: str, decimals: int = 6) -> DataFrame:
    """n_levels, effective levels (exp of entropy), and percent at the commonest and the largest value."""
    x = F.round(F.col(col).cast("double"), decimals)
    levels = df.filter(x.isNotNull()).groupBy(x.alias("v")).agg(F.count("*").alias("n"))
    total = levels.agg(F.sum("n").alias("_all"), F.max("v").alias("_top"))
    p = F.col("n") / F.col("_all")
    return levels.join(F.broadcast(total), F.lit(True)).agg(F.count("*").alias("n_levels"), F.exp(-F.sum(p * F.ln(p))).alias("effective_levels"), (100 * F.max(p)).alias("pct_at_mode"), (100 * F.sum(F.when(F.col("v") == F.col("_top"), p).otherwise(0))).alias("pct_at_max"))


def composition(df: DataFrame, key: str, label: str) -> DataFrame:
    """key, text like GNN:13,MLP:7: labels by falling count, then name."""
    counted = df.groupBy(key, label).agg(F.count("*").alias("n"))
    packed = counted.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), F.col(label).alias("b")))).alias("_s"))
    return packed.select(key, F.array_join(F.transform("_s", lambda x: F.concat(x["b"], F.lit(":"), (-x["a"]).cast("string"))), ",").alias("composition"))


# Ordered analytics ---------------------------------------------------------------------------------------------------------


def best_so_far(df: DataFrame, keys: list[str], order: str, value: str, state: str) -> DataFrame:
    """df with best: the smallest complete value up to each trial; before the first complete one, that one's."""
    done = F.when(F.col(state) == "COMPLETE", F.col(value))
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = F.first(done, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("best", F.coalesce(F.min(done).over(w.rowsBetween(Window.unboundedPreceding, 0)), ahead))


def average_ranks(df: DataFrame, value: str, out: str, group: list[str] | None = None) -> DataFrame:
    """df with the average rank from 1 of each value, ties sharing the mean, null for null.

    Ranks are made on counted distinct values: a range-partitioned running count, so no task sorts all rows.
    """
    from molquarry.runtime import SALTS

    keys = group or []
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if keys:
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = counted.withColumn("_b", before)
    else:
        parts = Scratch(df.sparkSession).keep(counted.repartitionByRange(SALTS, value).withColumn("_p", F.spark_partition_id()))
        totals = parts.groupBy("_p").agg(F.sum("_n").alias("_t"))
        offset = totals.select("_p", F.coalesce(F.sum("_t").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # SALTS rows
        own = F.coalesce(F.sum("_n").over(Window.partitionBy("_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = parts.join(F.broadcast(offset), "_p").withColumn("_b", own + F.col("_o")).drop("_p", "_o")
    ranked = ranked.select(*keys, value, (F.col("_b") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranked, [*keys, value], "left").select(*df.columns, out)


def exact_quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float]:
    """The quantiles of the non-null values, interpolated as `percentile` does; [] without values.

    `percentile` holds all distinct values in one task and goes through them once a share. Here counted values are
    sorted by ranges, and only those at the places asked for come to the driver.
    """
    from molquarry.runtime import SALTS

    scratch = Scratch(df.sparkSession)
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parts = scratch.keep(counted.repartitionByRange(max(SALTS, df.sparkSession.sparkContext.defaultParallelism), "v").withColumn("p", F.spark_partition_id()))
    totals, begin, total = parts.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect(), {}, 0  # a row a range
    for r in totals:
        begin[r["p"]], total = total, total + r["n"]
    if not total:
        return []
    places = [(total - 1) * s for s in shares]
    wanted = sorted({int(f(x)) for x in places for f in (np.floor, np.ceil)})
    bounds = [*begin.values(), total]
    asked = {p: np.asarray([i for i in wanted if a <= i < z], np.int64) for p, a, z in zip(begin, bounds, bounds[1:])}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto: dict[int, int] = {}  # values of a range that came before
        for b in batches:
            p, v, n = (b.column(i).to_numpy() for i in range(3))
            for own in np.unique(p).tolist():
                mine = p == own
                z = np.cumsum(n[mine]) + upto.get(own, begin[own])
                at = asked[own]
                at = at[(at >= upto.get(own, begin[own])) & (at < z[-1])]
                upto[own] = int(z[-1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(v[mine][np.searchsorted(z, at, side="right")])], names=["i", "v"])

    value_at = {r["i"]: r["v"] for r in parts.select("p", "v", "n").repartition("p").sortWithinPartitions("p", "v").mapInArrow(pick, "i long, v double").collect()}
    scratch.drop()
    out = []
    for x in places:
        low, high = int(np.floor(x)), int(np.ceil(x))
        a, b = value_at[low], value_at[high]
        out.append(a if a == b else (high - x) * a + (x - low) * b)
    return out


def fractional_rank(df: DataFrame, value: str, out: str, group: list[str] | None = None) -> DataFrame:
    """Average rank over the number of values."""
    got = average_ranks(df, value, "_r", group)
    if group:
        n = F.count(F.col(value)).over(Window.partitionBy(*group))
        return got.withColumn(out, F.col("_r") / n).drop("_r")
    total = df.agg(F.count(value).alias("_n"))
    return got.join(F.broadcast(total), F.lit(True)).withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n")


def mean_of_ranks(weights: dict[str, float]) -> Column:
    """Weighted mean of rank columns."""
    return reduce(lambda a, b: a + b, (F.col(c) * w for c, w in weights.items())) / sum(weights.values())


def min_max(df: DataFrame, value: str, out: str, group: list[str] | None = None, invert: bool = False, constant: float = 0.5) -> DataFrame:
    """df with value scaled to [0, 1] over all rows or its group; constant values give `constant`, null stays null."""
    bounds = df.groupBy(*(group or [])).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = df.join(bounds, group) if group else df.join(F.broadcast(bounds), F.lit(True))
    x = F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    x = F.when(F.col(value).isNotNull(), F.coalesce(1 - x if invert else x, F.lit(constant)))
    return joined.select(*df.columns, x.alias(out))


def ecdf(df: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """x, share of values up to it, for each grid point, from one pass."""
    v = F.col(value).cast("double")
    row = df.agg(F.count(v).alias("n"), *(F.count_if(v <= g).alias(f"_{i}") for i, g in enumerate(grid)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(float(g)).alias("x"), F.try_divide(F.col(f"_{i}"), F.col("n")).alias("share")) for i, g in enumerate(grid)))).alias("s")).select("s.*")


def robust_z(df: DataFrame, value: str, out: str = "robust_z") -> DataFrame:
    """df with (x - median) / (1.4826 MAD); 0 where the MAD is 0."""
    x = F.col(value).cast("double")
    med = df.agg(F.percentile(x, 0.5).alias("_m"))
    mad = df.join(F.broadcast(med), F.lit(True)).agg(F.percentile(F.abs(x - F.col("_m")), 0.5).alias("_d"), F.first("_m").alias("_m"))
    z = F.when(F.col("_d") == 0, F.when(x.isNotNull(), F.lit(0.0))).otherwise((x - F.col("_m")) / (1.4826 * F.col("_d")))
    return df.join(F.broadcast(mad), F.lit(True)).select(*df.columns, z.alias(out))  # one row is broadcast


def outlier_flags(df: DataFrame, value: str, z: float = 3.5, heavy: float = 10.0, tail: float = 0.01, out: str = "is_outlier") -> DataFrame:
    """Outside the quantiles tail and 1 - tail where the excess kurtosis passes `heavy`, else robust z beyond z."""
    x = F.col(value).cast("double")
    row = df.agg(F.kurtosis(x).alias("_k"), F.percentile(x, tail).alias("_lo"), F.percentile(x, 1 - tail).alias("_hi"))
    got = robust_z(df, value, "_z").join(F.broadcast(row), F.lit(True))
    return got.withColumn(out, F.when(F.abs("_k") > heavy, (x < F.col("_lo")) | (x > F.col("_hi"))).otherwise(F.abs("_z") > z)).select(*df.columns, out)


def threshold_sensitivity(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """quantile, threshold, n_above: how many rows pass the value's own quantiles."""
    x = F.col(value).cast("double")
    cuts = df.agg(F.percentile(x, quantiles).alias("_t"))
    return df.join(F.broadcast(cuts), F.lit(True)).agg(*(F.struct(F.lit(q).alias("quantile"), F.first(F.col("_t")[i]).alias("threshold"), F.count_if(x > F.col("_t")[i]).alias("n_above")).alias(f"_{i}") for i, q in enumerate(quantiles))).select(F.explode(F.array(*(f"_{i}" for i in range(len(quantiles))))).alias("s")).select("s.*")


def numbered_folds(df: DataFrame, held_out: DataFrame | None = None) -> DataFrame:
    """df(seed, fold, ...) with block, the place of each fold in visiting order from 1; held-out rows come last."""
    folds = df.select("seed", "fold").distinct().withColumn("block", F.dense_rank().over(Window.orderBy("seed", "fold")))  # a few folds
    got = df.join(F.broadcast(folds), ["seed", "fold"])  # seeds times folds
    if held_out is None:
        return got
    last = folds.agg((F.max("block") + 1).alias("block"))
    return got.unionByName(held_out.join(F.broadcast(last), F.lit(True)), allowMissingColumns=True)
