"""Regression, classification, calibration and agreement metrics, and tests of distributions.

Metrics of a long table of predictions come out of one grouped pass; those that need ranks get them from counted
distinct values. Undefined values are null, never NaN.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molquarry.operators.aggregates import average_ranks


def _finite(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, ((F.abs(F.col(c).cast("double")) < float("inf")) & ~F.isnan(F.col(c).cast("double")) for c in cols))


def finite_pairs(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where all columns are finite numbers."""
    return df.filter(F.coalesce(_finite(*cols), F.lit(False)))


def safe_corr(a: Column, b: Column) -> Column:
    """An aggregate: Pearson's r, null for fewer than two pairs or where a side is constant."""
    there = a.isNotNull() & b.isNotNull()
    x, y = F.when(there, a.cast("double")), F.when(there, b.cast("double"))
    varies = (F.count(x) >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    cov = F.covar_pop(x, y)
    return F.when(varies, F.try_divide(cov, F.stddev_pop(x) * F.stddev_pop(y)))


def regression_metrics(df: DataFrame, y: str, p: str, *groups: str) -> DataFrame:
    """n, r2, rmse, mae, medae, max_error, explained_variance, bias, pearson of each group; non-finite pairs don't count."""
    t, e = F.col(y).cast("double"), F.col(p).cast("double") - F.col(y).cast("double")
    ss = F.var_pop(t) * F.count(t)
    return finite_pairs(df, y, p).groupBy(*groups).agg(
        F.count(t).alias("n"), (1 - F.try_divide(F.sum(e * e), F.when(F.min(t) < F.max(t), ss))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.percentile(F.abs(e), 0.5).alias("medae"), F.max(F.abs(e)).alias("max_error"), (1 - F.try_divide(F.var_pop(e), F.when(F.min(t) < F.max(t), F.var_pop(t)))).alias("explained_variance"),
        F.avg(e).alias("bias"), safe_corr(t, F.col(p)).alias("pearson"),
    )


def spearman(df: DataFrame, a: str, b: str, group: list[str] | None = None) -> DataFrame:
    """spearman of each group, on average ranks of the complete pairs."""
    own = finite_pairs(df, a, b).select(*(group or []), F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y"))
    ranked = average_ranks(average_ranks(own, "_x", "_rx", group), "_y", "_ry", group)
    return ranked.groupBy(*(group or [])).agg(safe_corr(F.col("_rx"), F.col("_ry")).alias("spearman"))


def kendall(df: DataFrame, a: str, b: str, levels: int = 4000) -> DataFrame:
    """Kendall's tau-b of all complete pairs, from the table of counted value pairs.

    Concordant and discordant pairs are counted on a grid of the distinct values of both sides, by running sums, so
    work grows with distinct value pairs, not with pairs of rows. More than `levels` distinct values of b on a side
    are an error: the running sums hold one column of them for each task.
    """
    import numpy as np

    own = finite_pairs(df, a, b).groupBy(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).agg(F.count("*").alias("n"))
    ys = own.select("y").distinct()
    if ys.count() > levels:
        raise ValueError(f"more than {levels} distinct values of {b}: round it first")
    table = own.orderBy("x", "y").toPandas() if own.count() <= 4_000_000 else None
    if table is None:
        raise ValueError("too many distinct value pairs: round the values first")
    y, code = np.unique(table["y"].to_numpy(), return_inverse=True)
    n = table["n"].to_numpy(np.float64)
    x = table["x"].to_numpy()
    tree, concordant, discordant, seen = np.zeros(len(y) + 1), 0.0, 0.0, 0.0
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]).astype(int)
    for s, e in zip(starts[:-1], starts[1:]):
        upto = np.cumsum(tree)
        c = code[s:e]
        below, above = upto[c], seen - upto[c + 1]
        concordant += float((n[s:e] * below).sum())
        discordant += float((n[s:e] * above).sum())
        np.add.at(tree, c + 1, n[s:e])
        seen += float(n[s:e].sum())
    pairs = lambda k: float((k * (k - 1) / 2).sum())
    tx = pairs(np.add.reduceat(n, starts[:-1])) if len(n) else 0.0
    ty = pairs(np.bincount(code, n)) if len(n) else 0.0
    total = seen * (seen - 1) / 2
    scale = ((total - tx) * (total - ty)) ** 0.5
    return df.sparkSession.createDataFrame([((concordant - discordant) / scale if scale > 0 else None,)], "kendall double")


def correlations(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """left, right, r for all pairs of columns, complete pairs only; 'pearson' or 'spearman'."""
    if method == "spearman":
        for c in cols:
            df = average_ranks(df, c, f"_rank_{c}")
        df = df.select(*(F.col(f"_rank_{c}").alias(c) for c in cols))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    row = df.agg(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), safe_corr(F.col(a), F.col(b)).alias("r")).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.explode(F.array(*(f"_{i}" for i in range(len(pairs))))).alias("s")).select("s.*")


def strongest_pairs(matrix: DataFrame, limit: float) -> DataFrame:
    """Pairs of different columns whose |r| reaches the limit."""
    return matrix.filter((F.col("left") != F.col("right")) & (F.abs("r") >= limit))


def target_correlations(matrix: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """column, r with the target by falling |r|, null last; at most `top`."""
    own = matrix.filter(((F.col("left") == target) | (F.col("right") == target)) & (F.col("left") != F.col("right")))
    got = own.select(F.when(F.col("left") == target, F.col("right")).otherwise(F.col("left")).alias("column"), "r").orderBy(F.abs("r").desc_nulls_last(), "column")
    return got if top is None else got.limit(top)


def binary_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.7, *groups: str) -> DataFrame:
    """Counts and rates with both sides cut at the threshold (from it on is positive), of finite pairs.

    Ratios with nothing below are 0; a group of one class has null for what needs both.
    """
    t, q = F.col(y) >= threshold, F.col(p) >= threshold
    counted = finite_pairs(df, y, p).groupBy(*groups).agg(F.count_if(t & q).alias("tp"), F.count_if(~t & q).alias("fp"), F.count_if(~t & ~q).alias("tn"), F.count_if(t & ~q).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    expected = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    accuracy = ratio(tp + tn, n)
    return counted.select(
        *groups, "tp", "fp", "tn", "fn", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), specificity.alias("specificity"), ((recall + specificity) / 2).alias("balanced_accuracy"),
        accuracy.alias("accuracy"), F.coalesce(F.try_divide(accuracy - expected, 1 - expected), F.lit(0.0)).alias("kappa"), ratio(tp + fn, n).alias("positive_rate"), ratio(tp + fp, n).alias("predicted_rate"),
    )


def ranking_metrics(df: DataFrame, y: str, p: str, threshold: float = 0.7, group: list[str] | None = None) -> DataFrame:
    """roc_auc and pr_auc (average precision) of the score p for y >= threshold; null for one class.

    Scores are counted first: the curves need running sums over distinct scores only.
    """
    keys = group or []
    own = finite_pairs(df, y, p).groupBy(*keys, F.col(p).cast("double").alias("_s")).agg(F.count_if(F.col(y) >= threshold).alias("_p"), F.count_if(F.col(y) < threshold).alias("_n"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    down = part.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumns({"_tp": F.sum("_p").over(down), "_fp": F.sum("_n").over(down), "_all_p": F.sum("_p").over(part), "_all_n": F.sum("_n").over(part)})
    both = (F.max("_all_p") > 0) & (F.max("_all_n") > 0)
    # Each score's negatives are outranked by all positives above and half of those at it.
    auc = F.try_divide(F.sum(F.col("_n") * (F.col("_tp") - F.col("_p") / 2)), F.max("_all_p") * F.max("_all_n").cast("double"))
    ap = F.try_divide(F.sum(F.col("_p") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))), F.max("_all_p").cast("double"))
    return run.groupBy(*keys).agg(F.when(both, auc).alias("roc_auc"), F.when(both, ap).alias("pr_auc"))


def averaged_over(df: DataFrame, target: str, sums: list[str]) -> DataFrame:
    """One row of metrics a target to one row: counts summed, all else averaged without nulls."""
    rest = [c for c in df.columns if c not in (target, *sums)]
    return df.agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(c) for c in rest))


def all_metrics(df: DataFrame, y: str, p: str, target: str, threshold: float = 0.7) -> DataFrame:
    """One flat row: class metrics averaged over targets with their counts summed, regression metrics of all pairs, n_samples."""
    counts = ["tp", "fp", "tn", "fn"]
    classes = averaged_over(binary_metrics(df, y, p, threshold, target), target, counts).withColumn("n_samples", sum((F.col(c) for c in counts), F.lit(0)))
    return classes.join(F.broadcast(regression_metrics(df, y, p).drop("n")), F.lit(True))


def hpo_objective(rmse: Column, rank: Column, spread_rank: Column | None = None, alpha: float = 0.5, beta: float = 0.0) -> Column:
    """alpha of the rmse and the rest of 1 - rank correlation, of which beta goes to that of spread and error.

    An undefined correlation counts -1, an undefined rmse 1; lower is better.
    """
    one = lambda r: 1 - F.coalesce(r, F.lit(-1.0))
    ranks = one(rank) if spread_rank is None else (1 - beta) * one(rank) + beta * one(spread_rank)
    return alpha * F.coalesce(rmse, F.lit(1.0)) + (1 - alpha) * ranks


def ks_statistic(df: DataFrame, value: str, flag: Column) -> DataFrame:
    """ks, n_true, n_false: the largest distance of the two distributions, over counted distinct values."""
    counted = df.filter(F.col(value).isNotNull() & flag.isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count_if(flag).alias("a"), F.count_if(~flag).alias("b"))
    parts = counted.repartitionByRange(16, "v").withColumn("_p", F.spark_partition_id())
    from molquarry.runtime import Scratch

    parts = Scratch(df.sparkSession).keep(parts)
    totals = parts.groupBy("_p").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select("_p", F.coalesce(F.sum("ta").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("tb").over(before), F.lit(0)).alias("ob"), F.sum("ta").over(Window.partitionBy()).alias("na"), F.sum("tb").over(Window.partitionBy()).alias("nb"))  # 16 rows
    upto = Window.partitionBy("_p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = parts.join(F.broadcast(offset), "_p").select(F.abs(F.try_divide(F.sum("a").over(upto) + F.col("oa"), F.col("na")) - F.try_divide(F.sum("b").over(upto) + F.col("ob"), F.col("nb"))).alias("d"), "na", "nb")
    return run.agg(F.max("d").alias("ks"), F.coalesce(F.max("na"), F.lit(0)).alias("n_true"), F.coalesce(F.max("nb"), F.lit(0)).alias("n_false"))


def ks_verdict(row: DataFrame, level: float = 0.05) -> DataFrame:
    """row with p_value (asymptotic) and whether the distributions differ at the level."""
    n = F.col("n_true") * F.col("n_false") / (F.col("n_true") + F.col("n_false"))
    x = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * F.col("ks")
    p = 2 * reduce(lambda a, b: a + b, ((-1.0) ** (k - 1) * F.exp(-2 * k * k * x * x) for k in range(1, 40)))
    return row.withColumn("p_value", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).withColumn("differs", F.col("p_value") < level)


def chi_square(df: DataFrame, category: str, flag: Column) -> DataFrame:
    """chi2, dof: whether categories are distributed alike on both sides."""
    cells = df.filter(F.col(category).isNotNull() & flag.isNotNull()).groupBy(category).agg(F.count_if(flag).alias("a"), F.count_if(~flag).alias("b"))
    total = cells.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    row = cells.join(F.broadcast(total), F.lit(True))
    n, m = F.col("na") + F.col("nb"), F.col("a") + F.col("b")
    part = lambda o, t: F.try_divide((F.col(o) - m * F.col(t) / n) * (F.col(o) - m * F.col(t) / n), m * F.col(t) / n)
    return row.agg(F.sum(part("a", "na") + part("b", "nb")).alias("chi2"), (F.count("*") - 1).alias("dof"))


def agreement(df: DataFrame, a: str, b: str, key: str, threshold: float = 0.7, share: float = 0.1) -> DataFrame:
    """r, rho, mean and largest |difference|, percent of labels that flip at the threshold, Jaccard of the top shares.

    The top share takes ties by key.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    own = finite_pairs(df, a, b)
    row = own.agg(safe_corr(x, y).alias("pearson"), F.avg(F.abs(x - y)).alias("mean_diff"), F.max(F.abs(x - y)).alias("max_diff"), (100 * F.count_if((x >= threshold) != (y >= threshold)) / F.count("*")).alias("pct_flips"), F.count("*").alias("_n"))
    n = own.count()
    k = max(1, int(n * share))
    top = lambda c: own.orderBy(F.col(c).desc(), F.col(key)).limit(k).select(key)
    both = top(a).join(top(b), key).agg(F.count("*").alias("_both"))
    return row.join(F.broadcast(both), F.lit(True)).join(F.broadcast(spearman(own, a, b)), F.lit(True)).select("pearson", "spearman", "mean_diff", "max_diff", "pct_flips", (F.col("_both") / (2 * k - F.col("_both"))).alias("top_jaccard"))


def variance_shares(df: DataFrame, terms: dict[str, float]) -> DataFrame:
    """term, share: covariance of each weighted term with the whole score over the score's variance; they sum to 1."""
    total = sum(terms.values())
    part = {t: F.col(t) * (w / total) for t, w in terms.items()}
    score = reduce(lambda a, b: a + b, part.values())
    row = df.agg(*(F.struct(F.lit(t).alias("term"), F.try_divide(F.covar_pop(c, score), F.var_pop(score)).alias("share")).alias(f"_{i}") for i, (t, c) in enumerate(part.items())))
    return row.select(F.explode(F.array(*(f"_{i}" for i in range(len(part))))).alias("s")).select("s.*")


def uncertainty_metrics(df: DataFrame, y: str, p: str, s: str, *groups: str) -> DataFrame:
    """Mean spread, and how many errors stay within one, two and three spreads."""
    e, sd = F.abs(F.col(p) - F.col(y)), F.col(s)
    cover = lambda k: F.avg((e <= k * sd).cast("double"))
    return finite_pairs(df, y, p, s).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(sd).alias("mean_std"), cover(1).alias("within_1"), cover(2).alias("within_2"), cover(3).alias("within_3"), safe_corr(sd, e).alias("std_error_r"))


def calibration(df: DataFrame, y: str, p: str, threshold: float = 0.7, bins: int = 10) -> DataFrame:
    """bin, n, confidence, rate of equal bins of the predicted probability; 1.0 is in the last one."""
    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-7)), F.lit(1 - 1e-7))
    return finite_pairs(df, y, p).groupBy(F.least(F.floor(q * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(q).alias("confidence"), F.avg((F.col(y) >= threshold).cast("double")).alias("rate"))


def calibration_errors(bins: DataFrame) -> DataFrame:
    """ece: mean gap weighted by rows; mce: the largest gap."""
    gap = F.abs(F.col("confidence") - F.col("rate"))
    return bins.agg(F.try_divide(F.sum(gap * F.col("n")), F.sum("n").cast("double")).alias("ece"), F.max(gap).alias("mce"))


def evidential_spreads(v: Column, alpha: Column, beta: Column) -> dict[str, Column]:
    """Aleatoric, epistemic and total standard deviation of a four-parameter evidential head."""
    aleatoric = F.try_divide(beta, alpha - 1)
    return {"aleatoric_std": F.sqrt(aleatoric), "epistemic_std": F.sqrt(F.try_divide(aleatoric, v)), "total_std": F.sqrt(aleatoric + F.try_divide(aleatoric, v))}


def moments(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """n, mean, bias-corrected skew and excess kurtosis; null for too few values or none that vary."""
    x = F.col(value).cast("double")
    n = F.count(x).cast("double")
    varies = F.min(x) < F.max(x)
    g1, g2 = F.skewness(F.when(x.isNotNull(), x)), F.kurtosis(x)
    return df.groupBy(*groups).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"),
        F.when((n > 2) & varies, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * g1).alias("skew"),
        F.when((n > 3) & varies, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
    )


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """w, variance_ratio, n_groups: Levene's statistic about the group medians."""
    med = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.percentile(value, 0.5).alias("_m"), F.var_samp(value).alias("_v"))
    z = df.join(med, group).select(group, F.abs(F.col(value) - F.col("_m")).alias("z"))
    ratio = med.agg(F.try_divide(F.max("_v"), F.min("_v")).alias("variance_ratio"))
    return anova(z, "z", group).withColumnRenamed("f", "w").join(F.broadcast(ratio), F.lit(True))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """f, n, n_groups of a one-way analysis of variance."""
    g = df.filter(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return t.select(F.try_divide(F.try_divide(between, F.col("n_groups") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("n_groups"))).alias("f"), "n", "n_groups")


def may_use_parametric(p_value: Column, variance_ratio: Column, limit: float = 9.0) -> Column:
    """Whether samples look normal and their variances alike."""
    return ~((p_value < 0.05) & (variance_ratio > limit))
