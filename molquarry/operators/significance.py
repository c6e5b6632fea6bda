"""p-values of analyses of variance, of equal variances and of pairs of groups: sums from one aggregation, distributions by number."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.operators.metrics import anova, levene


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def f_tail(f: float | None, d1: float, d2: float) -> float | None:
    """P(F > f); null for an undefined f."""
    return None if f is None or math.isnan(f) or d1 < 1 or d2 < 1 else beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def range_tail(q: float, groups: int, dof: float) -> float:
    """P(studentised range > q): the range of `groups` normals, averaged over the spread of the pooled deviation."""
    z, w = np.polynomial.legendre.leggauss(200)
    x, wx = 9 * z, 9 * w  # the smallest or any normal
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    cdf = lambda v: 0.5 * (1 + np.vectorize(math.erf)(v / math.sqrt(2)))
    wide = 12 / math.sqrt(2 * dof)
    s, ws = 1 + wide * z, wide * w
    s, ws = s[s > 0], ws[s > 0]
    chi = np.exp((dof / 2) * math.log(dof / 2) + math.log(2) - math.lgamma(dof / 2) + (dof - 1) * np.log(s) - dof * s * s / 2)
    lower = cdf(x)
    within = np.asarray([(wx * density * groups * np.maximum(lower - cdf(x - q * v), 0) ** (groups - 1)).sum() for v in s])
    return float(min(max(1 - (ws * chi * within).sum() / (ws * chi).sum(), 0.0), 1.0))


def _with_p(df: DataFrame, f: str) -> DataFrame:
    r = df.first()  # one row of sums
    p = f_tail(r[f], r["n_groups"] - 1, r["n"] - r["n_groups"])
    return df.withColumn("p_value", F.lit(p).cast("double"))


def anova_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """f, n, n_groups, p_value of a one-way analysis of variance; null p for fewer than two groups or no spread."""
    return _with_p(anova(df, value, group), "f")


def levene_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """w, n, n_groups, variance_ratio, p_value: whether variances are alike, about the medians."""
    return _with_p(levene(df, value, group), "w")


def tukey_pairs(df: DataFrame, value: str, group: str, level: float = 0.05) -> DataFrame:
    """first, second, difference of means, q, p_value, differs for each pair of groups, groups ordered by mean.

    Only the groups' counts, means and variances come to the driver: groups are compared treatments, a few. Groups of
    unequal size are weighed after Kramer. Groups without a value are left out.
    """
    g = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).cast("string").alias("g")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).filter("g is not null").orderBy("m", "g").collect()
    dof = sum(r["n"] for r in g) - len(g)
    within = sum(r["n"] * r["v"] for r in g) / dof if dof > 0 else float("nan")
    rows = []
    for i, a in enumerate(g):
        for b in g[i + 1 :]:
            spread = math.sqrt(within / 2 * (1 / a["n"] + 1 / b["n"])) if within > 0 else float("nan")
            q = (b["m"] - a["m"]) / spread
            p = None if math.isnan(q) else range_tail(q, len(g), dof)
            rows.append((a["g"], b["g"], b["m"] - a["m"], None if p is None else q, p, None if p is None else p < level))
    return df.sparkSession.createDataFrame(rows, "first string, second string, difference double, q double, p_value double, differs boolean")
