"""Ensembles over a long table of predictions(model, row_id, y_pred) and truth(row_id, y_true).

Greedy selection under squared error needs no rows: all it asks of the data is the members' products of errors, a
table of members by members from one pass.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.operators.metrics import finite_pairs, ranking_metrics, regression_metrics
from molquarry.runtime import Scratch


def error_products(predictions: DataFrame, truth: DataFrame, members: list[str]) -> tuple[np.ndarray, int]:
    """(sum of error i times error j over rows that all members predict, number of rows)."""
    own = predictions.join(truth, "row_id").withColumn("e", F.col("y_pred") - F.col("y_true"))
    wide = finite_pairs(own, "y_pred", "y_true").groupBy("row_id").pivot("model", members).agg(F.first("e")).dropna(subset=members)
    pairs = [(i, j) for i in range(len(members)) for j in range(i, len(members))]
    row = wide.agg(F.count("*").alias("n"), *(F.sum(F.col(f"`{members[i]}`") * F.col(f"`{members[j]}`")).alias(f"_{i}_{j}") for i, j in pairs)).first()
    g = np.zeros((len(members), len(members)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"_{i}_{j}"] or 0.0
    return g, row["n"]


def greedy_counts(products: np.ndarray, n: int, size: int, start: int = 1, allowed: list[int] | None = None) -> np.ndarray:
    """How often each member is taken: from the `start` best ones on, `size` times the member, again or anew, with
    which the mean of all taken has the least squared error; ties to the first. The best prefix counts."""
    who = list(range(len(products))) if allowed is None else allowed
    order = sorted(who, key=lambda i: (products[i, i], i))
    counts = np.zeros(len(products))
    for i in order[:start]:
        counts[i] += 1
    mse = lambda c: float(c @ products @ c) / c.sum() ** 2 / max(n, 1)
    best, kept = mse(counts) if counts.sum() else np.inf, counts.copy()
    while counts.sum() < size:
        tries = []
        for i in who:
            counts[i] += 1
            tries.append((mse(counts), i))
            counts[i] -= 1
        score, i = min(tries)
        counts[i] += 1
        if score < best - 1e-15:
            best, kept = score, counts.copy()
    return kept


def greedy_selection(predictions: DataFrame, truth: DataFrame, size: int = 50, start: int = 1, bags: int = 1, bag_share: float = 0.5, seed: int = 0) -> DataFrame:
    """model, weight: greedy forward selection with replacement, weights of several bags of members averaged."""
    members = sorted(r[0] for r in predictions.select("model").distinct().collect())
    products, n = error_products(predictions, truth, members)
    rng = np.random.default_rng(seed)
    total = np.zeros(len(members))
    for b in range(bags):
        allowed = None if bags == 1 else sorted(rng.choice(len(members), max(1, int(len(members) * bag_share)), replace=False).tolist())
        c = greedy_counts(products, n, size, start, allowed)
        total += c / c.sum()
    total /= bags
    rows = [(m, float(w)) for m, w in zip(members, total) if w > 0]
    return predictions.sparkSession.createDataFrame(rows, "model string, weight double").orderBy(F.desc("weight"), "model")


#: Metrics that selection may go by; all are turned so that lower is better.
METRICS = ("rmse", "mse", "r2", "auc", "log_loss", "brier")


def selection_metric(df: DataFrame, y: str, p: str, metric: str, threshold: float = 0.7, *groups: str) -> DataFrame:
    """groups, value (lower is better): rmse, mse, -r2, -auc, log_loss or brier; the last three see y from the threshold on as 1.

    Pairs that aren't finite are left out; r2 of a constant truth and auc of one class are null.
    """
    if metric not in METRICS:
        raise ValueError(f"{metric} isn't one of {METRICS}")
    if metric == "auc":
        return ranking_metrics(df, y, p, threshold, list(groups)).select(*groups, (-F.col("roc_auc")).alias("value"))
    t, q = (F.col(y) >= threshold).cast("double"), F.least(F.greatest(F.col(p).cast("double"), F.lit(1e-7)), F.lit(1 - 1e-7))
    e2 = (F.col(p) - F.col(y)) * (F.col(p) - F.col(y))
    value = {
        "mse": F.avg(e2), "rmse": F.sqrt(F.avg(e2)), "r2": F.when(F.var_pop(y) > 0, F.avg(e2) / F.nullif(F.var_pop(y), F.lit(0.0)) - 1),
        "log_loss": -F.avg(t * F.ln(q) + (1 - t) * F.ln(1 - q)), "brier": F.avg((F.col(p) - t) * (F.col(p) - t)),
    }
    return finite_pairs(df, y, p).groupBy(*groups).agg(value[metric].alias("value"))


def greedy_by(predictions: DataFrame, truth: DataFrame, metric: str, size: int = 50, start: int = 1, threshold: float = 0.7) -> DataFrame:
    """model, weight by greedy selection with replacement under any metric; the best prefix counts, ties go to the first name.

    Rows that all members predict are kept side by side in a written table; a round is one aggregation that judges
    every candidate at once. Under squared error greedy_selection needs a single pass instead.
    """
    spark = predictions.sparkSession
    members = sorted(r[0] for r in predictions.select("model").distinct().collect())
    own = finite_pairs(predictions.join(truth, "row_id"), "y_pred", "y_true")
    wide = own.groupBy("row_id", "y_true").pivot("model", members).agg(F.first("y_pred")).dropna(subset=members)
    scratch = Scratch(spark)
    wide = scratch.keep(wide.select("y_true", F.array(*(F.col(f"`{m}`").cast("double") for m in members)).alias("p")))
    counts = np.zeros(len(members))

    def judged() -> list[float]:
        taken = F.aggregate(F.zip_with("p", F.array(*map(F.lit, counts.tolist())), lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
        tries = wide.select("y_true", taken.alias("s"), F.posexplode("p").alias("i", "x")).withColumn("q", (F.col("s") + F.col("x")) / (counts.sum() + 1))
        got = {r["i"]: r["value"] for r in selection_metric(tries, "y_true", "q", metric, threshold, "i").collect()}
        return [math.inf if got.get(i) is None else got[i] for i in range(len(members))]

    first = judged()
    for i in sorted(range(len(members)), key=lambda i: (first[i], i))[:start]:
        counts[i] += 1
    best, kept = (first[int(np.argmax(counts))], counts.copy()) if start == 1 else (math.inf, counts.copy())
    while counts.sum() < size:
        values = judged()
        i = min(range(len(members)), key=lambda i: (values[i], i))
        counts[i] += 1
        if values[i] < best - 1e-15:
            best, kept = values[i], counts.copy()
    scratch.drop()
    rows = [(m, float(c / kept.sum())) for m, c in zip(members, kept) if c > 0]
    return spark.createDataFrame(rows, "model string, weight double").orderBy(F.desc("weight"), "model")


def uniform_weights(predictions: DataFrame) -> DataFrame:
    names = predictions.select("model").distinct()
    total = names.agg(F.count("*").alias("_n"))
    return names.join(F.broadcast(total), F.lit(True)).select("model", (1 / F.col("_n")).alias("weight"))


def normalised_weights(weights: DataFrame) -> DataFrame:
    """Weights that sum to 1; negative, null or all-zero weights are an error with all the names concerned."""
    bad = [r[0] for r in weights.filter("weight is null or weight < 0").collect()]
    total = weights.agg(F.sum("weight")).first()[0]
    if bad or not total:
        raise ValueError(f"weights can't be normalised: {bad or 'all are zero'}")
    return weights.withColumn("weight", F.col("weight") / F.lit(total))


def ensemble_predictions(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """row_id, y_pred (weighted mean), y_std (population, unweighted; null for fewer than two members), n_members.

    Weights are renormalised over the members that a row has.
    """
    own = predictions.filter(F.col("y_pred").isNotNull() & ~F.isnan("y_pred")).join(F.broadcast(weights), "model")  # one row a member
    return own.groupBy("row_id").agg(F.try_divide(F.sum(F.col("y_pred") * F.col("weight")), F.sum("weight")).alias("y_pred"), F.when(F.count("*") >= 2, F.stddev_pop("y_pred")).alias("y_std"), F.count("*").alias("n_members"))


def strategies(predictions: DataFrame, truth: DataFrame, select_rows: DataFrame, size: int = 50) -> DataFrame:
    """strategy and regression metrics on the rows that weren't used to select: best single member, all alike, all of
    the best backend, greedy selection."""
    picking = predictions.join(select_rows.select("row_id"), "row_id", "left_semi")
    judged = truth.join(select_rows.select("row_id"), "row_id", "left_anti")
    each = regression_metrics(picking.join(truth, "row_id"), "y_true", "y_pred", "model").select("model", "rmse")
    best = each.orderBy("rmse", "model").first()["model"]
    kinds = each.withColumn("b", F.substring_index("model", "_", 1)).groupBy("b").agg(F.avg("rmse").alias("r")).orderBy("r", "b").first()["b"]
    plans = {
        "best_single": predictions.filter(F.col("model") == best).transform(uniform_weights),
        "uniform": uniform_weights(predictions),
        "best_backend": predictions.filter(F.substring_index("model", "_", 1) == kinds).transform(uniform_weights),
        "greedy": greedy_selection(picking, truth, size),
    }
    out = None
    for name, w in plans.items():
        got = regression_metrics(ensemble_predictions(predictions, w).join(judged, "row_id"), "y_true", "y_pred").withColumn("strategy", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out


def weights_document(weights: DataFrame, **facts: object) -> str:
    """The ensemble as JSON: facts, and members by falling weight."""
    rows = weights.orderBy(F.desc("weight"), "model").collect()
    return json.dumps({**facts, "n_members": len(rows), "weights": {r["model"]: r["weight"] for r in rows}}, indent=2)


def resolved_members(weights: dict[str, float], available: dict[str, str]) -> list[dict]:
    """model, weight, path of each member; all that are missing are named in one error."""
    missing = sorted(m for m in weights if m not in available)
    if missing:
        raise ValueError(f"no files for members {missing}")
    total = sum(weights.values())
    return [{"model": m, "weight": w / total, "path": available[m]} for m, w in sorted(weights.items(), key=lambda x: (-x[1], x[0]))]
