"""Features, model backends, search of parameters and nested cross-validation, on Spark ML pipelines.

Backends are entries of a registry: a name, an estimator and its space of parameters. Those here are Spark's own;
others are registered by whoever has their libraries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from molquarry.functions.scores import bounded
from molquarry.operators.aggregates import exact_quantiles
from molquarry.operators.metrics import hpo_objective, regression_metrics, spearman


def preprocessor(numeric: list[str], vector: str | None = None, components: int | None = None) -> Pipeline:
    """Medians for missing numbers, constant columns dropped, the rest standardised; the vector block to its principal components."""
    filled = [f"_{c}" for c in numeric]
    stages: list = [Imputer(inputCols=numeric, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_numeric")]
    stages += [VarianceThresholdSelector(featuresCol="_numeric", outputCol="_varying", varianceThreshold=0.0), StandardScaler(inputCol="_varying", outputCol="_scaled", withMean=True)]
    parts = ["_scaled"]
    if vector:
        stages.append(PCA(k=components, inputCol=vector, outputCol="_components") if components else VectorAssembler(inputCols=[vector], outputCol="_components"))
        parts.append("_components")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features")])


def sanitized(df: DataFrame, cols: list[str], limit: float = 1e4) -> DataFrame:
    return df.withColumns({c: bounded(F.col(c).cast("double"), limit) for c in cols})


@dataclass(frozen=True)
class QuantileNormal:
    """A target brought to a normal distribution by its quantiles, and back; values beyond the fitted range take its ends."""

    values: tuple[float, ...]
    scores: tuple[float, ...]

    @staticmethod
    def fit(df: DataFrame, y: str, n: int = 1000) -> QuantileNormal:
        """From n + 1 exact quantiles of the finite values, sorted by ranges."""
        shares = [i / n for i in range(n + 1)]
        x = F.when(F.abs(F.col(y).cast("double")) < float("inf"), F.col(y).cast("double"))
        cuts = exact_quantiles(df.select(x.alias("x")), "x", shares)
        if not cuts:
            raise ValueError(f"no finite values in {y}")
        inverse = NormalDist().inv_cdf
        values, at = np.unique(np.asarray(cuts, float), return_inverse=True)
        score = np.bincount(at.reshape(-1), [inverse(min(max(s, 1e-7), 1 - 1e-7)) for s in shares]) / np.bincount(at.reshape(-1))
        return QuantileNormal(tuple(values.tolist()), tuple(score.tolist()))

    def _mapped(self, c: Column, a: tuple, b: tuple) -> Column:
        @F.pandas_udf(DoubleType())
        def run(x: pd.Series) -> pd.Series:
            got = np.interp(x.to_numpy(float, na_value=np.nan), a, b)
            return pd.Series(np.where(x.isna(), np.nan, got)).astype("Float64").mask(x.isna().to_numpy())

        return run(c.cast("double"))

    def forward(self, c: Column) -> Column:
        return self._mapped(c, self.values, self.scores)

    def inverse(self, c: Column) -> Column:
        return self._mapped(c, self.scores, self.values)


@dataclass(frozen=True)
class BackendSpec:
    """make: parameters to an estimator; space: parameter to (kind, low, high): 'int', 'float' or 'log'."""

    make: Callable[..., object]
    space: dict[str, tuple]


BACKENDS: dict[str, BackendSpec] = {
    "GBT": BackendSpec(lambda **p: GBTRegressor(labelCol="y", seed=0, **p), {"maxDepth": ("int", 3, 8), "maxIter": ("int", 20, 80), "stepSize": ("log", 0.02, 0.3), "subsamplingRate": ("float", 0.6, 1.0)}),
    "RF": BackendSpec(lambda **p: RandomForestRegressor(labelCol="y", seed=0, **p), {"maxDepth": ("int", 4, 12), "numTrees": ("int", 20, 100)}),
    "LIN": BackendSpec(lambda **p: LinearRegression(labelCol="y", **p), {"regParam": ("log", 1e-4, 1.0), "elasticNetParam": ("float", 0.0, 1.0)}),
}


def register(name: str, spec: BackendSpec) -> None:
    BACKENDS[name] = spec


def drawn(space: dict[str, tuple], rng: np.random.Generator) -> dict:
    """One random point of a space."""
    out = {}
    for n, (kind, low, high) in space.items():
        out[n] = int(rng.integers(low, high + 1)) if kind == "int" else float(np.exp(rng.uniform(np.log(low), np.log(high)))) if kind == "log" else float(rng.uniform(low, high))
    return out


def known_params(space: dict[str, tuple], params: dict) -> dict:
    """Of older parameters those that the space still has, integers where it wants them."""
    return {k: int(v) if space[k][0] == "int" else float(v) for k, v in params.items() if k in space}


def fitted(train: DataFrame, features: list[str], backend: str, params: dict) -> PipelineModel:
    return Pipeline(stages=[preprocessor(features), BACKENDS[backend].make(**params)]).fit(train.withColumnRenamed("target", "y") if "target" in train.columns else train)


def predicted(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """key, y_pred."""
    return model.transform(df).select(key, F.col("prediction").alias("y_pred"))


def objective(pred: DataFrame, truth: DataFrame, key: str, alpha: float = 0.5) -> float:
    """The search objective of predictions against truth(key, y): lower is better."""
    both = pred.join(truth, key)
    row = regression_metrics(both, "y", "y_pred").crossJoin(spearman(both, "y", "y_pred")).select(hpo_objective(F.col("rmse"), F.col("spearman"), alpha=alpha).alias("o")).first()  # one row each
    return float(row["o"])


def search(train: DataFrame, validation: DataFrame, features: list[str], key: str, backend: str, trials: int, seed: int, done: list[dict] | None = None) -> list[dict]:
    """Trials of random search, each {number, params, value}; trials already done are kept and not run again."""
    rng = np.random.default_rng(seed)
    out = list(done or [])
    for n in range(trials):
        params = drawn(BACKENDS[backend].space, rng)
        if n < len(out):
            continue
        model = fitted(train, features, backend, params)
        out.append({"number": n, "params": params, "value": objective(predicted(model, validation, key), validation.select(key, "y"), key)})
    return out


def run_fold(df: DataFrame, features: list[str], key: str, backend: str, part: str, trials: int, seed: int, fold: int) -> tuple[DataFrame, dict]:
    """One outer fold of df(key, features, y, part): parameters searched on inner_train against inner_val, refit on
    both, judged on outer_val. Gives the outer predictions and {seed, fold, params, inner, metrics}."""
    inner, val, outer = (df.filter(F.col(part) == p) for p in ("inner_train", "inner_val", "outer_val"))
    found = min(search(inner, val, features, key, backend, trials, seed * 1000 + fold), key=lambda t: (t["value"], t["number"]))
    model = fitted(inner.unionByName(val), features, backend, found["params"])
    pred = predicted(model, outer, key)
    row = regression_metrics(pred.join(outer.select(key, "y"), key), "y", "y_pred").first().asDict()
    return pred.withColumns({"model": F.lit(f"{backend}_seed{seed}_fold{fold}")}), {"seed": seed, "fold": fold, "params": found["params"], "inner": found["value"], "metrics": row}


def chosen(results: list[dict]) -> dict:
    """The fold whose inner, never outer, objective is best."""
    return min(results, key=lambda r: (r["inner"], r["seed"], r["fold"]))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
