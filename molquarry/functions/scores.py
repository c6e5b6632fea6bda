"""Score terms and rescalings as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rescaled(x: Column, low: float, high: float, invert: bool = False) -> Column:
    """x from [low, high] to [0, 1], not clipped; inverted if wished."""
    t = (x - low) / (high - low)
    return 1 - t if invert else t


def accessibility(x: Column) -> Column:
    """A raw ease score of 1 (easy) to 10 to [0, 1], 1 the easy end."""
    return rescaled(x, 1, 10, invert=True)


def complexity(x: Column) -> Column:
    """A raw complexity of 1 (simple) to 5 to [0, 1], 1 the simple end."""
    return rescaled(x, 1, 5, invert=True)


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def length_term(lls: Column, longest: float = 11.0) -> Column:
    """1 for one step, falling evenly to 0 at `longest` steps."""
    return F.greatest(F.lit(0.0), 1 - (F.greatest(lls, F.lit(1)) - 1) / (longest - 1))


def linear_depth(lls: Column, longest: float) -> Column:
    return clipped(1 - (lls - 1) / (longest - 1))


def log_depth(lls: Column, longest: float) -> Column:
    return clipped(1 - F.ln(F.greatest(lls, F.lit(1)).cast("double")) / F.ln(F.lit(float(longest))))


def convergence(lls: Column, n_steps: Column) -> Column:
    """How far the longest line stays below the number of steps; null for no steps."""
    return 1 - F.try_divide(lls, n_steps)


def branching(mean: Column, low: float = 1.0, high: float = 2.0) -> Column:
    return clipped(rescaled(mean, low, high))


def weighted_mean(terms: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the terms named in weights; null as soon as one of them is."""
    total = sum(weights.values())
    return reduce(lambda a, b: a + b, (terms[n] * w for n, w in weights.items())) / total


#: Designs that are compared: a depth term, and weights of depth, convergence, branching and balance (fixed values).
DESIGNS = {
    "length_balance": ("linear", {"depth": 0.5, "balance": 0.5}),
    "length_coupling_balance": ("linear", {"depth": 0.5, "coupling": 0.3, "balance": 0.2}),
    "length_only": ("linear", {"depth": 1.0}),
    "log_only": ("log", {"depth": 1.0}),
    "balance_only": ("linear", {"balance": 1.0}),
    "coupling_only": ("linear", {"coupling": 1.0}),
    "branching_only": ("linear", {"branching": 1.0}),
    "convergence_only": ("linear", {"convergence": 1.0}),
    "log_balance": ("log", {"depth": 0.5, "balance": 0.5}),
    "length_branching": ("linear", {"depth": 0.5, "branching": 0.5}),
    "length_convergence": ("linear", {"depth": 0.5, "convergence": 0.5}),
    "log_coupling_balance": ("log", {"depth": 0.5, "coupling": 0.3, "balance": 0.2}),
    "equal": ("linear", {"depth": 1.0, "coupling": 1.0, "balance": 1.0}),
    "equal_with_branching": ("linear", {"depth": 1.0, "branching": 1.0, "balance": 1.0}),
    "equal_with_convergence": ("linear", {"depth": 1.0, "convergence": 1.0, "balance": 1.0}),
}


def design_variants(lls: Column, n_steps: Column, coupling: Column, mean_branching: Column, balance: Column, longest: float = 11.0) -> dict[str, Column]:
    """Every design's score, by name."""
    shared = {"coupling": coupling, "balance": balance, "branching": branching(mean_branching), "convergence": convergence(lls, n_steps)}
    depths = {"linear": linear_depth(lls, longest), "log": log_depth(lls, longest)}
    return {n: weighted_mean({**shared, "depth": depths[kind]}, w) for n, (kind, w) in DESIGNS.items()}


def bounded(x: Column, limit: float = 1e4) -> Column:
    """Infinities to null, the rest cut to [-limit, limit]."""
    return F.when(F.abs(x) < float("inf"), clipped(x, -limit, limit))


def blended_availability(available: Column, length: Column, alpha: float = 0.95, longest: int = 20, clamp: bool = False) -> Column:
    """alpha of the available share and the rest of shortness, 1 - length / longest, which may fall below 0 unless clamped."""
    short = 1 - length / longest
    return alpha * available + (1 - alpha) * (F.greatest(short, F.lit(0.0)) if clamp else short)
