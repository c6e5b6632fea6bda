"""Batch scoring: aligned, resumable, with failures kept to the row, the scorer or the member."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.sources.sinks import append_new

Scorer = Callable[[list[str]], np.ndarray]


def aligned(scorer: Scorer, texts: list[str | None], valid: Callable[[str], bool]) -> list[float | None]:
    """A score for each text in its place: null for null, invalid and non-finite ones; a wrong length is an error."""
    at = [i for i, t in enumerate(texts) if t is not None and t.strip() and valid(t)]
    out: list[float | None] = [None] * len(texts)
    if at:
        got = np.asarray(scorer([texts[i] for i in at]), float).reshape(-1)
        if len(got) != len(at):
            raise ValueError(f"{len(got)} scores for {len(at)} texts")
        for i, s in zip(at, got):
            out[i] = float(s) if np.isfinite(s) else None
    return out


def plainly_valid(text: str) -> bool:
    """Balanced brackets and no blanks inside: what can be told without a toolkit."""
    depth = 0
    for c in text.strip():
        depth += (c in "([") - (c in ")]")
        if depth < 0 or c.isspace():
            return False
    return depth == 0


def score_table(df: DataFrame, col: str, scorers: dict[str, Scorer], valid: Callable[[str], bool] = plainly_valid, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns in keep) with a column for each scorer; a scorer that fails on a batch gives nulls there.

    Arrow batches go to Python once for all scorers; a length mismatch still ends the job.
    """
    names = keep if keep is not None else df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["_text"]]
            out = b.drop(columns=["_text"])
            for n, s in scorers.items():
                try:
                    out[n] = pd.array(aligned(s, texts, valid), dtype="Float64")
                except ValueError as e:
                    if "scores for" in str(e):
                        raise
                    out[n] = pd.array([None] * len(b), dtype="Float64")
                except Exception:  # noqa: BLE001 - one scorer's failure isn't the others'
                    out[n] = pd.array([None] * len(b), dtype="Float64")
            yield out

    own = df.select(*names, F.col(col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{n}` {dict(df.dtypes)[n]}" for n in names)
    return own.mapInPandas(run, ", ".join([kinds, *(f"`{n}` double" for n in scorers)]) if kinds else ", ".join(f"`{n}` double" for n in scorers))


def score_remaining(df: DataFrame, path: str, key: str, col: str, scorers: dict[str, Scorer], batches: int = 1) -> int:
    """Score the rows that the stored output lacks, in so many batches, each stored before the next; how many are new.

    A run that breaks off goes on where the last whole batch ended.
    """
    total = 0
    for i in range(batches):
        part = df if batches == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == i)
        try:
            have = df.sparkSession.read.parquet(path).select(key)
            part = part.join(have, key, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        total += append_new(score_table(part, col, scorers, keep=[key]), path, key)
    return total


@dataclass
class Members:
    """Members loaded when first asked for; the least used leaves when more than `resident` are held."""

    load: Callable[[str], Scorer]
    resident: int = 4
    _held: OrderedDict = field(default_factory=OrderedDict)
    _lock: object = field(default_factory=threading.Lock)

    def get(self, name: str) -> Scorer:
        with self._lock:
            if name in self._held:
                self._held.move_to_end(name)
            else:
                self._held[name] = self.load(name)
                while len(self._held) > self.resident:
                    self._held.popitem(last=False)
            return self._held[name]

    def __reduce__(self):
        return (Members, (self.load, self.resident))


def ensemble_scores(df: DataFrame, key: str, col: str, members: Members, weights: dict[str, float]) -> DataFrame:
    """key, score (weighted mean), spread (population std of members) of each row; invalid rows have null."""
    total = sum(weights.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["_text"]]
            got = np.array([[np.nan if v is None else v for v in aligned(members.get(m), texts, plainly_valid)] for m in weights], float)
            w = np.array(list(weights.values()))[:, None] / total
            there = np.isfinite(got).all(0)
            score, spread = (got * w).sum(0), got.std(0)
            yield pd.DataFrame({key: b[key], **{n: pd.array([float(x) if ok else None for x, ok in zip(v, there)], dtype="Float64") for n, v in (("score", score), ("spread", spread))}})

    return df.select(key, F.col(col).cast("string").alias("_text")).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, score double, spread double")


def self_test(scorer: Scorer, probe: str = "CCO") -> float:
    """The score of a known text; an error if it isn't one finite number."""
    got = aligned(scorer, [probe], plainly_valid)[0]
    if got is None:
        raise ValueError(f"the scorer gives no finite number for {probe}")
    return got


class ScoringService:
    """What an endpoint needs: scores in order for a request's texts, and facts about the members."""

    def __init__(self, members: Members, weights: dict[str, float], config: dict | None = None):
        self.members, self.weights, self.config = members, weights, config or {}
        for m in weights:
            self_test(members.get(m))

    def predict(self, texts: list[str | None]) -> dict[str, list]:
        total = sum(self.weights.values())
        got = [aligned(self.members.get(m), texts, plainly_valid) for m in self.weights]
        rows = list(zip(*got)) if got else [()] * len(texts)
        mean = [None if not r or None in r else sum(w * v for w, v in zip(self.weights.values(), r)) / total for r in rows]
        spread = [None if m is None else float(np.std(r)) for m, r in zip(mean, rows)]
        return {"score": mean, "spread": spread}

    def info(self) -> dict:
        kinds: dict[str, int] = {}
        for m in self.weights:
            kinds[m.split("_")[0]] = kinds.get(m.split("_")[0], 0) + 1
        return {"n_members": len(self.weights), "backends": kinds, "config": self.config}

    def in_chunks(self, texts: list[str | None], size: int = 512) -> dict[str, list]:
        out: dict[str, list] = {}
        for i in range(0, len(texts), size):
            for k, v in self.predict(texts[i : i + size]).items():
                out.setdefault(k, []).extend(v)
        return out

    @staticmethod
    def selected(response: dict[str, list], name: str) -> list[float]:
        """One series, null as nan."""
        return [float("nan") if v is None else v for v in response[name]]
