"""A varied subset of given size by greedy determinant maximisation over composable core-sets (problem 7).

Molecules become unit vectors of their weighted character grams; the determinant of the vectors' Gram matrix is the
squared volume they span, which grows with variety and falls to nothing with repeats. Random partitions each pick
their best by greedy selection, one row of the Cholesky factor at a time; what they pick is a core-set, core-sets of
core-sets follow until one task can hold them, and a last pass picks the subset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.llm.cosine_join import gram_hashes
from molquarry.llm.molecules import molecule_text
from molquarry.runtime import Scratch

#: The least length of the vectors; characters of a gram. What makes a series, shared ends, makes vectors alike.
DIMENSIONS, GRAM = 256, 5
#: Rows that a partition selects from, at most about; and that the last pass does.
PARTITION_ROWS, LAST_ROWS = 8_192, 16_384


def dimensions(size: int) -> int:
    """A power of two that is twice the subset at least: with fewer dimensions than rows the volume would be the ridge's."""
    return max(DIMENSIONS, 1 << (2 * size - 1).bit_length())


def vectors(texts: list[str], length: int = DIMENSIONS) -> np.ndarray:
    """A unit vector for each text: signed hashed counts of its grams, square roots taken. Zero for texts without grams."""
    h, owner, _ = gram_hashes([t if len(t) >= GRAM else t.ljust(GRAM, "\x01") for t in texts], GRAM)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([new, [len(h)]]))
    h, owner = h[new], owner[new]
    slot = (h % np.uint64(length)).astype(np.int64)
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    x = np.bincount(owner * length + slot, sign * np.sqrt(count), len(texts) * length).reshape(len(texts), length)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def greedy_determinant(x: np.ndarray, size: int, ridge: float = 1e-3) -> list[int]:
    """Rows of x in the order in which each adds most to the determinant of the chosen rows' kernel x x' + ridge.

    The Cholesky factor grows by one column a step; `gain` holds every row's next pivot. Ties go to the first row.
    With more rows wanted than there are, all are given.
    """
    n = len(x)
    size = min(size, n)
    gain = np.einsum("ij,ij->i", x, x).astype(np.float64) + ridge
    factor = np.zeros((n, size), np.float32)
    chosen: list[int] = []
    open_ = np.ones(n, bool)
    for step in range(size):
        j = int(np.argmax(np.where(open_, gain, -np.inf)))
        chosen.append(j)
        open_[j] = False
        if step + 1 == size:
            break
        row = x @ x[j]
        row[j] += ridge
        column = (row - factor[:, :step] @ factor[j, :step]) / np.sqrt(max(gain[j], 1e-12))
        factor[:, step] = column
        gain -= column.astype(np.float64) ** 2
    return chosen


def varied_subset(df: DataFrame, size: int, key: str = "row_id", smiles: str = "smiles") -> DataFrame:
    """(key, rank): `size` rows of df that differ as much as can be; of rows with one molecule only the first key.

    Null and blank molecules and null keys are left out; with no more different molecules than size, all are given. rank is
    the order of choice, 1 the first. Every row takes part in the selection of its partition; what a partition
    hands on is bounded by size, and partitions are merged until the last pass has LAST_ROWS at most (or twice size).
    """

    def molecules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([molecule_text(s) for s in b.column(1).to_pylist()], pa.string())], names=["id", "text"])

    rows = df.filter(F.col(key).isNotNull() & F.col(smiles).isNotNull()).select(F.col(key).cast("long"), F.col(smiles).cast("string"))
    rows = rows.mapInArrow(molecules, "id long, text string").filter("text <> ''").groupBy("text").agg(F.min("id").alias("id"))
    scratch = Scratch(df.sparkSession)
    rows = scratch.keep(rows)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by("id")
        ids, texts = table.column("id").to_numpy(), table.column("text").to_pylist()
        picked = greedy_determinant(vectors(texts, dimensions(size)), size)
        yield pa.RecordBatch.from_arrays([pa.array(ids[picked]), pa.array([texts[i] for i in picked], pa.string()), pa.array(np.arange(1, len(picked) + 1, dtype=np.int32))], names=["id", "text", "rank"])

    last = max(LAST_ROWS, 2 * size)
    per = max(PARTITION_ROWS, 4 * size)
    n = rows.count()
    while n > last:
        parts = -(-n // per)
        spread = rows.repartition(parts, F.xxhash64("id", F.lit(n)))
        rows = scratch.keep(spread.select("id", "text").mapInArrow(select, "id long, text string, rank int").select("id", "text"))
        n = rows.count()
    return rows.select("id", "text").repartition(1).mapInArrow(select, "id long, text string, rank int").select(F.col("id").alias(key), "rank")


def volume(df: DataFrame, smiles: str = "smiles", ridge: float = 1e-3) -> float:
    """Logarithm of the determinant of the kernel of a chosen subset's molecules."""
    x = vectors([molecule_text(r[0]) for r in df.select(smiles).collect()], dimensions(max(1, df.count()))).astype(float)
    return float(np.linalg.slogdet(x @ x.T + ridge * np.eye(len(x)))[1])


def coverage(df: DataFrame, subset: DataFrame, group: str, key: str = "row_id") -> DataFrame:
    """By group: its rows in the whole table and in the subset."""
    own = df.select(key, group).join(subset.select(key, F.lit(1).alias("_in")), key, "left")
    return own.groupBy(group).agg(F.count("*").alias("n_rows"), F.sum(F.coalesce("_in", F.lit(0))).alias("n_chosen"))
