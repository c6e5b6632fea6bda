"""The same or nearly the same molecules across splits (problem 1)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from molquarry.llm.cosine_join import JoinPlan, near_texts
from molquarry.llm.molecules import molecule_text
from molquarry.runtime import Scratch


def with_molecule(df: DataFrame, smiles: str, keep: list[str]) -> DataFrame:
    """The columns of keep and `text`, the structure in its one spelling; without rows that have none."""
    names = [F.col(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([molecule_text(s) for s in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*keep, "text"])

    picked = df.select(*names, F.col(smiles).cast("string").alias("_smiles"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, text string").filter("text <> ''")


def split_overlaps(train: DataFrame, evaluations: dict[str, DataFrame], key: str = "row_id", smiles: str = "smiles", source: str = "datasource", plan: JoinPlan = JoinPlan()) -> DataFrame:
    """split, source, train_id, eval_id, distance, cosine: every pair of a training and an evaluation row with one molecule.

    Molecules are one if their texts, free of spelling, remarks, stereo marks and small components, differ by at
    most plan.edits characters. Rows with null or blank texts or null keys take no part; repeated rows pair each;
    equal texts are joined once and given back to all their rows. source is the evaluation row's.
    """
    scratch = Scratch(train.sparkSession)

    def numbered(df: DataFrame) -> DataFrame:
        """df with id, the same for rows of one text, and whether a row is the first of its text."""
        alike = Window.partitionBy("text").orderBy("_m")
        own = df.withColumn("_m", F.monotonically_increasing_id())
        return own.select(*df.columns, F.first("_m").over(alike).alias("id"), (F.row_number().over(alike) == 1).alias("first"))

    rows = scratch.keep(numbered(with_molecule(train.filter(F.col(key).isNotNull()), smiles, [key]).withColumnRenamed(key, "train_id")))
    tests = None
    for split, df in evaluations.items():
        own = with_molecule(df.filter(F.col(key).isNotNull()).select(F.col(key), F.col(source).cast("string").alias("source"), F.col(smiles).alias("smiles"), F.lit(split).alias("split")), "smiles", ["split", "source", key])
        own = own.withColumnRenamed(key, "eval_id")
        tests = own if tests is None else tests.unionByName(own)
    tests = scratch.keep(numbered(tests))
    pairs = scratch.keep(near_texts(*(t.filter("first").select("id", "text") for t in (rows, tests)), plan))
    ids = pairs.join(rows.select(F.col("id").alias("left_id"), "train_id"), "left_id")
    return ids.join(tests.select(F.col("id").alias("right_id"), "split", "source", "eval_id"), "right_id").select("split", "source", "train_id", "eval_id", "distance", "cosine")


def overlap_report(overlaps: DataFrame) -> DataFrame:
    """By split and source: pairs, exact ones among them, evaluation and training rows concerned."""
    return overlaps.groupBy("split", "source").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("distance") == 0).alias("n_same_text"),
        F.count_distinct("eval_id").alias("n_eval_rows"),
        F.count_distinct("train_id").alias("n_train_rows"),
    )
