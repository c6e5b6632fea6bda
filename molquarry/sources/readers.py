"""Readers: delimited text with sniffed separators, JSON in either form, many files with provenance, SQLite, configs."""

from __future__ import annotations

import json
import os
import sqlite3
import time
from collections.abc import Callable, Iterator
from dataclasses import fields, is_dataclass
from typing import TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from molquarry.runtime import detect_column

C = TypeVar("C")
#: Separators that sniffing tries; ties go to the earlier one.
SEPARATORS = (";", ",", "\t", "|")


def sniffed_separator(spark: SparkSession, path: str, candidates: tuple[str, ...] = (";", ",")) -> str:
    """The separator that the first line has most of."""
    line = spark.read.text(path).limit(1).collect()
    text = line[0][0].lstrip("﻿") if line else ""
    return max(candidates, key=lambda c: (text.count(c), -candidates.index(c)))


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str | None = None, columns: list[str] | None = None, multiline: bool = False, candidates: tuple[str, ...] = (";", ",")) -> DataFrame:
    """A delimited file with header; all text unless a schema is given; only the columns wanted reach the scan.

    Splits take the place of chunks: a file without multi-line values is read by many tasks.
    """
    sep = sep or sniffed_separator(spark, path, candidates)
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=multiline, mode="PERMISSIVE")
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.select(*columns) if columns else df


def read_cxsmiles(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file whose first column is the structure and second the name; extra columns stay."""
    df = read_delimited(spark, path, sep="\t")
    first, *rest = df.columns
    return df.select(F.trim(F.regexp_replace(first, "\\s+\\|[^|]*\\|\\s*$", "")).alias("smiles"), *rest)


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines, an array of objects, or one object: told apart by how the files begin."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    whole = bool(head) and head[0][0].lstrip("﻿ \t").startswith("[") or bool(head) and head[0][0].strip() == "{"
    reader = spark.read.option("multiLine", whole)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def with_provenance(df: DataFrame, out: str = "source_file") -> DataFrame:
    """df with the name of the file that each row came from."""
    return df.withColumn(out, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_many(spark: SparkSession, pattern: str, fmt: str = "csv", schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """All files that match, as one table with source_file."""
    reader = spark.read.format(fmt).options(**({"header": True} if fmt == "csv" else {}), **options)
    return with_provenance((reader.schema(schema) if schema is not None else reader).load(pattern))


def name_keys(c: Column, pattern: str, keys: dict[str, str]) -> dict[str, Column]:
    """Columns from the groups of a file name pattern, e.g. seed and fold: {'seed': 'long', 'fold': 'long'}."""
    return {k: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, i + 1).try_cast(t)) for i, (k, t) in enumerate(keys.items())}


def read_fold_scores(spark: SparkSession, pattern: str, schema: T.StructType | str, prefix: str = "") -> DataFrame:
    """One JSON object a file called <prefix>seed<S>_fold<F>.json: its fields with seed and fold; absent folds are just not there."""
    df = read_many(spark, pattern, "json", schema, multiLine=True)
    return df.withColumns(name_keys(F.col("source_file"), f"{prefix}.*seed(\\d+)_fold(\\d+)", {"seed": "long", "fold": "long"}))


def read_runs(spark: SparkSession, root: str, runs: list[str], file: str = "metrics.csv") -> DataFrame:
    """One table of metrics a run, tagged with the run's label; a missing one is an error that names it."""
    from molquarry.operators.relational import tagged_union

    got, missing = {}, []
    for run in runs:
        try:
            got[run.split("_")[0].upper()] = spark.read.options(header=True, inferSchema=True).csv(f"{root}/{run}/{file}")
        except Exception as e:  # noqa: BLE001 - Spark tells a missing path only by message
            if "PATH_NOT_FOUND" not in str(e):
                raise
            missing.append(run)
    if missing:
        raise FileNotFoundError(f"no {file} for runs {missing} under {root}")
    return tagged_union(got, "model")


def distinct_values(df: DataFrame, candidates: list[str]) -> DataFrame:
    """Distinct non-null values of the first candidate column that is there."""
    c = detect_column(df, candidates)
    return df.select(F.col(c).alias(candidates[0])).filter(F.col(candidates[0]).isNotNull()).distinct()


def scores_only(df: DataFrame, score: str) -> DataFrame:
    """The score column without null and NaN."""
    return df.select(F.col(score).cast("double").alias(score)).filter(F.col(score).isNotNull() & ~F.isnan(score))


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], expected: int | None = None) -> DataFrame:
    """The table stored at path, else computed, stored and read again; a stored one of another row count is made anew."""
    try:
        df = spark.read.parquet(path)
        if expected is None or df.count() == expected:
            return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def feature_path(root: str, kind: str, **params: object) -> str:
    """Where features of given parameters are kept: kind_k1v1_k2v2."""
    return f"{root}/" + "_".join([kind, *(f"{k}{v}" for k, v in sorted(params.items()))])


def load_config(cls: type[C], path: str, *sections: str) -> C:
    """A dataclass from a YAML or JSON file: unknown names are ignored, nested dataclasses and sections are followed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        raw = json.loads(text)
    else:
        import yaml

        raw = yaml.safe_load(text)
    raw = raw or {}
    for s in sections:
        raw = raw.get(s, raw)

    def build(kind: type, values: dict) -> object:
        own = {}
        for f in fields(kind):
            if f.name in values:
                sub = f.default_factory if is_dataclass(f.default_factory) else None
                own[f.name] = build(sub, values[f.name]) if sub and isinstance(values[f.name], dict) else values[f.name]
        return kind(**own)

    return build(cls, raw)


def cv_scheme(path: str, fallback: tuple[list[int], int] = ([42], 5)) -> tuple[list[int], int]:
    """(seeds, folds) of a config's cross_validation block, the fallback where there is none."""
    try:
        import yaml

        with open(path, encoding="utf-8") as f:
            block = (yaml.safe_load(f) or {})["cross_validation"]
        return [int(s) for s in block["seeds"]], int(block["n_folds"])
    except (OSError, KeyError, TypeError, ValueError):
        return fallback


# SQLite as a data source ------------------------------------------------------------------------------------------------------


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    """Ranges of row ids, one a partition."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.table, self.parts = schema, options["path"], options["table"], int(options.get("partitions", 8))

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[_Range]:
        with self._connect() as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        if high is None:
            return [_Range(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        with self._connect() as db:
            yield from db.execute(f'select {names} from "{self.table}" where rowid between ? and ?', (partition.low, partition.high))


class SQLiteSource(DataSource):
    """spark.read.format('sqlite') with options path, table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        kinds = {"INTE": T.LongType(), "INT": T.LongType(), "BIGI": T.LongType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType(), "BLOB": T.BinaryType()}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            info = db.execute(f'pragma table_info("{self.options["table"]}")').fetchall()
        return T.StructType([T.StructField(name, kinds.get((kind or "").upper()[:4], T.StringType())) for _, name, kind, *_ in info])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SQLiteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A SQLite table by ranges of row ids. The file must be where the executors can see it."""
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").options(path=os.path.abspath(path), table=table, partitions=partitions).load()


# Lookups elsewhere --------------------------------------------------------------------------------------------------------------


def with_retries(call: Callable[[], object], tries: int = 3, wait: float = 1.0, again: Callable[[Exception], bool] = lambda e: True) -> object:
    """call(), tried again after growing waits while `again` says so."""
    for i in range(tries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if i + 1 == tries or not again(e):
                raise
            time.sleep(wait * 2**i)
    return None


def batch_lookup(df: DataFrame, key: str, fetch: Callable[[list[str]], list[object]], out: str, kind: str = "long", batch: int = 100, tries: int = 3, wait: float = 1.0, missing: object = 0) -> DataFrame:
    """key, out for distinct keys: fetch takes a batch and gives one value for each, in order; failures give `missing`.

    A fetch of the wrong length is an error. Batches are formed within partitions, so requests fall by the batch size.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for start in range(0, len(p), batch):
                keys = p[key].iloc[start : start + batch].tolist()
                try:
                    values = with_retries(lambda k=keys: fetch(k), tries, wait)
                except Exception:  # noqa: BLE001 - a failed batch isn't the job's failure
                    values = [missing] * len(keys)
                if len(values) != len(keys):
                    raise ValueError(f"{len(values)} values for {len(keys)} keys")
                yield pd.DataFrame({key: keys, out: [missing if v is None else v for v in values]})

    return df.select(key).filter(F.col(key).isNotNull()).distinct().mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {out} {kind}")


def found_heading(document: object, heading: str) -> object:
    """The first section of a nested document with that heading, depth first; None if there is none."""
    stack = [document]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if heading in (x.get("TOCHeading"), x.get("heading"), x.get("Heading")):
                return x
            stack += list(x.values())[::-1]
        elif isinstance(x, list):
            stack += x[::-1]
    return None
