"""Delimited lines to a typed table, with the lines that can't be read and why (problem 3).

Structure is checked on each line; values are not: each distinct value is judged once for each kind of column it stands
in, in Arrow batches, the failing ones make a dictionary of invalid values with reasons, and that is joined back.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molquarry.functions import smiles as S
from molquarry.functions.text import DECIMAL, decimal, let, strip_blanks
from molquarry.runtime import SALTS, Scratch, replicated


#: Judges values: texts to reasons, None for valid ones. Columns with one check share its dictionary.
Check = Callable[[list[str]], list[str | None]]
_DECIMAL = re.compile(DECIMAL[1:-1], re.ASCII)


def _number(low: float, high: float | None, whole: bool = False) -> Check:
    def one(text: str) -> str | None:
        x = float(text) if _DECIMAL.fullmatch(text) else math.inf
        if math.isinf(x):
            return "not a number"
        if x < low:
            return "too small"
        if high is not None and x > high:
            return "too large"
        return "not whole" if whole and x != math.floor(x) else None

    return lambda texts: [one(t) for t in texts]


def _booleans(texts: list[str]) -> list[str | None]:
    return [None if t.lower() in ("true", "false") else "neither true nor false" for t in texts]


CHECKS: dict[str, Check] = {"structure": S.faults, "boolean": _booleans, "share": _number(0, 1), "amount": _number(0, None), "count": _number(0, None, True)}


@dataclass(frozen=True)
class Field:
    """name; type of the cast; check: a name in CHECKS or None; needed: not empty."""

    name: str
    type: str = "string"
    check: str | None = None
    needed: bool = False


#: The route files' seven fields.
ROUTE_FIELDS = (
    Field("smiles", "string", "structure", True),
    Field("target_smiles", "string", "structure"),
    Field("resolved", "boolean", "boolean"),
    Field("route_score", "double", "share"),
    Field("search_time_seconds", "double", "amount"),
    Field("n_steps", "int", "count"),
    Field("note"),
)


@dataclass(frozen=True)
class Parsed:
    """rows: line_id and the typed fields; bad: line_id, reason, column, detail. Each line is in one of them, headers in none."""

    rows: DataFrame
    bad: DataFrame


#: Stands for the field separator once quotes are resolved.
_SEP = "\x01"


def _fields(line: Column, delimiter: Column) -> Column:
    """broken (whether the quotes are) and values (the fields) of a line; split at its quotes, its pieces alternate outside and inside."""
    outside = lambda i: i % 2 == 0

    def judged(parts: Column) -> Column:
        last = F.size(parts) - 1
        wrong = F.transform(
            parts,
            lambda x, i: outside(i)
            & (x != "")
            & (((i > 0) & ~F.startswith(F.ltrim(x), delimiter) & ~((i == last) & (F.trim(x) == ""))) | ((i < last) & ~F.endswith(F.rtrim(x), delimiter) & ~((i == 0) & (F.trim(x) == "")))),
        )
        # An empty piece between two quoted ones is a doubled quote.
        resolved = F.transform(
            parts,
            lambda x, i: F.when(~outside(i), x)
            .when((x == "") & (i > 0) & (i < last), F.lit('"'))
            .otherwise(F.replace(x, delimiter, F.lit(_SEP))),
        )
        return F.struct(((last % 2 == 1) | F.array_contains(wrong, True)).alias("broken"), F.split(F.array_join(resolved, ""), _SEP, -1).alias("values"))

    plain = F.struct(F.lit(False).alias("broken"), F.split(F.replace(line, delimiter, F.lit(_SEP)), _SEP, -1).alias("values"))
    return F.when(delimiter.isNotNull() & ~F.contains(line, F.lit('"')), plain).otherwise(let(F.split(line, '"', -1), judged))


def parse_rows(lines: DataFrame, fields: tuple[Field, ...] = ROUTE_FIELDS) -> Parsed:
    """Split lines(line_id, source_file, line_no, line, ...) into typed rows and bad lines.

    line_no 1 of a file is its header and gives delimiter and field order; of several, the smallest line_id
    counts. reason is 'quoting', else 'columns', else 'value'. A null line, a blank line and a line of a file
    without header have too few columns. Empty fields are null but for the needed ones. Extra columns are
    ignored; repeated lines are judged each. No lines give two empty tables.
    """
    text = F.rtrim(F.ltrim(F.coalesce("line", F.lit("")), F.lit("\ufeff")), F.lit("\r\n"))
    text = F.translate(text, _SEP, "�")
    lines = lines.select("line_id", F.coalesce("source_file", F.lit("")).alias("_file"), "line_no", text.alias("_text"))
    headers = (
        lines.filter("line_no = 1")
        .groupBy("_file")
        .agg(F.min_by("_text", "line_id").alias("_head"))
        .withColumn("_d", F.regexp_extract("_head", '[^A-Za-z0-9_" ]', 0))
        .withColumn("_d", F.when(F.col("_d") == "", F.lit(",")).otherwise(F.col("_d")))
        .withColumn("_names", F.transform(F.split(F.replace("_head", "_d", F.lit(_SEP)), _SEP), lambda x: F.lower(F.trim(F.translate(x, '"', "")))))
        .drop("_head")
    )
    body = lines.filter("line_no is null or line_no <> 1").withColumn("_salt", F.pmod(F.xxhash64("line_id"), F.lit(SALTS)).cast("int"))
    body = body.join(replicated(headers), ["_file", "_salt"], "left")
    body = body.select("line_id", "_names", _fields(F.col("_text"), F.col("_d")).alias("_f")).select("line_id", "_names", F.col("_f.broken").alias("_broken"), F.col("_f.values").alias("_values"))
    reason = F.when(F.col("_broken"), "quoting").when(F.coalesce(F.size("_values"), F.lit(1)) != len(fields), "columns")
    value = lambda f: F.try_element_at("_values", F.nullif(F.array_position("_names", f.name), F.lit(0)).cast("int"))
    # A line without header has null fields: its quotes can be judged only for being left open.
    body = body.select(
        "line_id",
        F.when(F.col("_names").isNull(), "columns").otherwise(reason).alias("reason"),
        *(F.coalesce(strip_blanks(value(f)), F.lit("")).alias(f.name) for f in fields),
    )
    body = Scratch(lines.sparkSession).keep(body)  # lines are split once, the three readers below read columns
    structural = body.filter("reason is not null").select("line_id", "reason", F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("detail"))
    fine = body.filter("reason is null").drop("reason")

    checked = [f for f in fields if f.check or f.needed]
    long = fine.select(
        "line_id",
        F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), F.lit(f.check or "").alias("check"), F.lit(f.needed).alias("needed"), F.col(f.name).alias("value")) for f in checked))).alias("x"),
    ).select("line_id", "x.*")
    empty = long.filter("needed and value = ''").select("line_id", "column", F.lit("empty").alias("detail"))
    valued = long.filter("check <> '' and value <> ''")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
            for kind in sorted(set(kinds.tolist())):
                own = values.take(pa.array(np.flatnonzero(kinds == kind)))
                details = pa.array(CHECKS[kind](own.to_pylist()), pa.string())
                bad = pa.array(np.flatnonzero(details.is_valid()))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(bad), pa.string()), own.take(bad), details.take(bad)], names=["check", "value", "detail"])

    invalid = valued.select("check", "value").distinct().mapInArrow(judge, "check string, value string, detail string")
    # Hot values are spread by salt; the dictionary has one row a value.
    found = valued.withColumn("_salt", F.pmod(F.xxhash64("line_id"), F.lit(SALTS)).cast("int")).join(replicated(invalid), ["check", "value", "_salt"]).select("line_id", "column", "detail")
    faulty = found.unionByName(empty).groupBy("line_id").agg(F.min(F.struct("column", "detail")).alias("x")).select("line_id", F.lit("value").alias("reason"), "x.column", "x.detail")  # a line has a few faults, lines with one are few
    cast = {"string": lambda c: c, "double": decimal, "int": lambda c: decimal(c).cast("int"), "boolean": lambda c: F.lower(c) == "true"}
    rows = fine.join(faulty, "line_id", "left_anti").select(
        "line_id", *(F.when(F.col(f.name) != "", cast[f.type](F.col(f.name))).alias(f.name) for f in fields)
    )
    return Parsed(rows, structural.unionByName(faulty))
