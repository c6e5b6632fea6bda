"""Writers: delimited and JSON output, merged parts, keyed tables, reports and documents."""

from __future__ import annotations

import json
import os
import re
import sqlite3
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.operators.relational import insert_or_ignore


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    """A folder of delimited parts, each with the header."""
    df.write.mode(mode).options(header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def _filesystem(spark: SparkSession, path: str) -> tuple:
    """(file system of a path, the path): whatever shared storage holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files in a folder."""
    fs, p = _filesystem(spark, folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if f.isFile())


def write_file(df: DataFrame, path: str, fmt: str = "csv", sep: str = ",") -> None:
    """One file of that very name, for tools that need one: a bounded export, written by one task. Folders are made, an old file is replaced."""
    spark, folder = df.sparkSession, path + ".parts"
    if fmt == "csv":
        write_delimited(df.coalesce(1), folder, sep)
    else:
        df.coalesce(1).write.mode("overwrite").format(fmt).save(folder)
    fs, target = _filesystem(spark, path)
    part = next(x for x in listed(spark, folder) if x.rsplit("/", 1)[-1].startswith("part-"))
    fs.delete(target, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(part), target)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder), True)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key isn't stored yet, and tell how many; running it again appends nothing.

    The stored keys are read once; new rows are written by partitions.
    """
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path).select(key)
        fresh = df.join(have.distinct(), key, "left_anti").select(*df.columns)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        fresh = df
    before = _count(spark, path)
    fresh.write.mode("append").parquet(path)
    return _count(spark, path) - before


def _count(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(path).count()
    except Exception:  # noqa: BLE001
        return 0


def write_clustered(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """In place of an index: files sorted by the keys, so that row group statistics skip what a lookup doesn't want."""
    n = partitions or max(1, df.rdd.getNumPartitions())
    df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_star(tables: dict[str, DataFrame], root: str, keys: dict[str, list[str]]) -> None:
    """Several tables under one root, each clustered by its keys."""
    for name, df in tables.items():
        write_clustered(df, f"{root}/{name}", keys[name])


def store_stock(df: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """The stored stock with the first new row of each key that it lacks; stored again clustered by key."""
    spark = df.sparkSession
    try:
        have = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = df.limit(0)
    merged = insert_or_ignore(have, df, key, order)
    write_clustered(merged, path + ".next", [key])
    spark.read.parquet(path + ".next").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def routed(df: DataFrame, route: str) -> dict[str, DataFrame]:
    """A table for each value of the routing column, null left out; values are few."""
    return {r[0]: df.filter(F.col(route) == r[0]).drop(route) for r in df.select(route).distinct().collect() if r[0] is not None}


def write_sqlite(df: DataFrame, path: str, table: str, key: str | None = None, indexes: Iterable[str] = (), batch: int = 10_000) -> int:
    """A SQLite table for tools that need one: rows come to the driver a partition at a time; rows of a key that is there are ignored.

    Meant for bounded exports; the library's own tables are parquet.
    """
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER"}
    with sqlite3.connect(path) as db:
        cols = ", ".join(f'"{n}" {kinds.get(t, "TEXT")}' + (" UNIQUE" if n == key else "") for n, t in df.dtypes)
        db.execute(f'create table if not exists "{table}" ({cols})')
        marks, rows = ", ".join("?" * len(df.columns)), []
        for r in df.toLocalIterator():
            rows.append(tuple(r))
            if len(rows) == batch:
                db.executemany(f'insert or ignore into "{table}" values ({marks})', rows)
                rows.clear()
        db.executemany(f'insert or ignore into "{table}" values ({marks})', rows)
        for c in indexes:
            db.execute(f'create index if not exists "ix_{table}_{c}" on "{table}" ("{c}")')
        return db.execute(f'select count(*) from "{table}"').fetchone()[0]


def task_prefixes(names: list[str]) -> dict[str, list[str]]:
    """Parts by the name they have without their task number."""
    out: dict[str, list[str]] = {}
    for n in sorted(names):
        stem = re.sub(r"_task\d+.*$", "", os.path.basename(n))
        if stem != os.path.basename(n):
            out.setdefault(stem, []).append(n)
    return out


def merge_delimited(spark: SparkSession, folder: str, out: str, prefix: str | None = None) -> dict[str, int]:
    """All parts <prefix>_task*.csv of every prefix (or one) to <out>/<prefix>; rows of each."""
    return _merge(spark, folder, out, prefix, (".csv",))


def merge_json(spark: SparkSession, folder: str, out: str, prefix: str | None = None) -> dict[str, int]:
    """The same for .json and .jsonl parts, arrays and lines mixed."""
    return _merge(spark, folder, out, prefix, (".json", ".jsonl"))


def _merge(spark: SparkSession, folder: str, out: str, prefix: str | None, endings: tuple[str, ...]) -> dict[str, int]:
    done = {}
    for stem, parts in task_prefixes([n for n in listed(spark, folder) if n.endswith(endings)]).items():
        if prefix and stem != prefix:
            continue
        if endings == (".csv",):
            df = spark.read.options(header=True, quote='"', escape='"').csv(parts)
            write_delimited(df, f"{out}/{stem}")
        else:
            whole = [p for p in parts if _first_byte(spark, p) == "["]
            lines = [p for p in parts if p not in whole]
            both = [spark.read.option("multiLine", m).json(p) for m, p in ((True, whole), (False, lines)) if p]
            df = both[0] if len(both) == 1 else both[0].unionByName(both[1], allowMissingColumns=True)
            df.write.mode("overwrite").json(f"{out}/{stem}")
        done[stem] = df.count()
    return done


def _first_byte(spark: SparkSession, path: str) -> str:
    fs, p = _filesystem(spark, path)
    stream = fs.open(p)
    try:
        got = stream.read()
    finally:
        stream.close()
    return chr(got) if got >= 0 else ""


# Reports and documents --------------------------------------------------------------------------------------------------------------


def sectioned_report(sections: dict[str, DataFrame]) -> str:
    """Small tables as CSV text, each under its title and parted by blank lines."""
    blocks = []
    for title, df in sections.items():
        rows = [",".join(df.columns), *(",".join("" if v is None else str(v) for v in r) for r in df.collect())]
        blocks.append("\n".join([f"# {title}", *rows]))
    return "\n\n".join(blocks) + "\n"


def latex_table(df: DataFrame, caption: str = "") -> str:
    """A small table as LaTeX text."""
    esc = lambda v: "---" if v is None else re.sub(r"([&%$#_{}])", r"\\\1", str(v))
    lines = ["\\begin{tabular}{" + "l" * len(df.columns) + "}", "\\toprule", " & ".join(map(esc, df.columns)) + " \\\\", "\\midrule"]
    lines += [" & ".join(map(esc, r)) + " \\\\" for r in df.collect()]
    lines += ["\\bottomrule", "\\end{tabular}"]
    return "\n".join((["% " + caption] if caption else []) + lines) + "\n"


def summary_document(df: DataFrame, value: str, source: str) -> str:
    """JSON with the value's quantile summary and count, mean and std by source."""
    from molquarry.operators.aggregates import fold_summary, quantile_summary

    whole = quantile_summary(df, value).first().asDict()
    parts = {r[source]: {"count": r["n"], "mean": r["mean"], "std": r["std"]} for r in fold_summary(df, [source], value).collect()}
    return json.dumps({"all": whole, "by_source": parts}, indent=2, default=str)


def nested_scores(long: DataFrame) -> dict[str, dict[str, list]]:
    """{model: {metric: [values by seed and fold]}} of a long table of fold scores."""
    out: dict[str, dict[str, list]] = {}
    for r in long.orderBy("model", "metric", "seed", "fold").collect():
        out.setdefault(r["model"], {}).setdefault(r["metric"], []).append(r["value"])
    return out


def output_paths(source: str, folder: str | None = None, prefix: str = "") -> dict[str, str]:
    """Where results of an input go: scored table, summary, report, next to it unless a folder is given."""
    stem = os.path.splitext(os.path.basename(source))[0]
    base = f"{folder or os.path.dirname(source) or '.'}/{prefix + '_' if prefix else ''}{stem}"
    return {"scored": f"{base}_scored", "summary": f"{base}_summary.json", "report": f"{base}_report.txt"}


def route_table(df: DataFrame, key: str) -> DataFrame:
    """role, smiles of the target and the leaves of each route."""
    from molquarry.operators.routes import route_roles

    return route_roles(df, key).filter("role <> 'intermediate'").select(key, F.when(F.col("role") == "target", "target").otherwise("building_block").alias("role"), F.col("node").alias("smiles"))


def manifest(weights: dict[str, float], members: dict[str, str], config: dict) -> str:
    """The ensemble's document: members by falling weight with their paths, and its feature configuration."""
    from molquarry.operators.ensembles import resolved_members

    return json.dumps({"members": resolved_members(weights, members), "features": config}, indent=2)


def correlation_text(matrix: DataFrame) -> str:
    """A correlation matrix as aligned text."""
    rows = {(r["left"], r["right"]): r["r"] for r in matrix.collect()}
    names = list(dict.fromkeys(k for p in rows for k in p))
    get = lambda a, b: rows.get((a, b), rows.get((b, a)))
    show = lambda v: "   n/a" if v is None else f"{v:6.3f}"
    wide = max(map(len, names), default=0)
    return "\n".join(f"{a:<{wide}} " + " ".join(show(get(a, b)) for b in names) for a in names) + "\n"
