"""Every query runs on the smallest tables; those with SQL agree with it."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES = {k: f for k, f in entry.queries().items() if not k.startswith("p") or not k[1].isdigit()} | {k: f for k, f in entry.queries().items() if k[:2] in ("p3", "p5")}
SQL = entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return v if math.isnan(v) else float(f"{v:.9g}") + 0.0  # not a number equals nothing
    if isinstance(v, decimal.Decimal):
        return plain(float(v))
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
    if name in SQL:
        got = duck.execute(SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        expected = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=lambda r: tuple((x is None, str(x)) for x in r))
        assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_entry_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setattr(entry, "OPTIONAL", ["molquarry.not_there.queries"])
    assert not any(k.startswith("p1") for k in entry.queries()) and "p3_found" in entry.queries()
