"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows with one hot key are spread over this many sub-keys where an operator salts.
SALTS = 16


def local_session(cpus: int | str = "*", memory: str = "8g", app: str = "molquarry") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; where that is unset, a temporary one of a local session.

    Executors on other machines couldn't read a temporary folder, so a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
        return named
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="molquarry-cp-", dir=os.environ.get("TMPDIR")))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint: a lost executor can't take it along."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df itself, or a ValueError that lists what is there."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
    return df


def detect_column(df: DataFrame, candidates: list[str], needed: bool = True) -> str | None:
    """The first candidate that df has, in any letter case."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    for c in candidates:
        if c.lower() in by_lower:
            return by_lower[c.lower()]
    if needed:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return None


def salted(df: DataFrame, *keys: str | Column, salts: int = SALTS) -> DataFrame:
    """df with a column _salt that spreads equal keys evenly, made from the other columns given."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))


def replicated(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """df once for every salt: the other side of a salted join. Only for sides with one row a key."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


class Scratch:
    """Tables written to the shared checkpoint folder: lineage ends there, and what is no longer read can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, checkpoint_dir(spark).rstrip("/"), []

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        """df written, in folders by the columns given, and read again."""
        path = f"{self.root}/table-{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, but: int = 0) -> None:
        """Delete all tables kept so far but the last few."""
        gone, self.paths = self.paths[: len(self.paths) - but], self.paths[len(self.paths) - but :]
        jvm = self.spark._jvm
        for path in gone:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
