"""Session helpers: settings, table access, shipping of the package and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def build(app: str = "loomgraph", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings this engine expects: UTC, AQE, Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **(conf or {}),
    }.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once per application.

    Python functions that run on executors import this package by name; a
    cluster that does not have it installed gets it from here.
    """
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_shipped", False):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="loomgraph-ship-"), f"loomgraph-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, str(Path(ROOT.name) / p.relative_to(ROOT)))
    sc.addPyFile(out)  # the driver serves it to every executor, late ones too
    sc._loomgraph_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task of spread() gets.
ROWS_A_TASK = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by the keys to as many tasks as ROWS_A_TASK asks for, if these are more than the session's partitions: what a task holds then does not grow with the table. Joins and groupings by the keys keep the deal."""
    n = -(-rows // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the cluster names none (tests, a laptop) a local folder is set.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    local = tempfile.mkdtemp(prefix="loomgraph-checkpoint-")
    sc.setCheckpointDir(local)
    return local


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the shared folder; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


class Stored:
    """A table written to the shared folder, read back as often as needed; by: in folders by that column."""

    def __init__(self, df: DataFrame, name: str, by: str | None = None):
        self.spark = df.sparkSession
        self.schema = None if by else df.schema
        self.path = f"{shared_dir(self.spark).rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(self.path)

    def read(self) -> DataFrame:
        read = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)  # else a job of its own finds it
        return read.parquet(self.path)

    def drop(self) -> None:
        """Remove the files; call it once no later read can need them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
