"""Session helpers: table loading, shared scratch tables and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "corpusloom", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(8, n)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table out to all cores when its files hold fewer splits than there are cores.

    Large inputs already have more splits than cores and are left where they are, so no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without, and gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc.getCheckpointDir()


#: Where note() puts the scratch folders that are made.
_noted: list[Scratch] | None = None


@contextmanager
def note() -> Iterator[list[Scratch]]:
    """The scratch folders that are made within, for a caller that knows when their tables are read no more."""
    global _noted
    before, _noted = _noted, []
    try:
        yield _noted
    finally:
        _noted = before


class Scratch:
    """Tables written to the shared folder, to cut lineage so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root = spark, f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
        if _noted is not None:
            _noted.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str | None = None) -> None:
        """Removes a table, or all of them, that no later step reads."""
        jvm, at = self.spark._jvm, self.path(name) if name else self.root
        where = jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def send_file(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to the executors, once per application; the name by which sent_file() finds it there."""
    sc, name = spark.sparkContext, os.path.basename(path)
    sent = sc.__dict__.setdefault("_corpusloom_sent", {})
    if sent.get(name) != path:
        sc.addFile(path)
        sent[name] = path
    return name


def sent_file(name: str) -> str:
    """In a task, where a sent file lies."""
    return SparkFiles.get(name)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, for tasks that run Python."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="corpusloom-ship-"), "corpusloom.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(to)
    sc._corpusloom_shipped = True
