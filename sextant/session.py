"""Session helpers: a configured local session and shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", app: str = "sextant", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names the shared folder. Only where it is unset (a
    single-machine test) is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.environ.get("SEXTANT_SCRATCH") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: Folders of the tables that the last ``stage_scratch`` has stored, and whether one is open.
_scratch: list[str] = []
_recording: list[bool] = [False]


def store(rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows to a table in the shared folder and read them back.

    Cuts the lineage of a result that several later steps read: it is computed once, its
    plan stays small, and it outlives lost executors.
    """
    path = shared_dir(rows.sparkSession, purpose)
    rows.write.parquet(path)
    if _recording[0]:
        _scratch.append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@contextmanager
def stage_scratch(spark: SparkSession) -> Iterator[None]:
    """One stage of a chain whose results are written before the next one begins.

    So what earlier stages have stored inside of it is read no more, and is deleted first.
    """
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _recording[0] = True
    try:
        yield
    finally:
        _recording[0] = False


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows hashed by ``keys`` to as many partitions as ``store_bucketed`` writes buckets."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def store_bucketed(rows: DataFrame, purpose: str, keys: list[str]) -> DataFrame:
    """Store rows that were ``dealt`` by ``keys``, sorted in each bucket: joins on the keys read them without a shuffle.

    The session lists the table under a fresh name; its files are in the shared folder. Join
    such tables one by one: a union of them does not keep their hashing.
    """
    spark = rows.sparkSession
    name = f"{purpose.replace('-', '_')}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", shared_dir(spark, purpose))
        .saveAsTable(name)
    )
    return spark.table(name)
