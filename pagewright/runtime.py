"""Session helpers: table reads, lineage cuts, and the session used by tests and the bench."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read through Spark's own file systems."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder.

    A reliable checkpoint survives the loss of any executor.  The folder is the one named by
    ``spark.checkpoint.dir``; only where that is unset (tests) a temporary one is made.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_table(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage`` for many narrow rows: a compressed Parquet table in the same folder.

    Spark does not clear such tables; they go with the checkpoint folder of the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame):
    """``df`` kept by the executors, in memory or else on disk, for what is read several times inside the ``with``.

    Unlike a table it keeps how its rows are dealt, so windows and groups by the same keys shuffle nothing;
    what is lost is made again.
    """
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def python_ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is installed, or shipped with ``--py-files``; then this adds nothing.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([p for p in (root, env.get("PYTHONPATH", "")) if p])


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over as many tasks as its rows need at about ``rows`` each, so that a task's share doesn't grow with the table; ``df`` is counted."""
    return df.repartition(max(partitions(df.sparkSession), -(-df.count() // rows)), *keys)


def local_session(cpus: str | None = None, app: str = "pagewright") -> SparkSession:
    """A local session with the settings used by the tests and the bench."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
