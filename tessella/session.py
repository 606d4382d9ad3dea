"""Session construction, table access and tables written on the way, shared by every part of the library."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A single-JVM session for tests and benchmarks; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessella")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; the path is only ever opened by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many tasks as shuffles have, by keys where given: for small rows that costly work is to be done on, which adaptive execution would leave in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse; a temporary one only for a session within one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        one_machine = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        found = tempfile.mkdtemp(prefix="tessella-") if one_machine else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessella"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table by the file system that holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if (own := _scope.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path), path


_scope: ContextVar[list[str] | None] = ContextVar("tables of the innermost scope of this thread", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored() wrote inside it, in this thread: for callers that have written what they wanted from an operator by then.

    Tables of results made outside, or in other threads, stay.
    """
    own: list[str] = []
    before = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(before)
        for path in own:
            remove(spark, path)
