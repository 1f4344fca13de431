"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only in a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class _Written(threading.local):
    """The tables of one driver thread, so that queries on other threads keep theirs."""

    def __init__(self):
        self.tables: list[tuple[SparkSession, str]] = []
        _every.append(self.tables)


_every: list[list[tuple[SparkSession, str]]] = []
_written = _Written()


def durable(df: DataFrame) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, outlives executors, keeps column pruning."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def mark() -> int:
    """How many tables durable() holds on this thread; for drop_scratch(since)."""
    return len(_written.tables)


def drop_scratch(since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that durable() wrote on this thread since the mark, but for those kept. Whatever reads them must be stored before."""
    paths, tables = {getattr(df, "_scratch_path", None) for df in keep}, _written.tables
    gone = [x for x in tables[since:] if x[1] not in paths]
    tables[since:] = [x for x in tables[since:] if x[1] in paths]
    _delete(gone)


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended: nothing is left to ask
            return


@atexit.register
def _at_exit() -> None:
    for tables in _every:
        _delete(tables)
