"""Where intermediate results go: always a folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables written so far: session, path and the tag they were written under.
_written: list[tuple[SparkSession, str, str]] = []
_tag = ""


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where the setting is absent, a temporary one, but only if all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="veldspar-checkpoint-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow frame by a reliable checkpoint; Spark deletes it with the frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write a wide frame as Parquet in the shared folder and read it again.

    Columnar and compressed, so it suits frames that hold texts or signatures, and the
    size that Spark knows of it is its true one. Removed when the process ends, or by ``drop``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/veldspar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path, _tag))
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Arrow batches hold fewer rows than the default, as texts can be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


@contextlib.contextmanager
def tagged(tag: str) -> Iterator[None]:
    """Tables written meanwhile bear ``tag``."""
    global _tag
    before, _tag = _tag, tag
    try:
        yield
    finally:
        _tag = before


def drop(tag: str) -> None:
    """Delete the tables that bear ``tag``; what was computed from them must have been written by now."""
    for entry in [e for e in _written if e[2] == tag]:
        _delete(*entry[:2])
        _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path, _ in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended already
            return
