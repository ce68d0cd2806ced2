"""Durable cuts of the lineage, in the folder that all executors share.

A table written to the folder named by ``spark.checkpoint.dir`` is seen by
every executor, so a lost one costs a re-run of its tasks and nothing else.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}
_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session gets a temporary one; on a cluster,
    whose machines would each write to their own disk, that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="textmill-"))
    return _fallback[0]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends at the latest."""
    path = f"{shared_dir(spark)}/textmill/{label}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a durable cut of the lineage."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame, label: str) -> DataFrame:
    """``written``, after which the shuffle files behind the table go at once instead of whenever the driver collects garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return written(df, label)
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a work path through Hadoop's file system, wherever it lies."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _written.pop(path, None)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing reads any more."""
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for path in [p for p in _written if p.rsplit("/", 1)[-1] in folders]:
        remove(df.sparkSession, path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            remove(spark, path)
        except Exception:  # that session is gone; others may still be there
            continue
