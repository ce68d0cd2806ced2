"""Global ranks without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textmill.operators.cuts import written


def ranked(df: DataFrame, order: Sequence[Column], out: str, start: int = 1) -> DataFrame:
    """Append the 1-based place of each row in ``order``, whose last key must be unique.

    A range sort deals the rows to ordered partitions; each numbers its own rows
    on top of the counts of those before it. The counts, one per partition, are
    all that reaches the driver. The sorted rows are cut in the shared folder.
    """
    ordered = written(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_no", F.monotonically_increasing_id()), "ranked")
    counts = sorted((r[0], r[1], r[2]) for r in ordered.groupBy("_part").agg(F.count(F.lit(1)), F.min("_no")).collect())
    bases, total = [], start
    for part, n, first in counts:
        bases.append((part, total - first))
        total += n
    shift = df.sparkSession.createDataFrame(bases, "_part int, _shift long")
    return ordered.join(F.broadcast(shift), "_part").withColumn(out, F.col("_no") + F.col("_shift")).drop("_part", "_no", "_shift")


def to_batches(df: DataFrame, size: int, order: Sequence[Column], group: Sequence[str] = (), out: str = "batch") -> DataFrame:
    """Append the number, from 0, of the batch of ``size`` rows that a row falls in, in ``order``, within each group.

    A size below 1 counts as 1. Without a group the places come from ``ranked``,
    and the last key of ``order`` must be unique.
    """
    width = max(1, int(size))
    if group:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
        return df.withColumn(out, F.floor(place / width).cast("bigint"))
    return ranked(df, order, out, 0).withColumn(out, F.floor(F.col(out) / width).cast("bigint"))
