"""As-of join: to every row the last observation of its key that is not later.

Both sides are sorted by key and time in one range sort, which splits a hot key
over as many tasks as its rows need. Each task carries the last observation
along; what a task cannot know, the observation that was last before its first
row, comes from one row that every task leaves behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.operators.cuts import written


def _filled(rows: pa.Table, before: pa.Table | None) -> tuple[pa.Table, np.ndarray, pa.Table]:
    """``rows``, sorted, with the row of the last observation of the same key (-1: none), and the last row of all for what follows."""
    rows = rows if before is None else pa.concat_tables([before, rows])
    key = rows.column("key").combine_chunks().dictionary_encode()
    code = np.asarray(key.indices)
    at = np.arange(rows.num_rows)
    starts = np.ones(rows.num_rows, dtype=bool)
    starts[1:] = code[1:] != code[:-1]
    begin = np.maximum.accumulate(np.where(starts, at, 0))
    last = np.maximum.accumulate(np.where(rows.column("observed").to_numpy(), at, -1))
    return rows, np.where(last >= begin, last, -1), rows.slice(rows.num_rows - 1)


def asof_join(rows: DataFrame, observations: DataFrame, key: str, time: str, other_key: str, other_time: str, tie: str | None = None, out: str = "last") -> DataFrame:
    """``rows`` with ``out``, a struct of the last of ``observations`` with the same key and no later time; null if there is none.

    Of observations at one time the greatest ``tie`` is last. Rows without key
    or time find none, and such observations are found by none. Every row comes
    back once. Both keys, and both times, are of one type.
    """
    spark = rows.sparkSession
    seen = observations.where(F.col(other_key).isNotNull() & F.col(other_time).isNotNull())
    value, row = F.struct(*[F.col(c) for c in observations.columns]), F.struct(*[F.col(c) for c in rows.columns])
    right = seen.select(F.col(other_key).alias("key"), F.col(other_time).alias("time"), F.lit(True).alias("observed"), (F.col(tie) if tie else F.lit(0)).alias("tie"), value.alias("value"))
    asked = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    left = asked.select(F.col(key).alias("key"), F.col(time).alias("time"), F.lit(False).alias("observed"), row.alias("row"))
    both = right.unionByName(left, allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in both.schema.fields}
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("edge", T.BooleanType()), T.StructField("key", kinds["key"]), T.StructField("row", kinds["row"]), T.StructField("value", kinds["value"])])

    def carry(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), None
        for batch in it:
            if not batch.num_rows:
                continue
            rows, last, end = _filled(pa.Table.from_batches([batch]), before)
            found = rows.column("value").combine_chunks().take(pa.array(last, mask=last < 0))
            asks = np.flatnonzero(~rows.column("observed").to_numpy() & (np.arange(rows.num_rows) >= (0 if before is None else 1)))
            told = pa.table({"part": np.full(len(asks), task, np.int32), "edge": np.zeros(len(asks), bool), "key": rows.column("key").take(asks), "row": rows.column("row").take(asks), "value": found.take(pa.array(asks))})
            yield from told.combine_chunks().to_batches()
            # the next batch sees the last row as an observation of what was last by then
            columns = {c: end.column(c) for c in end.column_names} | {"value": pa.chunked_array([found.slice(len(found) - 1)]), "observed": pa.chunked_array([pa.array([bool(last[-1] >= 0)])])}
            before = pa.table(columns, schema=end.schema)
        if before is not None:
            yield from pa.table({"part": np.array([task], np.int32), "edge": np.array([True]), "key": before.column("key"), "row": pa.nulls(1, before.schema.field("row").type), "value": before.column("value")}).combine_chunks().to_batches()

    ordered = both.orderBy("key", "time", F.col("observed").desc(), "tie")
    told = written(ordered.select("key", "observed", "row", "value").mapInArrow(carry, schema), "asof")
    carried, now = [], None
    for edge in told.where("edge").orderBy("part").collect():  # one row a task
        if now is not None:
            carried.append((edge.part, now.key, now.value))
        if edge.value is not None or now is None or now.key != edge.key:
            now = edge if edge.value is not None else None
    before = spark.createDataFrame(carried, T.StructType([schema["part"], schema["key"], T.StructField("earlier", kinds["value"])]))
    joined = told.where(~F.col("edge")).join(F.broadcast(before), ["part", "key"], "left")
    found = joined.select("row.*", F.coalesce("value", "earlier").alias(out))
    return found.unionByName(rows.where(F.col(key).isNull() | F.col(time).isNull()).withColumn(out, F.lit(None).cast(kinds["value"])))
