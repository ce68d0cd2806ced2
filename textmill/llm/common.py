"""Shared plumbing of the training-data operators: numbering, skew-proof joins, locators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from textmill.operators.cuts import dropped, remove, work_path, written  # noqa: F401 - the operators take them from here

#: A key with more than this part of all rows is hot; there are at most as many hot keys.
HOT = 2048


def narrow_batches(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, in order; other columns, whatever their names, play no part."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def fresh_name(df: DataFrame, wish: str) -> str:
    """``wish``, or a variant that ``df`` does not have as a column yet."""
    taken = {c.lower() for c in df.columns}
    name = wish
    while name.lower() in taken:
        name = "_" + name
    return name


def with_offsets(df: DataFrame, group: list[str], order: list[str], out: str, size: Column | None = None, buckets: int | None = None) -> DataFrame:
    """Append, per row, the sum of ``size`` (1 without it) over the rows before it in its group, gathering no group in one task.

    Rows are dealt to ``buckets`` hash buckets by the order key; only the sums
    per (group, bucket) are added up in sequence, and each bucket adds up its
    own rows. Order inside a group: bucket, then ``order``. Rows that agree in
    all of ``order`` are interchangeable.
    """
    buckets = buckets or shuffle_partitions(df.sparkSession)
    bucket, base, mine = fresh_name(df, "gi_bucket"), fresh_name(df, "gi_base"), fresh_name(df, "gi_size")
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn(mine, F.lit(1) if size is None else size)
    sums = dealt.groupBy(*group, bucket).agg(F.sum(mine).alias(base))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    theirs = {c: fresh_name(df, f"gi_of{i}") for i, c in enumerate([*group, bucket])}
    bases = sums.select(*[F.col(c).alias(theirs[c]) for c in theirs], F.coalesce(F.sum(base).over(before), F.lit(0)).alias(base))
    cond = reduce(and_, [F.col(c).eqNullSafe(F.col(t)) for c, t in theirs.items()])
    joined = dealt.join(bases, cond).drop(*theirs.values())
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, (F.col(base) + F.sum(mine).over(inside) - F.col(mine)).cast("long")).drop(bucket, base, mine)


def with_gapless_index(df: DataFrame, group: list[str], order: list[str], out: str, buckets: int | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ...: ``with_offsets`` of ones."""
    return with_offsets(df, group, order, out, buckets=buckets)


def join_hot(rows: DataFrame, told: DataFrame, key: list[str], n: str) -> DataFrame:
    """``rows`` inner-joined with ``told``, whose ``key`` is unique and which counts the rows of each key in ``n``.

    A key that holds more than 1/HOT of all rows is told by a broadcast of such
    keys, of which there are HOT at most; the others meet in a shuffle, where
    none is hot any more. ``rows`` and ``told`` should be tables, as both are read twice.
    """
    total = told.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(told.where(F.col(n) * HOT > total).drop(n))
    cold = told.where(F.col(n) * HOT <= total).drop(n)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))


def released(df: DataFrame, label: str) -> DataFrame:
    """``written``, after which the shuffle files behind the table go at once instead of whenever the driver collects garbage."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return written(df, label)
    finally:
        spark.conf.set(key, before)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` as a plain file scan, so that each row has a durable locator.

    A scan (possibly filtered or projected) is kept; anything else is written
    to the shared folder first.
    """
    stack, kinds = [docs._jdf.queryExecution().analyzed()], set()
    while stack:
        node = stack.pop()
        kinds.add(node.nodeName().split(" ")[0])
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    if kinds <= {"Relation", "LogicalRelation", "Project", "Filter", "SubqueryAlias"} and kinds & {"Relation", "LogicalRelation"}:
        try:
            docs.select(F.col("_metadata.row_index"))
            return docs
        except Exception:  # a scan without row indexes (not Parquet)
            pass
    return written(docs, "located")


LOCATOR = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])


def locator() -> Column:
    """(file, row index) of a row of a Parquet scan: where its content lies."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
