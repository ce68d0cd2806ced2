"""Folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the identifiers that learning never sees; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, parts: int = 2) -> DataFrame:
    """``text, y, part`` of at most ``rows`` labels outside the held-out fold, the least by hash of the id.

    ``part`` (0 to ``parts`` - 1) splits the sample by another hash. The sample's
    bound is what makes it a broadcast. A label teaches one row: of several
    documents of its id, the least text. Repeated labels and equal texts of one
    label count once, so that copies neither weigh more nor meet themselves in
    another part.
    """
    picked = (
        labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("label_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("label_id")))
        .distinct()
        .orderBy(F.xxhash64("label_id"), "label_id", "y")
        .limit(rows)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("label_id")), F.lit(parts)).cast("int")
    told = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).groupBy("label_id", "y").agg(F.min("text").alias("text"))
    told = told.groupBy("text", "y").agg(F.min("label_id").alias("label_id"))
    return told.select("text", "y", part.alias("part"))
