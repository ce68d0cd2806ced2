"""Exact deduplication by a stateful stream.

Rows reduced to (digest, length, identifier, content locator) flow through a
Structured Streaming aggregation keyed by digest. Its state lives on disk
(RocksDB state store, snapshots in the shared folder), has no watermark and so
never expires; rows of one digest are combined before the shuffle, so a hot
text costs one row per task. Each micro-batch appends the groups it changed,
under its batch id, to a table in the shared folder: a re-run batch overwrites
its own folder only.

On a hit the full normalised texts of the digest are compared, by a batch pass
over the content behind the locators once the stream has drained; rows whose
digest agrees while their bytes do not are grouped anew by the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import fresh_name, join_hot, located, locator, remove, work_path, written

WHITE = " \t\n\x0b\x0c\r"
#: State on disk; many small stores neither preallocate their logs nor upload whole snapshots each batch.
_ROCKS = "spark.sql.streaming.stateStore.rocksdb"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_ROCKS}.allowFAllocate": "false",
    f"{_ROCKS}.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """The text without spaces and the control characters 09 to 0D; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _best() -> Column:
    """Most code points, then the smallest identifier (of any type with an order; null last), then the first locator."""
    return F.min(F.struct("minus_cp", "no_id", "doc_id", "at"))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful core: per digest the row to keep and the row count. ``stream`` may be a stream or a table."""
    return stream.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))


def run_stream(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain ``stream`` through the keyed state; changed groups land in ``out``, by batch."""
    spark = stream.sparkSession

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = keyed_state(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def groups_of(spark: SparkSession, out: str) -> DataFrame:
    """The final state: of each digest, what its last batch said."""
    said = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = said.groupBy("digest").agg(F.max_by(F.struct("best", "n"), F.col("batch").cast("long")).alias("last"))
    return last.select("digest", "last.best", "last.n")


def among(rows: DataFrame, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows whose digest may be among ``keys``, told map-side by a broadcast bitmap of ``bits`` bits (8 MB) at most.

    Rows of other digests can pass when their hash bit is shared; none of the
    wanted ones is lost.
    """
    spot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    maps = keys.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("map"))
    pos = F.bitmap_bit_position(spot)
    byte = F.conv(F.hex(F.substring("map", F.shiftright(pos, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = F.expr("1").cast("int") == F.call_function("getbit", byte, pos.bitwiseAND(F.lit(7)).cast("int")).cast("int")
    return rows.withColumn("bucket", F.bitmap_bucket_number(spot)).join(F.broadcast(maps), "bucket").where(kept).drop("bucket", "map")


def dedup_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    max_bytes_per_trigger: int = 64 << 30,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, scan)``: the decision for every row, with its locator ``at``, and the scan it refers to.

    ``digest`` may be any function of the normalised text: equality of whole
    texts is checked, so even a weak digest gives right groups.
    """
    spark = docs.sparkSession
    scan = located(docs)
    base = scan.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), locator().alias("at"))
    norm = normalised(F.col("text"))
    narrow = written(
        base.select(
            "doc_id",
            F.col("doc_id").isNull().alias("no_id"),
            digest(norm).alias("digest"),
            F.sha2(norm, 256).alias("text_sha256"),
            (-F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("minus_cp"),
            "at",
        ),
        "narrow",
    )
    rows_path = [p for p in narrow.inputFiles()][:1]
    out, checkpoint = work_path(spark, "groups"), work_path(spark, "stream")
    if rows_path:
        folder = rows_path[0].rsplit("/", 1)[0]
        stream = spark.readStream.schema(narrow.schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(folder)
        run_stream(stream, out, checkpoint)
        groups = written(groups_of(spark, out), "digests")
        remove(spark, checkpoint)
        remove(spark, out)
    else:
        groups = keyed_state(narrow)
    texts = base.select(digest(norm).alias("digest"), norm.alias("norm"), "at")
    # full bytes on hits: a digest is sound when the least and the greatest of its texts are the same
    wrong = written(
        among(texts, groups.where(F.col("n") > 1))
        .groupBy("digest")
        .agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("digest"),
        "collisions",
    )
    joined = join_hot(narrow, groups.withColumn("of", F.col("n")), ["digest"], "of").select("doc_id", "digest", "text_sha256", "at", "best", "n")
    if wrong.isEmpty():
        rows = joined
    else:
        torn = narrow.join(wrong, "digest", "left_semi").join(texts.select("at", "norm"), "at")
        anew = torn.groupBy("norm").agg(_best().alias("best"), F.count(F.lit(1)).alias("n"))
        rows = joined.join(wrong, "digest", "left_anti").unionByName(
            torn.join(anew, "norm").select("doc_id", "digest", "text_sha256", "at", "best", "n")
        )
    decided = rows.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("at") == F.col("best.at")).alias("kept"),
        "text_sha256",
        "at",
    )
    return decided, scan


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``, dropped ones too.

    Texts are equal when identical after deleting white space; the row with the
    most code points in its original text stays, then the smallest id (ties).
    Ids may be of any type that has an order; a null id loses against any other.
    Null texts are empty texts; whole texts count, however long. Repeated rows
    (same id, same text) count each, and one of them stays. An empty table
    gives no rows; other columns, whatever their names, play no part.
    """
    rows, _ = dedup_rows(docs, **options)
    return rows.drop("at")


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns unchanged, clashing names included.

    Nulls, ties, repeated rows and long texts as in ``exact_duplicates``: one
    null or blank text stays of all; an empty table gives none back.
    """
    rows, scan = dedup_rows(docs, **options)
    at = fresh_name(scan, "kept_at")
    gone = rows.where(~F.col("kept")).select(F.col("at").alias(at))
    return scan.withColumn(at, locator()).join(gone, at, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
