"""Sinks and stores: artifacts behind a no-write gate, tolerant JSON, vector collections, local files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from textmill.functions.vectors import cosine, dot, squared_distance
from textmill.sources.bytes import extract


class Artifacts:
    """Writes of one run. With ``no_write`` nothing reaches a file system; the tables are held, the last per path."""

    def __init__(self, no_write: bool = False):
        self.no_write = no_write
        self.held: dict[str, DataFrame] = {}

    def write(self, path: str, df: DataFrame, fmt: str = "parquet") -> str:
        if self.no_write:
            self.held[path] = df
        else:
            df.write.mode("overwrite").format(fmt).save(path)
        return path

    def take(self) -> dict[str, DataFrame]:
        held, self.held = self.held, {}
        return held


def last_per_path(artifacts: DataFrame) -> DataFrame:
    """Of ``(path, seq, content)`` the content written last to each path."""
    return artifacts.groupBy("path").agg(F.max_by("content", "seq").alias("content"))


def parsed_json(c: Column | str) -> Column:
    """A VARIANT, null for what does not parse: absent and malformed are the same."""
    return F.try_parse_json(F.col(c) if isinstance(c, str) else c)


def local_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files to text by the router of ``extract``: content decides where the name does not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.lower(F.decode(F.substring("content", F.lit(1), F.lit(200)), "ISO-8859-1"))
    kind = F.when(head.rlike(r"^\s*<(!doctype|html|head|body)\b"), "text/html").otherwise("text/plain")
    return extract(files.select(F.col("path").alias("url"), F.lit(200).alias("status"), kind.alias("content_type"), F.col("content").alias("bytes"))).drop("bytes")


def observed(df: DataFrame, name: str = "fetch", text: str = "text", cached: str = "cached") -> tuple[DataFrame, Observation]:
    """``df`` with a count of rows, bytes and cached rows on the side, filled in by the first action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("bytes"), F.count_if(F.col(cached)).alias("cached")), seen


# -- vectors ------------------------------------------------------------------------------------

#: Larger is nearer for all of them.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    "Cosine": cosine,
    "Dot": dot,
    "Euclid": lambda a, b: -F.sqrt(squared_distance(a, b)),
}


class Collection:
    """A vector collection ``(id, vector, payload)`` as a Parquet folder: create, upsert by id, search, drop.

    An upsert writes a new version next to the old one and switches to it, so
    readers of the old version are not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str, size: int, distance: str = "Cosine"):
        if distance not in DISTANCES:
            raise ValueError(f"unknown distance {distance}")
        self.spark, self.path, self.size, self.distance, self.version = spark, path.rstrip("/"), size, distance, -1

    def read(self) -> DataFrame:
        if self.version < 0:
            return self.spark.createDataFrame([], "id string, vector array<float>, payload string")
        return self.spark.read.parquet(f"{self.path}/v{self.version}")

    def upsert(self, points: DataFrame) -> None:
        """New points replace those of their id; of repeated ids the largest payload counts. A vector of another size is an error."""
        wrong = points.where((F.size("vector") != self.size) | F.col("vector").isNull())
        if not wrong.isEmpty():
            raise ValueError(f"every vector needs {self.size} numbers")
        new = points.groupBy("id").agg(F.max_by(F.struct("vector", "payload"), F.coalesce("payload", F.lit(""))).alias("p")).select("id", "p.vector", "p.payload")
        self.read().join(new, "id", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1

    def search(self, vector: list[float], limit: int = 10, where: Column | None = None) -> DataFrame:
        """The nearest points, ``id, payload, score``; ties by id."""
        points = self.read() if where is None else self.read().where(where)
        asked = F.array(*[F.lit(float(x)) for x in vector])
        return points.select("id", "payload", DISTANCES[self.distance](F.col("vector"), asked).alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)

    def drop(self) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.version = -1


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 16, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, vector`` by a model that maps a batch of texts to vectors, called once per ``batch`` rows; results are keyed by id, never by place."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                vectors = model(part[text_col].fillna("").tolist())
                if len(vectors) != len(part):
                    raise ValueError("the model returned another number of vectors")
                yield pd.DataFrame({id_col: part[id_col].tolist(), "vector": [list(map(float, v)) for v in vectors]})

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, vector array<float>")


def rescued(responses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Dead links with the text of their newest archived snapshot ``(url, snapshot_url, timestamp, text)``; walls are no rescue."""
    from textmill.functions.markup import junk_reason
    from textmill.sources.responses import is_dead_link

    good = snapshots.where((F.trim(F.coalesce("text", F.lit(""))) != "") & junk_reason("text").isNull())
    newest = good.groupBy("url").agg(F.max_by(F.struct("text", "snapshot_url", "timestamp"), "timestamp").alias("_s"))
    joined = responses.join(newest, "url", "left")
    dead = is_dead_link("status")
    return joined.select(
        *[c for c in responses.columns if c != "text"],
        F.when(dead, F.col("_s.text")).otherwise(F.col("text")).alias("text"),
        F.when(dead, F.col("_s.snapshot_url")).alias("snapshot_url"),
    )
