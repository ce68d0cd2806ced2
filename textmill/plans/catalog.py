"""Where registered queries and the SQL that checks them are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The fixed question of the ranking queries: words of the corpus in several languages.
QUESTION = "thering enten pour leaux considerations of worthless verkeit"


def query(oracle: str | None = None):
    """Decorator: register a function of (session, folder) under its own name, with its SQL if there is any."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return wrap


#: Rows of an Arrow batch, unless the session has its own number: texts are long, and a worker holds a batch and what is made of it.
BATCH, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    if spark.conf.get(BATCH_KEY, "10000") == "10000":  # Spark's default
        spark.conf.set(BATCH_KEY, str(BATCH))
    return spark.read.parquet(f"{d}/{name}.parquet")
