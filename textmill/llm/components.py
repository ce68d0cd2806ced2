"""Connected components of a link table, never gathered on the driver.

Alternating large-star and small-star rounds: each round rewires every node to
the smallest node it can see. All rounds are joins and aggregations; each is
written to the shared folder, so the lineage stays one round deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import dropped, written


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has a link; component = its smallest reachable node.

    Links may repeat, point either way or be loops; nodes with a loop only get
    no row. Nulls on either side are ignored. An empty table gives no rows.
    """
    edges = (
        links.select(F.greatest(F.col(a), F.col(b)).alias("u"), F.least(F.col(a), F.col(b)).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges = written(edges, "links")
    last = _fingerprint(edges)
    for _ in range(max_rounds):
        if not last[0]:
            break
        # large star: every larger neighbour of u moves to the least node that u sees
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(before)
        now = _fingerprint(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
