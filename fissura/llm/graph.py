"""Connected components of link tables by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fissura.llm.shared import stored

MAX_ROUNDS = 100


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def components(links: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``links (a long, b long)``; the smallest id names a component.

    Each round hangs the larger neighbours of a vertex below its smallest one,
    then the smaller ones. A round is two aggregations and joins over at most as
    many links as came in, written to shared storage; no neighbour list is ever
    gathered, and the rounds grow with the logarithm of a component's size.
    """
    edges = stored(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _smallest(both).select("a", F.least("a", "low").alias("low"))
        large = (
            both.filter(F.col("b") > F.col("a"))
            .join(low, "a")
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        large = stored(large, "stars")
        low = _smallest(large)
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter(F.col("a") != F.col("b"))
            .distinct()
        )
        edges = stored(small, "stars")
        now = edges.agg(
            F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0)),
            F.count_distinct("a"),
        ).first()
        if now[0] == now[2] and tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
