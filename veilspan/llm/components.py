"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, write_table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node reachable.

    Alternates large-star and small-star steps: a step sends each node's neighbours to the smallest of them, so long chains
    shorten to stars in a logarithmic number of rounds. Each round is written to the shared folder and the one before goes;
    only a row count and a checksum reach the driver. The smallest neighbour is a partial aggregate, so a node with very many
    neighbours isn't gathered in one task; the joins back are skew-split by Spark. Empty input gives empty output; loops and
    repeated edges change nothing.
    """
    now = write_table(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = _state(now)
    while seen["n"]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = write_table(
            small.select(F.col("a"), F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(),
            "edges",
        )
        is_now = _state(after)
        drop_table(now)
        now = after
        if is_now == seen:
            break
        seen = is_now
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
