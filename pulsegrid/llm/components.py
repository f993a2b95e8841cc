"""Connected components of an edge table: alternating large-star and small-star rounds.

Every round is two joins and two aggregations over edges; nothing is gathered in one task, and each round is
written to the shared folder, so the lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffled, written


def _stars(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    return edges.join(shuffled(lowest), "u")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge; root is the smallest node of its component. Self-loops and
    edges with a null end are ignored; an empty table gives an empty result."""
    x, y = F.col(a), F.col(b)
    now = edges.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    now = written(now, "cc")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        # large star: the larger neighbours of a node go to the smallest node of its neighbourhood
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(shuffled(lowest), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(least), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        now = written(small, "cc")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError(f"no fixed point in {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
