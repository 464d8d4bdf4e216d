"""Connected components of an edge table, by alternating large and small stars.

Every round writes its edges below ``spark.checkpoint.dir``; the number of edges never grows. A
hub's neighbours are only reduced to a minimum by a grouped aggregation (combined before the
shuffle) and joined with it, which adaptive execution can split; they are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import discard, keep

ROUNDS = 60


def _star(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v -> one large star and one small star."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u != v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over the edges (a, b), for nodes with an edge.

    Edges may repeat or be loops; those with a null end are left out. Nodes without a neighbour
    other than themselves are not in the result.
    """
    spark = edges.sparkSession
    ordered = edges.where("a is not null and b is not null and a != b")
    ordered = ordered.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, path = keep(ordered, label)
    before = _mark(now)
    for _ in range(ROUNDS):
        if before[0] == 0:
            break
        following, new_path = keep(_star(now), label)
        discard(spark, path)
        now, path = following, new_path
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle within {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h
