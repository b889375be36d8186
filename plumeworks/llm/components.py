"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, saved


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of it and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (its least node) for each node of edges (a, b), both long.

    Loops, repeated and reversed edges are allowed; edges with a null end are
    ignored; no edges give no rows. The rows are read from a table on the shared folder.
    """
    e = saved(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        e, old = saved(small_star(large_star(e)), "edges"), e
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = saved(e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", F.col("a")).distinct()), "parts")
    discard(e)
    return found
