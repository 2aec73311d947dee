"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.session import cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select("m", F.col("b")).where("m <> b").distinct().toDF("a", "b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select("m", F.col("v").alias("x"))
    return moved.union(least.select("m", F.col("u").alias("x"))).distinct().toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches, for nodes that are not roots.

    Every round groups by node and keeps a minimum; a node with very many neighbours is combined on the map side and
    split by the join.  Rounds are written to the shared folder, so a lost executor costs no more than its tasks.
    Loops (a = b) are ignored; repeated edges and no edges are fine.
    """
    current = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    for _ in range(MAX_ROUNDS):
        count, mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not count or state == (count, mark):
            break
        state = (count, mark)
        current = cut(_small_star(_large_star(current)))
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return current.select(F.col("b").alias("node"), F.col("a").alias("root"))
