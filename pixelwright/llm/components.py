"""Connected components of an edge table by alternating stars, without collecting any part of it.

large star: every larger neighbour of a node is linked to the least of its neighbourhood;
small star: every smaller neighbour, and the node, is linked to the least smaller neighbour.
The two steps keep the components, and end in one star around the least node of each. Each
round is written to the shared folder, so the lineage stays short and lost executors cost only
one round. Minima are pre-aggregated before the shuffle; a hub's rows are split by the
planner's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_files, materialize

MOST_ROUNDS = 64


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # edges run from the larger node a to the smaller b
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        least = least.select("a", F.least("a", "m").alias("m"))
        linked = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = both.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        linked = linked.unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, any direction). Returns node, root: the least node of its component; nodes in no edge are absent."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        after = materialize(_star(_star(now, large=True), large=False), "edges")
        drop_files(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
