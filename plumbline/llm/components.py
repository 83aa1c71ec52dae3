"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, written


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the smallest node names a component.

    Every round hangs the larger neighbours of each node on its smallest one, then the
    smaller ones likewise, until nothing moves. A round only takes minima by node and
    joins them back, so a node with very many neighbours is folded inside each task, and
    its edges can be split between tasks. Rounds are written to the scratch folder.
    Edges with a null end and loops count nothing. The result reads from ``scratch``, if given.
    """
    keep = scratch.written if scratch else written
    pair = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = keep(pair.where("a > b").distinct(), "edges")
    before = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = state.union(state.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        state = keep(small.where("a > b").distinct(), "edges")
    members = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(state.select("b", "b").distinct())
