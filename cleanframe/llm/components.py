"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cls, comp) for every vertex of the edges (a, b): comp is the smallest vertex of its component.

    Each turn points every vertex and its neighbours to the smallest of them, first those above it, then those below it,
    until nothing changes. Minima are combined before the shuffle, so a vertex with many edges is no hot key, and the
    edges of a turn are written, so a lost executor redoes one turn only. Tables of earlier turns are deleted.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    before, turn = None, 0
    while True:
        # Larger neighbours of u go to the smallest vertex around u.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(both.join(low, "u").filter("m < u and v < u").select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        large = scratch.keep(large, f"{name}-large{turn}")
        # Smaller neighbours of u, and u, go to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        edges = scratch.keep(small, f"{name}-small{turn}")
        scratch.drop(f"{name}-large{turn}", f"{name}-small{turn - 1}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, turn = now, turn + 1
    labels = scratch.keep(edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("cls"), "comp").union(
        edges.select(F.col("v").alias("cls"), F.col("v").alias("comp")).distinct()).groupBy("cls").agg(F.min("comp").alias("comp")), name)
    scratch.drop(f"{name}-small{turn}")
    return labels
