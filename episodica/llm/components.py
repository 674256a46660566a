"""Connected components by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.session import ensure_checkpoint_dir


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node that each node reaches.

    Large-star and small-star rounds take about log(n) rounds; each is cut by a
    checkpoint in the shared folder. Minima are pre-aggregated before the
    shuffle, so a node with very many neighbours is one row per task there.
    Nodes without an edge to another node do not appear; nulls and loops are dropped.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    pairs = edges.select(
        F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")
    ).where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct().checkpoint()
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # without the hint every round would leave its minima in the driver's memory as a broadcast
        large = both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # every node now keeps its smaller neighbours only; tie them to the smallest of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low.hint("merge"), "u")
        tied = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        pairs = tied.where("u != v").distinct().checkpoint()
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
