"""Incremental pair counts over a stream of touches: optional, equal to the batch result once windows close.

A basket (user and window) closes when the watermark passes its end; its pairs are then final,
and a basket never counts twice, so sums of the emitted rows are the batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closed_baskets(touches: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """start, owner, items: distinct items of each owner and window; touches: ts, owner, item."""
    t = touches.withWatermark("ts", delay) if touches.isStreaming else touches
    g = t.groupBy(F.window("ts", window).alias("w"), "owner").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return g.select(F.col("w.start").alias("start"), "owner", "items")


def basket_pairs(baskets: DataFrame, max_items: int = 50) -> DataFrame:
    """start, owner, a < b of baskets of at most ``max_items`` items, as the corpus filter has it."""
    b = baskets.where((F.size("items") > 1) & (F.size("items") <= max_items))
    first = b.select("start", "owner", "items", F.posexplode("items").alias("i", "a"))
    return first.select("start", "owner", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
