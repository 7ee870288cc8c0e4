"""Connected components of a links table: least labels spread over links, with jumps to the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def jumped(parts: DataFrame, tables: Scratch) -> DataFrame:
    """(u, v): nodes with a smaller parent v, moved up to the root by doubling; parts has one row a node."""
    while True:
        up = parts.join(parts.select(F.col("u").alias("v"), F.col("v").alias("w")), "v", "left")
        new = tables.save(up.select("u", F.coalesce("w", "v").alias("v"), F.col("w").isNotNull().alias("moved")))
        tables.drop(parts)
        if new.where("moved").isEmpty():
            return new.select("u", "v")
        parts = new.select("u", "v")
        parts._scratch_path = new._scratch_path


def connected(links: DataFrame, tables: Scratch) -> DataFrame:
    """(u, v): every node of the links with the least node of its component.

    A round takes each node's least label among itself and its neighbours (a map-side minimum over a plain sort-merge
    join of written tables, so a node with very many neighbours is split), then that label's own label. It ends when
    no label has changed.
    """
    both = tables.save(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v"))
    labels = tables.save(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("v")))
    while True:
        known = labels.select(F.col("u").alias("v"), F.col("v").alias("label"))
        seen = both.join(known, "v").select("u", "label").union(labels.select("u", F.col("v").alias("label")))
        least = seen.groupBy("u").agg(F.min("label").alias("v"), F.max("label").alias("most"))
        least = least.join(known.select("v", F.col("label").alias("up")), "v").select("u", F.col("up").alias("v"), (F.col("most") > F.col("up")).alias("open"))
        new = tables.save(least)
        tables.drop(labels)
        if new.where("open").isEmpty():  # every neighbour had the same label
            tables.drop(both)
            return new.select("u", "v")
        labels = new.select("u", "v")
        labels._scratch_path = new._scratch_path
