"""Coincidence of two streams in a closed time window, and the keyed optical flow made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EventError, floor_div, time_ns

#: Windows in a time bucket; an event is copied to the next bucket if its window reaches there.
WINDOWS_A_BUCKET = 64


def fuse(a: DataFrame, b: DataFrame, window="50 ms", min_count: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """One event for each input event at which both streams have one in [t - window, t], and min_count together.

    Ties in time: a before b, then by seq. Counts are differences of running sums: rows up to the event, less rows
    before the window. Time is cut into buckets with a halo, so no task gets the whole stream.
    """
    win = time_ns(window)
    if win <= 0:
        raise EventError("fuse", "window must be positive")
    width = win * WINDOWS_A_BUCKET
    cols = [*keys, "t_ns", "seq"]
    both = a.select(*cols, F.lit(0).alias("src")).union(b.select(*cols, F.lit(1).alias("src"))).where("t_ns is not null")
    both = both.withColumn("own", floor_div("t_ns", width)).withColumn("reach", floor_div(f"(t_ns + {win}L)", width))
    spread = both.withColumn("bucket", F.explode(F.sequence("own", "reach")))
    part = Window.partitionBy(*keys, "bucket")
    upto = part.orderBy("t_ns", "src", "seq").rowsBetween(Window.unboundedPreceding, 0)
    gone = part.orderBy("t_ns").rangeBetween(Window.unboundedPreceding, -(win + 1))
    one = {s: F.when(F.col("src") == s, 1).otherwise(0) for s in (0, 1)}
    for s, name in ((0, "n_a"), (1, "n_b")):
        spread = spread.withColumn(name, F.sum(one[s]).over(upto) - F.coalesce(F.sum(one[s]).over(gone), F.lit(0)))
    hit = spread.where(f"bucket = own and n_a > 0 and n_b > 0 and n_a + n_b >= {int(min_count)}")
    channel = [] if "ch" in keys else [F.lit(0).alias("ch")]
    return hit.select(*keys, "t_ns", (F.col("seq") * 2 + F.col("src")).alias("seq"), *channel, F.lit(1.0).alias("val"), F.lit("coincidence").alias("unit"))


def optical_flow(events: DataFrame, width: int, height: int, window="5 ms", lag="2 ms", edge_lag="200 us", min_count: int = 2) -> DataFrame:
    """Per pixel and polarity, coincidence of events with their neighbours' (x - 1, x + 1) later copies; each place once."""
    if width <= 0 or height <= 0 or min_count <= 0 or min(time_ns(lag), time_ns(edge_lag)) < 0:
        raise EventError("vision", "sizes and min_count must be positive, delays not negative")
    seen = events.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & F.col("polarity").between(0, 1))
    copies = seen.withColumn("x", F.explode(F.array(F.col("x") - 1, F.col("x") + 1))).where(F.col("x").between(0, width - 1))
    copies = copies.withColumn("t_ns", F.col("t_ns") + time_ns(lag) + time_ns(edge_lag))
    out = fuse(seen, copies, window, min_count, keys=("x", "y", "polarity"))
    return out.select("t_ns", "x", "y", "polarity", "val").distinct()
