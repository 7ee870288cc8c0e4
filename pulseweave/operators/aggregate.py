"""Buckets, order statistics, telemetry, profiles and rates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EventError, floor_div, time_ns
from ..sources.shared import settled


def _positive(dt) -> int:
    width = time_ns(dt)
    if width <= 0:
        raise EventError("bucket", "dt must be positive")
    return width


def bucket_sum(events: DataFrame, dt) -> DataFrame:
    """Sums of the steps of dt of a stream in time order, given at the step's end."""
    width = _positive(dt)
    out = events.groupBy((floor_div("t_ns", width) * width + width).alias("t_ns")).agg(F.sum("val").alias("val"), F.min("seq").alias("seq"))
    return out.select("t_ns", "seq", F.lit(0).alias("ch"), "val", F.lit("bucket").alias("unit"))


def bucket_runs(events: DataFrame, dt, chunk: int = 1 << 20) -> DataFrame:
    """Sums of unbroken runs of one step in arrival order: a step may come up several times.

    Runs are numbered without a global window: arrival is cut into chunks, each chunk knows the step before it by a join
    of chunk ends, and run starts are counted by chunk before they are counted within.
    """
    width = _positive(dt)
    rows = events.select("seq", "val", floor_div("t_ns", width).alias("step")).withColumn("chunk", floor_div("seq", chunk))
    ends = rows.groupBy("chunk").agg(F.max_by("step", "seq").alias("last"))
    order = Window.orderBy("chunk")  # one row a chunk
    before = ends.select("chunk", F.lag("last").over(order).alias("before"))
    inside = Window.partitionBy("chunk").orderBy("seq")
    rows = rows.join(before, "chunk").withColumn("start", F.coalesce((F.col("step") != F.coalesce(F.lag("step").over(inside), F.col("before"))).cast("long"), F.lit(1)))
    sums = rows.groupBy("chunk").agg(F.sum("start").alias("n"))
    sums = sums.select("chunk", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.join(sums, "chunk").withColumn("run", F.col("base") + F.sum("start").over(inside))
    out = rows.groupBy("run").agg((F.first("step") * width + width).alias("t_ns"), F.sum("val").alias("val"))
    return out.select("t_ns", F.col("run").alias("seq"), F.lit(0).alias("ch"), "val", F.lit("bucket").alias("unit"))


def window_reduce(events: DataFrame, window, how: str = "sum") -> DataFrame:
    """A tumbling sum or maximum by channel, given at the step's start."""
    width, fn = _positive(window), {"sum": F.sum, "max": F.max}[how]
    return events.groupBy((floor_div("t_ns", width) * width).alias("t_ns"), "ch").agg(fn("val").alias("val"), F.min("seq").alias("seq")).select("t_ns", "seq", "ch", "val")


def gaps(events: DataFrame, chunk_ns: int = 3_600_000_000_000, positive: bool = False) -> DataFrame:
    """dt to the event before in arrival order (seq); arrival is cut so that no task gets all rows."""
    rows = events.select("t_ns", "seq").withColumn("chunk", floor_div("seq", 1 << 20))
    order = Window.orderBy("chunk")
    before = rows.groupBy("chunk").agg(F.max_by("t_ns", "seq").alias("last")).select("chunk", F.lag("last").over(order).alias("before"))
    inside = Window.partitionBy("chunk").orderBy("seq")
    out = rows.join(before, "chunk").select((F.col("t_ns") - F.coalesce(F.lag("t_ns").over(inside), F.col("before"))).alias("dt")).where("dt is not null")
    return out.where("dt > 0") if positive else out


#: Ranks of the three rules for order statistics; each gives the place in a sorted list of n.
RULES = {"nearest": lambda n, q: F.rint((n - 1) * F.lit(q)), "middle": lambda n, q: F.floor(n / 2), "floor": lambda n, q: F.least(F.floor(n * F.lit(q)), n - 1)}


def counted(values: DataFrame, column: str) -> DataFrame:
    """(v, c): the distinct values with how often each comes; a map-side aggregate."""
    return values.groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("c"))


def pick_ranks(counts: DataFrame, picks: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with the values at exact ranks of a table of counted().

    Values are cut into stretches by their logarithm (a function of the value, so both readings of the table agree).
    Running counts over the stretches, of which there are at most half a million, say in which each rank lies, and only
    those few stretches are ranked value by value.
    """
    rows = counts.withColumn("part", (F.signum("v") * F.floor(F.log2(F.abs("v") + F.lit(1.0)) * 4096)).cast("long"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("c").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)))
    parts = parts.withColumn("all", F.sum("n").over(Window.partitionBy()))
    within = lambda rule, q, lo, hi: (RULES[rule](F.col("all"), q) >= lo) & (RULES[rule](F.col("all"), q) < hi)
    wanted = [within(rule, q, F.col("base"), F.col("base") + F.col("n")) for rule, q in picks.values()]
    inside = Window.partitionBy("part").orderBy("v")
    few = rows.join(F.broadcast(parts.where(F.greatest(*[w.cast("int") for w in wanted], F.lit(0)) == 1)), "part")  # a row a pick at most
    few = few.withColumn("end", F.col("base") + F.sum("c").over(inside))
    return few.agg(*[F.max(F.when(within(rule, q, F.col("end") - F.col("c"), F.col("end")), F.col("v"))).alias(name) for name, (rule, q) in picks.items()])


def telemetry(events: DataFrame, positive: bool = True, host_ns: int | None = None) -> DataFrame:
    """One row: count, time range, rate, gaps in whole microseconds with their order statistics, and the clock's: span,
    drift against the host's span if that is given, and order statistics of the gaps' distance from their median. The gaps
    are read when this is called.

    Halves of microseconds round to even. Gaps are those above 0, or all if `positive` is off. The distances come from
    the table of counted gaps, not from the rows again.
    """
    us = lambda c: F.rint(F.col(c) / F.lit(1000.0)).cast("long")
    some = {"dt_p50_us": ("nearest", 0.5), "dt_p95_us": ("nearest", 0.95), "dt_p99_us": ("nearest", 0.99), "dt_median_us": ("middle", 0.5)}
    late = {"jitter_p50_us": ("middle", 0.5), "jitter_p95_us": ("floor", 0.95), "jitter_p99_us": ("floor", 0.99)}
    with settled(counted(gaps(events, positive=positive).select(us("dt").alias("dt")), "dt")) as dt:
        found = {"dt_count": dt.agg(F.sum("c")).first()[0]} | pick_ranks(dt, some).first().asDict()
        apart = dt.groupBy(F.abs(F.col("v") - F.lit(found["dt_median_us"] or 0)).alias("v")).agg(F.sum("c").alias("c"))
        found |= pick_ranks(apart, late).first().asDict()
    whole = events.agg(F.count("*").alias("count"), F.min("t_ns").alias("lo"), F.max("t_ns").alias("hi"))
    span = F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))
    whole = whole.select("count", us("lo").alias("ts_min_us"), us("hi").alias("ts_max_us"), span.alias("sensor_duration_ns"))
    whole = whole.withColumn("duration_us", us("sensor_duration_ns")).withColumn("events_per_second", F.when(F.col("duration_us") > 0, F.col("count") / (F.col("duration_us") / 1e6)).otherwise(0.0))
    drift = F.lit(None).cast("double") if host_ns is None else (F.col("sensor_duration_ns") - F.lit(max(1, host_ns))) / F.lit(float(max(1, host_ns))) * 1e6
    return whole.withColumn("drift_ppm_est", drift).withColumns({k: F.lit(v or 0).cast("long") for k, v in found.items()})


def profile(events: DataFrame) -> DataFrame:
    """One row: count, time range, value range and mean, gap mean and order statistics (null without a gap)."""
    with settled(counted(gaps(events), "dt")) as dt:
        found = dt.agg((F.sum(F.col("v") * F.col("c").cast("double")) / F.sum("c")).alias("dt_mean")).first().asDict()
        ranks = pick_ranks(dt, {"dt_p50": ("middle", 0.5), "dt_p95": ("floor", 0.95)}).first().asDict()
    whole = events.agg(F.count("*").alias("n"), F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"), F.min("val").alias("val_min"), F.max("val").alias("val_max"), F.avg(F.coalesce("val", F.lit(0.0))).alias("val_mean"))
    return whole.withColumn("dt_mean", F.lit(found["dt_mean"]).cast("double")).withColumns({k: F.lit(v).cast("long") for k, v in ranks.items()})


def top_channels(events: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent channels; ties by first arrival."""
    return events.groupBy("ch").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(k)


def first_events(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy("seq").limit(n)


def disorder(events: DataFrame) -> DataFrame:
    """Rows whose time is less than that of the row before them in arrival."""
    rows = events.select("t_ns", "seq").withColumn("chunk", floor_div("seq", 1 << 20))
    order = Window.orderBy("chunk")
    before = rows.groupBy("chunk").agg(F.max_by("t_ns", "seq").alias("last")).select("chunk", F.lag("last").over(order).alias("before"))
    inside = Window.partitionBy("chunk").orderBy("seq")
    out = rows.join(before, "chunk").withColumn("prev_ns", F.coalesce(F.lag("t_ns").over(inside), F.col("before")))
    return out.where("t_ns < prev_ns").select("seq", "t_ns", "prev_ns")


def limit_rate(events: DataFrame, per_second: int) -> DataFrame:
    """The first events of each channel and second."""
    order = Window.partitionBy("ch", floor_div("t_ns", 1_000_000_000)).orderBy("t_ns", "seq")
    return events.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= per_second).drop("rn")


def overflow(events: DataFrame, window, capacity: int, drop: str) -> DataFrame:
    """What a buffer of this capacity keeps of each window: the newest (drop head) or the oldest (drop tail)."""
    last = drop == "head"
    order = Window.partitionBy(floor_div("t_ns", _positive(window))).orderBy(F.desc("t_ns") if last else "t_ns", F.desc("seq") if last else "seq")
    return events.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= capacity).drop("rn")


def clock_fit(pairs: DataFrame) -> DataFrame:
    """Offset and drift of a host clock against a device clock (t_dev, t_host), by least squares around the means."""
    mean = pairs.agg(F.avg("t_dev").alias("md"), F.avg("t_host").alias("mh"))
    at = pairs.crossJoin(F.broadcast(mean)).select((F.col("t_dev") - F.col("md")).alias("d"), (F.col("t_host") - F.col("mh")).alias("h"), "md", "mh")
    out = at.agg((F.sum(F.col("d") * F.col("h")) / F.sum(F.col("d") * F.col("d"))).alias("slope"), F.first("md").alias("md"), F.first("mh").alias("mh"))
    return out.select("slope", (F.col("mh") - F.col("slope") * F.col("md")).alias("offset"), ((F.col("slope") - 1) * 1e6).alias("drift_ppm"))


def odd_gaps(events: DataFrame, z: float = 3.0) -> DataFrame:
    """Gaps by channel farther than z deviations from the channel's mean gap: a sign of made-up events."""
    inside = Window.partitionBy("ch").orderBy("t_ns", "seq")
    rows = events.withColumn("dt", F.col("t_ns") - F.lag("t_ns").over(inside)).where("dt is not null")
    stats = rows.groupBy("ch").agg(F.avg("dt").alias("m"), F.stddev_pop("dt").alias("sd"))
    return rows.join(stats, "ch").where(F.abs(F.col("dt") - F.col("m")) > z * F.col("sd")).select("ch", "t_ns", "seq", "dt")


def flashes(events: DataFrame, window, pixels: int, share: float) -> DataFrame:
    """Steps of time in which more than `share` of the sensor's pixels send at once: a flash, or made-up events."""
    width = _positive(window)
    step = events.groupBy((floor_div("t_ns", width) * width).alias("t_ns")).agg(F.count_distinct("x", "y").alias("active"), F.count("*").alias("n"))
    return step.where(F.col("active") > share * pixels)


def _median(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Middle value by channel; equal values are counted first."""
    counts = rows.groupBy("ch", F.col(value).alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy("ch").orderBy("v")
    ranked = counts.withColumn("end", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy("ch")))
    middle = F.floor(F.col("n") / 2)
    return ranked.where((middle >= F.col("end") - F.col("c")) & (middle < F.col("end"))).select("ch", F.col("v").alias(name))


def band_spikes(events: DataFrame, window, k: float = 6.0) -> DataFrame:
    """Events over the median of their channel's step of time by more than k median absolute deviations of it."""
    width = _positive(window)
    rows = events.select("t_ns", "seq", F.col("ch").alias("band"), "val", (floor_div("t_ns", width) * width).alias("step")).where("val is not null")
    rows = rows.withColumn("ch", F.struct("band", "step"))
    rows = rows.join(_median(rows, "val", "med"), "ch").withColumn("off", F.abs(F.col("val") - F.col("med")))
    rows = rows.join(_median(rows, "off", "mad"), "ch")
    return rows.where(F.col("val") - F.col("med") > k * F.col("mad")).select("t_ns", "seq", F.col("band").alias("ch"), "val", "med", "mad")


def moving_average(values: DataFrame, alpha: float, by: str = "seq", value: str = "val") -> DataFrame:
    """One row: the exponential moving average after the last row, begun at the first: a weighted sum, so no fold is needed.

    Weights fall below the least double some 745 / -ln(1 - alpha) rows from the end; only those rows are ranked."""
    if not 0 < alpha <= 1:
        raise EventError("sync", "alpha must be above 0 and at most 1")
    rows = values.where(f"{value} is not null").select(F.col(by).alias("k"), F.col(value).cast("double").alias("v"))
    reach = 1 if alpha == 1 else int(745 / -math.log1p(-alpha)) + 2
    last = rows.orderBy(F.desc("k")).limit(reach).withColumn("age", F.row_number().over(Window.orderBy(F.desc("k"))) - 1)
    first = rows.agg(F.count("*").alias("n"))
    weight = F.when(F.col("age") == F.col("n") - 1, F.pow(F.lit(1 - alpha), "age")).otherwise(F.lit(alpha) * F.pow(F.lit(1 - alpha), "age"))
    return last.crossJoin(F.broadcast(first)).agg(F.sum(F.col("v") * weight).alias("ema"))  # one row
