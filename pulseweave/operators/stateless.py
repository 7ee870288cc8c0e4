"""Row-wise operators on events: everything here stays in one codegen stage and moves no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EventError, time_ns


def delay(events: DataFrame, by="1 ms") -> DataFrame:
    return events.withColumn("t_ns", F.col("t_ns") + F.lit(time_ns(by)))


def synapse(events: DataFrame, weight: float = 1.0, tau="5 ms") -> DataFrame:
    """Weights values; the time constant is only noted in attrs, as nothing decays here."""
    out = events.withColumn("val", F.col("val") * F.lit(float(weight)))
    if "attrs" not in out.columns:
        return out
    noted = F.create_map(F.lit("syn"), F.lit("exp"), F.lit("tau_s_ns"), F.lit(str(time_ns(tau))))
    kept = F.map_filter(F.coalesce("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: ~k.isin("syn", "tau_s_ns"))
    return out.withColumn("attrs", F.map_concat(kept, noted))


def xy_to_channel(events: DataFrame, width: int = 128, height: int = 128) -> DataFrame:
    """Pixels in bounds, numbered by row; a missing value counts 1."""
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    return events.where(inside).withColumn("ch", (F.col("y") * width + F.col("x")).cast("int")).withColumn("val", F.coalesce("val", F.lit(1.0)))


def shift_xy(events: DataFrame, dx: int, dy: int, width: int = 128, height: int = 128) -> DataFrame:
    """Moves channels by whole pixels, held at the border."""
    x = F.greatest(F.lit(0), F.least(F.lit(width - 1), F.col("ch") % width + dx))
    y = F.greatest(F.lit(0), F.least(F.lit(height - 1), F.expr(f"ch div {width}") + dy))
    return events.where("ch >= 0").withColumn("ch", (y * width + x).cast("int"))


def in_bounds(events: DataFrame, width: int, height: int) -> DataFrame:
    """Pixels and polarities that a sensor of this size can send; values become 1."""
    if width <= 0 or height <= 0:
        raise EventError("vision", "width and height must be positive")
    return events.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & F.col("polarity").between(0, 1)).withColumn("val", F.lit(1.0))


def mask_pixels(events: DataFrame, dead: DataFrame) -> DataFrame:
    """Without the pixels listed in dead (x, y). Spark broadcasts the list only if it is small."""
    return events.join(dead.select("x", "y").distinct(), ["x", "y"], "left_anti").select(*events.columns)


def balance_polarity(events: DataFrame, positive: float, negative: float) -> DataFrame:
    return events.withColumn("val", F.col("val") * F.when(F.col("polarity") > 0, F.lit(float(positive))).otherwise(F.lit(float(negative))))


def correct_clock(events: DataFrame, ppm: float, offset_ns: int) -> DataFrame:
    """Scales time by drift, cut to whole nanoseconds, then adds the offset."""
    return events.withColumn("t_ns", (F.col("t_ns") * F.lit(1 + ppm / 1e6)).cast("long") + F.lit(int(offset_ns)))


def index_of(events: DataFrame, pixels: bool) -> DataFrame:
    """Adds idx: [x, y, polarity] of pixel events, else [channel]."""
    return events.withColumn("idx", F.array("x", "y", "polarity") if pixels else F.array("ch"))


def threshold(events: DataFrame, least: float) -> DataFrame:
    return events.where(F.col("val") >= least)


def time_slice(events: DataFrame, start, end) -> DataFrame:
    return events.where((F.col("t_ns") >= time_ns(start)) & (F.col("t_ns") < time_ns(end)))


def finite(events: DataFrame) -> DataFrame:
    """Guards: no null, NaN or infinite values."""
    return events.where(F.col("val").isNotNull() & ~F.isnan("val") & (F.abs("val") < float("inf")))


def canonical(events: DataFrame) -> DataFrame:
    """Order by time, index and arrival (a distributed range sort)."""
    return events.orderBy("ts", "idx", "seq")


def merge(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
