"""Traces compared by position, within tolerances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trace_mismatches(golden: DataFrame, candidate: DataFrame, eps_time: int = 100, eps_value: float = 1e-5, limit: int = 20) -> DataFrame:
    """The first rows (pos, ts, idx, val on either side) that differ in time, index or relatively in value, or are missing."""
    a = golden.select("pos", *[F.col(c).alias(f"g_{c}") for c in ("ts", "idx", "val")], F.lit(True).alias("in_g"))
    b = candidate.select("pos", *[F.col(c).alias(f"c_{c}") for c in ("ts", "idx", "val")], F.lit(True).alias("in_c"))
    both = a.join(b, "pos", "full_outer")
    gv, cv = F.coalesce("g_val", F.lit(0.0)), F.coalesce("c_val", F.lit(0.0))
    off = (F.abs(F.col("g_ts") - F.col("c_ts")) > eps_time) | (F.abs(gv - cv) / F.greatest(F.lit(1.0), F.abs(gv)) > eps_value) | ~F.col("g_idx").eqNullSafe(F.col("c_idx"))
    lost = F.col("in_g").isNull() | F.col("in_c").isNull()
    why = F.when(lost, "missing").when(F.abs(F.col("g_ts") - F.col("c_ts")) > eps_time, "time").when(~F.col("g_idx").eqNullSafe(F.col("c_idx")), "index").otherwise("value")
    return both.where(lost | off).select("pos", why.alias("why"), "g_ts", "c_ts", "g_val", "c_val").orderBy("pos").limit(limit)


def traces_equal(a: DataFrame, b: DataFrame, eps_time: int = 0, eps_value: float = 1e-6) -> DataFrame:
    """One row: do traces (node, pos, t_ns, val) hold the same nodes and rows within absolute tolerances."""
    both = a.select("node", "pos", F.col("t_ns").alias("t1"), F.col("val").alias("v1"), F.lit(1).alias("x")).join(b.select("node", "pos", F.col("t_ns").alias("t2"), F.col("val").alias("v2"), F.lit(1).alias("y")), ["node", "pos"], "full_outer")
    bad = F.col("x").isNull() | F.col("y").isNull() | (F.abs(F.col("t1") - F.col("t2")) > eps_time) | (F.abs(F.col("v1") - F.col("v2")) > eps_value)
    return both.agg(F.count("*").alias("compared"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad")).withColumn("equal", F.col("bad") == 0)


def first_difference(a: DataFrame, b: DataFrame, tolerance: float, value_tolerance: float | None = None) -> DataFrame:
    """Of two logs (pos, type, t_s, payload map), the first position that differs in type, time or a shared numeric value."""
    both = a.select("pos", *[F.col(c).alias(f"a_{c}") for c in ("type", "t_s", "payload")], F.lit(1).alias("x")).join(b.select("pos", *[F.col(c).alias(f"b_{c}") for c in ("type", "t_s", "payload")], F.lit(1).alias("y")), "pos", "full_outer")
    shared = F.array_intersect(F.map_keys("a_payload"), F.map_keys("b_payload"))
    number = lambda side, k: F.element_at(side, k).try_cast("double")
    apart = F.exists(shared, lambda k: F.coalesce(F.abs(number("a_payload", k) - number("b_payload", k)) > (tolerance if value_tolerance is None else value_tolerance), F.lit(False)))
    why = F.when(F.col("x").isNull() | F.col("y").isNull(), "length").when(F.col("a_type") != F.col("b_type"), "type").when(F.abs(F.col("a_t_s") - F.col("b_t_s")) > tolerance, "time").when(F.coalesce(apart, F.lit(False)), "payload")
    return both.select("pos", why.alias("why")).where("why is not null").orderBy("pos").limit(1)
