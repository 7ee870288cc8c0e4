"""Leaky integrate-and-fire: a sequential fold over each key's events, streamed through sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import EventError, time_ns

#: Fixed value: the base of the decay, which is not e to its last digits.
DECAY_BASE = 2.71828


class Neuron:
    """State and step of one neuron; times in nanoseconds."""

    __slots__ = ("v", "t", "fired", "tau", "v_th", "v_reset", "r_m", "refractory")

    def __init__(self, tau: int, v_th: float, v_reset: float, r_m: float, refractory: int):
        self.v, self.t, self.fired = 0.0, 0, -(10**18)
        self.tau, self.v_th, self.v_reset, self.r_m, self.refractory = tau, v_th, v_reset, r_m, refractory

    def step(self, t: int, val: float) -> bool:
        keep = DECAY_BASE ** (-max(0, t - self.t) / self.tau) if self.tau > 0 else 0.0
        self.v, self.t = self.v * keep + self.r_m * val, t
        if t - self.fired <= self.refractory or self.v < self.v_th:
            return False
        self.v, self.fired = self.v_reset, t
        return True


def lif(events: DataFrame, tau_m="10 ms", v_th: float = 1.0, v_reset: float = 0.0, r_m: float = 1.0, refractory="2 ms", key: str | None = None) -> DataFrame:
    """Spikes of one neuron a key, or of one for the whole stream.

    Rows are hash-partitioned by key and sorted; a task walks them batch by batch and holds one neuron, so a key of any
    length fits. Without a key the fold is one sequence by definition and runs in one task, in bounded memory.
    """
    tau, ref = time_ns(tau_m), time_ns(refractory)
    if tau < 0 or ref < 0:
        raise EventError("lif", "times must not be negative")
    kept = [key] if key else []
    src = events.select(*kept, "t_ns", "seq", F.coalesce("val", F.lit(0.0)).alias("val")).where("t_ns is not null")
    src = (src.repartition(key) if key else src.repartition(1)).sortWithinPartitions(*kept, "t_ns", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = object(), None
        for b in batches:
            on = []
            keys = b.column(0).to_pylist() if key else [None] * b.num_rows
            for i, (k, t, v) in enumerate(zip(keys, b.column("t_ns").to_pylist(), b.column("val").to_pylist(), strict=True)):
                if cell is None or k != now:
                    now, cell = k, Neuron(tau, v_th, v_reset, r_m, ref)
                if cell.step(t, v):
                    on.append(i)
            hit = b.take(pa.array(on, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(hit.column(c) for c in [*kept, "t_ns", "seq"])], names=[*kept, "t_ns", "seq"])

    schema = src.select(*kept, "t_ns", "seq").schema
    more = {"ch": F.lit(0), "val": F.lit(1.0), "unit": F.lit("spike")}
    return src.mapInArrow(run, schema).withColumns({k: v for k, v in more.items() if k != key})
