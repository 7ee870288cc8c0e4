"""Structured Streaming: watermarked steps, and neurons and coincidences with state from batch to batch."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import Neuron
from ..schema import time_ns


def watermarked(events: DataFrame, late="10 s") -> DataFrame:
    """Adds `event_time` (microseconds; logic keeps t_ns) with a watermark; later rows are dropped by stateful operators."""
    return events.withColumn("event_time", F.timestamp_micros(F.expr("t_ns div 1000"))).withWatermark("event_time", f"{time_ns(late) // 1_000_000} milliseconds")


def window_sum(events: DataFrame, step="1 s", late="10 s") -> DataFrame:
    """Tumbling sums by channel of a watermarked stream."""
    span = F.window("event_time", f"{time_ns(step) // 1_000_000} milliseconds")
    return watermarked(events, late).groupBy(span, "ch").agg(F.sum("val").alias("val"), F.count("*").alias("n"))


def stream_lif(events: DataFrame, key: str, tau_m="10 ms", v_th: float = 1.0, v_reset: float = 0.0, r_m: float = 1.0, refractory="2 ms") -> DataFrame:
    """One neuron a key (long); its potential and times are the state. Each micro-batch is folded in order of t_ns, seq."""
    tau, ref = time_ns(tau_m), time_ns(refractory)

    def fold(k, batches, state: GroupState):
        cell = Neuron(tau, v_th, v_reset, r_m, ref)
        if state.exists:
            cell.v, cell.t, cell.fired = state.get
        rows = pd.concat(list(batches)).sort_values(["t_ns", "seq"], kind="stable")
        hit = [cell.step(int(t), float(v)) for t, v in zip(rows["t_ns"], rows["val"], strict=True)]
        state.update((cell.v, cell.t, cell.fired))
        spikes = rows.loc[hit, ["t_ns", "seq"]]
        spikes.insert(0, key, k[0])
        yield spikes

    src = events.select(F.col(key).cast("long").alias(key), "t_ns", "seq", F.coalesce("val", F.lit(0.0)).alias("val"))
    return src.groupBy(key).applyInPandasWithState(fold, f"{key} long, t_ns long, seq long", "v double, t long, fired long", "append", GroupStateTimeout.NoTimeout)


def stream_fuse(events: DataFrame, key: str, window="50 ms", min_count: int = 2, late=None) -> DataFrame:
    """Coincidence by key of a stream with a column src (0 for a, 1 for b); the state is the events still in the window.

    With `late` the stream gets a watermark: rows behind it are dropped, and a key's state goes once the watermark has
    passed the window of its last event, as nothing can meet it any more. Without, state stays and no row is late.
    """
    win = time_ns(window)

    def fold(k, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = [list(x) for x in state.get] if state.exists else [[], []]
        for h in held:
            heapify(h)
        rows = pd.concat(list(batches)).sort_values(["t_ns", "src", "seq"], kind="stable")
        out = []
        for t, s, q in zip(rows["t_ns"].tolist(), rows["src"].tolist(), rows["seq"].tolist(), strict=True):
            heappush(held[s], t)
            for h in held:
                while h and h[0] < t - win:
                    heappop(h)
            if held[0] and held[1] and len(held[0]) + len(held[1]) >= min_count:
                out.append((k[0], t, q))
        state.update((held[0], held[1]))
        if late is not None:
            last = max(h for x in held for h in x)  # the row just put in is there
            state.setTimeoutTimestamp(max((last + win) // 1_000_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=[key, "t_ns", "seq"])

    timeout = GroupStateTimeout.NoTimeout if late is None else GroupStateTimeout.EventTimeTimeout
    rows = events if late is None else watermarked(events, late)
    src = rows.select(F.col(key).cast("long").alias(key), "t_ns", "seq", F.col("src").cast("int").alias("src"), *([] if late is None else ["event_time"]))
    return src.groupBy(key).applyInPandasWithState(fold, f"{key} long, t_ns long, seq long", "a array<long>, b array<long>", "append", timeout)
