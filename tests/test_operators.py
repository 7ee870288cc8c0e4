"""Operators against sequential definitions, on random streams with many ties."""

import math
import random

import pytest

from pulseweave import domains
from pulseweave.functions.signal import hann, mel_filters
from pulseweave.operators import aggregate, correlate, spectral, state, stateless
from pulseweave.plans.graph import Graph, trace
from pulseweave.schema import EventError, as_events, time_ns


def stream(spark, times, vals=None):
    vals = vals or [1.0] * len(times)
    rows = [(t, i, 0, float(v)) for i, (t, v) in enumerate(zip(times, vals, strict=True))]
    return as_events(spark.createDataFrame(rows, "t_ns long, seq long, ch int, val double"), t_ns="t_ns", seq="seq", ch="ch", val="val")


def fuse_by_hand(a, b, win, least):
    held, out = ([], []), []
    for t, s in sorted([(t, 0) for t in a] + [(t, 1) for t in b]):
        held[s].append(t)
        for h in held:
            h[:] = [x for x in h if x >= t - win]
        if held[0] and held[1] and len(held[0]) + len(held[1]) >= least:
            out.append(t)
    return out


@pytest.mark.parametrize(("a", "b", "win", "least"), [([], [1], 5, 1), ([0, 100, 250, 400, 650, 900], [50, 300, 450, 700, 950], 120, 2), ([1000] * 5, [1000] * 7, 10, 10), ([-7, -3, 0], [-5, 2], 3, 2)])
def test_fuse_cases(spark, a, b, win, least):
    out = correlate.fuse(stream(spark, a), stream(spark, b), win, least)
    assert sorted(r["t_ns"] for r in out.collect()) == fuse_by_hand(a, b, win, least)


def test_fuse_random(spark):
    rng = random.Random(3)
    for win, least in ((5, 2), (50, 2), (200, 4)):
        a, b = (sorted(rng.randrange(3000) for _ in range(400)) for _ in "ab")
        out = correlate.fuse(stream(spark, a), stream(spark, b), win, least)
        assert sorted(r["t_ns"] for r in out.collect()) == fuse_by_hand(a, b, win, least)
    with pytest.raises(EventError):
        correlate.fuse(stream(spark, [1]), stream(spark, [1]), 0)


def test_optical_flow_of_three_events(spark):
    rows = spark.createDataFrame([(100_000, 0, 12, 45, 1, 1.0), (104_000, 1, 12, 45, 0, 1.0), (133_000, 2, 13, 45, 1, 1.0)], "t_ns long, seq long, x int, y int, polarity int, val double")
    out = correlate.optical_flow(rows, 128, 128, "5 ms", "2 ms", "200 us", 2)
    assert sorted((r["t_ns"], r["x"], r["y"], r["polarity"]) for r in out.collect()) == [(2_300_000, 13, 45, 1), (2_333_000, 12, 45, 1)]
    with pytest.raises(EventError):
        correlate.optical_flow(rows, 0, 128)


def lif_by_hand(rows, tau, th, reset, r, ref):
    v, last, fired, out = 0.0, 0, -(10**18), []
    for t, x in rows:
        v = v * (2.71828 ** (-max(0, t - last) / tau) if tau > 0 else 0) + r * x
        last = t
        if t - fired > ref and v >= th:
            v, fired = reset, t
            out.append(t)
    return out


def test_lif(spark):
    pulses = stream(spark, [1_000_000, 2_000_000, 3_000_000])
    assert [r["t_ns"] for r in state.lif(pulses, "10 ms", 0.9, refractory="2 ms").collect()] == [1_000_000]
    rng = random.Random(4)
    rows = sorted((rng.randrange(10**6), rng.random()) for _ in range(800))
    out = state.lif(stream(spark, [t for t, _ in rows], [v for _, v in rows]), 4000, 1.5, 0.1, 1.0, 2000)
    assert [r["t_ns"] for r in out.orderBy("t_ns").collect()] == lif_by_hand(rows, 4000, 1.5, 0.1, 1.0, 2000)


@pytest.mark.parametrize("dt", [1, 10, 100])
def test_buckets(spark, dt):
    from itertools import groupby

    rng = random.Random(dt)
    times = [rng.randrange(-50, 300) for _ in range(300)]
    vals = [rng.randrange(9) for _ in times]
    runs = [((k + 1) * dt, sum(vals[i] for i in g)) for k, g in ((k, list(g)) for k, g in groupby(range(300), key=lambda i: times[i] // dt))]
    out = aggregate.bucket_runs(stream(spark, times, vals), dt, 64).orderBy("seq").collect()
    assert [(r["t_ns"], int(r["val"])) for r in out] == runs
    whole = {}
    for t, v in zip(times, vals, strict=True):
        whole[(t // dt + 1) * dt] = whole.get((t // dt + 1) * dt, 0) + v
    assert {r["t_ns"]: int(r["val"]) for r in aggregate.bucket_sum(stream(spark, times, vals), dt).collect()} == whole
    with pytest.raises(EventError):
        aggregate.bucket_sum(stream(spark, [1]), 0)


def test_stft_and_mel(spark):
    sr, n, hop = 1000, 32, 10
    x = [math.sin(2 * math.pi * 200 * i / sr) for i in range(100)]
    samples = stream(spark, [i * 1_000_000 for i in range(100)], x)
    got = {(r["t_ns"], r["ch"]): r["val"] for r in spectral.stft(samples, n, "10 ms", sr).collect()}
    w, want = hann(n), {}
    for f in range((100 - n) // hop + 1):
        for k in range(n // 2 + 1):
            z = sum(x[f * hop + i] * w[i] * complex(math.cos(2 * math.pi * k * i / n), -math.sin(2 * math.pi * k * i / n)) for i in range(n))
            want[(f * hop + n) * 1_000_000, k] = abs(z)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    mels = spectral.mel(spectral.stft(samples, n, "10 ms", sr), n, sr, 8).collect()
    assert len(mels) == 8 * len({t for t, _ in want})
    filters = mel_filters(n, sr, 8)
    for r in mels[:20]:
        e = sum(want[r["t_ns"], k] * v for m, k, v in filters if m == r["ch"])
        assert abs(r["val"] - math.log(max(e, 1e-12))) < 1e-6
    assert spectral.stft(stream(spark, [0, 1_000_000]), n, "10 ms", sr).count() == 0


def test_pixels(spark):
    at = as_events(spark.createDataFrame([(0, 0, 3, 2)], "t_ns long, seq long, x int, y int"), t_ns="t_ns", seq="seq", x="x", y="y")
    ch = stateless.xy_to_channel(at, 8, 8)
    assert [r["ch"] for r in ch.collect()] == [19]
    assert [r["ch"] for r in stateless.shift_xy(ch, 1, 0, 8, 8).collect()] == [20]
    assert [r["ch"] for r in stateless.shift_xy(ch, -9, -9, 8, 8).collect()] == [0]
    made = stateless.synapse(at, 0.5, "5 ms").first()
    assert made["attrs"] == {"syn": "exp", "tau_s_ns": "5000000"}


def test_times():
    assert [time_ns(x) for x in (5, "10 ms", "2.5us", "1 s", "7 ns", "0.5 ns", "1.5 ns")] == [5, 10_000_000, 2500, 10**9, 7, 0, 2]


def test_graphs(spark):
    ev = stream(spark, [1_000_000 * i for i in range(1, 40)])
    for name, build in domains.BUILDERS.items():
        g = build()
        again = Graph.from_json(g.to_json())
        assert again.nodes == g.nodes and again.edges == g.edges and g.validate()
        if "stft" not in g.nodes and name != "event_slam":
            made = g.run(**{n: ev.withColumn("x", ev["seq"].cast("int")).withColumn("y", ev["ch"]) for n in g.inputs})
            assert trace(made).count() >= 0
    fixed = domains.reflex_controller().run_fixed("2 ms", out=ev)["out"].collect()
    assert fixed and all(r["t_ns"] % 2_000_000 == 0 for r in fixed)
    g = Graph().add("a", "delay").add("b", "delay").connect("a", "b")
    with pytest.raises(EventError, match="wired twice"):
        g.connect("a", "b")
    with pytest.raises(EventError, match="cycle"):
        g.connect("b", "a").order()
    with pytest.raises(EventError):
        Graph().add("a", "no such kind")
    with pytest.raises(EventError, match="no time"):
        Graph().add("a", "delay", by="soon").validate()
    assert len(domains.music_generator(rounds=3).nodes) == 6


def test_energy():
    out = spectral.energy(10, 64, 8, 5, 7, "arm")
    assert out["stft"] == pytest.approx(10 * 5 * 64 * 6 * 0.03) and out["vad"] == pytest.approx(0.2)
