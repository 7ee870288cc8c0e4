"""Documents run as graphs, metrics, telemetry and spectra against their definitions, files passed through."""

import json
import math
import random
import struct
import wave

import pytest

from pulseweave import cli, domains
from pulseweave.operators import aggregate, spectral
from pulseweave.plans import artifacts, documents
from pulseweave.plans.graph import Graph
from pulseweave.schema import EventError, as_events
from pulseweave.sources import readers
from pulseweave.streaming import stateful

WORDS = {
    "version": "0.1.0", "profile": "BASE", "time": {"unit": "us", "mode": "exact_event"}, "graph": {"name": "g"},
    "nodes": [{"id": "front", "kind": "kernel", "op": "conv1d_events", "params": {"bands": 4, "stride": 1}}, {"id": "head", "kind": "spiking_neuron", "op": "lif", "params": {"size": 64, "tau_ms": 10.0, "v_th": 1.0}}, {"id": "out", "kind": "probe", "params": {"target": "head", "type": "spike"}}],
    "edges": [{"src": "front", "dst": "head", "weight": 0.5, "delay_us": 300}], "probes": [{"id": "p", "target": "h*"}],
}


def stream(spark, rows):
    raw = spark.createDataFrame([(t, i, c, float(v)) for i, (t, c, v) in enumerate(rows)], "t_ns long, seq long, ch int, val double")
    return as_events(raw, t_ns="t_ns", seq="seq", ch="ch", val="val")


def test_document(spark):
    g = documents.lower(WORDS)
    assert g.inputs == ["front"] and g.nodes["head"].params == {"tau_m": "10.0 ms", "v_th": 1.0}
    made = documents.run_document(WORDS, {"front": stream(spark, [(0, 1, 2.5), (1_000_000, 9, 5.0), (5_000_000, 0, 0.4)])})
    for name in ("head", "out", "probe p"):
        assert [r["t_ns"] for r in made[name].collect()] == [300_000], name
    with pytest.raises(EventError, match="no operator"):
        documents.lower({**WORDS, "nodes": [{"id": "a", "kind": "custom", "op": "what"}], "edges": [], "probes": []})
    with pytest.raises(EventError, match="no target"):
        documents.run_document({**WORDS, "probes": [{"id": "p", "target": "zz"}]}, {"front": stream(spark, [])})
    with pytest.raises(EventError, match="nothing feeds"):
        documents.run_document(WORDS, {})


def test_document_ports(spark):
    """Two edges fill the two ports of a coincidence in turn; further ones are merged into them."""
    doc = {**WORDS, "nodes": [{"id": n, "kind": "group"} for n in "abc"] + [{"id": "f", "kind": "custom", "op": "fuse", "params": {"window": "2 ms", "min_count": 3}}], "edges": [{"src": n, "dst": "f"} for n in "abc"], "probes": []}
    streams = {"a": stream(spark, [(0, 0, 1)]), "b": stream(spark, [(1_000_000, 0, 1)]), "c": stream(spark, [(1_500_000, 0, 1), (9_000_000, 0, 1)])}
    assert [r["t_ns"] for r in documents.run_document(doc, streams)["f"].collect()] == [1_500_000]


def test_metrics(spark):
    g, ev = domains.always_on_bands(window="3 ms", min_count=2, tau="10 ms", v_th=0.9), stream(spark, [(i * 1_000_000, 0, 1.0) for i in range(20)])
    made = g.run(mel=ev)
    rows = {r["node"]: r for r in g.metrics({"mel": ev}, made, timed=True).collect()}
    assert {n: (r["kind"], r["in_events"], r["out_events"]) for n, r in rows.items()} == {n: (g.nodes[n].kind, 40 if n == "vad" else 20, made[n].count()) for n in g.nodes}
    assert all(r["wall_time_s"] > 0 for r in rows.values())
    assert Graph().add("a", "delay").nodes["a"].kind == "delay"


def told_by_hand(times, positive):
    dt = sorted(round(x / 1000) for a, b in zip(times, times[1:]) if (x := b - a) > 0 or not positive)
    near = lambda v, q: v[round((len(v) - 1) * q)]
    mid = dt[len(dt) // 2]
    j = sorted(abs(x - mid) for x in dt)
    return [len(dt), near(dt, 0.5), near(dt, 0.95), near(dt, 0.99), mid, j[len(j) // 2], j[int(len(j) * 0.95)], j[int(len(j) * 0.99)]]


@pytest.mark.parametrize("positive", [True, False])
def test_telemetry(spark, positive):
    rng = random.Random(4)
    for spread in (3_000, 2_000_000, 10**15):
        times = [1_700_000_000 * 10**9]
        for _ in range(400):
            times.append(times[-1] + rng.choice([0, -500, 1500, 2500, rng.randrange(spread)]))
        r = aggregate.telemetry(stream(spark, [(t, 0, 1) for t in times]), positive, host_ns=1000).first()
        assert [r[c] for c in ("dt_count", "dt_p50_us", "dt_p95_us", "dt_p99_us", "dt_median_us", "jitter_p50_us", "jitter_p95_us", "jitter_p99_us")] == told_by_hand(times, positive)
        assert r["ts_min_us"] == round(min(times) / 1000) and r["drift_ppm_est"] == pytest.approx((max(times) - min(times) - 1000) / 1000 * 1e6)


def test_ranks(spark):
    rng = random.Random(6)
    for n in (1, 2, 7, 300):
        v = sorted(rng.choice([-(10**6), -3, 0, 1, 2, 10**12]) + rng.randrange(3) for _ in range(n))
        r = aggregate.pick_ranks(aggregate.counted(spark.createDataFrame([(x,) for x in v], "x long"), "x"), {"a": ("nearest", 0.5), "b": ("middle", 0.5), "c": ("floor", 0.95), "d": ("nearest", 1.0)}).first()
        assert list(r) == [v[round((n - 1) * 0.5)], v[n // 2], v[min(int(n * 0.95), n - 1)], v[-1]]


def test_sample_index(spark):
    """Real times: no overflow, and halves round to even whatever the second."""
    rng, rate = random.Random(2), 16001
    times = [rng.randrange(18 * 10**17) for _ in range(300)] + [10**9 * s + 5 * 10**8 for s in range(8)]
    for rate in (16000, 16001, 3):
        got = stream(spark, [(t, 0, 1) for t in times]).select("t_ns", spectral.sample_index(rate).alias("i")).collect()
        whole = lambda t: (t * rate) // 10**9 + ((2 * ((t * rate) % 10**9) > 10**9) or (2 * ((t * rate) % 10**9) == 10**9 and (t * rate) // 10**9 % 2))
        assert [r["i"] for r in got] == [whole(r["t_ns"]) for r in got]


def test_stft_far_from_zero(spark):
    """A stream of today gives its own frames only; two samples at one index: the later counts; a gap gives zeros."""
    t0 = 1_700_000_000 * 10**9
    ev = stream(spark, [(t0 + i * 1_000_000, 0, math.sin(i)) for i in range(64)])
    out = spectral.stft(ev, 16, "8 ms", 1000, skip_empty=True).where("val > 1e-12")
    first = out.agg({"t_ns": "min"}).first()[0]
    assert t0 < first < t0 + 16_000_000 + 1 and out.select("t_ns").distinct().count() <= 9
    ev = stream(spark, [(0, 0, 1.0), (0, 0, 3.0), (5_000_000_000, 0, 1.0)])
    rows = {(r["t_ns"], r["ch"]): r["val"] for r in spectral.stft(ev, 4, "4 ms", 1000, window="none").collect()}
    assert rows[4_000_000, 0] == pytest.approx(3.0) and len(rows) == 3 * 1250 and sum(v > 0 for v in rows.values()) == 3


def test_files_passed_through(spark, tmp_path):
    src, out = tmp_path / "in.jsonl", tmp_path / "out.jsonl"
    src.write_text('{"ts": 30, "idx": [1], "val": 2.5}\n\n{"ts": 10, "idx": [0]}\n')
    told = readers.normalize(spark, f"vision.dvs://file?format=jsonl&path={src}", str(out), host_ns=5).first()
    lines = [json.loads(x) for x in out.read_text().splitlines()]
    assert lines[0]["header"] == readers.DEFAULT_HEADER and lines[1:] == [{"ts": 30, "idx": [1], "val": 2.5}, {"ts": 10, "idx": [0], "val": 0.0}]
    assert told["count"] == 2 and told["dt_count"] == 1 and told["dt_p50_us"] == -20
    made = domains.run_file(spark, f"file://{src}", "always_on_bands", window="1 ms", min_count=2)
    assert made["mel"].count() == 2
    with wave.open(str(tmp_path / "s.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"".join(struct.pack("<h", int(9000 * math.sin(i))) for i in range(800)))
    made = domains.run_file(spark, f"file://{tmp_path}/s.wav", "always_on", n_fft=64, sample_rate=8000, n_mels=6)
    assert made["mel"].count() == 6 * ((800 - 64) // 80 + 1)
    with pytest.raises(EventError):
        domains.run_file(spark, f"file://{src}", "event_slam")


def test_compare_and_conformance(spark, tmp_path, capsys):
    logs = [tmp_path / "a.jsonl", tmp_path / "b.jsonl"]
    for p, v in zip(logs, (1, 1.0000001)):
        p.write_text("".join(json.dumps({"type": t, "t_s": i / 10, "payload": {"v": str(v)}}) + "\n" for i, t in enumerate(("meta", "event", "deliver"))))
    assert cli.main(["compare", *map(str, logs)]) == 0 and cli.main(["compare", *map(str, logs), "--tol-val", "1e-9"]) == 1
    (tmp_path / "bands.jsonl").write_text('{"header": {"schema_version": "0.1.0", "dims": ["band"], "units": {"time": "us", "value": "dB"}, "dtype": "f16", "layout": "coo"}}\n{"ts": 0, "idx": [3], "val": 4}\n{"ts": 20, "idx": [2], "val": 1}\n')
    (tmp_path / "g.json").write_text(json.dumps(WORDS))
    (tmp_path / "cases.json").write_text(json.dumps([{"name": "bands", "uri": f"audio.mic://{tmp_path}/bands.jsonl", "eir": str(tmp_path / "g.json")}]))
    assert cli.main(["conformance", str(tmp_path / "cases.json"), "--out", str(tmp_path / "c")]) == 0
    assert "bands: pass" in (tmp_path / "c" / "badges.md").read_text()
    assert cli.main(["run", str(tmp_path / "g.json"), "--input", str(tmp_path / "bands.jsonl"), "--out", str(tmp_path / "t.jsonl"), "--probes-out", str(tmp_path / "probes")]) == 0
    assert {r["node"] for r in readers.read_trace(spark, str(tmp_path / "probes")).collect()} >= {"front", "head", "probe p"}
    with pytest.raises(EventError, match="no input"):
        artifacts.run_documents(spark, artifacts.plan(WORDS), [], str(tmp_path / "x.jsonl"))
    capsys.readouterr()


def test_streamed_coincidence(spark, tmp_path):
    """State from batch to batch, with and without a watermark, against one pass."""
    rows = [(10**9 + i * 7_000_000, i, 1, i % 2) for i in range(90)]  # a row at time 0 would be behind the first watermark
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], "t_ns long, seq long, ch int, src int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    want = [t for i, (t, *_) in enumerate(rows) if i >= 1]
    for k, late in enumerate((None, "10 s")):
        live = spark.readStream.schema("t_ns long, seq long, ch int, src int").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
        q = stateful.stream_fuse(live, "ch", "20 ms", 2, late).writeStream.format("memory").queryName(f"fused{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(r["t_ns"] for r in spark.sql(f"select * from fused{k}").collect()) == want
