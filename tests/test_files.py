"""Sources, sinks, checks, planning, streaming and the command line."""

import json
import math
import struct
import wave

import pytest

from pulseweave import cli
from pulseweave.operators import aggregate
from pulseweave.operators.state import lif
from pulseweave.plans import artifacts
from pulseweave.schema import EventError
from pulseweave.sources import readers, writers
from pulseweave.streaming import stateful

HEADER = {"schema_version": "0.1.0", "dims": ["x", "y", "polarity"], "units": {"time": "us", "value": "dimensionless"}, "dtype": "u8", "layout": "coo"}
DOC = {"version": "0.1.0", "profile": "BASE", "time": {"unit": "us", "mode": "exact_event"}, "graph": {"name": "g"}, "nodes": [{"id": "a", "kind": "kernel", "op": "conv2d_events"}, {"id": "b", "kind": "probe"}], "edges": [{"src": "a", "dst": "b"}]}


@pytest.fixture
def sample(tmp_path):
    p = tmp_path / "in.jsonl"
    rows = [{"ts": 100, "idx": [12, 45, 1], "val": 1}, {"ts": 104, "idx": [12, 45, 0]}, {"ts": 133, "idx": [13, 45, 1], "val": 1}]
    p.write_text("\n".join([json.dumps({"header": HEADER}), *map(json.dumps, rows), "", "not json"]) + "\n")
    return str(p)


def test_tensor_files(spark, sample, tmp_path):
    header, rows = readers.read_tensor(spark, sample)
    events = readers.tensor_events(header, rows)
    assert [(r["t_ns"], r["x"], r["polarity"], r["val"]) for r in events.orderBy("seq").collect()] == [(100_000, 12, 1, 1.0), (104_000, 12, 0, 1.0), (133_000, 13, 1, 1.0)]
    out = str(tmp_path / "out.jsonl")
    writers.write_tensor(events, out, header, pixels=True)
    assert artifacts.check_tensor(spark, out) == []
    assert any("lack" in f for f in artifacts.check_tensor(spark, sample))
    back = tmp_path / "back.jsonl"
    back.write_text(json.dumps({"header": HEADER}) + '\n{"ts":20,"idx":[1,1,1],"val":1}\n{"ts":10,"idx":[1],"val":1}\n')
    assert len(artifacts.check_tensor(spark, str(back))) == 2


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("t,channel,value\n0.5,1.5,2\n1.5,0,3\n")
    rows = readers.read_csv(spark, str(p)).orderBy("seq").collect()
    assert [(r["t_ns"], r["ch"], r["val"]) for r in rows] == [(0, 2, 2.0), (2000, 0, 3.0)]
    with pytest.raises(EventError):
        readers.read_csv(spark, str(p), value="nope")
    imu = tmp_path / "i.csv"
    imu.write_text("t_ns,ax,ay,az,gx,gy,gz\n5,1,2,3,4,5,6\n")
    got = readers.open_source(spark, f"imu://{imu}").orderBy("seq").collect()
    assert [(r["ch"], r["val"], r["unit"]) for r in got][2:4] == [(2, 3.0, "m/s^2"), (3, 4.0, "rad/s")]
    with pytest.raises(EventError, match="unsupported"):
        readers.open_source(spark, "what://x.y")
    assert readers.open_source(spark, "vision://a.aedat4").count() == 1000 and readers.live(spark).count() == 0 and readers.pulses(spark).count() == 3


def test_wav(spark, tmp_path):
    p = str(tmp_path / "s.wav")
    with wave.open(p, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"".join(struct.pack("<h", int(12000 * math.sin(2 * math.pi * 1000 * i / 16000))) for i in range(4000)))
    pcm = readers.read_wav(spark, p)
    assert pcm.count() == 4000 and pcm.where("seq = 16").first()["t_ns"] == 1_000_000
    bands = readers.read_wav_bands(spark, p, 32).where("t_ns > 50000000 and t_ns < 150000000")
    top = bands.groupBy("ch").avg("val").orderBy("avg(val)", ascending=False).first()["ch"]
    assert top == 4  # bin 16 of 129: bands begin at bins 0, 4, 8, 12, 16


def test_checks_and_plans():
    assert artifacts.check_graph(DOC) == []
    assert artifacts.check_graph({}) and artifacts.check_graph({**DOC, "edges": [{"src": "a", "dst": "zz"}]})
    made = artifacts.plan(DOC)
    assert made["unsupported_ops"] == ["conv2d_events"] and made["dt_us"] is None
    fixed = {**DOC, "time": {"unit": "us", "mode": "fixed_step", "fixed_step_dt_us": 1500, "epsilon_time_us": 10}}
    assert artifacts.plan(fixed, {**artifacts.SPARK_DEVICE, "time_resolution_ns": 1000})["dt_us"] == 1500
    with pytest.raises(EventError, match="quantization"):
        artifacts.plan(fixed, {**artifacts.SPARK_DEVICE, "time_resolution_ns": 1_000_000})
    with pytest.raises(EventError, match="unsupported_profile"):
        artifacts.plan({**DOC, "profile": "LEARNING"})
    assert artifacts.plan({**DOC, "security": {"overflow_policy": "block"}})["overflow"] == "drop_tail"
    assert artifacts.check_device(artifacts.SPARK_DEVICE) == [] and artifacts.check_device({})


def test_packages(tmp_path):
    (tmp_path / "g.json").write_text(json.dumps(DOC))
    made = artifacts.package(str(tmp_path), "p", "1.0", {"eir": "g.json"})
    assert artifacts.check_package(str(tmp_path), made) == []
    (tmp_path / "g.json").write_text("{}")
    assert artifacts.check_package(str(tmp_path), made) == ["g.json has another digest"]
    for n in writers.REQUIRED:
        (tmp_path / "src" / n).parent.mkdir(exist_ok=True)
        (tmp_path / "src" / n).write_text(n)
    writers.pack_bundle(str(tmp_path / "src"), str(tmp_path / "b.tar.gz"))
    writers.unpack_bundle(str(tmp_path / "b.tar.gz"), str(tmp_path / "to"))
    assert (tmp_path / "to" / writers.REQUIRED[0]).read_text() == writers.REQUIRED[0]
    r = writers.Registry(str(tmp_path / "reg"))
    r.add("m", "1.9", "a")
    r.add("m", "1.10", "b")
    assert writers.Registry(str(tmp_path / "reg")).get("m") == "b" and r.get("m", "1.9") == "a" and len(r.list()) == 2
    with pytest.raises(EventError):
        r.push_remote("m")


def test_command_line(spark, sample, tmp_path, capsys):
    good, doc = str(tmp_path / "good.jsonl"), str(tmp_path / "g.json")
    header, rows = readers.read_tensor(spark, sample)
    writers.write_tensor(readers.tensor_events(header, rows), good, header, pixels=True)
    (tmp_path / "g.json").write_text(json.dumps(DOC))
    assert cli.main(["version"]) == 0 and cli.main(["nonsense"]) == 2 and cli.main(["validate-eir", doc]) == 0
    assert cli.main(["validate-event", good]) == 0 and cli.main(["validate-event", sample]) == 1 and cli.main(["validate-event", "/nope"]) == 2
    assert cli.main(["profile", good]) == 0 and cli.main(["build", doc]) == 0
    out = str(tmp_path / "golden.jsonl")
    assert cli.main(["run", doc, "--input", good, "--out", out]) == 0
    assert cli.main(["compare-traces", good, out]) == 0
    lines = open(out).read().replace('"ts":133', '"ts":933')
    open(out, "w").write(lines)
    assert cli.main(["compare-traces", good, out]) == 1
    assert cli.main(["sal-stream", "vision://x.aedat4", "--out", str(tmp_path / "t.jsonl"), "--telemetry-out", str(tmp_path / "t.json")]) == 0
    assert json.loads((tmp_path / "t.json").read_text())["count"] == 1000
    capsys.readouterr()


def test_streaming_equals_batch(spark, tmp_path):
    schema = "t_ns long, seq long, ch int, val double"
    rows = [(i * 1_000_000, i, i % 3, 0.7) for i in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    spikes = stateful.stream_lif(live, "ch", "10 ms", 1.0, refractory="2 ms")
    q = spikes.writeStream.format("memory").queryName("spikes").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = lif(spark.createDataFrame(rows, schema), "10 ms", 1.0, refractory="2 ms", key="ch")
    assert sorted(r["t_ns"] for r in spark.sql("select * from spikes").collect()) == sorted(r["t_ns"] for r in want.collect())
    sums = stateful.window_sum(live, "10 ms", "0 s")
    q = sums.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) as n from sums").first()["n"] == 60


def test_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"type":"meta"}\nbroken\n{"type":"event","t_s":0.1,"payload":{"v":"1"}}\n{"type":"deliver","t_s":0.2,"payload":{}}\n')
    assert [(r["pos"], r["type"]) for r in readers.read_log(spark, str(p)).collect()] == [(0, "event"), (1, "deliver")]


def test_empty_streams(spark):
    none = readers.live(spark)
    assert aggregate.telemetry(none).first()["count"] == 0 and aggregate.profile(none).first()["n"] == 0
    assert lif(none).count() == 0 and aggregate.bucket_runs(none, 10).count() == 0
