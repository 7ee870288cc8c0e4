"""Sources: tensor JSONL, CSV, WAV, synthetic sensors, log JSONL and saved traces; and the registry of source URIs."""

from __future__ import annotations

import io
import json
import wave
from urllib.parse import parse_qsl, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.signal import hann
from ..schema import EVENT_SCHEMA, UNIT_NS, EventError, as_events

#: Fixed value: the header of a stream that has none.
DEFAULT_HEADER = {"schema_version": "0.1.0", "dims": ["ch"], "units": {"time": "us", "value": "dimensionless"}, "dtype": "f32", "layout": "coo"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a place that grows along each file: partition, then place in it."""
    return spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).where(F.trim("value") != "")


def read_header(spark: SparkSession, path: str) -> dict:
    first = _lines(spark, path).orderBy("seq").limit(1).collect()
    raw = json.loads(first[0]["value"]) if first else {}
    return raw.get("header", DEFAULT_HEADER) if isinstance(raw, dict) else DEFAULT_HEADER


def read_tensor(spark: SparkSession, path: str, strict: bool = False, default: float = 1.0) -> tuple[dict, DataFrame]:
    """Header and rows (ts, idx, val, seq); lines that do not parse are skipped, or fail the read if strict."""
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE"}
    row = F.from_json("value", "ts bigint, idx array<int>, val double", mode)
    rows = _lines(spark, path).where(~F.col("value").rlike(r'^\s*\{\s*"header"')).select(row.alias("r"), "seq")
    return read_header(spark, path), rows.where("r.ts is not null").select("r.ts", "r.idx", F.coalesce("r.val", F.lit(default)).alias("val"), "seq")


def tensor_events(header: dict, rows: DataFrame) -> DataFrame:
    """Event rows of a tensor, with its time unit converted."""
    scale, dims = UNIT_NS[header.get("units", {}).get("time", "us")], header.get("dims", ["ch"])
    named = {d: f"idx[{i}]" for i, d in enumerate(dims)}
    pixels = {k: v for k, v in named.items() if k in ("x", "y", "polarity")}
    return as_events(rows, t_ns=f"ts * {scale}L", seq="seq", ch="0" if pixels else "idx[0]", val="val", **pixels)


def read_imu_csv(spark: SparkSession, path: str) -> DataFrame:
    """Six events a row: accelerations on channels 0 to 2, rates on 3 to 5."""
    raw = spark.read.csv(path, header=True, schema="t_ns bigint, ax double, ay double, az double, gx double, gy double, gz double")
    return unpivot_imu(raw.withColumn("row", F.monotonically_increasing_id()))


def unpivot_imu(raw: DataFrame) -> DataFrame:
    tall = raw.selectExpr("t_ns", "row", "stack(6, 0, ax, 1, ay, 2, az, 3, gx, 4, gy, 5, gz) as (ch, val)")
    return as_events(tall, t_ns="t_ns", seq="row * 6 + ch", ch="ch", val="val", unit="if(ch < 3, 'm/s^2', 'rad/s')")


def read_csv(spark: SparkSession, path: str, time: str = "t", channel: str = "channel", value: str = "value", unit: str = "us") -> DataFrame:
    """Named columns; a missing one or a value that is no number is an error; halves round to even."""
    raw = spark.read.csv(path, header=True)
    for c in (time, channel, value):
        if c not in raw.columns:
            raise EventError("csv", f"no column {c}")
    raw = raw.withColumn("row", F.monotonically_increasing_id())
    number = {c: f"cast(`{c}` as double)" for c in (time, channel, value)}
    checked = raw.where(F.expr(" and ".join(f"(try_cast(`{c}` as double) is not null or raise_error('csv: {c} is no number') is null)" for c in number)))
    return as_events(checked, t_ns=f"cast(rint({number[time]}) as bigint) * {UNIT_NS[unit]}L", seq="row", ch=f"cast(rint({number[channel]}) as int)", val=number[value])


def _wav(content: bytes) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise EventError("wav", "only 16-bit samples are read")
        return w.getframerate(), np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Samples as events, channels averaged towards zero."""

    def run(batches):
        for b in batches:
            for content in b.column("content").to_pylist():
                rate, s = _wav(content)
                mono = np.trunc(s.sum(1) / s.shape[1])
                for a in range(0, len(mono), 1 << 16):
                    i = np.arange(a, min(len(mono), a + (1 << 16)))
                    yield pa.RecordBatch.from_arrays([pa.array((i * 1e9 / rate).astype(np.int64)), pa.array(i), pa.array(mono[i] / 32768)], names=["t_ns", "seq", "val"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "t_ns bigint, seq bigint, val double")
    return as_events(raw, t_ns="t_ns", seq="seq", ch="0", val="val", unit="'pcm'")


def read_wav_bands(spark: SparkSession, path: str, bands: int = 32, size: int = 256) -> DataFrame:
    """Band means of spectra over half-overlapping windows, zero-padded at both ends; magnitudes are linear."""

    def run(batches):
        w = np.array(hann(size, periodic=True))
        for b in batches:
            for content in b.column("content").to_pylist():
                rate, s = _wav(content)
                x = np.concatenate([np.zeros(size // 2), s.ravel().astype(float), np.zeros(size // 2)])
                x = np.concatenate([x, np.zeros(-(len(x) - size) % (size // 2))])
                starts = np.arange(0, len(x) - size + 1, size // 2)
                mags = np.abs(np.fft.rfft(x[starts[:, None] + np.arange(size)] * w, axis=1)) / w.sum()
                n = mags.shape[1]
                edge = [int(k * n / bands) for k in range(bands + 1)]
                means = np.stack([mags[:, a:z].mean(1) if z > a else np.zeros(len(mags)) for a, z in zip(edge, edge[1:], strict=False)], 1)
                t = np.repeat((starts * 1e9 / rate).astype(np.int64), bands)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.arange(len(t))), pa.array(np.tile(np.arange(bands), len(starts)).astype(np.int32)), pa.array(means.ravel())], names=["t_ns", "seq", "ch", "val"])

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "t_ns bigint, seq bigint, ch int, val double")
    return as_events(raw, t_ns="t_ns", seq="seq", ch="ch", val="val", unit="'dB'")


def replay_sensor(spark: SparkSession, n: int = 1000) -> DataFrame:
    """A synthetic camera: one event a microsecond, walking over 64 by 64 pixels."""
    return as_events(spark.range(n), t_ns="id * 1000", seq="id", ch="0", val="cast(id & 1 as double)", x="id % 64", y="id div 64 % 64", polarity="id & 1")


def pulses(spark: SparkSession) -> DataFrame:
    return as_events(spark.range(1, 4), t_ns="id * 1000000", seq="id", ch="0", val="1.0")


def live(spark: SparkSession) -> DataFrame:
    """A sensor that is not there: no events."""
    return spark.createDataFrame([], EVENT_SCHEMA)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of type event or deliver, placed in order; others and broken lines are skipped."""
    row = F.from_json("value", "type string, t_s double, payload map<string,string>")
    rows = _lines(spark, path).select(row.alias("r"), "seq").where("r.type in ('event', 'deliver')")
    rows = rows.withColumn("part", F.expr("seq div 1048576"))  # counted by stretches, then within them
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("seq"))
    return rows.join(sizes, "part").select((F.col("base") + inside - 1).cast("long").alias("pos"), "r.type", "r.t_s", "r.payload")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("t_ns bigint, seq bigint, ch int, val double, node string").json(path)


SOURCES = {("csv", "csv"): read_imu_csv, ("imu", "csv"): read_imu_csv, ("file", "csv"): read_imu_csv, ("file", "wav"): read_wav_bands, ("audio", "wav"): read_wav_bands, ("vision", "aedat4"): lambda spark, _: replay_sensor(spark), ("file", "aedat4"): lambda spark, _: replay_sensor(spark), ("vision", ""): lambda spark, _: live(spark), ("audio", ""): lambda spark, _: live(spark), ("imu", ""): lambda spark, _: live(spark)}


def parse_uri(uri: str) -> tuple[str, str, dict[str, str]]:
    u = urlsplit(uri)
    query = dict(parse_qsl(u.query))
    return u.scheme, query.get("path", u.netloc + u.path), query


def is_tensor(uri: str) -> bool:
    """Does the URI name a tensor file, by its ending or its format."""
    _, path, query = parse_uri(uri)
    return query.get("format") == "jsonl" or path.lower().endswith(".jsonl")


def open_source(spark: SparkSession, uri: str) -> DataFrame:
    """Events of scheme://path, by scheme and file name ending; tensor files are read under any scheme."""
    scheme, path, _ = parse_uri(uri)
    if is_tensor(uri):
        return tensor_events(*read_tensor(spark, path, default=0.0))
    tail = path.rpartition("/")[2]
    kind = tail.rpartition(".")[2].lower() if "." in tail else ""
    if (scheme, kind) not in SOURCES:
        raise EventError("sal.unsupported_source", uri)
    return SOURCES[scheme, kind](spark, path)


def normalize(spark: SparkSession, uri: str, out: str, host_ns: int | None = None) -> DataFrame:
    """Writes a source as a tensor file and gives its telemetry. Tensor files keep their header (a missing one is made up),
    order and all gaps; other sources are written in canonical order, and only gaps above 0 count."""
    from ..operators.aggregate import telemetry
    from .writers import normalize_tensor, write_tensor

    if is_tensor(uri):
        header, rows = read_tensor(spark, parse_uri(uri)[1], default=0.0)
        normalize_tensor(rows, out, header)
        return telemetry(tensor_events(header, rows), positive=False, host_ns=host_ns)
    events = open_source(spark, uri)
    pixels = events.where("x is not null").limit(1).count() > 0
    write_tensor(events, out, {**DEFAULT_HEADER, "dims": ["x", "y", "polarity"] if pixels else ["ch"]}, pixels)
    return telemetry(events, host_ns=host_ns)
