"""Short-time spectra, mel bands and band means as joins with small tables."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import hann, mel_filters
from ..schema import EventError, time_ns


def sample_index(rate: int) -> F.Column:
    """The sample nearest to t_ns, halves to even; seconds go apart from the rest, so real times neither overflow nor lose bits."""
    whole = F.expr(f"(t_ns - pmod(t_ns, 1000000000L)) div 1000000000L * {rate}L")
    odd = F.pmod(whole, F.lit(2))
    return whole - odd + F.rint(F.expr("pmod(t_ns, 1000000000L)") * F.lit(float(rate)) / F.lit(1e9) + odd).cast("long")


def _transformed(batches, n_fft: int, stride: int, per: int, weights: np.ndarray):
    """Magnitudes of the frames of each bucket; rows come bucket by bucket, by index and arrival (index null: none)."""
    bins = n_fft // 2 + 1

    def frames_of(bucket: int, last: int, at: np.ndarray, val: np.ndarray):
        first = bucket * per
        n = min(per, last - first + 1)
        if n <= 0:
            return
        x, at = np.zeros((per - 1) * stride + n_fft), at - first * stride
        on = np.append(at[1:] != at[:-1], True) & (at >= 0) & (at < len(x))  # the latest of equal indices
        x[at[on]] = val[on]
        for a in range(0, n, 256):
            f = np.arange(a, min(n, a + 256))
            mags = np.abs(np.fft.rfft(x[f[:, None] * stride + np.arange(n_fft)] * weights, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(first + f, bins)), pa.array(np.tile(np.arange(bins, dtype=np.int32), len(f))), pa.array(mags.ravel())], names=["frame", "k", "val"])

    key, held = None, []
    for b in batches:
        bucket, last = b.column("bucket").to_numpy(), b.column("last").to_numpy()
        known = ~b.column("i").is_null().to_numpy(zero_copy_only=False)
        at, val = b.column("i").fill_null(0).to_numpy(), b.column("val").fill_null(0.0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a == z:
                continue
            if held and key != (bucket[a], last[a]):
                yield from frames_of(*key, *map(np.concatenate, zip(*held, strict=True)))
                held = []
            key = (bucket[a], last[a])
            held.append((at[a:z][known[a:z]], val[a:z][known[a:z]]))
    if held:
        yield from frames_of(*key, *map(np.concatenate, zip(*held, strict=True)))


def stft(samples: DataFrame, n_fft: int = 256, hop="10 ms", sample_rate: int = 16000, window: str = "hann", skip_empty: bool = False) -> DataFrame:
    """Magnitudes of bins 0 to n_fft / 2 of each frame from sample 0 on that the samples reach the end of, at the frame's end.

    Frames are dealt in buckets; a sample goes to the buckets it lies in (two at a seam), and a bucket is transformed at
    once. Every bucket has a marker row, so that frames without a sample are given with magnitudes of 0; with
    `skip_empty` buckets without any sample are left out, as a stream that begins far from time 0 needs. Of samples at
    one index the latest counts, null is 0, samples before time 0 are ignored.
    """
    stride = max(1, round(time_ns(hop) * sample_rate / 1e9))
    if n_fft < 1 or sample_rate < 1:
        raise EventError("stft", "n_fft and sample_rate must be positive")
    bins, per = n_fft // 2 + 1, max(-(-n_fft // stride), min(256, max(1, (1 << 18) // stride)))
    w = np.array(hann(n_fft) if window == "hann" else [1.0] * n_fft)
    at = samples.select(sample_index(sample_rate).alias("i"), F.coalesce("val", F.lit(0.0)).alias("val"), "seq").where("i >= 0")
    last = at.agg(F.max("i").alias("top")).where(f"top >= {n_fft - 1}").select(F.expr(f"(top - {n_fft - 1}) div {stride}").alias("last"))
    low = F.expr(f"greatest(0, (i - {n_fft - 1} + {stride - 1}) div {stride}) div {per}")
    rows = at.withColumn("bucket", F.explode(F.sequence(low, F.greatest(low, F.expr(f"i div {stride} div {per}")))))
    rows = rows.select("bucket", "i", "seq", "val")
    if not skip_empty:
        coarse = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {per} div 4096"))).alias("c"), F.expr(f"last div {per}").alias("end"))
        marks = coarse.repartition("c").select(F.explode(F.sequence(F.col("c") * 4096, F.least(F.col("c") * 4096 + 4095, "end"))).alias("bucket"))
        rows = rows.union(marks.select("bucket", F.lit(None).cast("long"), F.lit(-1).cast("long"), F.lit(None).cast("double")))
    rows = rows.crossJoin(F.broadcast(last)).repartition("bucket").sortWithinPartitions("bucket", "i", "seq")  # last is one row
    out = rows.mapInArrow(partial(_transformed, n_fft=n_fft, stride=stride, per=per, weights=w), "frame long, k int, val double")
    end = F.col("frame") * stride + n_fft
    t = F.expr(f"(frame * {stride} + {n_fft}) div {sample_rate}") * F.lit(1_000_000_000) + F.rint(F.pmod(end, F.lit(sample_rate)) * F.lit(1e9) / F.lit(float(sample_rate))).cast("long")
    return out.select(t.alias("t_ns"), (F.col("frame") * bins + F.col("k")).alias("seq"), F.col("k").alias("ch"), "val", F.lit("mag").alias("unit"))


def mel(spectrum: DataFrame, n_fft: int = 256, sample_rate: int = 16000, n_mels: int = 32, log: bool = True) -> DataFrame:
    """Mel energies of every frame (equal t_ns), all bands given; of a bin given twice the later counts."""
    spark = spectrum.sparkSession
    weights = spark.createDataFrame(mel_filters(n_fft, sample_rate, n_mels) or [(0, 0, 0.0)], "mel int, ch int, w double")
    rows = spectrum.where(f"ch between 0 and {n_fft // 2}").groupBy("t_ns", "ch").agg(F.max_by("val", "seq").alias("val"))
    sums = rows.join(F.broadcast(weights), "ch").groupBy("t_ns", "mel").agg(F.sum(F.col("val") * F.col("w")).alias("e"))
    frames = spectrum.select("t_ns").distinct().withColumn("mel", F.explode(F.sequence(F.lit(0), F.lit(n_mels - 1))))
    e = F.coalesce("e", F.lit(0.0))
    out = frames.join(sums, ["t_ns", "mel"], "left")
    return out.select("t_ns", F.col("mel").cast("long").alias("seq"), F.col("mel").alias("ch"), (F.ln(F.greatest(e, F.lit(1e-12))) if log else e).alias("val"), F.lit("mel").alias("unit"))


def band_mean(spectrum: DataFrame, bins: int, bands: int) -> DataFrame:
    """Means of equal slices of bins: slice b has the bins from b * bins / bands to the next."""
    edge = [int(b * bins / bands) for b in range(bands + 1)]
    spark = spectrum.sparkSession
    table = spark.createDataFrame([(k, b) for b in range(bands) for k in range(edge[b], edge[b + 1])], "ch int, band int")
    return spectrum.join(F.broadcast(table), "ch").groupBy("t_ns", "band").agg(F.avg("val").alias("val")).select("t_ns", F.col("band").alias("ch"), "val")


def mel_matrix(mels: DataFrame, n_mels: int) -> DataFrame:
    """A row a frame with an array of its bands, 0 where one is missing."""
    by = mels.groupBy("t_ns").agg(F.map_from_entries(F.collect_set(F.struct("ch", "val"))).alias("m"))
    return by.select("t_ns", F.transform(F.sequence(F.lit(0), F.lit(n_mels - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("bands"))


def frames(mels: DataFrame) -> DataFrame:
    return mels.agg(F.countDistinct("t_ns").alias("frames"))


#: Nanojoules of a multiply-add and of an operation.
ENERGY_MODELS = {"arm": (0.03, 0.01), "laptop": (0.3, 0.05)}


def energy(n_frames: int, n_fft: int, n_mels: int, vad_in: int, kws_in: int, model: str) -> dict[str, float]:
    """Nanojoules by node of an always-on listener."""
    mac, op = ENERGY_MODELS[model]
    out = {"stft": n_frames * 5 * n_fft * math.log2(max(2, n_fft)) * mac, "mel": n_frames * n_mels * (n_fft // 2 + 1) * mac, "vad": vad_in * 4 * op, "kws": kws_in * 6 * op}
    return out | {"total": sum(out.values())}


def convolve(events: DataFrame, kernel: dict[int, float], stride: int = 1) -> DataFrame:
    """Weighted sums over neighbouring channels of one time: channel c gives kernel[d] times its value to (c - d) / stride."""
    taps = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(w)).alias("w")) for d, w in kernel.items()]))
    out = events.withColumn("tap", taps).withColumn("to", F.col("ch") - F.col("tap.d")).where(f"to >= 0 and to % {stride} = 0")
    return out.groupBy("t_ns", F.expr(f"to div {stride}").cast("int").alias("ch")).agg(F.sum(F.col("val") * F.col("tap.w")).alias("val"), F.min("seq").alias("seq")).select("t_ns", "seq", "ch", "val")


def convolve_bands(events: DataFrame, bands: int = 32, stride: int = 1, kernel: list[float] | None = None) -> DataFrame:
    """convolve() of the first `bands` channels by a kernel that is centred on its middle weight (none: each channel by itself)."""
    kernel = kernel or [1.0]
    return convolve(events.where(f"ch between 0 and {bands - 1}"), {i - len(kernel) // 2: w for i, w in enumerate(kernel)}, stride)
