"""Registered queries over the test tables, each with SQL of another shape that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import domains
from .operators import aggregate as A
from .operators import compare as X
from .operators import correlate as J
from .operators import spectral as S
from .operators import state as W
from .operators import stateless as P
from .plans import documents
from .plans.graph import trace
from .schema import as_events
from .sources import readers, writers
from .sources.shared import shared_path

HOUR = 3_600_000_000_000
QUERIES, SQL = {}, {}

#: The test tables as streams; the same expressions in both dialects but for the clock.
COLUMNS = {"seq": "event_id", "ch": "user_id % 32", "val": "value", "x": "user_id % 16", "y": "event_id % 16", "polarity": "case when event_type = 'error' then 1 else 0 end"}


def events(spark: SparkSession, sf_dir: str, kind: str | None = None, hours: bool = False) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    if kind:
        raw = raw.where(F.col("event_type") == kind)
    t = "unix_micros(cast(ts as timestamp)) * 1000"
    return as_events(raw, t_ns=f"{t} div {HOUR} * {HOUR}" if hours else t, **COLUMNS)


def sql_events(kind: str | None = None, hours: bool = False) -> str:
    t = "epoch_us(ts) * 1000"
    t = f"({t} // {HOUR} * {HOUR})" if hours else t
    cols = ", ".join(f"{v} as {k}" for k, v in COLUMNS.items())
    return f"(select {t} as t_ns, {cols} from events" + (f" where event_type = '{kind}'" if kind else "") + ")"


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _six(c):
    return F.round(c, 6)


EV = sql_events()


@query(f"select t_ns + 5000000 as t_ns, seq, ch, val from {EV}")
def delay(spark, d):
    return P.delay(events(spark, d), "5 ms").select("t_ns", "seq", "ch", "val")


@query(f"select t_ns, seq, round(val * 0.25, 6) as val from {EV}")
def synapse_weight(spark, d):
    return P.synapse(events(spark, d), 0.25).select("t_ns", "seq", _six("val").alias("val"))


@query(f"select t_ns, seq, y * 12 + x as ch, coalesce(val, 1.0) as val from {EV} where x < 12 and y < 10")
def xy_to_channel(spark, d):
    return P.xy_to_channel(events(spark, d), 12, 10).select("t_ns", "seq", F.col("ch").cast("long").alias("ch"), "val")


@query(f"select seq, least(greatest((ch // 8) - 1, 0), 3) * 8 + least(ch % 8 + 2, 7) as ch from {EV}")
def shift_xy(spark, d):
    return P.shift_xy(events(spark, d), 2, -1, 8, 4).select("seq", F.col("ch").cast("long").alias("ch"))


@query(f"select t_ns, seq, x, y, polarity, 1.0::double as val from {EV} where x between 0 and 9 and y between 0 and 7 and polarity between 0 and 1")
def sensor_bounds(spark, d):
    return P.in_bounds(events(spark, d), 10, 8).select("t_ns", "seq", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "polarity", "val")


@query(f"select seq, x, y from {EV} e where not exists (select 1 from {EV} f where f.x = e.x and f.y = e.y and f.val > 0 and f.seq < 20)")
def dead_pixel_mask(spark, d):
    ev = events(spark, d)
    return P.mask_pixels(ev, ev.where("val > 0 and seq < 20")).select("seq", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))


@query(f"select seq, round(case when polarity > 0 then val * 2.0 else val * 0.5 end, 6) as val from {EV}")
def polarity_balance(spark, d):
    return P.balance_polarity(events(spark, d), 2.0, 0.5).select("seq", _six("val").alias("val"))


@query(f"select seq, trunc(t_ns::double * (1 + 40 / 1e6))::bigint + 7 as t_ns from {EV}")
def clock_correct(spark, d):
    return P.correct_clock(events(spark, d), 40, 7).select("seq", "t_ns")


@query(f"select t_ns, seq, ch, val from {EV} where val >= 50")
def threshold(spark, d):
    return P.threshold(events(spark, d), 50.0).select("t_ns", "seq", "ch", "val")


@query(f"select t_ns, seq from {EV} where t_ns >= {HOUR} * 473400 and t_ns < {HOUR} * 473600")
def time_slice(spark, d):
    return P.time_slice(events(spark, d), 473400 * HOUR, 473600 * HOUR).select("t_ns", "seq")


@query(f"select t_ns, seq, val from {EV} where val is not null and not isnan(val) and not isinf(val)")
def finite_guard(spark, d):
    return P.finite(events(spark, d)).select("t_ns", "seq", "val")


def fuse_sql(a: str, b: str, window: int, least: int, keys: str = "", seqs: bool = True) -> str:
    """Counts by a join of every event with those not after it and not before its window."""
    k = f"{keys}, " if keys else ""
    same = "".join(f" and x.{c.strip()} = y.{c.strip()}" for c in keys.split(",")) if keys else ""
    own = ", ".join(f"x.{c.strip()}" for c in keys.split(",")) + ", " if keys else ""
    return (
        f"with e as (select 0 as src, {k}t_ns, seq from {a} union all select 1, {k}t_ns, seq from {b}), n as (select {own}x.src, x.t_ns, x.seq, count(*) filter (y.src = 0) as na, count(*) filter (y.src = 1) as nb "
        f"from e x join e y on y.t_ns between x.t_ns - {window} and x.t_ns and (y.t_ns < x.t_ns or y.src < x.src or (y.src = x.src and y.seq <= x.seq)){same} group by all) "
        f"select {k}t_ns, 1.0::double as val from n where na > 0 and nb > 0 and na + nb >= {least}"
    )


def _fused(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, "t_ns", F.col("val").cast("double").alias("val"))


@query(fuse_sql(sql_events("click"), sql_events("error"), 600 * 10**9, 3))
def fuse_click_error(spark, d):
    return _fused(J.fuse(events(spark, d, "click"), events(spark, d, "error"), "600 s", 3))


@query(fuse_sql(sql_events("click", True), sql_events("error", True), 2 * HOUR, 4))
def fuse_ties(spark, d):
    return _fused(J.fuse(events(spark, d, "click", True), events(spark, d, "error", True), 2 * HOUR, 4))


@query(fuse_sql(sql_events("click"), sql_events("error"), 24 * HOUR, 2, "ch"))
def fuse_by_channel(spark, d):
    return _fused(J.fuse(events(spark, d, "click"), events(spark, d, "error"), 24 * HOUR, 2, ("ch",)), "ch")


_FLOW = f"(select t_ns, seq, x, y, polarity from {sql_events(hours=True)} where x between 0 and 15 and y between 0 and 15)"
_COPIES = f"(select t_ns + {2 * HOUR} as t_ns, seq, x + s as x, y, polarity from {_FLOW}, (values (-1), (1)) v(s) where x + s between 0 and 15)"


@query("select distinct * from (" + fuse_sql(_FLOW, _COPIES, 6 * HOUR, 2, "x, y, polarity").replace(f"select 1, x, y, polarity, t_ns, seq from {_COPIES}", f"select 1, x, y, polarity, t_ns, row_number() over (order by t_ns, seq, x) as seq from {_COPIES}") + ")")
def optical_flow_keyed(spark, d):
    out = J.optical_flow(events(spark, d, hours=True), 16, 16, 6 * HOUR, HOUR, HOUR, 2)
    return out.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "polarity", "t_ns", F.col("val").cast("double").alias("val"))


@query(f"select (t_ns // {HOUR}) * {HOUR} + {HOUR} as t_ns, round(sum(val), 4) as val, count(*) as n from {EV} group by 1")
def bucket_sum(spark, d):
    ev = events(spark, d)
    n = ev.groupBy((F.floor(F.col("t_ns") / HOUR) * HOUR + HOUR).alias("t_ns")).agg(F.count("*").alias("n"))
    return A.bucket_sum(ev, HOUR).join(n, "t_ns").select("t_ns", F.round("val", 4).alias("val"), "n")


_UNSORTED = f"(select t_ns, val, row_number() over (order by val, seq) as seq from {EV})"


@query(f"with r as (select *, t_ns // {24 * HOUR} as step from {_UNSORTED}), m as (select *, row_number() over (order by seq) - row_number() over (partition by step order by seq) as run from r) select (step + 1) * {24 * HOUR} as t_ns, min(seq) as first_seq, round(sum(val), 4) as val from m group by step, run")
def bucket_runs(spark, d):
    from pyspark.sql import Window

    ev = events(spark, d).withColumn("seq", F.row_number().over(Window.orderBy("val", "seq")).cast("long"))
    runs = A.bucket_runs(ev, 24 * HOUR, 1000)
    sizes = ev.withColumn("step", F.floor(F.col("t_ns") / (24 * HOUR))).withColumn("start", F.coalesce((F.col("step") != F.lag("step").over(Window.orderBy("seq"))), F.lit(True))).where("start")
    firsts = sizes.withColumn("run", F.row_number().over(Window.orderBy("seq")).cast("long")).select(F.col("run").alias("seq"), F.col("seq").alias("first_seq"))
    return runs.join(firsts, "seq").select("t_ns", "first_seq", F.round("val", 4).alias("val"))


@query(f"select t_ns // {HOUR} * {HOUR} as t_ns, ch, max(val) as val from {EV} group by all")
def window_reduce(spark, d):
    return A.window_reduce(events(spark, d), HOUR, "max").drop("seq")


_LIF = """with recursive e as (select {key} as k, t_ns, seq, coalesce(val, 0) as val, row_number() over (partition by {key} order by t_ns, seq) as rn from {src}),
s as (select k, rn, t_ns, seq, {r} * val as v0, ({r} * val >= {th}) as hit, case when {r} * val >= {th} then {reset}::double else {r} * val end as v, case when {r} * val >= {th} then t_ns else -1000000000000000000 end as fired from e where rn = 1
union all select e.k, e.rn, e.t_ns, e.seq, s.v * pow(2.71828, -greatest(0, e.t_ns - s.t_ns)::double / {tau}) + {r} * e.val, e.t_ns - s.fired > {ref} and s.v * pow(2.71828, -greatest(0, e.t_ns - s.t_ns)::double / {tau}) + {r} * e.val >= {th},
case when e.t_ns - s.fired > {ref} and s.v * pow(2.71828, -greatest(0, e.t_ns - s.t_ns)::double / {tau}) + {r} * e.val >= {th} then {reset}::double else s.v * pow(2.71828, -greatest(0, e.t_ns - s.t_ns)::double / {tau}) + {r} * e.val end,
case when e.t_ns - s.fired > {ref} and s.v * pow(2.71828, -greatest(0, e.t_ns - s.t_ns)::double / {tau}) + {r} * e.val >= {th} then e.t_ns else s.fired end from s join e on e.k = s.k and e.rn = s.rn + 1)
select {out}t_ns, seq from s where hit"""


@query(_LIF.format(key="ch", src=EV, r=1.0, th=120.0, reset=0.0, tau=12 * HOUR, ref=HOUR, out="k as ch, "))
def lif_by_channel(spark, d):
    return W.lif(events(spark, d), 12 * HOUR, 120.0, 0.0, 1.0, HOUR, "ch").select(F.col("ch").cast("long").alias("ch"), "t_ns", "seq")


@query(_LIF.format(key="0", src=EV, r=0.5, th=60.0, reset=5.0, tau=2 * HOUR, ref=HOUR // 2, out=""))
def lif_whole_stream(spark, d):
    return W.lif(events(spark, d), 2 * HOUR, 60.0, 5.0, 0.5, HOUR // 2).select("t_ns", "seq")


_GAPS = f"(select t_ns - lag(t_ns) over (order by seq) as dt from {EV})"


@query(
    f"with g as (select round_even(dt / 1000.0, 0)::bigint as dt from {_GAPS} where dt > 0), s as (select list(dt order by dt) as l, count(*) as n from g), "
    "m as (select n as dt_count, l[round_even((n - 1) * 0.5, 0)::int + 1] as dt_p50_us, l[round_even((n - 1) * 0.95, 0)::int + 1] as dt_p95_us, l[round_even((n - 1) * 0.99, 0)::int + 1] as dt_p99_us, l[n // 2 + 1] as dt_median_us from s), "
    "j as (select list(abs(dt - dt_median_us) order by abs(dt - dt_median_us)) as l, count(*) as n from g, m), "
    "q as (select l[n // 2 + 1] as jitter_p50_us, l[floor(n * 0.95)::int + 1] as jitter_p95_us, l[floor(n * 0.99)::int + 1] as jitter_p99_us from j), "
    f"w as (select count(*) as count, round_even(min(t_ns) / 1000.0, 0)::bigint as ts_min_us, round_even(max(t_ns) / 1000.0, 0)::bigint as ts_max_us, max(t_ns) - min(t_ns) as sensor_duration_ns from {EV}) "
    "select *, round_even(sensor_duration_ns / 1000.0, 0)::bigint as duration_us, round(count / (round_even(sensor_duration_ns / 1000.0, 0) / 1e6), 6) as events_per_second, round((sensor_duration_ns - 5e15) / 5e15 * 1e6, 3) as drift_ppm_est from w, m, q"
)
def ingest_telemetry(spark, d):
    return A.telemetry(events(spark, d), host_ns=5 * 10**15).withColumn("events_per_second", _six("events_per_second")).withColumn("drift_ppm_est", F.round("drift_ppm_est", 3))


@query(f"with g as (select dt, row_number() over (order by dt) - 1 as r, count(*) over () as n from {_GAPS} where dt is not null), p as (select max(dt) filter (r = n // 2) as dt_p50, max(dt) filter (r = least(floor(n * 0.95), n - 1)) as dt_p95, round(avg(dt), 3) as dt_mean from g), w as (select count(*) as n, min(t_ns) as first_ns, max(t_ns) as last_ns, min(val) as val_min, max(val) as val_max, round(avg(coalesce(val, 0)), 6) as val_mean from {EV}) select * from w, p")
def stream_profile(spark, d):
    return A.profile(events(spark, d)).withColumn("val_mean", _six("val_mean")).withColumn("dt_mean", F.round("dt_mean", 3))


@query(f"select ch, count(*) as n, min(seq) as first_seq from {EV} group by ch order by n desc, first_seq limit 10")
def top_channels(spark, d):
    return A.top_channels(events(spark, d))


@query(f"select t_ns, seq from {EV} order by seq limit 25")
def read_first(spark, d):
    return A.first_events(events(spark, d), 25).select("t_ns", "seq")


@query(f"select t_ns // 1000 as ts, seq, val from {sql_events('click')} union all select t_ns // 1000, seq, val from {sql_events('error')}")
def canonical_merge(spark, d):
    both = P.merge(events(spark, d, "click"), events(spark, d, "error")).select(F.expr("t_ns div 1000").alias("ts"), F.array("ch").alias("idx"), "seq", "val")
    return P.canonical(both).select("ts", "seq", "val")


@query(f"with r as (select seq, t_ns, lag(t_ns) over (order by seq) as prev_ns from {_UNSORTED}) select * from r where t_ns < prev_ns")
def disorder(spark, d):
    from pyspark.sql import Window

    return A.disorder(events(spark, d).withColumn("seq", F.row_number().over(Window.orderBy("val", "seq")).cast("long")))


@query(f"with r as (select t_ns, seq, ch, row_number() over (partition by ch, t_ns // 1000000000 order by t_ns, seq) as rn from {sql_events(hours=True)}) select t_ns, seq, ch from r where rn <= 2")
def rate_limit(spark, d):
    return A.limit_rate(events(spark, d, hours=True), 2).select("t_ns", "seq", "ch")


@query(f"with r as (select t_ns, seq, row_number() over (partition by t_ns // {24 * HOUR} order by t_ns desc, seq desc) as rn from {EV}) select t_ns, seq from r where rn <= 7")
def overflow_drop_head(spark, d):
    return A.overflow(events(spark, d), 24 * HOUR, 7, "head").select("t_ns", "seq")


@query(f"with r as (select t_ns, seq, row_number() over (partition by t_ns // {24 * HOUR} order by t_ns, seq) as rn from {EV}) select t_ns, seq from r where rn <= 7")
def overflow_drop_tail(spark, d):
    return A.overflow(events(spark, d), 24 * HOUR, 7, "tail").select("t_ns", "seq")


@query(f"select round(regr_slope(h, t), 6) as slope, round(regr_intercept(h, t), 3) as offset, round((regr_slope(h, t) - 1) * 1e6, 1) as drift_ppm from (select seq::double as t, (seq * 1.5 + 3 + val * 0.01)::double as h from {EV})")
def clock_regression(spark, d):
    pairs = events(spark, d).select(F.col("seq").cast("double").alias("t_dev"), (F.col("seq") * 1.5 + 3 + F.col("val") * 0.01).alias("t_host"))
    return A.clock_fit(pairs).select(_six("slope").alias("slope"), F.round("offset", 3).alias("offset"), F.round("drift_ppm", 1).alias("drift_ppm"))


@query(f"with recursive v as (select val, row_number() over (order by seq) as rn from {EV}), e as (select rn, val as ema from v where rn = 1 union all select v.rn, 0.25 * v.val + 0.75 * e.ema from e join v on v.rn = e.rn + 1) select round(max_by(ema, rn), 6) as ema from e")
def moving_average(spark, d):
    return A.moving_average(events(spark, d), 0.25).select(_six("ema").alias("ema"))


@query(f"select t_ns // {HOUR} * {HOUR} as t_ns, count(distinct x * 100 + y) as active, count(*) as n from {EV} group by 1 having count(distinct x * 100 + y) > 0.06 * 256")
def flashes(spark, d):
    return A.flashes(events(spark, d), HOUR, 256, 0.06)


_BAND = f"(select t_ns, seq, ch, val, t_ns // {240 * HOUR} as step from {EV})"


@query(f"with m as (select ch, step, list(val order by val)[count(*) // 2 + 1] as med from {_BAND} group by all), o as (select b.*, med, abs(val - med) as off from {_BAND} b join m using (ch, step)), k as (select ch, step, list(off order by off)[count(*) // 2 + 1] as mad from o group by all) select t_ns, seq, ch, val, round(med, 6) as med, round(mad, 6) as mad from o join k using (ch, step) where val - med > 3 * mad")
def band_spikes(spark, d):
    return A.band_spikes(events(spark, d), 240 * HOUR, 3.0).select("t_ns", "seq", F.col("ch").cast("long").alias("ch"), "val", _six("med").alias("med"), _six("mad").alias("mad"))


@query(f"with g as (select ch, t_ns, seq, t_ns - lag(t_ns) over (partition by ch order by t_ns, seq) as dt from {EV}), s as (select ch, avg(dt) as m, stddev_pop(dt) as sd from g where dt is not null group by ch) select ch, t_ns, seq, dt from g join s using (ch) where abs(dt - m) > 4 * sd")
def odd_gaps(spark, d):
    return A.odd_gaps(events(spark, d), 4.0)


def _samples(spark, d) -> DataFrame:
    return as_events(spark.read.parquet(f"{d}/events.parquet"), t_ns="event_id * 1000000", seq="event_id", ch="0", val="value")


_SAMPLES = "(select event_id as i, value as val from events)"
_STFT = f"""select ((f * 32 + 64) * 1000000)::bigint as t_ns, k as ch, round(sqrt(pow(sum(val * w * cos(2 * pi() * k * o / 64)), 2) + pow(sum(val * w * sin(2 * pi() * k * o / 64)), 2)), 4) as val
from (select f, i - f * 32 as o, val, 0.5 - 0.5 * cos(2 * pi() * (i - f * 32) / 63) as w from {_SAMPLES} s, range(0, (select (max(i) - 63) // 32 + 1 from {_SAMPLES})) r(f) where i between f * 32 and f * 32 + 63), range(0, 33) b(k) group by f, k"""


@query(_STFT)
def stft(spark, d):
    return S.stft(_samples(spark, d), 64, "32 ms", 1000).select("t_ns", F.col("ch").cast("long").alias("ch"), F.round("val", 4).alias("val"))


_BINS = "(select vec_id as t_ns, unnest(embedding)::double as val, unnest(range(0, len(embedding))) as ch from embeddings)"


def _bins(spark, d) -> DataFrame:
    raw = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("t_ns"), F.posexplode("embedding").alias("ch", "val"))
    return raw.select("t_ns", F.col("ch").cast("long").alias("seq"), "ch", F.abs(F.col("val").cast("double")).alias("val"))


def sql_filters(n_fft: int, rate: int, mels: int) -> str:
    """Triangles over mel-spaced edges up to half the rate, from the formula."""
    edge = f"floor({n_fft + 1} * 700 * (pow(10, 2595 * log10(1 + {rate / 2} / 700) * i / {mels + 1} / 2595) - 1) / {rate})::int"
    return (
        f"(select l.i as m, k, case when k < c.b then (k - l.b) / coalesce(nullif(c.b - l.b, 0), 1)::double else (r.b - k) / coalesce(nullif(r.b - c.b, 0), 1)::double end as w "
        f"from (select i, {edge} as b from range(0, {mels + 2}) t(i)) l join (select i, {edge} as b from range(0, {mels + 2}) t(i)) c on c.i = l.i + 1 join (select i, {edge} as b from range(0, {mels + 2}) t(i)) r on r.i = l.i + 2, "
        f"range(0, {n_fft // 2 + 1}) q(k) where k between l.b and r.b)"
    )


@query(f"with e as (select t_ns, m, sum(abs(val) * w) as e from {_BINS} join {sql_filters(64, 8000, 12)} f on f.k = ch group by all) select t.t_ns, r.m as ch, round(ln(greatest(coalesce(e, 0), 1e-12)), 5) as val from (select distinct t_ns from {_BINS}) t cross join range(0, 12) r(m) left join e on e.t_ns = t.t_ns and e.m = r.m")
def mel_bands(spark, d):
    return S.mel(_bins(spark, d), 64, 8000, 12).select("t_ns", F.col("ch").cast("long").alias("ch"), F.round("val", 5).alias("val"))


@query(f"select t_ns, ch // 8 as ch, round(avg(abs(val)), 6) as val from {_BINS} where ch < 32 group by all")
def band_mean(spark, d):
    return S.band_mean(_bins(spark, d), 32, 4).select("t_ns", F.col("ch").cast("long").alias("ch"), _six("val").alias("val"))


@query(f"select t.t_ns, b.b as band, round(coalesce(max(abs(val)), 0.0), 6) as val from (select distinct t_ns from {_BINS}) t cross join range(0, 70) b(b) left join {_BINS} x on x.t_ns = t.t_ns and x.ch = b.b group by all")
def mel_matrix(spark, d):
    m = S.mel_matrix(_bins(spark, d), 70)
    return m.select("t_ns", F.posexplode("bands").alias("band", "val")).select("t_ns", F.col("band").cast("long").alias("band"), _six("val").alias("val"))


@query(f"select count(distinct t_ns) as frames from {_BINS}")
def mel_frames(spark, d):
    return S.frames(_bins(spark, d))


@query(f"select t_ns, (ch - s.d) // 2 as ch, round(sum(abs(val) * s.w), 5) as val from {_BINS}, (values (-1, 0.25), (0, 0.5), (1, 0.25)) s(d, w) where ch - s.d >= 0 and (ch - s.d) % 2 = 0 group by all")
def convolve(spark, d):
    return S.convolve(_bins(spark, d), {-1: 0.25, 0: 0.5, 1: 0.25}, 2).select("t_ns", F.col("ch").cast("long").alias("ch"), F.round("val", 5).alias("val"))


_PAIR = f"with g as (select seq as pos, t_ns // 1000 as ts, ch, val from {EV}), c as (select pos, ts + case when pos % 50 = 0 then 500 else 20 end as ts, case when pos % 70 = 1 then ch + 1 else ch end as ch, val + case when pos % 90 = 2 then 1 else 0 end as val from g where pos % 1000 <> 3)"


def _traces(spark, d):
    g = events(spark, d).select(F.col("seq").alias("pos"), F.expr("t_ns div 1000").alias("ts"), F.array("ch").alias("idx"), "val")
    c = g.where("pos % 1000 <> 3").select("pos", F.expr("ts + if(pos % 50 = 0, 500, 20)").alias("ts"), F.expr("array(if(pos % 70 = 1, idx[0] + 1, idx[0]))").alias("idx"), F.expr("val + if(pos % 90 = 2, 1, 0)").alias("val"))
    return g, c


@query(_PAIR + " select pos, case when c.pos is null then 'missing' when abs(g.ts - c.ts) > 100 then 'time' when g.ch <> c.ch then 'index' else 'value' end as why from g left join c using (pos) where c.pos is null or abs(g.ts - c.ts) > 100 or g.ch <> c.ch or abs(g.val - c.val) / greatest(1, abs(g.val)) > 1e-5 order by pos limit 20")
def trace_compare(spark, d):
    return X.trace_mismatches(*_traces(spark, d)).select("pos", "why")


@query(_PAIR + " select count(*) as compared, sum(case when c.pos is null or abs(g.ts - c.ts) > 100 or abs(g.val - c.val) > 0.5 then 1 else 0 end)::bigint as bad, bool_and(c.pos is not null and abs(g.ts - c.ts) <= 100 and abs(g.val - c.val) <= 0.5) as equal from g left join c using (pos)")
def trace_equivalent(spark, d):
    a, b = (t.select(F.lit("out").alias("node"), "pos", F.col("ts").alias("t_ns"), "val") for t in _traces(spark, d))
    return X.traces_equal(a, b, 100, 0.5)


@query("select event_id as pos, 'payload' as why from events where event_id >= 700 and abs((props::json->>'k')::double + 5) > 1e-6 order by event_id limit 1")
def log_compare(spark, d):
    raw = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("pos"), F.col("event_type").alias("type"), (F.col("event_id") / 10).alias("t_s"), F.from_json("props", "map<string,string>").alias("payload"))
    other = raw.withColumn("payload", F.when(F.col("pos") >= 700, F.create_map(F.lit("k"), F.lit("-5"))).otherwise(F.col("payload")))
    return X.first_difference(raw, other, 1e-6).select("pos", "why")


@query("select ((l_orderkey * 10 + l_linenumber) * 6 + c) as seq, c as ch, round(v, 4) as val, case when c < 3 then 'm/s^2' else 'rad/s' end as unit from (select l_orderkey, l_linenumber, unnest([0, 1, 2, 3, 4, 5]) as c, unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2, l_tax * 2]) as v from lineitem)")
def imu_unpivot(spark, d):
    raw = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("0L as t_ns", "l_orderkey * 10 + l_linenumber as row", "cast(l_quantity as double) ax", "cast(l_extendedprice as double) ay", "cast(l_discount as double) az", "cast(l_tax as double) gx", "cast(l_quantity * 2 as double) gy", "cast(l_tax * 2 as double) gz")
    return readers.unpivot_imu(raw).select("seq", "ch", F.round("val", 4).alias("val"), "unit")


@query("select i * 1000 as t_ns, i % 64 as x, (i // 64) % 64 as y, i % 2 as polarity from range(0, 1000) r(i)")
def sensor_replay(spark, d):
    return readers.replay_sensor(spark).select("t_ns", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "polarity")])


def _builder(name: str, sql: str, node: str = "out", inputs=None, **params):
    """Registers a ready-made graph over the event tables."""

    def run(spark, d):
        g = domains.BUILDERS[name](**params)
        streams = inputs(spark, d) if inputs else {g.inputs[0]: events(spark, d)}
        return g.run(**streams)[node].select("t_ns", F.col("val").cast("double").alias("val"))

    run.__name__ = f"graph_{name}" + (f"_{node}" if node != "out" else "")
    QUERIES[run.__name__], SQL[run.__name__] = run, sql


_PIX = lambda w, h, src=EV: f"(select t_ns, seq, y * {w} + x as ch from {src} where x < {w} and y < {h})"
_late = lambda src, by: f"(select t_ns + {by} as t_ns, seq from {src})"
for _name, _n in (("gesture_detect", 20), ("obstacle_avoidance", 3)):
    _builder(_name, fuse_sql(EV, EV, HOUR // 4, _n), window=HOUR // 4, min_count=_n)
for _name, _n in (("change_point", 2), ("spike_pattern_mining", 2)):
    _builder(_name, fuse_sql(EV, _late(EV, HOUR), HOUR, _n), window=HOUR, min_count=_n)
for _name, _n in (("hrv_index", 2), ("sleep_staging", 2), ("stress_index", 3)):
    _builder(_name, fuse_sql(EV, _late(EV, HOUR), HOUR, _n), window=HOUR)
_builder("bio_sequencer", fuse_sql(EV, _late(EV, HOUR), HOUR, 1), tempo=HOUR)
_builder("object_tracking", fuse_sql(_PIX(16, 16), _late(_PIX(16, 16), HOUR), HOUR, 2), window=HOUR, lag=HOUR, width=16, height=16)
_builder("corner_tracking", fuse_sql(_PIX(12, 12), _PIX(12, 12), HOUR, 2), window=HOUR, width=12, height=12)
for _node in ("flow_e", "flow_w"):
    _builder("optical_flow", fuse_sql(_PIX(16, 16), _late(_PIX(16, 16), HOUR), 2 * HOUR, 1), node=_node, window=2 * HOUR, lag=HOUR, width=16, height=16)
_builder("event_slam", fuse_sql(_PIX(16, 16), _late(EV, HOUR), HOUR, 2), inputs=lambda s, d: {"xy": events(s, d), "imu": events(s, d)}, imu_delay=HOUR, window=HOUR, width=16, height=16)
_builder("event_graphics", f"select t_ns, val from {EV}")


def _lif(src: str, th: float, tau: int, out: str = "t_ns, 1.0::double as val") -> str:
    return _LIF.format(key="0", src=src, r=1.0, th=th, reset=0.0, tau=tau, ref=2_000_000, out="").replace("select t_ns, seq from s", f"select {out} from s")


_builder("reflex_controller", _lif(EV, 120.0, HOUR), tau=HOUR, v_th=120.0)
_builder("anomaly_detector", _lif(EV, 150.0, 2 * HOUR), tau=2 * HOUR, threshold=150.0)
_ROUND = f"(select t_ns + {HOUR} as t_ns, seq, val from {EV})"
_builder("music_generator", _lif(_ROUND, 100.0, HOUR), node="spike_0", lag=HOUR, tau=HOUR, v_th=100.0)


@query(
    f"with recursive e as (select t_ns + {HOUR} as t_ns, coalesce(val, 0) as val, row_number() over (order by t_ns, seq) as rn from {EV}), "
    # state: time and potential of the first neuron, its last spike, and those of the second, which hears the spikes an hour later
    f"s as (select 0::bigint as rn, 0::bigint as t, 0.0::double as v, -1000000000000000000 as fired, 0::bigint as t2, 0.0::double as v2, -1000000000000000000 as fired2, false as hit2 "
    f"union all select a.rn, a.t, case when a.hit then 0.0 else a.v end, case when a.hit then a.t else a.fired end, case when a.hit then a.t else a.t2 end, case when not a.hit then a.v2 when a.w >= 1.05 and a.t - a.fired2 > 2000000 then 0.0 else a.w end, "
    f"case when a.hit and a.w >= 1.05 and a.t - a.fired2 > 2000000 then a.t else a.fired2 end, a.hit and a.w >= 1.05 and a.t - a.fired2 > 2000000 "
    f"from (select e.rn, e.t_ns as t, s.v * pow(2.71828, -greatest(0, e.t_ns - s.t)::double / {HOUR}) + e.val as v, s.fired, s.t2, s.v2, s.fired2, "
    f"e.t_ns - s.fired > 2000000 and s.v * pow(2.71828, -greatest(0, e.t_ns - s.t)::double / {HOUR}) + e.val >= 1.05 as hit, s.v2 * pow(2.71828, -greatest(0, e.t_ns - s.t2)::double / {HOUR}) + 1 as w from s join e on e.rn = s.rn + 1) a) "
    f"select t + {HOUR} as t_ns, 1.0::double as val from s where hit2"
)
def graph_music_generator_two_rounds(spark, d):
    g = domains.music_generator(lag=HOUR, tau=HOUR, v_th=1.05, rounds=2)
    return g.run(round_0=events(spark, d))["spike_1"].select("t_ns", F.col("val").cast("double").alias("val"))


_builder("always_on_bands", fuse_sql(EV, EV, HOUR, 5), node="vad", window=HOUR, min_count=5)
_builder("always_on_bands", _lif(EV, 130.0, HOUR), node="kws", tau=HOUR, v_th=130.0)

#: Graphs that begin with a spectrum, over the events' values as samples, a thousand a second.
_SOUND = {"n_fft": 64, "hop": "32 ms", "sample_rate": 1000}
_MAG = _STFT.replace("round(sqrt(", "sqrt((").replace(", 4) as val", ") as val")
_MEL = f"(select a.t_ns, a.m as seq, ln(greatest(coalesce(sum(x.val * f.w), 0), 1e-12)) as val from (select distinct t_ns, m from ({_MAG}) t, range(0, 12) r(m)) a left join {sql_filters(64, 1000, 12)} f on f.m = a.m left join ({_MAG}) x on x.t_ns = a.t_ns and x.ch = f.k group by all)"
_MEL_AT = "(select (f * 32 + 64) * 1000000 as t_ns, m as seq from range(0, (select (max(event_id) - 63) // 32 + 1 from events)) r(f), range(0, 12) q(m))"
_sound = lambda s, d: {"stft": _samples(s, d)}
for _name, _ms, _n in (("voice_activity", 40, 30), ("diarization", 70, 60), ("localization", 20, 4)):
    _builder(_name, fuse_sql(_MEL_AT, _MEL_AT, _ms * 10**6, _n), inputs=_sound, window=f"{_ms} ms", min_count=_n, n_mels=12, **_SOUND)
_builder("keyword_spotter", _lif(_MEL, 14.7, 10_000_000), inputs=_sound, tau="10 ms", v_th=14.7, n_mels=12, **_SOUND)
_builder("always_on", fuse_sql(_MEL_AT, _MEL_AT, 40 * 10**6, 30), node="vad", inputs=_sound, window="40 ms", min_count=30, n_mels=12, **_SOUND)
_builder("always_on", _lif(_MEL, 14.7, 10_000_000), node="kws", inputs=_sound, tau="10 ms", v_th=14.7, n_mels=12, **_SOUND)


@query(_STFT)
def graph_stft_frontend(spark, d):
    out = domains.stft_frontend(**_SOUND).run(stft=_samples(spark, d))["stft"]
    return out.select("t_ns", F.col("ch").cast("long").alias("ch"), F.round("val", 4).alias("val"))


@query(f"select t_ns, seq as ch, round(val, 4) as val from {_MEL}")
def graph_mel_frontend(spark, d):
    out = domains.mel_frontend(n_mels=12, **_SOUND).run(stft=_samples(spark, d))["mel"]
    return out.select("t_ns", F.col("ch").cast("long").alias("ch"), F.round("val", 4).alias("val"))


_STEPS = f"(select distinct t_ns // {HOUR} * {HOUR} + {HOUR} as t_ns, t_ns // {HOUR} as seq from {EV})"


@query(fuse_sql(_STEPS, _late(_STEPS, 2 * HOUR), 3 * HOUR, 4))
def graph_fixed_step(spark, d):
    g = domains.change_point(window=3 * HOUR, min_count=4)
    g.nodes["late"].params["by"] = 2 * HOUR
    return _fused(g.run_fixed(HOUR, **{"in": events(spark, d)})["out"])


@query(f"with n as (select count(*) as n from {EV}), f as (select count(*) as n from ({fuse_sql(EV, EV, HOUR, 5)})), l as (select count(*) as n from ({_lif(EV, 130.0, HOUR)})) select 'mel' as node, 'delay' as kind, n.n as in_events, n.n as out_events from n union all select 'vad', 'fuse', 2 * n.n, f.n from n, f union all select 'kws', 'lif', n.n, l.n from n, l")
def graph_metrics(spark, d):
    g, streams = domains.always_on_bands(window=HOUR, min_count=5, tau=HOUR, v_th=130.0), {"mel": events(spark, d)}
    return g.metrics(streams, g.run(**streams)).drop("wall_time_s")


#: Documents: steps of an hour, maxima, a threshold and a rate; channels weighed, delayed, convolved and watched.
_STEPPED = {"version": "0.1.0", "profile": "BASE", "time": {"unit": "ms", "mode": "fixed_step", "fixed_step_dt_us": 3_600_000_000}, "graph": {"name": "steps"},
    "nodes": [{"id": "win", "kind": "kernel", "op": "window_reduce_events", "params": {"window_ms": 86_400_000, "agg": "max"}}, {"id": "det", "kind": "kernel", "op": "threshold_events", "params": {"thr": 90.0}}, {"id": "out", "kind": "probe", "params": {"target": "det"}}],
    "edges": [{"src": "win", "dst": "det"}], "probes": [{"id": "p", "target": "det", "type": "rate", "window_us": 864_000_000_000}]}
_WEIGHED = {"version": "0.1.0", "profile": "BASE", "time": {"unit": "us", "mode": "exact_event"}, "graph": {"name": "weights"},
    "nodes": [{"id": "front", "kind": "kernel", "op": "conv1d_events", "params": {"bands": 32, "stride": 2, "kernel": [0.25, 0.5, 0.25]}}, {"id": "aside", "kind": "route", "params": {"channels": [1, 3]}}, {"id": "sum", "kind": "group"}],
    "edges": [{"src": "front", "dst": "sum", "weight": 0.2, "delay_us": 300}, {"src": "aside", "dst": "sum"}], "probes": [{"id": "p", "target": "s*"}]}


@query(f"with s as (select t_ns // {HOUR} * {HOUR} + {HOUR} as t_ns, ch, sum(val) as val from {EV} group by all), w as (select t_ns // {24 * HOUR} * {24 * HOUR} as t_ns, ch, max(val) as val from s group by all) select t_ns // {240 * HOUR} * {240 * HOUR} as t_ns, ch, count(*)::double as val from w where round(val, 6) >= 90 group by all")
def document_fixed_step(spark, d):
    made = documents.run_document(_STEPPED, {"win": events(spark, d).withColumn("val", _six("val"))})
    return made["probe p"].select("t_ns", F.col("ch").cast("long").alias("ch"), "val")


@query(f"select t_ns + 300000 as t_ns, (ch - k.d) // 2 as ch, round(0.2 * sum(val * k.w), 6) as val from {EV}, (values (-1, 0.25), (0, 0.5), (1, 0.25)) k(d, w) where ch - k.d >= 0 and (ch - k.d) % 2 = 0 group by all union all select t_ns, ch, round(val, 6) from {EV} where ch in (1, 3)")
def document_exact_event(spark, d):
    ev = events(spark, d)
    return documents.run_document(_WEIGHED, {"front": ev, "aside": ev})["probe p"].select("t_ns", F.col("ch").cast("long").alias("ch"), _six("val").alias("val"))


@query(f"select seq, x as i0, y as i1, polarity::bigint as i2, ch from {EV}")
def event_index(spark, d):
    pix = P.index_of(events(spark, d), True).select("seq", "ch", *[F.col("idx")[k].cast("long").alias(f"i{k}") for k in range(3)])
    one = P.index_of(events(spark, d), False).select("seq", F.col("idx")[0].cast("long").alias("ch"))
    return pix.drop("ch").join(one, "seq")


@query("select model, frames, round(s, 4) as stft, round(m, 4) as mel, round(v, 4) as vad, round(k, 4) as kws, round(s + m + v + k, 4) as total from (select model, f as frames, f * 5 * 256 * 8 * mac as s, f * 32 * 129 * mac as m, 700 * 4 * op as v, 900 * 6 * op as k from (values ('arm', 0.03::double, 0.01::double), ('laptop', 0.3::double, 0.05::double)) e(model, mac, op), (select count(*)::double as f from nation))")
def energy_model(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").count()
    rows = [{"model": m, "frames": float(n), **{k: round(v, 4) for k, v in S.energy(n, 256, 32, 700, 900, m).items()}} for m in S.ENERGY_MODELS]
    return spark.createDataFrame(rows, "model string, frames double, stft double, mel double, vad double, kws double, total double")


@query(f"select round_even(t_ns / 1000.0, 0)::bigint * 1000 as t_ns, x, y, polarity, val from {EV}")
def tensor_round_trip(spark, d):
    path = shared_path(spark)
    writers.write_tensor_folder(events(spark, d), path, pixels=True)
    head = {**readers.DEFAULT_HEADER, "dims": ["x", "y", "polarity"]}
    back = readers.tensor_events(head, readers.read_tensor(spark, path)[1])
    return back.select("t_ns", *[F.col(c).cast("long").alias(c) for c in ("x", "y")], "polarity", "val")


@query(f"select t_ns // 1000000 * 1000000 as t_ns, ch, val from {EV}")
def csv_round_trip(spark, d):
    path = shared_path(spark)
    events(spark, d).select(F.expr("t_ns div 1000000").alias("when"), F.col("ch").alias("lane"), F.col("val").alias("level")).write.csv(path, header=True)
    return readers.read_csv(spark, path, "when", "lane", "level", "ms").select("t_ns", F.col("ch").cast("long").alias("ch"), "val")


@query("select l_orderkey * 1000 as t_ns, ch, v as val from (select l_orderkey, unnest([0, 1, 2, 3, 4, 5]) as ch, unnest([l_quantity, l_extendedprice, l_discount, l_tax, 1.5, 2.5])::double as v from lineitem)")
def imu_csv_round_trip(spark, d):
    path = shared_path(spark)
    spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey * 1000 as t_ns", "l_quantity as ax", "l_extendedprice as ay", "l_discount as az", "l_tax as gx", "1.5D as gy", "2.5D as gz").write.csv(path, header=True)
    return readers.read_imu_csv(spark, path).select("t_ns", "ch", "val")


@query("select event_type as type, event_id / 10 as t_s, (props::json->>'k')::bigint as k, count(*) over () as n from events where event_type in ('click', 'error')")
def log_round_trip(spark, d):
    path = shared_path(spark)
    kind = F.when(F.col("event_type") == "click", "event").when(F.col("event_type") == "error", "deliver").otherwise("meta")
    raw = spark.read.parquet(f"{d}/events.parquet").select(kind.alias("type"), (F.col("event_id") / 10).alias("t_s"), F.from_json("props", "map<string,string>").alias("payload"))
    raw.select(F.to_json(F.struct("type", "t_s", "payload"))).write.text(path)
    back = readers.read_log(spark, path)
    n = back.agg((F.max("pos") + 1).alias("n"))  # positions are numbered without gaps
    kind = F.when(F.col("type") == "event", "click").otherwise("error")
    return back.crossJoin(F.broadcast(n)).select(kind.alias("type"), "t_s", F.col("payload")["k"].cast("long").alias("k"), "n")


@query(f"select 'late' as node, t_ns + {HOUR} as t_ns, seq, ch, val from {EV} union all select 'in', t_ns, seq, ch, val from {EV}")
def trace_round_trip(spark, d):
    g, path = domains.change_point(window=HOUR), shared_path(spark)
    made = g.run(**{"in": events(spark, d)})
    writers.write_trace(trace({k: made[k] for k in ("in", "late")}), path)
    return readers.read_trace(spark, path).select("node", "t_ns", "seq", F.col("ch").cast("long").alias("ch"), "val")


@query(f"select 'both' as part, count(*) as n from (select ch, t_ns // {24 * HOUR} as day from {sql_events('click')} intersect select ch, t_ns // {24 * HOUR} from {sql_events('error')}) union all select 'only', count(*) from (select ch, t_ns // {24 * HOUR} as day from {sql_events('click')} except select ch, t_ns // {24 * HOUR} from {sql_events('error')})")
def set_operations(spark, d):
    a, b = (events(spark, d, k).select("ch", F.expr(f"t_ns div {24 * HOUR}").alias("day")) for k in ("click", "error"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(a.intersect(b), "both").union(count(a.subtract(b), "only"))


@query(f"select t_ns, seq, x, y, polarity from {EV} order by t_ns, x, y, polarity, seq limit 500")
def pixel_order(spark, d):
    rows = events(spark, d).orderBy("t_ns", "x", "y", "polarity", "seq").limit(500)
    return rows.select("t_ns", "seq", *[F.col(c).cast("long").alias(c) for c in ("x", "y")], "polarity")
