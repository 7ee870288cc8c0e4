"""Ready-made graphs. An input node is where the caller's stream goes."""

from __future__ import annotations

from ..plans.graph import Graph
from ..schema import EventError
from ..sources import readers


def _require(kind: str, **values) -> None:
    for name, v in values.items():
        if v <= 0:
            raise EventError(kind, f"{name} must be positive")


def _pair(window, min_count: int, lag="0 ms") -> Graph:
    """A stream against its own copy, later by lag."""
    g = Graph(inputs=["in"]).add("in", "delay", by="0 ms").add("late", "delay", by=lag).add("out", "fuse", window=window, min_count=min_count)
    return g.connect("in", "late").connect("in", "out", "a").connect("late", "out", "b")


def _twice(window, min_count: int) -> Graph:
    """A stream on both ports, so that every event counts twice."""
    g = Graph(inputs=["in"]).add("in", "delay", by="0 ms").add("out", "fuse", window=window, min_count=min_count)
    return g.connect("in", "out", "a").connect("in", "out", "b")


def _heard(g: Graph, n_fft: int, hop, sample_rate: int, n_mels: int) -> Graph:
    g.inputs.append("stft")
    return g.add("stft", "stft", n_fft=n_fft, hop=hop, sample_rate=sample_rate).add("mel", "mel", n_fft=n_fft, sample_rate=sample_rate, n_mels=n_mels).connect("stft", "mel")


def optical_flow(window="2 ms", min_count=1, lag="1 ms", width=128, height=128) -> Graph:
    g = Graph(inputs=["xy"]).add("xy", "xy_to_ch", width=width, height=height)
    for name, dx in (("e", 1), ("w", -1)):
        g.add(f"shift_{name}", "shift_xy", dx=dx, dy=0, width=width, height=height).add(f"late_{name}", "delay", by=lag).add(f"flow_{name}", "fuse", window=window, min_count=min_count)
        g.connect("xy", f"shift_{name}").connect(f"shift_{name}", f"late_{name}").connect("xy", f"flow_{name}", "a").connect(f"late_{name}", f"flow_{name}", "b")
    return g


def corner_tracking(window="5 ms", width=128, height=128) -> Graph:
    g = Graph(inputs=["xy"]).add("xy", "xy_to_ch", width=width, height=height).add("right", "shift_xy", dx=1, dy=0, width=width, height=height).add("up", "shift_xy", dx=0, dy=-1, width=width, height=height)
    g.add("out", "fuse", window=window, min_count=2)
    return g.connect("xy", "right").connect("xy", "up").connect("right", "out", "a").connect("up", "out", "b")


def gesture_detect(window="50 ms", min_count=20) -> Graph:
    _require("vision", min_count=min_count)
    return _twice(window, min_count)


def object_tracking(window="20 ms", lag="5 ms", width=128, height=128) -> Graph:
    g = Graph(inputs=["xy"]).add("xy", "xy_to_ch", width=width, height=height).add("late", "delay", by=lag).add("out", "fuse", window=window, min_count=2)
    return g.connect("xy", "late").connect("xy", "out", "a").connect("late", "out", "b")


def _sound_pair(window, min_count, n_fft, hop, sample_rate, n_mels) -> Graph:
    g = _heard(Graph(), n_fft, hop, sample_rate, n_mels).add("out", "fuse", window=window, min_count=min_count)
    return g.connect("mel", "out", "a").connect("mel", "out", "b")


def voice_activity(window="25 ms", min_count=3, n_fft=128, hop="10 ms", sample_rate=16000, n_mels=32) -> Graph:
    return _sound_pair(window, min_count, n_fft, hop, sample_rate, n_mels)


def diarization(window="250 ms", min_count=5, n_fft=128, hop="10 ms", sample_rate=16000, n_mels=32) -> Graph:
    return _sound_pair(window, min_count, n_fft, hop, sample_rate, n_mels)


def localization(window="20 ms", min_count=4, n_fft=128, hop="10 ms", sample_rate=16000, n_mels=32) -> Graph:
    return _sound_pair(window, min_count, n_fft, hop, sample_rate, n_mels)


def keyword_spotter(tau="10 ms", v_th=0.5, n_fft=128, hop="10 ms", sample_rate=16000, n_mels=32) -> Graph:
    return _heard(Graph(), n_fft, hop, sample_rate, n_mels).add("out", "lif", tau_m=tau, v_th=v_th).connect("mel", "out")


def stft_frontend(n_fft=256, hop="10 ms", sample_rate=16000) -> Graph:
    return Graph(inputs=["stft"]).add("stft", "stft", n_fft=n_fft, hop=hop, sample_rate=sample_rate)


def mel_frontend(n_fft=256, hop="10 ms", sample_rate=16000, n_mels=32) -> Graph:
    return _heard(Graph(), n_fft, hop, sample_rate, n_mels)


def _listener(g: Graph, bands: str, window, min_count, tau, v_th) -> Graph:
    g.add("vad", "fuse", window=window, min_count=min_count).add("kws", "lif", tau_m=tau, v_th=v_th)
    return g.connect(bands, "vad", "a").connect(bands, "vad", "b").connect(bands, "kws")


def always_on(window="25 ms", min_count=3, tau="10 ms", v_th=0.5, n_fft=128, hop="10 ms", sample_rate=16000, n_mels=32) -> Graph:
    return _listener(_heard(Graph(), n_fft, hop, sample_rate, n_mels), "mel", window, min_count, tau, v_th)


def always_on_bands(window="25 ms", min_count=3, tau="10 ms", v_th=0.5) -> Graph:
    return _listener(Graph(inputs=["mel"]).add("mel", "delay", by="0 ms"), "mel", window, min_count, tau, v_th)


def reflex_controller(tau="5 ms", v_th=0.5) -> Graph:
    _require("robotics", v_th=v_th)
    return Graph(inputs=["out"]).add("out", "lif", tau_m=tau, v_th=v_th)


def event_slam(width=128, height=128, imu_delay="2 ms", window="5 ms", min_count=2) -> Graph:
    g = Graph(inputs=["xy", "imu"]).add("xy", "xy_to_ch", width=width, height=height).add("imu", "delay", by=imu_delay).add("out", "fuse", window=window, min_count=min_count)
    return g.connect("xy", "out", "a").connect("imu", "out", "b")


def obstacle_avoidance(window="15 ms", min_count=3) -> Graph:
    _require("robotics", min_count=min_count)
    return _twice(window, min_count)


def anomaly_detector(threshold=2.0, tau="50 ms") -> Graph:
    _require("timeseries", threshold=threshold)
    return Graph(inputs=["out"]).add("out", "lif", tau_m=tau, v_th=threshold)


def change_point(window="200 ms", min_count=2) -> Graph:
    return _pair(window, min_count, window)


def spike_pattern_mining(window="50 ms", min_count=2) -> Graph:
    return _pair(window, min_count, window)


def hrv_index(window="1 s") -> Graph:
    return _pair(window, 2, window)


def sleep_staging(window="30 s") -> Graph:
    return _pair(window, 2, window)


def stress_index(window="60 s") -> Graph:
    return _pair(window, 3, window)


def bio_sequencer(tempo="500 ms") -> Graph:
    return _pair(tempo, 1, tempo)


def event_graphics() -> Graph:
    return Graph(inputs=["out"]).add("out", "delay", by="0 ms")


def music_generator(lag="100 ms", tau="20 ms", v_th=0.8, rounds: int = 1) -> Graph:
    """Feedback through a neuron is unrolled: each round feeds the spikes of the one before back in, later by lag."""
    g = Graph(inputs=["round_0"]).add("round_0", "delay", by=lag).add("spike_0", "lif", tau_m=tau, v_th=v_th).connect("round_0", "spike_0")
    for i in range(1, rounds):
        g.add(f"round_{i}", "delay", by=lag).add(f"spike_{i}", "lif", tau_m=tau, v_th=v_th).connect(f"spike_{i - 1}", f"round_{i}").connect(f"round_{i}", f"spike_{i}")
    return g


BUILDERS = {f.__name__: f for f in (optical_flow, corner_tracking, gesture_detect, object_tracking, voice_activity, keyword_spotter, diarization, localization, stft_frontend, mel_frontend, always_on, always_on_bands, reflex_controller, event_slam, obstacle_avoidance, anomaly_detector, change_point, spike_pattern_mining, hrv_index, sleep_staging, stress_index, bio_sequencer, event_graphics, music_generator)}


def run_file(spark, uri: str, builder: str, **params):
    """The streams of a ready-made graph with one input, fed from a source URI; `.wav` files give samples, not bands, to
    graphs that begin with a spectrum."""
    g = BUILDERS[builder](**params)
    if len(g.inputs) != 1:
        raise EventError("graph", f"{builder} has {len(g.inputs)} inputs")
    path = readers.parse_uri(uri)[1]
    samples = path.lower().endswith(".wav") and g.nodes[g.inputs[0]].kind == "stft"
    return g.run(**{g.inputs[0]: readers.read_wav(spark, path) if samples else readers.open_source(spark, uri)})
