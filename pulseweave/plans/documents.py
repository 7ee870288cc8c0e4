"""Graph documents lowered to graphs: nodes to operators, edge weights and delays to operators between, probes to streams."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate
from ..schema import EventError
from .artifacts import check_graph
from .graph import ALIASES, KINDS, Graph

#: Endings of the parameters that are times.
TIME_ENDINGS = {"_ns": "ns", "_us": "us", "_ms": "ms", "_s": "s"}
#: Parameters of documents by operator, and what the operator calls them; others are notes and not passed on.
NAMES = {
    "lif": {"tau": "tau_m", "tau_m": "tau_m", "v_th": "v_th", "v_reset": "v_reset", "r_m": "r_m", "refractory": "refractory"},
    "exp_syn": {"weight": "weight", "tau": "tau"},
    "delay": {"delay": "by", "by": "by"},
    "fuse": {"window": "window", "min_count": "min_count"},
    "window_reduce_events": {"window": "window", "agg": "how", "how": "how"},
    "threshold_events": {"thr": "least", "least": "least"},
    "conv1d_events": {"bands": "bands", "stride": "stride", "kernel": "kernel"},
    "stft": {"n_fft": "n_fft", "hop": "hop", "sample_rate": "sample_rate", "window": "window"},
    "mel": {"n_fft": "n_fft", "sample_rate": "sample_rate", "n_mels": "n_mels", "log": "log"},
    "xy_to_ch": {"width": "width", "height": "height"},
    "shift_xy": {"dx": "dx", "dy": "dy", "width": "width", "height": "height"},
    "route": {"channels": "channels"},
}
#: What a node without an op does, by kind.
DEFAULT_OPS = {"delay_line": "delay", "group": "group", "route": "route", "probe": "probe"}


def _parameters(kind: str, given: dict) -> dict:
    names = NAMES.get(kind)
    out = {}
    for key, value in given.items():
        stem, unit = next(((key[: -len(e)], u) for e, u in TIME_ENDINGS.items() if key.endswith(e)), (key, None))
        if names is None:  # a custom kind takes its parameters as they are
            out[key] = value
        elif unit and stem in names:
            out[names[stem]] = f"{value} {unit}"
        elif key in names:
            out[names[key]] = value
    return out


def lower(doc: dict) -> Graph:
    """The graph of a document. Several edges into one port are merged; nodes that no edge feeds are its inputs.

    An edge names its port as dst "node.port"; else the edges into a node with two ports fill them in turn. A node of
    kind probe reads the node named as its target if no edge feeds it. Unknown operators are refused."""
    if faults := check_graph({**doc, "edges": [{**e, "src": e["src"].partition(".")[0], "dst": e["dst"].partition(".")[0]} for e in doc.get("edges", [])]}):
        raise EventError("eir", "; ".join(faults))
    g, feeds = Graph(), {}
    for n in doc["nodes"]:
        op = n.get("op") or DEFAULT_OPS.get(n["kind"])
        kind = ALIASES.get(op, op)
        if kind not in KINDS:
            raise EventError("eir", f"{n['id']}: no operator {op}")
        g.add(n["id"], kind, **_parameters(kind, {} if n["kind"] == "probe" else n.get("params", {})))
        if n["kind"] == "probe" and (target := n.get("params", {}).get("target")) and not any(e["dst"].partition(".")[0] == n["id"] for e in doc["edges"]):
            feeds.setdefault((n["id"], "in"), []).append(target)
    turns: dict[str, int] = {}
    for i, e in enumerate(doc["edges"]):
        (at, _, _), (to, _, port) = e["src"].partition("."), e["dst"].partition(".")
        ports = KINDS[g.nodes[to].kind][0]
        if not port:
            port = ports[turns.get(to, 0) % len(ports)]
            turns[to] = turns.get(to, 0) + 1
        if e.get("weight", 1) != 1:
            g.add(f"edge {i} weight", "exp_syn", weight=e["weight"]).connect(at, f"edge {i} weight")
            at = f"edge {i} weight"
        if e.get("delay_us"):
            g.add(f"edge {i} delay", "delay", by=f"{e['delay_us']} us").connect(at, f"edge {i} delay")
            at = f"edge {i} delay"
        feeds.setdefault((to, port), []).append(at)
    for (to, port), sources in feeds.items():
        at = sources[0]
        for k, other in enumerate(sources[1:]):
            name = f"{to}.{port} merge {k}"
            g.add(name, "merge").connect(at, name, "a").connect(other, name, "b")
            at = name
        g.connect(at, to, port)
    fed = {b for _, b, _ in g.edges}
    g.inputs = [n for n in g.nodes if n not in fed]
    g.validate()
    return g


def run_document(doc: dict, streams: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The streams of a document's nodes, and of its probes as "probe NAME". In fixed-step mode inputs are reduced to steps first."""
    g, time = lower(doc), doc["time"]
    if missing := [n for n in g.inputs if n not in streams]:
        raise EventError("eir", f"nothing feeds {', '.join(missing)}")
    made = g.run_fixed(f"{time['fixed_step_dt_us']} us", True, **streams) if time["mode"] == "fixed_step" else g.run(**streams)
    out = dict(made)
    for p in doc.get("probes", []):
        targets = [n["id"] for n in doc["nodes"] if fnmatchcase(n["id"], p["target"])]
        if not targets:
            raise EventError("eir", f"probe {p['id']} has no target {p['target']}")
        rows = None
        for t in targets:
            seen = made[t].select("t_ns", "seq", F.col("ch").cast("int").alias("ch"), F.col("val").cast("double").alias("val"))
            rows = seen if rows is None else rows.union(seen)
        if p.get("type") == "rate" and p.get("window_us"):  # events by channel and window
            rows = aggregate.window_reduce(rows.withColumn("val", F.lit(1.0)), f"{p['window_us']} us")
        out[f"probe {p['id']}"] = rows
    return out
