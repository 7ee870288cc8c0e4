"""Declarative graphs of operators, folded into lazy DataFrames."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, correlate, spectral, state, stateless
from ..schema import EventError, time_ns

#: kind -> (input ports, parameters that are times, function of the ports' streams and the parameters)
KINDS: dict = {}


def operator(kind: str, ports: tuple[str, ...] = ("in",), times: tuple[str, ...] = ()):
    """Registers a function as an operator kind; this is the extension point for custom kinds."""

    def add(fn):
        KINDS[kind] = (ports, times, fn)
        return fn

    return add


operator("delay", times=("by",))(stateless.delay)
operator("exp_syn", times=("tau",))(stateless.synapse)
operator("xy_to_ch")(stateless.xy_to_channel)
operator("shift_xy")(stateless.shift_xy)
operator("fuse", ("a", "b"), ("window",))(correlate.fuse)
operator("lif", times=("tau_m", "refractory"))(state.lif)
operator("stft", times=("hop",))(spectral.stft)
operator("mel")(spectral.mel)
operator("threshold_events")(stateless.threshold)
operator("window_reduce_events", times=("window",))(aggregate.window_reduce)
operator("conv1d_events")(spectral.convolve_bands)
operator("probe")(lambda events: events)
operator("route")(lambda events, channels=None: events if channels is None else events.where(F.col("ch").isin(list(channels))))
operator("group")(lambda events: events)
operator("merge", ("a", "b"))(stateless.merge)
#: Other names under which documents call the same operators.
ALIASES = {"delay_line": "delay", "synapse_exp": "exp_syn", "spiking_neuron": "lif", "coincidence": "fuse", "probe_spike": "probe"}


@dataclass
class Node:
    kind: str
    params: dict = field(default_factory=dict)


@dataclass
class Graph:
    nodes: dict[str, Node] = field(default_factory=dict)
    edges: list[tuple[str, str, str]] = field(default_factory=list)  # from, to, port
    inputs: list[str] = field(default_factory=list)

    def add(self, name: str, kind: str, **params) -> Graph:
        kind = ALIASES.get(kind, kind)
        if kind not in KINDS:
            raise EventError("graph", f"unknown kind {kind}")
        if name in self.nodes:
            raise EventError("graph", f"node {name} is there already")
        self.nodes[name] = Node(kind, params)
        return self

    def connect(self, source: str, target: str, port: str = "in") -> Graph:
        if source not in self.nodes or target not in self.nodes:
            raise EventError("graph", f"edge {source} -> {target} has an end that is no node")
        if port not in KINDS[self.nodes[target].kind][0]:
            raise EventError("graph", f"{target} has no port {port}")
        if any(e[1:] == (target, port) for e in self.edges):
            raise EventError("graph", f"port {target}.{port} is wired twice")
        self.edges.append((source, target, port))
        return self

    def order(self) -> list[str]:
        sorter = TopologicalSorter({n: [a for a, b, _ in self.edges if b == n] for n in self.nodes})
        try:
            return list(sorter.static_order())
        except CycleError as e:
            raise EventError("graph", f"cycle detected: {' -> '.join(e.args[1])}") from None

    def validate(self) -> list[str]:
        """Order, then every parameter declared as a time must parse."""
        out = self.order()
        for name, node in self.nodes.items():
            for p in KINDS[node.kind][1]:
                if p in node.params:
                    try:
                        time_ns(node.params[p])
                    except ValueError:
                        raise EventError("graph", f"{name}.{p} is no time: {node.params[p]!r}") from None
        return out

    def run(self, **streams: DataFrame) -> dict[str, DataFrame]:
        """All nodes' streams, lazily. An input feeds the ports of its node that no edge feeds."""
        made: dict[str, DataFrame] = {}
        for name in self.validate():
            ports, _, fn = KINDS[self.nodes[name].kind]
            given = {p: a for a, b, p in self.edges if b == name}
            feed = []
            for p in ports:
                if p in given:
                    feed.append(made[given[p]])
                elif name in streams:
                    feed.append(streams[name])
                else:
                    raise EventError("graph", f"nothing feeds {name}.{p}")
            made[name] = fn(*feed, **self.nodes[name].params)
        return made

    def metrics(self, streams: dict[str, DataFrame], made: dict[str, DataFrame], timed: bool = False) -> DataFrame:
        """A row a node: kind, events in (over all its ports) and out and, if timed, the seconds that its stream takes from
        the inputs on (streams are lazy, so a node's time holds that of the nodes before it)."""
        counts = None
        for name, df in [*made.items(), *((f"\0{k}", v) for k, v in streams.items())]:
            n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stream"), "n")
            counts = n if counts is None else counts.union(n)
        spark, feeds = counts.sparkSession, []
        for name, node in self.nodes.items():
            given = {p: a for a, b, p in self.edges if b == name}
            feeds += [(name, node.kind, given.get(p, f"\0{name}")) for p in KINDS[node.kind][0]]
        seconds = {}
        for name in self.order() if timed else []:
            began = time.perf_counter()
            made[name].write.format("noop").mode("overwrite").save()
            seconds[name] = time.perf_counter() - began
        table = spark.createDataFrame([(n, k, f, seconds.get(n)) for n, k, f in feeds], "node string, kind string, stream string, wall_time_s double")
        fed = table.join(F.broadcast(counts), "stream").groupBy("node", "kind", "wall_time_s").agg(F.sum("n").alias("in_events"))
        return fed.join(F.broadcast(counts.select(F.col("stream").alias("node"), F.col("n").alias("out_events"))), "node").select("node", "kind", "in_events", "out_events", "wall_time_s")

    def run_fixed(self, dt, keep_channel: bool = False, **streams: DataFrame) -> dict[str, DataFrame]:
        """Buckets the inputs to steps of dt first; channels are lost in that unless kept."""

        def step(s: DataFrame) -> DataFrame:
            if not keep_channel:
                return aggregate.bucket_sum(s, dt)
            return aggregate.window_reduce(s, dt).withColumn("t_ns", F.col("t_ns") + time_ns(dt))

        return self.run(**{k: step(s) for k, s in streams.items()})

    def to_json(self) -> str:
        return json.dumps({"version": "0.1", "nodes": {n: asdict(x) for n, x in self.nodes.items()}, "edges": self.edges, "inputs": self.inputs}, indent=1)

    @staticmethod
    def from_json(text: str) -> Graph:
        raw, g = json.loads(text), Graph()
        for n, x in raw["nodes"].items():
            g.add(n, x["kind"], **x["params"])
        for a, b, p in raw["edges"]:
            g.connect(a, b, p)
        g.inputs = raw.get("inputs", [])
        return g


def trace(made: dict[str, DataFrame]) -> DataFrame:
    """The nodes' streams as one table with a node column."""
    out = None
    for name, df in made.items():
        rows = df.select(F.lit(name).alias("node"), "t_ns", "seq", "ch", F.col("val").cast("double").alias("val"))
        out = rows if out is None else out.union(rows)
    return out
