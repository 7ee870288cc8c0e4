"""Checks of documents on the driver, capability planning, and running planned documents with Spark."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregate, stateless
from ..schema import EventError
from ..sources import readers, writers

#: Words that documents may use.
PROFILES = ("BASE", "REALTIME", "LEARNING", "LOWPOWER")
UNITS, MODES = ("ns", "us", "ms"), ("exact_event", "fixed_step")
NODE_KINDS = ("spiking_neuron", "synapse", "delay_line", "kernel", "group", "route", "probe", "custom")
NEEDS_OP = ("spiking_neuron", "synapse", "kernel")
DTYPES, LAYOUTS = ("f32", "f16", "i16", "u8"), ("coo", "block")

#: What the one backend can do, under the names documents ask for.
SPARK_DEVICE = {"name": "spark", "version": "0.1.0", "time_resolution_ns": 1, "deterministic_modes": list(MODES), "supported_ops": ["lif", "synapse_exp", "delay_line", "probe_spike", "conv1d_events", "window_reduce_events", "threshold_events"], "conformance_profiles": ["BASE", "REALTIME"], "overflow_behavior": "drop_tail"}


def check_graph(doc: dict) -> list[str]:
    """Faults of a graph document."""
    out = [f"missing {k}" for k in ("version", "profile", "time", "graph", "nodes", "edges") if k not in doc]
    if out:
        return out
    if not str(doc["version"]).startswith("0"):
        out.append(f"unsupported version {doc['version']}")
    if doc["profile"] not in PROFILES:
        out.append(f"unknown profile {doc['profile']}")
    time = doc["time"]
    if time.get("unit") not in UNITS or time.get("mode") not in MODES:
        out.append("time needs a known unit and mode")
    step = time.get("fixed_step_dt_us")
    if time.get("mode") == "fixed_step" and (not isinstance(step, int) or step < 1):
        out.append("fixed_step needs a positive fixed_step_dt_us")
    names = [n.get("id") for n in doc["nodes"]]
    out += [f"duplicate id {n}" for n in sorted({n for n in names if names.count(n) > 1}, key=str)]
    out += [f"{n.get('id')}: unknown kind {n.get('kind')}" for n in doc["nodes"] if n.get("kind") not in NODE_KINDS]
    out += [f"{n.get('id')}: needs an op" for n in doc["nodes"] if n.get("kind") in NEEDS_OP and not n.get("op")]
    return out + [f"edge end {e.get(k)} is no node" for e in doc["edges"] for k in ("src", "dst") if e.get(k) not in names]


def check_header(header: dict) -> list[str]:
    out = [f"missing {k}" for k in ("schema_version", "dims", "units", "dtype", "layout") if k not in header]
    if not out:
        if header["units"].get("time") not in UNITS:
            out.append("unknown time unit")
        if header["dtype"] not in DTYPES or header["layout"] not in LAYOUTS:
            out.append("unknown dtype or layout")
    return out


def check_tensor(spark: SparkSession, path: str, most: int = 20) -> list[str]:
    """Faults of a tensor file: its header, lines that are no rows, index lengths, times that go back."""
    header = readers.read_header(spark, path)
    out = check_header(header)
    lines = readers._lines(spark, path).where(~F.col("value").rlike(r'^\s*\{\s*"header"'))
    rows = lines.select(F.from_json("value", "ts bigint, idx array<int>, val double").alias("r"), "seq").select("r.*", "seq")
    bad = rows.where("ts is null or idx is null or val is null").count()
    if bad:
        out.append(f"{bad} lines lack ts, idx or val")
    wrong = rows.where(F.size("idx") != len(header.get("dims", []))).count()
    if wrong:
        out.append(f"{wrong} rows have an idx of another length than dims")
    back = aggregate.disorder(rows.select(F.col("ts").alias("t_ns"), "seq")).orderBy("seq").limit(most).collect()
    return out + [f"ts goes back from {r['prev_ns']} to {r['t_ns']}" for r in back]


def check_device(device: dict) -> list[str]:
    out = [f"missing {k}" for k in ("name", "version", "time_resolution_ns", "deterministic_modes", "supported_ops", "conformance_profiles") if k not in device]
    if not out:
        if not device["deterministic_modes"]:
            out.append("deterministic_modes is empty")
        if device["time_resolution_ns"] <= 0:
            out.append("time_resolution_ns must be positive")
        if (device.get("clock") or {}).get("deterministic_fixed_step_only") and "fixed_step" not in device["deterministic_modes"]:
            out.append("a fixed-step-only clock needs the fixed_step mode")
    return out


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def package(folder: str, name: str, version: str, artifacts: dict[str, str]) -> dict:
    """A manifest of files in the folder with their digests, checked before it is written."""
    out = {"name": name, "version": version, "artifacts": [{"role": r, "path": p, "sha256": file_digest(f"{folder}/{p}")} for r, p in sorted(artifacts.items())]}
    if faults := check_package(folder, out):
        raise EventError("package", "; ".join(faults))
    Path(folder, "package.json").write_text(json.dumps(out, indent=1))
    return out


def check_package(folder: str, manifest: dict) -> list[str]:
    out = [f"missing {k}" for k in ("name", "version", "artifacts") if k not in manifest]
    for a in manifest.get("artifacts", []):
        at = Path(folder, a["path"])
        if not at.is_file():
            out.append(f"{a['path']} is missing")
        elif file_digest(str(at)) != a["sha256"]:
            out.append(f"{a['path']} has another digest")
        elif a["role"] == "eir":
            out += check_graph(json.loads(at.read_text()))
    return out


def _asked(doc: dict, device: dict) -> dict:
    """What a document asks for beside what the device has, as the rules below read it."""
    time, clock = doc.get("time", {}), device.get("clock") or {}
    mode, tick, step = time.get("mode", "exact_event"), device["time_resolution_ns"] / 1000, time.get("fixed_step_dt_us")
    valid = isinstance(step, int) and step >= 1
    nearest = max(1, round(step / tick)) * tick if valid else 0.0
    policy, own = (doc.get("security") or {}).get("overflow_policy"), device.get("overflow_behavior")
    lacking = [{"id": n["id"], "op": n["op"]} for n in doc.get("nodes", []) if n.get("kind") in NEEDS_OP and n.get("op") and n["op"] not in device["supported_ops"]]
    return {
        "profile": doc.get("profile"), "profiles": device["conformance_profiles"], "mode": mode, "stepped": mode == "fixed_step", "step_valid": valid, "step": nearest,
        "error": abs(nearest - step) if mode == "fixed_step" and valid else tick / 2, "eps": time.get("epsilon_time_us", 100), "numeric": time.get("epsilon_numeric", 1e-5),
        "native_mode": mode in device["deterministic_modes"] and (mode == "fixed_step" or not clock.get("deterministic_fixed_step_only")),
        "policy": policy, "own": own, "replaced": bool(policy and own and policy != own), "lacking": lacking,
    }


#: Refusals: error name (fixed values), what must not hold, and the text; the first that applies is raised.
REFUSALS = [
    ("backend.unsupported_profile", lambda q: q["profile"] and q["profile"] not in q["profiles"], "{profile}"),
    ("backend.time_config_invalid", lambda q: q["stepped"] and not q["step_valid"], "fixed_step needs a positive fixed_step_dt_us"),
    ("backend.time_quantization_violation", lambda q: q["error"] > q["eps"], "{error} us is over epsilon {eps} us"),
]
#: Notes: what must hold, and the text; all that apply are given.
NOTES = [
    (lambda q: not q["native_mode"], "mode {mode} is emulated"),
    (lambda q: q["replaced"], "overflow policy {policy} is substituted by {own}"),
]


def plan(doc: dict, device: dict = SPARK_DEVICE) -> dict:
    """Negotiates a document with a device: refuses what cannot be met, notes what is emulated or substituted."""
    q = _asked(doc, device)
    for kind, applies, text in REFUSALS:
        if applies(q):
            raise EventError(kind, text.format(**q))
    return {
        "backend": device["name"], "mode": q["mode"], "dt_us": round(q["step"]) if q["stepped"] else None, "quantization_error_us": q["error"], "epsilons": {"time_us": q["eps"], "numeric": q["numeric"]},
        "graph": doc.get("graph", {}).get("name", "graph"), "nodes": [n.get("id") for n in doc.get("nodes", [])], "probes": doc.get("probes", []),
        "emulated": q["lacking"], "unsupported_ops": sorted({x["op"] for x in q["lacking"]}), "native": q["native_mode"] and not q["lacking"],
        "overflow": q["own"] if q["replaced"] else q["policy"], "warnings": [text.format(**q) for applies, text in NOTES if applies(q)],
    }


BACKENDS = {"spark": SPARK_DEVICE, "cpu-sim": {**SPARK_DEVICE, "name": "cpu-sim", "time_resolution_ns": 1000}, "gpu-sim": {**SPARK_DEVICE, "name": "gpu-sim", "time_resolution_ns": 1000}}


def run_documents(spark: SparkSession, planned: dict, inputs: list[str], out: str, unit: str = "us", doc: dict | None = None, probes_out: str | None = None) -> int:
    """Merges tensor files in canonical order into a golden trace; time units are converted. Returns the row count.

    With a document and `probes_out` its graph is run, too, the merged stream on every input node, and the streams of all
    nodes and probes are written there, a folder a node."""
    merged, header = None, None
    for path in inputs:
        if faults := check_tensor(spark, path):
            raise EventError("input", f"{path}: {faults[0]}")
        head, rows = readers.read_tensor(spark, path)
        events = readers.tensor_events(head, rows)
        header = header or head
        merged = events if merged is None else stateless.merge(merged, events)
    if merged is None:
        raise EventError("input", "no input")
    pixels = "x" in header["dims"]
    head = {**header, "units": {**header["units"], "time": unit}, "dtype": "f32", "metadata": {"backend": planned["backend"], "plan_mode": planned["mode"], "graph": planned["graph"]}}
    n = writers.write_tensor(merged, out, head, pixels)
    if doc is not None and probes_out:
        from .documents import lower, run_document
        from .graph import trace

        writers.write_trace(trace(run_document(doc, dict.fromkeys(lower(doc).inputs, merged))), probes_out)
    return n


def compile_and_run(spark: SparkSession, doc: dict, inputs: list[str], out: str, prefer: tuple[str, ...] = (), probes_out: str | None = None) -> dict:
    """Checks, plans and runs a document on the first backend that can, preferred ones first."""
    if faults := check_graph(doc):
        raise EventError("eir", "; ".join(faults))
    last: EventError | None = None
    for name in dict.fromkeys([*prefer, *BACKENDS]):
        try:
            planned = plan(doc, BACKENDS[name])
            return {"plan": planned, "rows": run_documents(spark, planned, inputs, out, doc=doc, probes_out=probes_out)}
        except EventError as e:
            last = e
    raise last


def placed(rows: DataFrame) -> DataFrame:
    """Rows with their position in seq order, for positional comparison: counted by stretches of seq, then within them."""
    part = rows.withColumn("part_", F.expr("seq div 1048576"))
    order = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    sizes = part.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(order), F.lit(0)).alias("base_"))
    inside = F.row_number().over(Window.partitionBy("part_").orderBy("seq"))
    return part.join(sizes, "part_").withColumn("pos", (F.col("base_") + inside - 1).cast("long")).select(*rows.columns, "pos")


def conformance(spark: SparkSession, cases: list[dict], out: str) -> dict[str, bool]:
    """Runs cases (name, uri, eir): each source is normalised, its document run on it twice, and the two traces compared.
    Writes a badge a case to the folder `out`."""
    from ..operators.compare import trace_mismatches

    results = {}
    for case in cases:
        folder = Path(out, case["name"])
        folder.mkdir(parents=True, exist_ok=True)
        norm, traces = str(folder / "input.jsonl"), [str(folder / f"{k}.jsonl") for k in ("golden", "candidate")]
        writers.write_telemetry(readers.normalize(spark, case["uri"], norm), str(folder / "telemetry.json"))
        doc = json.loads(Path(case["eir"]).read_text())
        for t in traces:
            compile_and_run(spark, doc, [norm], t)
        eps = doc["time"].get("epsilon_time_us", 100)
        results[case["name"]] = trace_mismatches(*(placed(readers.read_tensor(spark, t)[1]) for t in traces), eps, doc["time"].get("epsilon_numeric", 1e-5)).isEmpty()
    lines = [f"- {name}: {'pass' if ok else 'fail'}" for name, ok in results.items()]
    Path(out, "badges.md").write_text("\n".join(["# Conformance", "", *lines, ""]))
    return results
