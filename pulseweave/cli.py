"""Command line: python -m pulseweave.cli COMMAND. Exit codes: 0 fine, 1 invalid, 2 usage or files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators import aggregate, compare
from .plans import artifacts
from .schema import EventError
from .sources import readers, writers


def _session() -> SparkSession:
    return SparkSession.builder.appName("pulseweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pulseweave")
    sub = p.add_subparsers(dest="cmd", required=True)
    sub.add_parser("version")
    sub.add_parser("list-backends")
    for name in ("validate-eir", "validate-event", "validate-trace", "validate-dcd", "profile", "trace-stats"):
        sub.add_parser(name).add_argument("path")
    q = sub.add_parser("validate-efpkg")
    q.add_argument("path")
    q.add_argument("--root", default=".")
    q = sub.add_parser("package")
    q.add_argument("folder")
    q.add_argument("--name", required=True)
    q.add_argument("--version", required=True)
    q.add_argument("--artifact", action="append", default=[], metavar="ROLE=PATH")
    q = sub.add_parser("build")
    q.add_argument("path")
    q.add_argument("--backend", default="auto")
    q.add_argument("--plan-out")
    q = sub.add_parser("run")
    q.add_argument("path")
    q.add_argument("--backend", default="auto")
    q.add_argument("--input", action="append", default=[])
    q.add_argument("--out", required=True)
    q.add_argument("--probes-out")
    q = sub.add_parser("sal-stream")
    q.add_argument("uri")
    q.add_argument("--out", required=True)
    q.add_argument("--telemetry-out")
    q = sub.add_parser("compare")
    q.add_argument("golden")
    q.add_argument("test")
    q.add_argument("--tol-time", type=float, default=1e-6)
    q.add_argument("--tol-val", type=float, default=1e-6)
    q = sub.add_parser("conformance")
    q.add_argument("cases")
    q.add_argument("--out", required=True)
    q = sub.add_parser("compare-traces")
    q.add_argument("golden")
    q.add_argument("candidate")
    q.add_argument("--eps-time-us", type=int, default=100)
    q.add_argument("--eps-numeric", type=float, default=1e-5)
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        out, ok = _run(a)
    except OSError as e:
        out, ok = {"error": str(e)}, None
    except EventError as e:
        out, ok = {"error": str(e)}, False
    print(json.dumps(out, default=str))
    return 2 if ok is None else int(not ok)


def _run(a) -> tuple[dict, bool]:
    load = lambda path: json.loads(open(path).read())
    if a.cmd == "version":
        return {"version": "0.1.0"}, True
    if a.cmd == "list-backends":
        return {"backends": list(artifacts.BACKENDS)}, True
    checks = {"validate-eir": artifacts.check_graph, "validate-dcd": artifacts.check_device}
    if a.cmd in checks:
        faults = checks[a.cmd](load(a.path))
        return {"faults": faults}, not faults
    if a.cmd == "validate-efpkg":
        faults = artifacts.check_package(a.root, load(a.path))
        return {"faults": faults}, not faults
    if a.cmd == "package":
        return artifacts.package(a.folder, a.name, a.version, dict(x.split("=", 1) for x in a.artifact)), True
    if a.cmd == "build":
        made = artifacts.plan(load(a.path), artifacts.BACKENDS["spark" if a.backend == "auto" else a.backend])
        if a.plan_out:
            with open(a.plan_out, "w") as f:
                json.dump(made, f, indent=1)
        return made, True
    spark = _session()
    if a.cmd in ("validate-event", "validate-trace"):
        open(a.path).close()
        faults = artifacts.check_tensor(spark, a.path)
        return {"faults": faults}, not faults
    if a.cmd in ("profile", "trace-stats"):
        header, rows = readers.read_tensor(spark, a.path, default=0.0)
        events = readers.tensor_events(header, rows)
        return {"header": header, **aggregate.profile(events).first().asDict(), "top": [r.asDict() for r in aggregate.top_channels(events).collect()]}, True
    if a.cmd == "run":
        return artifacts.compile_and_run(spark, load(a.path), a.input, a.out, () if a.backend == "auto" else (a.backend,), a.probes_out), True
    if a.cmd == "sal-stream":
        told = readers.normalize(spark, a.uri, a.out)
        return (writers.write_telemetry(told, a.telemetry_out) if a.telemetry_out else told.first().asDict()), True
    if a.cmd == "compare":
        sides = [readers.read_log(spark, x) for x in (a.golden, a.test)]
        found = compare.first_difference(*sides, a.tol_time, a.tol_val).first()
        return {"events": sides[0].count(), "difference": found.asDict() if found else None}, not found
    if a.cmd == "conformance":
        results = artifacts.conformance(spark, load(a.cases), a.out)
        return {"ok": all(results.values()), "results": results}, all(results.values())
    sides = [readers.read_tensor(spark, x, default=0.0) for x in (a.golden, a.candidate)]
    if sides[0][0]["units"]["time"] != sides[1][0]["units"]["time"]:
        return {"mismatches": [{"why": "time unit"}]}, False
    found = compare.trace_mismatches(*(artifacts.placed(r) for _, r in sides), a.eps_time_us, a.eps_numeric).collect()
    return {"mismatches": [r.asDict() for r in found]}, not found


if __name__ == "__main__":
    sys.exit(main())
