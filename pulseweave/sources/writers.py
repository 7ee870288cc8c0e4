"""Sinks: tensor JSONL, telemetry, traces, bundles and a registry of packages."""

from __future__ import annotations

import json
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import UNIT_NS, EventError


def tensor_lines(events: DataFrame, pixels: bool, unit: str = "us") -> DataFrame:
    """JSON lines of events in canonical order; times are rounded half to even."""
    ts = F.rint(F.col("t_ns") / F.lit(float(UNIT_NS[unit]))).cast("long")
    idx = F.array("x", "y", "polarity") if pixels else F.array("ch")
    rows = events.select(ts.alias("ts"), idx.alias("idx"), F.col("val").cast("double").alias("val"), "seq")
    return rows.orderBy("ts", "idx", "seq").select(F.to_json(F.struct("ts", "idx", "val")).alias("value"))


def write_tensor(events: DataFrame, path: str, header: dict, pixels: bool = False) -> int:
    """One file for interchange: the header, then the rows in order, streamed through the driver without holding them. Gives the row count."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"header": header}) + "\n")
        for row in tensor_lines(events, pixels, header["units"]["time"]).toLocalIterator():
            f.write(row["value"] + "\n")
            n += 1
    return n


def normalize_tensor(rows: DataFrame, path: str, header: dict) -> None:
    """A tensor file passed through: its header, then its rows (ts, idx, val, seq) in their own order."""
    lines = rows.orderBy("seq").select(F.to_json(F.struct("ts", "idx", "val")).alias("value"))
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps({"header": header}) + "\n")
        for row in lines.toLocalIterator():
            f.write(row["value"] + "\n")


def write_tensor_folder(events: DataFrame, path: str, pixels: bool = False, unit: str = "us") -> None:
    """The rows as part files in order, for streams too large for one file."""
    tensor_lines(events, pixels, unit).write.text(path)


def write_telemetry(one_row: DataFrame, path: str) -> dict:
    out = one_row.first().asDict()
    Path(path).write_text(json.dumps(out, indent=1))
    return out


def write_trace(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy("node").json(path)


#: The files of a bundle.
REQUIRED = ("model.eir", "cap.json", "trace.json", "card.json")


def pack_bundle(folder: str, out: str) -> None:
    for name in REQUIRED:
        if not (Path(folder) / name).is_file():
            raise EventError("bundle", f"{name} is missing")
    with tarfile.open(out, "w:gz") as t:
        for p in sorted(Path(folder).iterdir()):
            t.add(p, arcname=p.name)


def unpack_bundle(path: str, folder: str) -> None:
    with tarfile.open(path) as t:
        t.extractall(folder, filter="data")


class Registry:
    """Packages by name and version in one JSON file; the latest is that of the greatest version numbers."""

    def __init__(self, root: str):
        self.file = Path(root) / "registry.json"
        self.held = json.loads(self.file.read_text()) if self.file.exists() else {}

    def add(self, name: str, version: str, path: str) -> None:
        self.held.setdefault(name, {})[version] = path
        self.file.parent.mkdir(parents=True, exist_ok=True)
        self.file.write_text(json.dumps(self.held, indent=1))

    def get(self, name: str, version: str | None = None) -> str:
        if name not in self.held:
            raise EventError("registry", f"no package {name}")
        versions = self.held[name]
        version = version or max(versions, key=lambda v: [(x.isdigit(), int(x) if x.isdigit() else 0, x) for x in v.split(".")])
        if version not in versions:
            raise EventError("registry", f"no version {version} of {name}")
        return versions[version]

    def list(self) -> list[tuple[str, str]]:
        return [(n, v) for n in sorted(self.held) for v in sorted(self.held[n])]

    def push_remote(self, *_):
        raise EventError("registry", "there is no remote registry")

    pull_remote = push_remote
