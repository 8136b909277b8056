"""Small state beside the scans, as JSON files: allow-lists, skip-lists, run history, baselines, manifests, settings.

Stores are read whole and written atomically by the driver; their files hold what people marked by hand or one row a
run, so they stay small. A missing or broken file counts as empty, but for a baseline, which must be there. Manifests
and results grow with the files scanned: they are Parquet, written by the executors.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import tempfile
import uuid
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from ..plans.model import AllowEntry

KEPT_RUNS = 50
MANIFEST = "rel_path string, mtime double, size long"


def read_json(path: str, default: Any) -> Any:
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return default
    return data if isinstance(data, type(default)) else default


def write_json(path: str, data: Any) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=False, indent=2)
    os.replace(name, path)


def now() -> str:
    return dt.datetime.now().isoformat(timespec="seconds")


def new_scan_id() -> str:
    return f"{dt.datetime.now():%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:8]}"


class AllowStore:
    """Entries (path_glob, rule_name); adding one that is there changes nothing."""

    def __init__(self, path: str):
        self.path = path

    def entries(self) -> list[AllowEntry]:
        rows = read_json(self.path, [])
        return [AllowEntry(**{k: v for k, v in r.items() if k in AllowEntry.__dataclass_fields__}) for r in rows if isinstance(r, dict) and r.get("path_glob")]

    def _write(self, entries: list[AllowEntry]) -> None:
        write_json(self.path, [asdict(e) for e in entries])

    def add(self, *entries: AllowEntry) -> int:
        """How many were new."""
        held = {(e.path_glob, e.rule_name): e for e in self.entries()}
        before = len(held)
        for e in entries:
            held.setdefault((e.path_glob, e.rule_name), e)
        self._write(list(held.values()))
        return len(held) - before

    def remove(self, path_glob: str, rule_name: str = "*") -> bool:
        old = self.entries()
        rest = [e for e in old if (e.path_glob, e.rule_name) != (path_glob, rule_name)]
        self._write(rest)
        return len(rest) < len(old)

    def remove_at(self, index: int) -> bool:
        old = self.entries()
        if not 0 <= index < len(old):
            return False
        self._write(old[:index] + old[index + 1 :])
        return True

    def clear(self) -> None:
        self._write([])

    def export_json(self, path: str) -> None:
        write_json(path, [asdict(e) for e in self.entries()])

    def import_json(self, path: str) -> int:
        return self.add(*AllowStore(path).entries())

    def mark_false_positive(self, path: str, rule_name: str = "*", archive_path: str | None = None) -> bool:
        """False for the entry of an archive, which can't be marked."""
        if archive_path:
            return False
        self.add(AllowEntry(path.replace(os.sep, "/"), rule_name or "*", source="runtime"))
        return True

    def effective(self, rules: tuple[AllowEntry, ...]) -> list[AllowEntry]:
        """The rule set's entries and the store's."""
        return list({(e.path_glob, e.rule_name): e for e in (*rules, *self.entries())}.values())


class SkipStore:
    """Paths that scans leave out."""

    def __init__(self, path: str):
        self.path = path

    def paths(self) -> list[str]:
        return sorted({p for p in read_json(self.path, []) if isinstance(p, str)})

    def add(self, *paths: str) -> None:
        write_json(self.path, sorted({*self.paths(), *paths}))

    def remove(self, *paths: str) -> None:
        write_json(self.path, sorted(set(self.paths()) - set(paths)))

    def __contains__(self, path: str) -> bool:
        return path in self.paths()

    def clear(self) -> None:
        write_json(self.path, [])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p,) for p in self.paths()], "path string")


class HistoryStore:
    """Runs (dicts with scan_id, workspace_id, finished_at, ...): the latest KEPT_RUNS of each workspace."""

    def __init__(self, path: str, most: int = KEPT_RUNS):
        self.path, self.most = path, most

    def all(self) -> list[dict]:
        rows = [r for r in read_json(self.path, []) if isinstance(r, dict) and r.get("scan_id")]
        return sorted(rows, key=lambda r: (r.get("finished_at", ""), r["scan_id"]))

    def add(self, entry: dict) -> None:
        held = {r["scan_id"]: r for r in self.all()}
        held[entry["scan_id"]] = entry
        by: dict[str, list[dict]] = {}
        for r in sorted(held.values(), key=lambda r: (r.get("finished_at", ""), r["scan_id"])):
            by.setdefault(r.get("workspace_id", ""), []).append(r)
        write_json(self.path, [r for rows in by.values() for r in rows[-self.most :]])

    def workspace(self, workspace_id: str, limit: int | None = None) -> list[dict]:
        """Latest first."""
        rows = [r for r in self.all() if r.get("workspace_id", "") == workspace_id][::-1]
        return rows[:limit] if limit is not None else rows

    def latest(self, workspace_id: str) -> dict | None:
        return next(iter(self.workspace(workspace_id, 1)), None)

    def previous(self, scan_id: str) -> dict | None:
        """The run before this one in its workspace."""
        rows = self.all()
        own = next((r for r in rows if r["scan_id"] == scan_id), None)
        earlier = [r for r in rows if own and r.get("workspace_id", "") == own.get("workspace_id", "") and rows.index(r) < rows.index(own)]
        return earlier[-1] if earlier else None

    def clear(self, workspace_id: str | None = None) -> None:
        write_json(self.path, [] if workspace_id is None else [r for r in self.all() if r.get("workspace_id", "") != workspace_id])


def compare_entries(current: dict, previous: dict | None, most: int = 50) -> dict:
    """What changed between two runs: hit paths new, resolved (at most ``most`` of each are listed) and persistent, rules, trend."""
    now_, before = set(current.get("hit_paths", [])), set((previous or {}).get("hit_paths", []))
    rules, old = set(current.get("rule_names", [])), set((previous or {}).get("rule_names", []))
    delta = current.get("matched_files", 0) - previous.get("matched_files", 0) if previous else 0
    return {
        "new_hits": sorted(now_ - before)[:most], "new_count": len(now_ - before),
        "resolved_hits": sorted(before - now_)[:most], "resolved_count": len(before - now_),
        "persistent_count": len(now_ & before), "new_rules": sorted(rules - old), "dropped_rules": sorted(old - rules), "delta": delta,
        "trend": "首次" if previous is None else "改善" if delta < 0 else "恶化" if delta > 0 else "持平",
    }


def build_manifest(files: DataFrame) -> DataFrame:
    """The fingerprint of every file that passed the filters."""
    return files.select("rel_path", "mtime", "size")


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """None where there is none, or none that can be read."""
    try:
        out = spark.read.parquet(path)
        return out.select(*[c.split()[0] for c in schema.split(", ")]) if schema else out
    except AnalysisException:
        return None


def save_baseline(stages: DataFrame, path: str) -> None:
    """stage, mean_ms, min_ms, max_ms, stddev_ms, n of a benchmark."""
    write_json(path, {"timestamp": now(), "stages": {r["stage"]: {k: v for k, v in r.asDict().items() if k != "stage"} for r in stages.collect()}, "meta": {}})


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        stages = json.load(f)["stages"]
    return spark.createDataFrame([(k, float(v["mean_ms"])) for k, v in stages.items()], "stage string, mean_ms double")


def history_frame(spark: SparkSession, store: HistoryStore) -> DataFrame:
    rows = [(r["scan_id"], r.get("workspace_id", ""), r.get("finished_at", ""), int(r.get("matched_files", 0))) for r in store.all()]
    return spark.createDataFrame(rows, "scan_id string, workspace_id string, finished_at string, matched_files long").withColumn("run", F.monotonically_increasing_id())
