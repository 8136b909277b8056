"""Changing files by what scans found: replacing, restoring, quarantine. The plans stay pure; files change only here.

Each file is written by the task that has its row, into a temporary file that then takes its place; its bytes before are
kept in a backup folder first. Entries of archives are left alone.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import Rule
from ..sources.extract import PLAIN, SOURCE

OUT = "path string, status string, replaced int, backup string"


def _backup(path: str, folder: str) -> str:
    """A free name in the folder for the file's copy."""
    os.makedirs(folder, exist_ok=True)
    base = os.path.join(folder, path.strip("/\\").replace("/", "__").replace("\\", "__").replace(":", "") + ".bak")
    name, n = base, 0
    while os.path.exists(name):
        n += 1
        name = f"{base}.{n}"
    shutil.copy2(path, name)
    return name


def replace_in_file(path: str, pairs: list[tuple[str, str]], backups: str) -> tuple[str, int, str]:
    """status (replaced, unchanged, missing, failed), how many texts were found, backup. Longest text first, literally."""
    pairs = sorted(pairs, key=lambda p: -len(p[0]))
    try:
        with open(path, "rb") as f:
            raw = f.read()
        new, found = raw, 0  # bytes, so that a file in another encoding keeps what isn't replaced
        for old, with_ in pairs:
            if old and old.encode() in new:
                new, found = new.replace(old.encode(), with_.encode()), found + 1
        if new == raw:
            return "unchanged", 0, ""
        kept = _backup(path, backups)
        handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
        with os.fdopen(handle, "wb") as f:
            f.write(new)
        shutil.copymode(path, name)
        os.replace(name, path)
        return "replaced", found, kept
    except FileNotFoundError:
        return "missing", 0, ""
    except OSError:
        return "failed", 0, ""


def replace_batch(results: DataFrame, rules: list[Rule], backups: str, override: str | None = None) -> DataFrame:
    """path, status, replaced, backup for each file with hits. Lazy: files change when the result is read; read it once.

    A rule's texts are replaced if it says so (all such rules must say by what, else the file is ``no_replacement``);
    with ``override`` every hit's texts are replaced by it. Files of other kinds than text are ``unsupported``.
    """
    by = {r.name: r.replace_with for r in rules if r.replace}
    kinds = PLAIN | SOURCE

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, inside, hits in zip(batch["path"], batch["archive_path"], batch["hits"], strict=True):
                wanted = [(h["rule_name"], t) for h in hits for t in h["match_texts"] if override is not None or h["rule_name"] in by]
                if inside is not None:
                    rows.append((path, "archive", 0, ""))
                elif path.rpartition(".")[2].lower() not in kinds:
                    rows.append((path, "unsupported", 0, ""))
                elif not wanted:
                    rows.append((path, "skipped", 0, ""))
                elif override is None and any(by[n] is None for n, _ in wanted):
                    rows.append((path, "no_replacement", 0, ""))
                else:
                    rows.append((path, *replace_in_file(path, [(t, override if override is not None else by[n]) for n, t in wanted], backups)))
            yield pd.DataFrame(rows, columns=["path", "status", "replaced", "backup"])

    inside = F.col("archive_path") if "archive_path" in results.columns else F.lit(None).cast("string").alias("archive_path")
    return results.where(F.size("hits") > 0).select("path", inside, "hits").mapInPandas(run, OUT)


def roll_up(outcomes: DataFrame) -> DataFrame:
    """files and texts of each status."""
    return outcomes.groupBy("status").agg(F.count("*").alias("files"), F.sum("replaced").alias("texts"))


def restore(path: str, backup: str) -> bool:
    """Copy a backup back; False where it is gone."""
    try:
        shutil.copy2(backup, path)
    except OSError:
        return False
    return True


def restore_all(outcomes: list) -> int:
    """Undo a batch: how many files are as before."""
    return sum(restore(r["path"], r["backup"]) for r in outcomes if r["backup"])


def quarantine(path: str, root: str, folder: str, skip=None) -> str | None:
    """Copy a file under the folder by its place below root, and put it on the skip list; where it went, or None."""
    target = os.path.join(folder, os.path.relpath(path, root))
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.copy2(path, target)
    except OSError:
        return None
    if skip is not None:
        skip.add(path)
    return target
