"""One call from folders to a report: walk, filter, read and extract, scan, archives, incremental merge, allow-list, numbers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import report, scan, state, stores
from .plans.model import AllowEntry, RuleSet, needs_content
from .sources.extract import READERS, archive_entries, extract_text
from .sources.filewalk import walk_all, with_bytes

COLUMNS = ["root", "path", "rel_path", "name", "extension", "size", "mtime", "archive_path"]


@dataclass
class Report:
    """What a scan found. ``results`` holds a row per file and entry, with its hits."""

    root: str
    results: DataFrame
    stats: dict
    manifest: DataFrame | None = None
    stages: dict[str, float] = field(default_factory=dict)
    cancelled: bool = False

    def render(self, kind: str) -> str:
        """text, json, csv or sarif, as one document; anything else is text."""
        if kind == "json":
            return report.json_report(self.results, self.root, self.stats, self.cancelled)
        if kind == "csv":
            return report.csv_report(self.results)
        return report.sarif(self.results) if kind == "sarif" else report.text_report(self.results, self.root, self.stats)

    def history_entry(self, workspace_id: str = "") -> dict:
        hit = self.results.where(F.size("hits") > 0)
        return {
            "scan_id": stores.new_scan_id(), "workspace_id": workspace_id, "finished_at": stores.now(), **self.stats,
            "hit_paths": sorted(r["path"] for r in hit.select("path").toLocalIterator()),
            "rule_names": [r["rule_name"] for r in scan.report_rules(self.results).collect()],
        }


class Scanner:
    """Rules and how to scan by them. Parameters that are None are the rule set's, or none.

    extractors: further ones by extension; readers: further archive readers; content: an expression for a file's text in
    place of all of them.
    """

    def __init__(
        self, spark: SparkSession, rules: RuleSet, *, max_depth: int | None = None, max_file_size: int | None = None, extensions: tuple[str, ...] | None = None,
        ignore_dirs: tuple[str, ...] = (), follow_symlinks: bool = False, scan_archives: bool | None = None, archive_password: str | None = None,
        allow: list[AllowEntry] | None = None, skip_paths: list[str] | None = None, extractors: dict[str, Callable[[bytes], str]] | None = None,
        readers: dict[str, Callable] | None = None, content: Callable | None = None, on_progress: Callable[[str, dict], None] | None = None,
    ):
        p = rules.scan_params
        self.spark, self.rules, self.follow = spark, rules, follow_symlinks
        self.depth = p.max_depth if max_depth is None else max_depth
        self.most = p.max_file_size if max_file_size is None else max_file_size
        self.extensions = rules.scan_extensions if extensions is None else extensions
        self.archives = bool(p.scan_archives if scan_archives is None else scan_archives)
        self.password, self.extractors, self.readers, self.content = archive_password, extractors, readers, content
        self.allow = list({(e.path_glob, e.rule_name): e for e in (*rules.whitelist, *(allow or []))}.values())
        self.ignore = tuple(dict.fromkeys((*rules.ignore_dirs, *ignore_dirs)))
        self.skip, self.told = skip_paths or [], on_progress
        self.broken = scan.broken_rules(rules.rules)

    def collect_entries(self, *roots: str) -> DataFrame:
        options: dict = {"ignore_dirs": "|".join(self.ignore), "ignore_paths": "|".join(self.rules.ignore_paths), "follow_symlinks": self.follow}
        if self.depth is not None:
            options["max_depth"] = self.depth
        return walk_all(self.spark, [r.rstrip("/") or "/" for r in roots], **options).drop("raw")

    def filter_entries(self, files: DataFrame) -> DataFrame:
        """Files that stay. Empty, oversize, unreadable and linked ones go, and those with other extensions or on the skip list."""
        files = scan.with_extensions(files.where(scan.removal_reason(self.most, self.archives).isNull()), self.extensions)
        return files.where(~F.col("path").isin(self.skip)) if self.skip else files

    def _limit(self) -> int | None:
        return scan.MAX_FILE_SIZE if self.most is None or self.most < 0 else self.most or None

    def scan_entries(self, files: DataFrame) -> DataFrame:
        """Results of files (without content), and of what is in archives among them."""
        plain = files.withColumn("archive_path", F.lit(None).cast("string"))
        needs = any(needs_content(r.match) for r in self.rules.rules)
        if self.content is not None:
            own = plain.withColumn("content", self.content(plain))
        elif needs:
            read = with_bytes(plain, self._limit())
            own = read.withColumn("content", extract_text(F.col("extension"), F.col("raw"), self.extractors)).drop("raw")
        else:
            own = plain.withColumn("content", F.lit(""))
        own = own.select(*COLUMNS, "content", F.lit(0).alias("errors"))
        if self.archives:
            kinds = sorted(READERS | (self.readers or {}))
            held = with_bytes(files.where(F.lower("extension").isin(kinds)))
            inner = archive_entries(held, self.extensions, password=self.password, readers=self.readers)
            inner = inner.join(files.select(F.col("path").alias("archive_path"), "root"), "archive_path").withColumn("rel_path", F.col("path"))
            own = own.unionByName(inner.select(*COLUMNS, "content", "errors"))
        return scan.scan(own, self.rules).drop("content")

    def scan(self, *roots: str, previous: DataFrame | None = None, manifest: DataFrame | None = None) -> Report:
        """Scan folders. With a previous run's results and manifest, only new and changed files are read; the hits of unchanged ones
        are taken over, those of entries of archives are not."""
        begun, stages = time.time(), {}

        def lap(stage: str, **numbers) -> None:
            stages[stage] = (time.time() - begun - sum(stages.values()) / 1000) * 1000
            if self.told:
                self.told(stage, numbers)

        walked = self.collect_entries(*roots).persist()
        total = walked.count()
        removed = scan.filter_counts(walked, self.most, self.archives).first().asDict()
        lap("walk", total_files=total)
        kept = self.filter_entries(walked).persist()
        n_kept = kept.count()
        lap("filter", kept=n_kept, **removed)
        todo, unchanged = kept, 0
        if previous is not None and manifest is not None:
            now = kept.withColumn("key", F.col("rel_path"))
            diff = state.manifest_diff(now.select(F.col("key").alias("path"), "mtime", "size"), manifest.withColumnRenamed("rel_path", "path")).persist()
            same = diff.where("status = 'unchanged'").select(F.col("path").alias("key"))
            old = now.join(same, "key", "left_semi").where(~F.lower("extension").isin(sorted(READERS)) if self.archives else F.lit(True)).drop("key").persist()
            unchanged = old.count()
            todo = kept.join(old.select("path"), "path", "left_anti")
        found = self.scan_entries(todo)
        if unchanged:
            taken = previous.where("archive_path IS NULL").select("path", "hits").join(old, "path")
            rest = old.join(taken.select("path"), "path", "left_anti").withColumn("hits", F.array().cast(found.schema["hits"].dataType))
            back = taken.unionByName(rest.select(*taken.columns)).withColumn("archive_path", F.lit(None).cast("string")).withColumn("errors", F.lit(0))
            found = found.unionByName(back.select(*found.columns))
        found = scan.allow_listed(found, self.allow).persist()
        numbers = scan.stats(found).first().asDict()
        errors = found.agg(F.sum("errors")).first()[0] or 0
        entries = found.where("archive_path IS NOT NULL").count()
        lap("scan", **numbers)
        seconds = time.time() - begun
        stats = numbers | {
            "total_files": total, "skipped_files": total - n_kept, "filter_removed": removed["total_removed"], "user_skipped": len(self.skip), "errors": errors,
            "archive_entries": entries, "unchanged_files": unchanged, "duration_seconds": seconds, "speed": n_kept / seconds if seconds else 0.0,
            "passed_files": max(numbers["scanned_files"] - numbers["matched_files"] - errors, 0),
        }
        return Report(roots[0] if len(roots) == 1 else "（多路径）", found, stats, stores.build_manifest(kept), stages)

    def scan_file(self, path: str) -> list:
        """The hits of one file, without the filters."""
        row = self.scan_entries(self.collect_entries(path)).where("archive_path IS NULL").first()
        return list(row["hits"]) if row else []


__all__ = ["Report", "Scanner"]
