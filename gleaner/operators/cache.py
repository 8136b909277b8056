"""The content cache: tables of files by hash, of paths, of results by (file, rule), and of extracted texts.

Contents are matched once for each distinct hash. Only predicates on content alone can be cached by it; those on names
and paths are evaluated again. A table is a Parquet folder; writes are upserts into a new version of it.
"""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.model import Rule, leaves, rule_hash
from .state import cached_hits, upsert, without_orphans

TABLES = {
    "files": "file_hash string, size long, scanned_at string",
    "paths": "path string, mtime double, file_hash string, seen_at string",
    "rules": "rule_hash string, rule_name string, seen_at string",
    "rule_files": "rule_file string, rule_hash string, seen_at string",
    "results": "file_hash string, rule_hash string, matched boolean, match_text string, match_count int, seen_at string",
    "contents": "file_hash string, content string, seen_at string",
}
KEYS = {"files": ["file_hash"], "paths": ["path"], "rules": ["rule_hash"], "rule_files": ["rule_file", "rule_hash"], "results": ["file_hash", "rule_hash"], "contents": ["file_hash"]}
ORDER = {name: schema.split(", ")[-1].split()[0] for name, schema in TABLES.items()}


def cacheable(rule: Rule) -> bool:
    """Whether the rule looks at nothing but the content."""
    return all(x.target == "content" for x in leaves(rule.match))


def hashes_of(targets: DataFrame, paths: DataFrame, files: DataFrame) -> DataFrame:
    """targets (path, mtime, size) with file_hash, where path and mtime are known and the size isn't another; else null."""
    p, f = paths.select("path", F.col("mtime"), "file_hash"), files.select("file_hash", F.col("size").alias("known size"))
    found = targets.join(p, ["path", "mtime"], "left").join(f, "file_hash", "left")
    same = F.col("known size").isNull() | (F.col("known size") == F.col("size"))
    return found.select(*targets.columns, F.when(same, F.col("file_hash")).alias("file_hash"))


def with_texts(files: DataFrame, contents: DataFrame, extract) -> DataFrame:
    """files (file_hash, raw, ...) with content: the cached text, else what ``extract`` (an expression) makes of it, once for each hash."""
    known = contents.select("file_hash", F.col("content").alias("cached"))
    # Two branches, so that the extraction runs on misses only; a repeated hash is extracted once.
    hits = files.join(known, "file_hash").withColumnRenamed("cached", "content")
    misses = files.join(known, "file_hash", "left_anti")
    once = misses.dropDuplicates(["file_hash"]).select("file_hash", extract.alias("content"))
    return hits.unionByName(misses.join(once, "file_hash"))


def missing_pairs(hashes: DataFrame, rules: list[Rule], results: DataFrame) -> DataFrame:
    """(file_hash, rule_hash) that the cache has no answer for; rules are few."""
    own = F.explode(F.array(*[F.lit(rule_hash(r)) for r in rules])).alias("rule_hash")
    wanted = hashes.select("file_hash").distinct().select("file_hash", own)
    return cached_hits(wanted, results).where("cached = 'unknown'").select("file_hash", "rule_hash")


def prune_orphan_rules(results: DataFrame, rule_files: DataFrame) -> DataFrame:
    """Results of rules that some rule file still has."""
    return without_orphans(results, rule_files, "rule_hash")


def prune_stale(tables: dict[str, DataFrame], cutoff: str) -> dict[str, DataFrame]:
    """All tables without the files not scanned since the cutoff, and what hangs on them."""
    files = tables["files"].where(F.col("scanned_at") >= cutoff)
    return tables | {"files": files} | {n: without_orphans(tables[n], files, "file_hash") for n in ("paths", "results", "contents")}


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class CacheStore:
    """The tables in a folder. Each write makes a new version; the pointer file names the one that counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _pointer(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.version")

    def table(self, name: str) -> DataFrame:
        try:
            with open(self._pointer(name), encoding="utf-8") as f:
                return self.spark.read.schema(TABLES[name]).parquet(os.path.join(self.folder, f.read().strip()))
        except OSError:
            return self.spark.createDataFrame([], TABLES[name])

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in TABLES}

    def write(self, name: str, rows: DataFrame) -> None:
        version = f"{name}-{uuid.uuid4().hex}"
        os.makedirs(self.folder, exist_ok=True)
        rows.write.parquet(os.path.join(self.folder, version))
        old = None
        if os.path.exists(self._pointer(name)):
            with open(self._pointer(name), encoding="utf-8") as f:
                old = f.read().strip()
        with open(self._pointer(name) + ".new", "w", encoding="utf-8") as f:
            f.write(version)
        os.replace(self._pointer(name) + ".new", self._pointer(name))
        if old:
            shutil.rmtree(os.path.join(self.folder, old), ignore_errors=True)

    def put(self, name: str, rows: DataFrame) -> None:
        self.write(name, upsert(self.table(name), rows.select(*self.table(name).columns), KEYS[name], ORDER[name]))

    def stats(self) -> dict[str, int]:
        out = {r["table_name"]: r["rows"] for r in counts(self.tables()).collect()}
        size = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.folder) for f in names)
        return out | {"bytes": size}

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def prune(self, cutoff: str) -> int:
        """How many files are gone."""
        n = self.table("files").count()
        for name in ("paths", "results", "contents", "files"):  # the files last: the others are pruned by them
            self.write(name, prune_stale(self.tables(), cutoff)[name])
        return n - self.table("files").count()
