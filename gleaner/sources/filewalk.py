"""A directory walk as a Spark data source: format("filewalk"). Lists hidden and empty files, prunes as it goes.

Options: path; ignore_dirs and ignore_paths (lists with | between), max_depth, extensions (with ,), follow_symlinks,
raw (true: with the files' bytes, of files up to max_raw bytes), default_ignores (false: none but the given ones). One
partition for each directory below the root, and for every FILES files in the root itself.
"""

from __future__ import annotations

import fnmatch
import os
import time
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories that are never entered, by name; the last is this engine's own.
IGNORED = frozenset(
    ".git .svn .hg __pycache__ .mypy_cache .pytest_cache .ruff_cache .venv venv env .tox .eggs node_modules .sass-cache .npm .yarn"
    " .pnpm-store .next .nuxt .turbo .parcel-cache .svelte-kit target .cargo .rustup .gradle .m2 .ivy .vs .nuget vendor .dart_tool"
    " dist build out .idea .vscode .cache .gleaner-cache".split()
)
#: Files of a directory in one partition.
FILES = 5_000


class _Dir(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.deep = deep


class _Files(InputPartition):
    """Files of the root itself."""


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.ignore = (IGNORED if options.get("default_ignores", "true").lower() == "true" else frozenset()) | {x.lower() for x in options.get("ignore_dirs", "").split("|") if x}
        self.globs = [x.lower() for x in options.get("ignore_paths", "").split("|") if x]
        self.depth = int(options["max_depth"]) if options.get("max_depth") else None
        kinds = options.get("extensions")
        self.extensions = None if kinds is None else {x for x in kinds.lower().split(",") if x}
        self.follow = options.get("follow_symlinks", "false").lower() == "true"
        self.raw = options.get("raw", "false").lower() == "true"
        self.most = int(options["max_raw"]) if options.get("max_raw") else None

    def _enter(self, path: str, name: str) -> bool:
        rel = os.path.relpath(path, self.root).replace(os.sep, "/").lower()
        globbed = any(fnmatch.fnmatchcase(rel, g) or fnmatch.fnmatchcase(rel + "/x", g) for g in self.globs)
        deep = self.depth is not None and rel.count("/") + 1 > self.depth
        return name.lower() not in self.ignore and not globbed and not deep and (self.follow or not os.path.islink(path))

    def partitions(self):
        if os.path.isfile(self.root):
            return [_Dir(self.root, False)]
        if not os.path.isdir(self.root):
            return []
        entries = list(os.scandir(self.root))
        below = [e.path for e in entries if e.is_dir() and self._enter(e.path, e.name)]
        if self.follow:  # several links to one directory are one directory
            below = list({os.path.realpath(p): p for p in sorted(below, reverse=True)}.values())
        files = sorted(e.path for e in entries if not e.is_dir())
        return [*[_Files(files[at : at + FILES]) for at in range(0, len(files), FILES)], *[_Dir(p, True) for p in sorted(below)]]

    def read(self, partition):
        if isinstance(partition, _Files):
            yield from (row for p in partition.value if (row := self._row(p)))
            return
        if os.path.isfile(partition.value):
            yield self._row(partition.value)
            return
        todo, seen = [partition.value], set()
        while todo:
            here = todo.pop()
            real = os.path.realpath(here)
            if real in seen:
                continue
            seen.add(real)
            try:
                entries = sorted(os.scandir(here), key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                if e.is_dir(follow_symlinks=True):
                    if partition.deep and self._enter(e.path, e.name):
                        todo.append(e.path)
                elif row := self._row(e.path):
                    yield row

    def _row(self, path: str):
        name = os.path.basename(path)
        kind = name.rpartition(".")[2].lower() if "." in name else ""
        if self.extensions is not None and kind not in self.extensions:
            return None
        link = os.path.islink(path)
        raw, size, mtime, readable = None, 0, 0.0, True
        try:
            stat = os.stat(path, follow_symlinks=self.follow or not link)
            size, mtime, readable = stat.st_size, stat.st_mtime, os.access(path, os.R_OK)
            if self.raw and (self.follow or not link) and (self.most is None or size <= self.most):
                with open(path, "rb") as f:
                    raw = f.read()
        except OSError:
            readable = False
        rel = os.path.relpath(path, self.root).replace(os.sep, "/")
        return self.root, path, name if rel == "." else rel, name, kind, size, mtime, readable, link, raw


class FileWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filewalk"

    def schema(self) -> str:
        return "root string, path string, rel_path string, name string, extension string, size long, mtime double, readable boolean, is_symlink boolean, raw binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def with_bytes(files: DataFrame, most: int | None = None, retries: int = 2, together: int = 16 << 20) -> DataFrame:
    """files (path, size, ...) with raw, read by the executors after all filters; null beyond ``most`` bytes or where reading fails.

    Rows go on in groups of about ``together`` bytes, so a task holds that much and one file.
    """
    columns = [c for c in files.columns if c != "raw"]

    def read(path: str) -> bytes | None:
        for attempt in range(retries + 1):
            try:
                with open(path, "rb") as f:
                    return f.read() if most is None else f.read(most)
            except OSError:
                time.sleep(0.05 * attempt)
        return None

    def run(batches):
        for batch in batches:
            first, held, total = 0, [], 0
            for i, (path, size) in enumerate(zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True)):
                held.append(read(path) if most is None or size <= most else None)
                total += len(held[-1] or b"")
                if total >= together or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first).select(columns)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*columns, "raw"])
                    first, held, total = i + 1, [], 0

    own = files.select(*columns)
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("raw", T.BinaryType())]))


def count_by_extension(spark: SparkSession, path: str, extensions: list[str], **options) -> DataFrame:
    """How many files of a tree the extensions keep and skip: kept, skipped_by_extension."""
    kinds = [x.lower().lstrip(".") for x in extensions]
    kept = F.col("extension").isin(kinds) if kinds else F.lit(False)
    return walk(spark, path, **options).agg(F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped_by_extension"))


def walk_all(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Several roots, one after the other; the column root tells them apart. A file below two of them counts once."""
    return reduce(DataFrame.unionByName, [walk(spark, p, **options) for p in paths]).dropDuplicates(["path"])


def drives() -> list[str]:
    """Where whole machines are scanned from."""
    return [d for d in (f"{c}:\\" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if os.path.isdir(d)] if os.name == "nt" else ["/"]


def walk(spark: SparkSession, path: str, **options):
    spark.dataSource.register(FileWalk)
    return spark.read.format("filewalk").options(path=path, **{k: str(v) for k, v in options.items()}).load()
