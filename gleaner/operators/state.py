"""Incremental scans, content caches, run history, metrics: relational state and its operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def manifest_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, status (new, changed, unchanged, deleted) by (mtime, size)."""
    c, p = current.select("path", "mtime", "size").alias("c"), previous.select("path", "mtime", "size").alias("p")
    same = (F.col("c.mtime") == F.col("p.mtime")) & (F.col("c.size") == F.col("p.size"))
    status = F.when(F.col("p.path").isNull(), "new").when(F.col("c.path").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return c.join(p, F.col("c.path") == F.col("p.path"), "full").select(F.coalesce("c.path", "p.path").alias("path"), status.alias("status"))


def merge_unchanged(fresh: DataFrame, previous_hits: DataFrame, diff: DataFrame) -> DataFrame:
    """Hits of this run, and the earlier hits of files that are unchanged; a changed file's earlier hits are gone."""
    same = diff.where("status = 'unchanged'").select("path")
    return fresh.unionByName(previous_hits.join(same, "path", "left_semi").join(fresh.select("path").distinct(), "path", "left_anti"))


def cached_hits(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (file_hash, rule_hash) with cached: hit, miss, or unknown where the cache has no row."""
    known = F.when(F.col("matched").isNull(), "unknown").when(F.col("matched"), "hit").otherwise("miss")
    return wanted.join(cache.select("file_hash", "rule_hash", "matched"), ["file_hash", "rule_hash"], "left").select("file_hash", "rule_hash", known.alias("cached"))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key, of both tables; rows win ties."""
    both = table.withColumn("from rows", F.lit(0)).unionByName(rows.withColumn("from rows", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("from rows"))
    return both.withColumn("rank in key", F.row_number().over(w)).where("`rank in key` = 1").select(*table.columns)


def without_orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key).distinct(), key, "left_semi")


def prune_older(table: DataFrame, column: str, cutoff: Column) -> DataFrame:
    return table.where(F.col(column) >= cutoff)


def latest_runs(history: DataFrame, most: int = 50) -> DataFrame:
    w = Window.partitionBy("workspace_id").orderBy(F.desc("finished_at"), F.desc("scan_id"))
    return history.withColumn("recent", F.row_number().over(w)).where(F.col("recent") <= most)


def trend(history: DataFrame) -> DataFrame:
    """Each run with its predecessor's matched files, the difference, and the trend."""
    w = Window.partitionBy("workspace_id").orderBy("finished_at", "scan_id")
    d = F.col("matched_files") - F.col("previous")
    word = F.when(d.isNull(), "首次").when(d < 0, "改善").when(d > 0, "恶化").otherwise("持平")
    return history.withColumn("previous", F.lag("matched_files").over(w)).withColumn("delta", d).withColumn("trend", word)


def compare_paths(current: DataFrame, previous: DataFrame) -> DataFrame:
    """path, status (new, resolved, persistent) of two runs' hit paths."""
    c, p = current.select("path").distinct().withColumn("c", F.lit(1)), previous.select("path").distinct().withColumn("p", F.lit(1))
    return c.join(p, "path", "full").select("path", F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "resolved").otherwise("persistent").alias("status"))


def stage_stats(samples: DataFrame) -> DataFrame:
    """Over rounds: mean, least, most, sample deviation (0 for one) and number per stage."""
    t = F.col("total_ms")
    return samples.groupBy("stage").agg(F.avg(t).alias("mean_ms"), F.min(t).alias("min_ms"), F.max(t).alias("max_ms"), F.coalesce(F.stddev_samp(t), F.lit(0.0)).alias("stddev_ms"), F.count("*").alias("n"))


def stage_shares(samples: DataFrame) -> DataFrame:
    total = samples.groupBy("stage").agg(F.sum("total_ms").alias("total_ms"))
    return total.withColumn("share", F.col("total_ms") * 100 / F.sum("total_ms").over(Window.partitionBy()))


def compare_to_baseline(current: DataFrame, baseline: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Full outer comparison of stage means; a regression is slower than the baseline by more than the threshold."""
    c, b = current.select("stage", F.col("mean_ms").alias("current_ms")), baseline.select("stage", F.col("mean_ms").alias("baseline_ms"))
    r = (F.col("current_ms") - F.col("baseline_ms")) / F.col("baseline_ms")
    return c.join(b, "stage", "full").withColumn("ratio", F.when(F.col("baseline_ms") > 0, r)).withColumn("regressed", F.coalesce(F.col("ratio") > threshold, F.lit(False)))


def perf_by_extension(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("total_ms").alias("total_ms"), F.avg("total_ms").alias("avg_ms"))


def perf_diffs(current: DataFrame, baseline: DataFrame, least_percent: float) -> DataFrame:
    d = (F.col("c.total_ms") - F.col("b.total_ms")) * 100 / F.col("b.total_ms")
    joined = current.alias("c").join(baseline.alias("b"), "path").where(F.col("b.total_ms") > 0)
    return joined.select("path", d.alias("diff_percent")).where(F.abs("diff_percent") >= least_percent).orderBy(F.desc("diff_percent"))


def merge_rules(base: DataFrame, over: DataFrame) -> DataFrame:
    """Rule tables by name: the base's without those that over has, then over's."""
    return base.join(over.select("name"), "name", "left_anti").unionByName(over)


def slowest_by_extension(files: DataFrame) -> DataFrame:
    """Per extension: files, total time, the slowest file and its time; the last by path among equals."""
    most = F.max(F.struct("total_ms", "path"))
    out = files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("total_ms").alias("total_ms"), most.alias("most"))
    return out.select("extension", "files", "total_ms", F.col("most.path").alias("slowest"), F.col("most.total_ms").alias("max_ms"))


def import_entries(held: DataFrame, more: DataFrame) -> DataFrame:
    """held, and of more what held doesn't name yet by (path_glob, rule_name)."""
    keys = ["path_glob", "rule_name"]
    return held.unionByName(more.dropDuplicates(keys).join(held.select(*keys), keys, "left_anti"))


def one_per_path(files: DataFrame) -> DataFrame:
    return files.dropDuplicates(["path"])


def compare_names(now: Column, before: Column) -> tuple[Column, Column]:
    """Sorted names that are new, and that are gone."""
    return F.array_sort(F.array_except(now, before)), F.array_sort(F.array_except(before, now))
