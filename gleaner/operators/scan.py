"""Scanning: files to nested hits, their statistics, filters, allow-lists. All are plans over DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex, is_minified, matches_glob, severity_name, severity_rank
from ..plans.compile import hit
from ..plans.model import AllowEntry, Rule, RuleSet, leaves, needs_content

MAX_FILE_SIZE = 50 * 1024 * 1024
ARCHIVES = ("zip", "rar", "7z")


def with_extensions(files: DataFrame, extensions: tuple[str, ...] | None) -> DataFrame:
    """None: all files; an empty list: none."""
    if extensions is None:
        return files
    return files.where(F.lower("extension").isin([x.lower().lstrip(".") for x in extensions]) if extensions else F.lit(False))


def without_skipped(files: DataFrame, skipped: DataFrame) -> DataFrame:
    return files.join(skipped.select("path").distinct(), "path", "left_anti")


def ignored_dirs(rel: Column, names: list[str]) -> Column:
    """Whether any directory of a relative path has one of the names, in any case."""
    parts = F.split(F.lower(rel), "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(n.lower()) for n in names]))


def ignored_paths(rel: Column, globs: list[str]) -> Column:
    """Whether any directory above a relative path fits one of the globs, or does with something below it."""
    parts = F.split(F.lower(rel), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    one = lambda d: F.greatest(*[F.rlike(d, F.lit(glob_regex(g.lower()))) | F.rlike(F.concat(d, F.lit("/x")), F.lit(glob_regex(g.lower()))) for g in globs], F.lit(False))
    return (F.size(parts) > 1) & F.exists(above, one)


def removal_reason(max_size: int | None = None, scan_archives: bool = False) -> Column:
    """Why the filter phase drops a file: the first of empty, oversize, unreadable, symlink; null if it stays."""
    most = MAX_FILE_SIZE if max_size is None or max_size < 0 else max_size
    over = F.lit(False) if most == 0 else (F.col("size") > most)
    if scan_archives:
        over = over & ~F.lower("extension").isin(list(ARCHIVES))
    return F.when(F.col("size") == 0, "empty").when(over, "oversize").when(~F.col("readable"), "unreadable").when(F.col("is_symlink"), "symlink")


def filter_counts(files: DataFrame, max_size: int | None = None, scan_archives: bool = False) -> DataFrame:
    reason = removal_reason(max_size, scan_archives)
    return files.agg(*[F.count_if(reason == r).alias(r) for r in ("empty", "oversize", "unreadable", "symlink")], F.count_if(reason.isNotNull()).alias("total_removed"))


def scan(files: DataFrame, rules: list[Rule] | tuple[Rule, ...] | RuleSet, chunk: int = 50) -> DataFrame:
    """files with hits: an array in the rules' order. Rules are part of the plan, so no join and no shuffle is needed.

    files: name, path, extension, and content if any rule needs it. Minified contents count as empty. Many rules are
    evaluated in chunks, which keeps generated code within the JIT's limits. A rule with an expression that isn't one
    finds nothing (``broken_rules`` names it); the others run.
    """
    rules = rules.rules if isinstance(rules, RuleSet) else rules
    keep = files.columns
    broken = {name for name, _ in broken_rules(rules)}
    if any(needs_content(r.match) for r in rules):
        files = files.withColumn("raw content", F.col("content")).withColumn("content", F.when(is_minified(F.col("content")), "").otherwise(F.col("content")))
    good = [(i, r) for i, r in enumerate(rules) if r.name not in broken]
    parts = [F.array_compact(F.array(*[hit(r, i) for i, r in good[at : at + chunk]])) for at in range(0, len(good), chunk)]
    if not parts:
        parts = [F.array().cast("array<struct<rule_ord:int,rule_name:string,severity:string,match_text:string,match_count:int,target:string,match_texts:array<string>,match_description:string>>")]
    out = files.withColumn("hits", parts[0] if len(parts) == 1 else F.concat(*parts))
    if "raw content" in out.columns:
        out = out.withColumn("content", F.col("raw content"))
    return out.select(*keep, "hits")


def broken_rules(rules: list[Rule] | tuple[Rule, ...]) -> list[tuple[str, str]]:
    """The rules that can't run, and why."""
    out = []
    for r in rules:
        try:
            for leaf in leaves(r.match):
                if leaf.mode == "regex":
                    re.compile(leaf.pattern)
        except re.error as e:
            out.append((r.name, str(e)))
    return out


def report_rules(results: DataFrame) -> DataFrame:
    """rule_name in the order of a report: by the rules' order."""
    return hits_long(results).groupBy("rule_name").agg(F.min("rule_ord").alias("rule_ord")).orderBy("rule_ord")


def speed(stats_: DataFrame) -> DataFrame:
    """stats with files a second: scanned and unchanged ones, 0 without a duration."""
    d = F.col("duration_seconds")
    return stats_.withColumn("speed", F.when(d > 0, (F.col("scanned_files") + F.col("unchanged_files")) / d).otherwise(0.0))


def roots_rollup(results: DataFrame) -> DataFrame:
    """Files, matched files and matches of each root, and of all of them (root null)."""
    return results.rollup("root").agg(F.count("*").alias("scanned_files"), F.count_if(F.size("hits") > 0).alias("matched_files"), F.sum(total_matches()).alias("total_matches"))


def max_severity() -> Column:
    return severity_name(F.coalesce(F.array_max(F.transform("hits", lambda h: severity_rank(h["severity"]))), F.lit(0)))


def total_matches() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["match_count"])


def rule_names() -> Column:
    return F.array_distinct(F.transform("hits", lambda h: h["rule_name"]))


def hits_long(results: DataFrame, *columns: str) -> DataFrame:
    # An outer explode: for an inner one the optimiser puts a filter on the hits below their projection, and rules run twice.
    return results.select(*(columns or ("path",)), F.explode_outer("hits").alias("hit")).where("hit IS NOT NULL").select(*(columns or ("path",)), "hit.*")


def group_by_rule(results: DataFrame) -> DataFrame:
    return hits_long(results).groupBy("rule_name", "severity").agg(F.countDistinct("path").alias("files"), F.sum("match_count").alias("matches"))


def group_by_severity(results: DataFrame) -> DataFrame:
    return results.where(F.size("hits") > 0).groupBy(max_severity().alias("max_severity")).agg(F.count("*").alias("files"))


def stats(results: DataFrame) -> DataFrame:
    hit_ = F.size("hits") > 0
    return results.agg(F.count("*").alias("scanned_files"), F.count_if(hit_).alias("matched_files"), F.coalesce(F.sum(total_matches()), F.lit(0)).alias("total_matches"), F.count_if(~hit_).alias("passed_files"))


def report_filter(results: DataFrame, path_query: str = "", rule_name: str = "") -> DataFrame:
    """Results by part of their path and by rule; hits are narrowed to that rule."""
    query = path_query.strip().lower()
    if query:
        results = results.where(F.contains(F.lower("path"), F.lit(query)))
    if rule_name:
        results = results.withColumn("hits", F.filter("hits", lambda h: h["rule_name"] == rule_name))
    return results.where(F.size("hits") > 0) if query or rule_name else results


def filter_and_sort(results: DataFrame, rules: list[str] | None = None, severities: list[str] | None = None, key: str = "path", descending: bool = False) -> DataFrame:
    """Interactive view: any of the rules, any of the severities; ties stay in path order."""
    if rules is not None:
        results = results.where(F.arrays_overlap(rule_names(), F.array(*[F.lit(r) for r in rules])) if rules else F.lit(False))
    if severities is not None:
        results = results.where(max_severity().isin(severities))
    by = {"path": F.lower("path"), "hits": F.size("hits"), "severity": severity_rank(max_severity())}[key]
    return results.orderBy(by.desc() if descending else by.asc(), "path")


def allow_listed(results: DataFrame, entries: list[AllowEntry]) -> DataFrame:
    """Drop a file only if every rule that hit it is covered by an entry for its path. Entries are part of the plan."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))

    def covered(h: Column) -> Column:
        out = F.lit(False)
        for e in entries:
            out = out | (matches_glob(path, e.path_glob) & (F.lit(True) if e.rule_name == "*" else h["rule_name"] == e.rule_name))
        return out

    if not entries:
        return results
    stays = (F.size("hits") == 0) | ~F.forall("hits", covered)
    # Through a generator, so that the condition isn't pushed below the hits' projection, where rules would run again.
    marked = results.select("*", F.explode_outer(F.when(stays, F.array(F.lit(True)))).alias("stays here"))
    return marked.where("`stays here` IS NOT NULL").drop("stays here")
