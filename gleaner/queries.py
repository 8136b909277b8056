"""Registered queries of the scanning engine and their SQL."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import cache, report, scan, state, stores
from .plans import templates
from .plans.builtin import RULES
from .plans.compile import column, python_match
from .plans.model import AllowEntry, And, Leaf, Not, Or, Rule, Spec
from .sources.extract import archive_entries, extract_text

EMAIL, IPV4, CARD = r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", r"[0-9]{13,16}"
DEMO = [
    Rule("email", Leaf("content", "regex", EMAIL, True), "warning"),
    Rule("license", Leaf("content", "contains", "mit license"), "info"),
    Rule("ipv4", Leaf("content", "regex", IPV4, True), "critical"),
    Rule("secret", And((Leaf("path", "startswith", "src"), Leaf("content", "contains", "token", True))), "critical"),
    Rule("either", Or((Leaf("filename", "endswith", "7.txt"), Leaf("content", "regex", CARD, True))), "info"),
    Rule("no-the", Not(Leaf("content", "contains", "the")), "info"),
]
DOCS_SQL = "d AS (SELECT doc_id, concat(source, '/', lang, '/', doc_id, '.txt') AS path, concat(doc_id, '.txt') AS name, 'txt' AS extension, n_chars AS size, text AS content0, CASE WHEN length(text) >= 2048 AND list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) >= 5000 THEN '' ELSE text END AS content FROM documents)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.concat("doc_id", F.lit(".txt")).alias("name"), F.lit("txt").alias("extension"), F.col("n_chars").alias("size"), "doc_id", F.col("text").alias("content"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(files(spark, sf_dir), DEMO).drop("content")


# SQL of the predicates, for the oracle.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_spec(spec: Spec) -> tuple[str, str]:
    """Whether it matches, and its count where it does."""
    if isinstance(spec, Leaf):
        t = {"filename": "name", "path": "path", "content": "content"}[spec.target]
        if spec.mode in ("regex", "contains"):
            p = spec.pattern if spec.mode == "regex" else "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in spec.pattern)
            n = f"len(regexp_extract_all({t}, {_q(('' if spec.case_sensitive else '(?i)') + p)}))"
            return f"({n} > 0)", n
        a, b = (t, _q(spec.pattern)) if spec.case_sensitive else (f"lower({t})", _q(spec.pattern.lower()))
        return {"equals": f"({a} = {b})", "startswith": f"starts_with({a}, {b})", "endswith": f"ends_with({a}, {b})"}[spec.mode], "1"
    if isinstance(spec, Not):
        return f"(NOT {sql_spec(spec.child)[0]})", "1"
    parts = [sql_spec(c) for c in spec.children]
    counts = " + ".join(f"CASE WHEN {m} THEN {n} ELSE 0 END" for m, n in parts)
    return "(" + (" AND " if isinstance(spec, And) else " OR ").join(m for m, _ in parts) + ")", f"({counts})"


def _hits_sql() -> str:
    parts = []
    for i, r in enumerate(DEMO):
        m, n = sql_spec(r.match)
        parts.append(f"SELECT {i} AS ord, path, size, {_q(r.name)} AS rule_name, {_q(r.severity)} AS severity, CAST({n} AS BIGINT) AS match_count FROM d WHERE {m}")
    return f"WITH {DOCS_SQL}, h AS ({' UNION ALL '.join(parts)}), f AS (SELECT d.path, max(d.size) AS size, count(h.path) AS n, coalesce(max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END), 0) AS rank, coalesce(sum(match_count), 0) AS total FROM d LEFT JOIN h ON d.path = h.path GROUP BY d.path) "


SEV = "CASE rank WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str = ""):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def _predicate(name: str, spec: Spec) -> None:
    m, n = sql_spec(spec)

    @query(f"WITH {DOCS_SQL} SELECT path, CAST({n} AS INTEGER) AS match_count FROM d WHERE {m}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = files(spark, sf_dir).withColumn("content", F.when(T.is_minified(F.col("content")), "").otherwise(F.col("content"))).select("path", column(spec).alias("m"))
        return found.where("m.matched").select("path", "m.match_count")


_LEAVES = {
    "filename": {"contains": "9.t", "equals": "17.TXT", "startswith": "12", "endswith": "3.TXT", "regex": r"^[0-9]7.*\.txt"},
    "path": {"contains": "/EN/", "equals": "SRC14/de/974.txt", "startswith": "SRC1", "endswith": "/33.txt", "regex": r"src[0-4]/(de|fr)/"},
    "content": {"contains": "license", "equals": "VON.", "startswith": "The", "endswith": "the.", "regex": EMAIL},
}
for _target, _modes in _LEAVES.items():
    for _mode, _pattern in _modes.items():
        _predicate(f"leaf_{_target}_{_mode}", Leaf(_target, _mode, _pattern))
_predicate("leaf_content_contains_case", Leaf("content", "contains", "License", True))
_predicate("leaf_content_regex_case", Leaf("content", "regex", CARD, True))
_predicate("composite_and", DEMO[3].match)
_predicate("composite_or", DEMO[4].match)
_predicate("composite_not", DEMO[5].match)
_predicate("composite_nested", And((Or((Leaf("content", "regex", EMAIL), Leaf("content", "contains", "license"))), Not(Leaf("path", "contains", "/fr/")), Leaf("filename", "endswith", ".txt"))))


@query(_hits_sql() + "SELECT path, rule_name, severity, CAST(match_count AS INTEGER) AS match_count FROM h")
def rule_hits_long(spark, sf_dir):
    return scan.hits_long(results(spark, sf_dir)).select("path", "rule_name", "severity", "match_count")


@query(_hits_sql() + "SELECT rule_name, severity, count(DISTINCT path) AS files, CAST(sum(match_count) AS BIGINT) AS matches FROM h GROUP BY ALL")
def group_by_rule(spark, sf_dir):
    return scan.group_by_rule(results(spark, sf_dir))


@query(_hits_sql() + f"SELECT {SEV} AS max_severity, count(*) AS files FROM f WHERE n > 0 GROUP BY ALL")
def group_by_severity(spark, sf_dir):
    return scan.group_by_severity(results(spark, sf_dir))


@query(_hits_sql() + f"SELECT f.path, {SEV} AS max_severity, CAST(total AS BIGINT) AS total_matches, coalesce(r.names, '') AS rule_names FROM f LEFT JOIN (SELECT path, string_agg(rule_name, ',' ORDER BY ord) AS names FROM h GROUP BY path) r ON f.path = r.path")
def file_summary(spark, sf_dir):
    return results(spark, sf_dir).select("path", scan.max_severity().alias("max_severity"), scan.total_matches().alias("total_matches"), F.array_join(scan.rule_names(), ",").alias("rule_names"))


@query(_hits_sql() + "SELECT count(*) AS scanned_files, count(*) FILTER (n > 0) AS matched_files, CAST(sum(total) AS BIGINT) AS total_matches, count(*) FILTER (n = 0) AS passed_files FROM f")
def scan_stats(spark, sf_dir):
    return scan.stats(results(spark, sf_dir))


def _flawed(spark, sf_dir):
    return files(spark, sf_dir).select("path", "extension", F.when(F.col("doc_id") % 11 == 0, 0).otherwise(F.col("size")).alias("size"), (F.col("doc_id") % 13 != 0).alias("readable"), (F.col("doc_id") % 17 == 0).alias("is_symlink"))


@query(f"WITH {DOCS_SQL}, x AS (SELECT CASE WHEN doc_id % 11 = 0 OR size = 0 THEN 'empty' WHEN size > 9000 THEN 'oversize' WHEN doc_id % 13 = 0 THEN 'unreadable' WHEN doc_id % 17 = 0 THEN 'symlink' END AS r FROM d) SELECT count(*) FILTER (r = 'empty') AS empty, count(*) FILTER (r = 'oversize') AS oversize, count(*) FILTER (r = 'unreadable') AS unreadable, count(*) FILTER (r = 'symlink') AS symlink, count(r) AS total_removed FROM x")
def filter_phase_counts(spark, sf_dir):
    return scan.filter_counts(_flawed(spark, sf_dir), 9000)


@query(r"SELECT page_id, regexp_extract(lower(url), '\.([^.]+)$', 1) AS extension FROM pages")
def extension_projection(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.extension(F.col("url")).alias("extension"))


for _label, _list, _where in (("none", None, "TRUE"), ("empty", (), "FALSE"), ("some", ("html", ".TXT"), "extension IN ('html', 'txt')")):

    def _whitelist(spark, sf_dir, own=_list):
        pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.extension(F.col("url")).alias("extension"))
        return scan.with_extensions(pages, own)

    query(rf"WITH p AS (SELECT page_id, regexp_extract(lower(url), '\.([^.]+)$', 1) AS extension FROM pages) SELECT * FROM p WHERE {_where}", f"extension_whitelist_{_label}")(_whitelist)


@query(f"WITH {DOCS_SQL} SELECT path, size FROM d WHERE doc_id % 7 <> 0")
def skip_list(spark, sf_dir):
    f = files(spark, sf_dir)
    return scan.without_skipped(f.select("path", "size"), f.where("doc_id % 7 = 0").select("path"))


@query(f"WITH {DOCS_SQL} SELECT path FROM d WHERE NOT list_contains(string_split(lower(path), '/')[1:2], 'fr') AND NOT (path LIKE 'src1%/de/%')")
def ignored(spark, sf_dir):
    f = files(spark, sf_dir).select("path")
    return f.where(~scan.ignored_dirs(F.col("path"), ["FR"]) & ~scan.ignored_paths(F.col("path"), ["src1*/DE"]))


@query(f"WITH {DOCS_SQL} SELECT path, length(content0) AS n FROM d WHERE length(content0) >= 2048 AND content = ''")
def minified_guard(spark, sf_dir):
    return files(spark, sf_dir).where(T.is_minified(F.col("content"))).select("path", F.length("content").cast("long").alias("n"))


@query(_hits_sql() + "SELECT path, CAST(sum(match_count) AS BIGINT) AS total_matches FROM h WHERE rule_name = 'license' AND contains(lower(path), '/en/') GROUP BY path")
def report_filter(spark, sf_dir):
    return scan.report_filter(results(spark, sf_dir), " /EN/ ", "license").select("path", scan.total_matches().alias("total_matches"))


@query(_hits_sql() + f"SELECT path, {SEV} AS severity, n AS hit_count FROM f WHERE path IN (SELECT path FROM h WHERE rule_name IN ('email', 'ipv4')) AND rank IN (1, 2) ORDER BY rank DESC, path LIMIT 20")
def filter_and_sort(spark, sf_dir):
    """The first page of the interactive view: a top-k report."""
    r = scan.filter_and_sort(results(spark, sf_dir), ["email", "ipv4"], ["warning", "critical"], "severity", True)
    return r.select("path", scan.max_severity().alias("severity"), F.size("hits").cast("long").alias("hit_count")).limit(20)


@query(_hits_sql() + f"SELECT f.path, r.rule_name AS first_rule, {SEV} AS severity, n AS hit_count FROM f JOIN (SELECT path, arg_min(rule_name, ord) AS rule_name FROM h GROUP BY path) r ON f.path = r.path")
def flat_rows(spark, sf_dir):
    return report.flat_rows(results(spark, sf_dir)).withColumn("hit_count", F.col("hit_count").cast("long"))


@query(f"WITH {DOCS_SQL}, l AS (SELECT path, string_split(content0, chr(10)) AS x FROM d), p AS (SELECT path, x, list_position(list_transform(x, lambda y: contains(y, 'License')), TRUE) AS a FROM l) SELECT path, array_to_string(list_transform(range(greatest(a - 1, 1), least(a + 1, len(x)) + 1), lambda i: (CASE WHEN i = a THEN '>>> ' ELSE '    ' END) || x[i]), chr(10)) AS snippet FROM p WHERE a > 0")
def context_snippet(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.context(F.col("content"), F.lit("License"), 1).alias("snippet")).where("snippet IS NOT NULL")


ALLOW = [AllowEntry("src1*/*", "*"), AllowEntry("*/en/*", "license"), AllowEntry("*[0-4].txt", "no-the")]


@query(_hits_sql() + "SELECT f.path, f.n AS hit_count FROM f WHERE f.n = 0 OR EXISTS (SELECT 1 FROM h WHERE h.path = f.path AND NOT (starts_with(path, 'src1') OR (rule_name = 'license' AND contains(path, '/en/')) OR (rule_name = 'no-the' AND regexp_matches(path, '[0-4]\\.txt$'))))".replace("\\\\", "\\"))
def allowlist_forall(spark, sf_dir):
    return scan.allow_listed(results(spark, sf_dir), ALLOW).select("path", F.size("hits").cast("long").alias("hit_count"))


def _states(spark, sf_dir):
    f = files(spark, sf_dir).select("path", F.lit(1.0).alias("mtime"), "size", "doc_id")
    before = f.where("doc_id % 5 <> 0").withColumn("size", F.when(F.col("doc_id") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return f.where("doc_id % 7 <> 0"), before


_DIFF = "s AS (SELECT path, doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM d WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0)"


@query(f"WITH {DOCS_SQL}, {_DIFF} SELECT path, status FROM s")
def manifest_diff(spark, sf_dir):
    return state.manifest_diff(*_states(spark, sf_dir))


@query(f"WITH {DOCS_SQL}, {_DIFF} SELECT path, CASE WHEN status = 'unchanged' AND doc_id % 4 <> 0 THEN 'old' ELSE 'fresh' END AS origin FROM s WHERE status <> 'deleted' AND (doc_id % 4 = 0 OR status = 'unchanged')")
def merge_unchanged(spark, sf_dir):
    now, before = _states(spark, sf_dir)
    fresh = now.where("doc_id % 4 = 0").select("path", F.lit("fresh").alias("origin"))
    return state.merge_unchanged(fresh, before.select("path", F.lit("old").alias("origin")), state.manifest_diff(now, before))


@query("WITH x AS (SELECT DISTINCT sha256(text) AS file_hash, min(doc_id) OVER (PARTITION BY text) AS k FROM documents) SELECT file_hash, 'r' AS rule_hash, CASE WHEN k % 3 = 0 THEN 'unknown' WHEN k % 2 = 0 THEN 'hit' ELSE 'miss' END AS cached FROM x")
def cache_lookup(spark, sf_dir):
    x = files(spark, sf_dir).groupBy(F.sha2("content", 256).alias("file_hash")).agg(F.min("doc_id").alias("k")).withColumn("rule_hash", F.lit("r"))
    return state.cached_hits(x, x.where("k % 3 <> 0").withColumn("matched", F.col("k") % 2 == 0))


@query(f"WITH {DOCS_SQL} SELECT sha256(content0) AS file_hash, count(*) AS copies, min(path) AS first_path FROM d GROUP BY ALL HAVING count(*) > 1")
def content_dedup_by_hash(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.sha2("content", 256).alias("file_hash")).agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).where("copies > 1")


def _history(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("scan_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("finished_at"), F.floor(F.col("o_totalprice") / 1000).cast("long").alias("matched_files"))


_HIST = "WITH h AS (SELECT o_custkey AS workspace_id, o_orderkey AS scan_id, strftime(o_orderdate, '%Y-%m-%d') AS finished_at, CAST(floor(o_totalprice / 1000) AS BIGINT) AS matched_files FROM orders)"


@query(_HIST + " SELECT workspace_id, scan_id, finished_at, matched_files, CAST(r AS INTEGER) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY finished_at DESC, scan_id DESC) AS r FROM h) WHERE r <= 5")
def history_trim(spark, sf_dir):
    return state.latest_runs(_history(spark, sf_dir), 5)


@query(_HIST + " SELECT *, matched_files - previous AS delta, CASE WHEN previous IS NULL THEN '首次' WHEN matched_files < previous THEN '改善' WHEN matched_files > previous THEN '恶化' ELSE '持平' END AS trend FROM (SELECT *, lag(matched_files) OVER (PARTITION BY workspace_id ORDER BY finished_at, scan_id) AS previous FROM h)")
def history_trend(spark, sf_dir):
    return state.trend(_history(spark, sf_dir))


@query(f"WITH {DOCS_SQL} SELECT path, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'persistent' WHEN doc_id % 2 = 0 THEN 'new' ELSE 'resolved' END AS status FROM d WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def compare_runs(spark, sf_dir):
    f = files(spark, sf_dir)
    return state.compare_paths(f.where("doc_id % 2 = 0"), f.where("doc_id % 3 = 0"))


def _samples(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("total_ms"), "user_id", "event_id")


@query("SELECT event_type AS stage, round(avg(value), 6) AS mean_ms, min(value) AS min_ms, max(value) AS max_ms, round(coalesce(stddev_samp(value), 0), 6) AS stddev_ms, count(*) AS n FROM events GROUP BY ALL")
def stage_stats(spark, sf_dir):
    return state.stage_stats(_samples(spark, sf_dir)).withColumn("mean_ms", F.round("mean_ms", 6)).withColumn("stddev_ms", F.round("stddev_ms", 6))


@query("SELECT event_type AS stage, round(sum(value), 4) AS total_ms, round(sum(value) * 100 / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY ALL")
def stage_shares(spark, sf_dir):
    return state.stage_shares(_samples(spark, sf_dir)).select("stage", F.round("total_ms", 4).alias("total_ms"), F.round("share", 6).alias("share"))


@query("WITH c AS (SELECT event_type AS stage, avg(value) AS m FROM events WHERE event_id % 2 = 0 AND event_type <> 'click' GROUP BY ALL), b AS (SELECT event_type AS stage, avg(value) AS m FROM events WHERE event_id % 2 = 1 GROUP BY ALL) SELECT coalesce(c.stage, b.stage) AS stage, round(c.m, 6) AS current_ms, round(b.m, 6) AS baseline_ms, round(CASE WHEN b.m > 0 THEN (c.m - b.m) / b.m END, 6) AS ratio, coalesce((c.m - b.m) / b.m > 0.1, FALSE) AS regressed FROM c FULL JOIN b ON c.stage = b.stage")
def baseline_compare(spark, sf_dir):
    s = _samples(spark, sf_dir)
    out = state.compare_to_baseline(state.stage_stats(s.where("event_id % 2 = 0 AND stage <> 'click'")), state.stage_stats(s.where("event_id % 2 = 1")))
    return out.select("stage", *[F.round(c, 6).alias(c) for c in ("current_ms", "baseline_ms", "ratio")], "regressed")


@query(f"WITH {DOCS_SQL} SELECT regexp_extract(path, '^([^/]*)', 1) AS extension, count(*) AS files, CAST(sum(size) AS DOUBLE) AS total_ms, round(avg(size), 6) AS avg_ms FROM d GROUP BY ALL")
def perf_by_extension(spark, sf_dir):
    f = files(spark, sf_dir).select(F.regexp_extract("path", "^([^/]*)", 1).alias("extension"), F.col("size").cast("double").alias("total_ms"))
    return state.perf_by_extension(f).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {DOCS_SQL} SELECT path, size FROM d ORDER BY size DESC, path LIMIT 10")
def slowest_files(spark, sf_dir):
    return files(spark, sf_dir).select("path", "size").orderBy(F.desc("size"), "path").limit(10)


@query(f"WITH {DOCS_SQL} SELECT path, sha256(replace(replace(content0, 'MIT License', '[L]'), 'the', '#')) AS digest FROM d")
def redact_text(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.sha2(T.redact(F.col("content"), [("the", "#"), ("MIT License", "[L]")]), 256).alias("digest"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS body FROM pages")
def html_strip(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.strip_html(F.col("html")).alias("body"))


@query(f"WITH {DOCS_SQL} SELECT path, CASE WHEN size < 1024 THEN format('{{}} B', size) WHEN size < 1048576 THEN printf('%.1f KB', size / 1024) ELSE printf('%.1f MB', size / 1048576) END AS shown, CASE WHEN size < 1024 THEN format('{{}}ms', CAST(floor(size / 1024 * 1000) AS BIGINT)) WHEN size < 61440 THEN printf('%.1fs', size / 1024) ELSE printf('%d分%02d秒', size // 61440, size // 1024 % 60) END AS took, CASE WHEN length(content0) > 200 THEN left(content0, 200) || '...' ELSE content0 END AS head FROM d")
def formats(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.format_size(F.col("size")).alias("shown"), T.format_elapsed(F.col("size") / 1024).alias("took"), T.truncate(F.col("content")).alias("head"))


@query(f"WITH {DOCS_SQL} SELECT path, CASE WHEN starts_with(path, 'src1/') THEN substr(path, 6) ELSE path END AS rel FROM d")
def relative_keys(spark, sf_dir):
    return files(spark, sf_dir).select("path", T.rel_key("src1", F.col("path")).alias("rel"))


@query(_hits_sql() + "SELECT path, size, severity, rule_name AS rule, '' AS description, CAST(match_count AS INTEGER) AS match_count FROM h")
def csv_rows(spark, sf_dir):
    return report.csv_rows(results(spark, sf_dir))


@query(_hits_sql() + "SELECT rule_name AS rule_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, path AS uri FROM h")
def sarif_levels(spark, sf_dir):
    return report.sarif_rows(results(spark, sf_dir))


@query(_hits_sql() + f"SELECT path, {SEV} AS max_severity, CAST(total AS BIGINT) AS match_count FROM f WHERE n > 0")
def json_rows(spark, sf_dir):
    rows = report.json_rows(results(spark, sf_dir))
    return rows.select("path", F.get_json_object("json", "$.max_severity").alias("max_severity"), F.get_json_object("json", "$.match_count").cast("long").alias("match_count"))


@query("SELECT p_name AS name, p_size AS value FROM part WHERE p_partkey % 2 = 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 2 = 1) UNION ALL SELECT p_name, p_size + 100 FROM part WHERE p_partkey % 2 = 1")
def ruleset_merge(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name"), F.col("p_size").alias("value"), "p_partkey")
    return state.merge_rules(p.where("p_partkey % 2 = 0").select("name", "value"), p.where("p_partkey % 2 = 1").select("name", (F.col("value") + 100).alias("value")))


@query(f"WITH {DOCS_SQL} SELECT path, CAST(len(regexp_extract_all(content0, '{EMAIL}')) AS INTEGER) AS match_count FROM d WHERE regexp_matches(content0, '{EMAIL}')")
def python_regex_rule(spark, sf_dir):
    """An expression that Java can't run alike goes through Python; this one can be checked."""
    m = files(spark, sf_dir).select("path", python_match(Leaf("content", "regex", EMAIL, True)).alias("m"))
    return m.where("m.matched").select("path", "m.match_count")


@query()
def builtin_scan(spark, sf_dir):
    return scan.hits_long(scan.scan(files(spark, sf_dir), RULES)).select("path", "rule_name", "severity", "match_text", "match_count")


@query("SELECT page_id, html AS content FROM pages")
def extract_html_source(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", extract_text(F.lit("html"), F.encode("html", "utf-8")).alias("content"))


@query("SELECT concat('turns.zip/', conv_id, '!', turn, '.txt') AS path, text AS content, 0 AS errors FROM conversations")
def archive_entries_scan(spark, sf_dir):
    """Each turn as the entry of a zip archive, written and read again."""
    import pandas as pd

    def pack(batches):
        for b in batches:
            rows = []
            for c, t, x in zip(b["conv_id"], b["turn"], b["text"], strict=True):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w") as z:
                    z.writestr(f"{t}.txt", x)
                rows.append((f"turns.zip/{c}", buffer.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "raw"])

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return archive_entries(c.mapInPandas(pack, "path string, raw binary")).select("path", "content", "errors")


# Incremental runs, caches and roll-ups.


@query(f"WITH {DOCS_SQL}, x AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE size END AS own FROM d) SELECT path AS rel_path, 1.0 AS mtime, own AS size FROM x WHERE own > 0 AND own <= 9000 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0")
def manifest_build(spark, sf_dir):
    kept = _flawed(spark, sf_dir).where(scan.removal_reason(9000).isNull())
    return stores.build_manifest(kept.select(F.col("path").alias("rel_path"), F.lit(1.0).alias("mtime"), "size"))


@query(_hits_sql() + f", {_DIFF} SELECT h.path, h.rule_name, CASE WHEN s.status = 'unchanged' THEN 'old' ELSE 'fresh' END AS origin FROM h JOIN s ON h.path = s.path WHERE s.status <> 'deleted'")
def incremental_scan(spark, sf_dir):
    """Only new and changed files are scanned; the hits of unchanged ones come from the run before."""
    now, before = _states(spark, sf_dir)
    diff = state.manifest_diff(now, before)
    todo = diff.where("status IN ('new', 'changed')").select("path")
    fresh = scan.hits_long(scan.scan(files(spark, sf_dir).join(todo, "path", "left_semi"), DEMO)).select("path", "rule_name", F.lit("fresh").alias("origin"))
    old = scan.hits_long(results(spark, sf_dir).join(before.select("path"), "path", "left_semi")).select("path", "rule_name", F.lit("old").alias("origin"))
    return state.merge_unchanged(fresh, old, diff)


def _cache_tables(spark, sf_dir):
    f = files(spark, sf_dir).select("path", F.lit(1.0).alias("mtime"), "size", "doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("file_hash"))
    paths = f.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, 2.0).otherwise(1.0).alias("mtime"), "file_hash")
    known = f.where("doc_id % 7 <> 0").select("file_hash", (F.col("size") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)).alias("size"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 100).cast("int")), "yyyy-MM-dd").alias("scanned_at"), "doc_id")
    return f, paths, known


@query(f"WITH {DOCS_SQL} SELECT path, CASE WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND (doc_id % 7 = 0 OR doc_id % 4 <> 0) THEN sha256(CAST(doc_id AS VARCHAR)) END AS file_hash FROM d")
def cache_by_path(spark, sf_dir):
    f, paths, known = _cache_tables(spark, sf_dir)
    return cache.hashes_of(f.select("path", "mtime", "size"), paths, known).select("path", "file_hash")


@query("SELECT doc_id, rule_hash FROM (SELECT doc_id, concat('r', doc_id % 6) AS rule_hash FROM documents) WHERE rule_hash IN ('r0', 'r2', 'r4')")
def prune_orphans(spark, sf_dir):
    held = files(spark, sf_dir).select("doc_id", F.concat(F.lit("r"), F.col("doc_id") % 6).alias("rule_hash"))
    return cache.prune_orphan_rules(held, spark.createDataFrame([("r0",), ("r2",), ("r4",), ("r9",)], "rule_hash string"))


@query("WITH k AS (SELECT * FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 100 >= 40) SELECT 'files' AS table_name, count(*) AS rows FROM k UNION ALL SELECT 'paths', count(*) FILTER (doc_id % 3 <> 0) FROM k UNION ALL SELECT 'results', count(*) FROM k UNION ALL SELECT 'contents', count(*) FROM k")
def prune_stale_counts(spark, sf_dir):
    f, paths, known = _cache_tables(spark, sf_dir)
    hashes = f.select("file_hash")
    return cache.counts(cache.prune_stale({"files": known, "paths": paths, "results": hashes, "contents": hashes}, "2024-02-10"))


@query("SELECT doc_id, CASE WHEN min(doc_id) OVER (PARTITION BY text) % 2 = 0 THEN 'cached' ELSE concat('read ', text) END AS content FROM documents")
def extract_once(spark, sf_dir):
    """The cached text of a hash, else the extracted one; each hash is extracted once."""
    d = files(spark, sf_dir).select("doc_id", "content", F.sha2("content", 256).alias("file_hash"))
    held = d.groupBy("file_hash").agg(F.min("doc_id").alias("k")).where("k % 2 = 0").select("file_hash", F.lit("cached").alias("content"))
    found = cache.with_texts(d.withColumnRenamed("content", "raw"), held, F.concat(F.lit("read "), "raw"))
    return found.select("doc_id", "content")


@query(_hits_sql() + "SELECT regexp_extract(path, '^([^/]*)', 1) AS root, count(*) AS scanned_files, count(*) FILTER (n > 0) AS matched_files, CAST(sum(total) AS BIGINT) AS total_matches FROM f GROUP BY ROLLUP (root)")
def roots_rollup(spark, sf_dir):
    return scan.roots_rollup(results(spark, sf_dir).withColumn("root", F.regexp_extract("path", "^([^/]*)", 1)))


@query(_hits_sql() + "SELECT rule_name, min(ord) AS rule_ord FROM h GROUP BY rule_name")
def report_rules(spark, sf_dir):
    return scan.report_rules(results(spark, sf_dir))


@query(f"WITH {DOCS_SQL} SELECT regexp_extract(path, '([^/]*)/[^/]*$', 1) AS extension, count(*) AS files, CAST(sum(size) AS DOUBLE) AS total_ms, arg_max(path, (size, path)) AS slowest, CAST(max(size) AS DOUBLE) AS max_ms FROM d GROUP BY ALL")
def perf_slowest_by_extension(spark, sf_dir):
    f = files(spark, sf_dir).select(F.regexp_extract("path", "([^/]*)/[^/]*$", 1).alias("extension"), "path", F.col("size").cast("double").alias("total_ms"))
    return state.slowest_by_extension(f)


@query(f"WITH {DOCS_SQL}, t AS (SELECT path, [regexp_extract(content, '{EMAIL}'), regexp_extract(content, '[0-9]+'), regexp_extract(content, '{IPV4}')] AS x FROM d) SELECT path, concat_ws('|', nullif(x[1], ''), nullif(x[2], ''), CASE WHEN x[3] <> '' AND x[3] <> x[2] THEN x[3] END) AS texts FROM t WHERE x[1] <> '' OR x[2] <> '' OR x[3] <> ''")
def match_texts_ordered_distinct(spark, sf_dir):
    """The first text of each predicate that hit, in the predicates' order, each once."""
    spec = Or(tuple(Leaf("content", "regex", p, True) for p in (EMAIL, "[0-9]+", IPV4)))
    f = files(spark, sf_dir).withColumn("content", F.when(T.is_minified(F.col("content")), "").otherwise(F.col("content")))
    return f.select("path", column(spec).alias("m")).where("m.matched").select("path", F.array_join("m.match_texts", "|").alias("texts"))


_ALLOWED = "WITH a AS (SELECT concat('p', doc_id % 50) AS path_glob, '*' AS rule_name FROM documents GROUP BY ALL), b AS (SELECT concat('p', doc_id % 80) AS path_glob, '*' AS rule_name FROM documents GROUP BY ALL)"


@query(_ALLOWED + " SELECT path_glob, rule_name, 'old' AS source FROM a UNION ALL SELECT path_glob, rule_name, 'new' FROM b WHERE path_glob NOT IN (SELECT path_glob FROM a)")
def whitelist_import(spark, sf_dir):
    ids = files(spark, sf_dir)
    held, more = (ids.select(F.concat(F.lit("p"), F.col("doc_id") % n).alias("path_glob"), F.lit("*").alias("rule_name")).distinct().withColumn("source", F.lit(s)) for n, s in ((50, "old"), (80, "new")))
    return state.import_entries(held, more)


@query("SELECT o_custkey AS workspace_id, CAST(sum(o_totalprice) AS DOUBLE) AS duration_seconds, count(*) AS scanned_files, 0 AS unchanged_files, count(*) / CAST(sum(o_totalprice) AS DOUBLE) AS speed FROM orders GROUP BY ALL")
def scan_speed(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    runs = o.groupBy(F.col("o_custkey").alias("workspace_id")).agg(F.sum("o_totalprice").alias("duration_seconds"), F.count("*").alias("scanned_files")).withColumn("unchanged_files", F.lit(0))
    return scan.speed(runs)


def _planted(spark, sf_dir):
    """The documents with a secret of one kind or another behind their text."""
    h = F.upper(F.sha2(F.col("doc_id").cast("string"), 256))
    kinds = [(3, F.concat(F.lit(" AKIA"), F.substring(h, 1, 16))), (5, F.concat(F.lit("\npassword = "), h)), (7, F.concat(F.lit(" ghp_"), F.substring(h, 1, 40))), (11, F.lit("\n-----BEGIN RSA PRIVATE KEY-----"))]
    more = F.concat(*[F.when(F.col("doc_id") % n == 0, x).otherwise("") for n, x in kinds])
    return files(spark, sf_dir).withColumn("content", F.concat("content", more))


def _planted_sql(rules) -> str:
    h = "upper(sha256(CAST(doc_id AS VARCHAR)))"
    kinds = [(3, f"concat(' AKIA', substr({h}, 1, 16))"), (5, f"concat(chr(10), 'password = ', {h})"), (7, f"concat(' ghp_', substr({h}, 1, 40))"), (11, "concat(chr(10), '-----BEGIN RSA PRIVATE KEY-----')")]
    text = "concat(text, " + ", ".join(f"CASE WHEN doc_id % {n} = 0 THEN {x} ELSE '' END" for n, x in kinds) + ")"
    d = f"p AS (SELECT *, {text} AS t FROM documents), d AS (SELECT concat(source, '/', lang, '/', doc_id, '.txt') AS path, concat(doc_id, '.txt') AS name, CASE WHEN length(t) >= 2048 AND list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) >= 5000 THEN '' ELSE t END AS content FROM p)"
    parts = []
    for r in rules:
        m, n = sql_spec(r.match)
        parts.append(f"SELECT path, {_q(r.name)} AS rule_name, {_q(r.severity)} AS severity, CAST({n} AS INTEGER) AS match_count FROM d WHERE {m}")
    return f"WITH {d} " + " UNION ALL ".join(parts)


@query(_planted_sql(RULES))
def builtin_scan_planted(spark, sf_dir):
    return scan.hits_long(scan.scan(_planted(spark, sf_dir), RULES)).select("path", "rule_name", "severity", "match_count")


_COMPLIANCE = templates.template("compliance_scan").rules


@query(f"SELECT rule_name, severity, count(DISTINCT path) AS files, CAST(sum(match_count) AS BIGINT) AS matches FROM ({_planted_sql(_COMPLIANCE)}) GROUP BY ALL")
def template_scan_planted(spark, sf_dir):
    return scan.group_by_rule(scan.scan(_planted(spark, sf_dir), _COMPLIANCE))


@query("SELECT path, any_value(size) AS size FROM (SELECT concat('f', doc_id % 500) AS path, 1 AS size FROM documents) GROUP BY path")
def duplicate_paths(spark, sf_dir):
    return state.one_per_path(files(spark, sf_dir).select(F.concat(F.lit("f"), F.col("doc_id") % 500).alias("path"), F.lit(1).alias("size")))


@query("WITH r AS (SELECT o_custkey AS workspace_id, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 0))) AS a, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderkey % 2 = 1))) AS b FROM orders GROUP BY ALL) SELECT workspace_id, array_to_string(list_sort([x for x in coalesce(a, []) if NOT list_contains(coalesce(b, []), x)]), ',') AS new_rules, array_to_string(list_sort([x for x in coalesce(b, []) if NOT list_contains(coalesce(a, []), x)]), ',') AS dropped_rules FROM r")
def compare_rules(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    names = lambda odd: F.collect_set(F.when(F.col("o_orderkey") % 2 == odd, F.col("o_orderpriority")))
    runs = o.groupBy(F.col("o_custkey").alias("workspace_id")).agg(names(0).alias("now"), names(1).alias("before"))
    fresh, gone = state.compare_names(F.col("now"), F.col("before"))
    return runs.select("workspace_id", F.array_join(fresh, ",").alias("new_rules"), F.array_join(gone, ",").alias("dropped_rules"))
