"""Reports: flat rows, CSV, JSON, SARIF and text, each as a plan that writes in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import hits_long, max_severity, rule_names, total_matches


def csv_rows(results: DataFrame) -> DataFrame:
    """One row per hit."""
    return hits_long(results, "path", "size").select("path", "size", "severity", F.col("rule_name").alias("rule"), F.col("match_description").alias("description"), "match_count")


def json_rows(results: DataFrame) -> DataFrame:
    return results.where(F.size("hits") > 0).select("path", F.to_json(F.struct("path", "size", max_severity().alias("max_severity"), total_matches().alias("match_count"), F.col("hits").alias("rules"))).alias("json"))


def sarif_rows(results: DataFrame) -> DataFrame:
    level = F.when(F.col("severity") == "critical", "error").when(F.col("severity") == "warning", "warning").otherwise("note")
    return hits_long(results).select(F.col("rule_name").alias("rule_id"), level.alias("level"), F.col("path").alias("uri"))


def sarif(results: DataFrame, name: str = "gleaner") -> str:
    """The whole envelope, for reports small enough for one document."""
    import json

    rows = [{"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["rule_id"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}}}]} for r in sarif_rows(results).toLocalIterator()]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": name}}, "results": rows}]}, ensure_ascii=False)


def text_rows(results: DataFrame) -> DataFrame:
    return results.where(F.size("hits") > 0).select(F.concat(F.lit("["), max_severity(), F.lit("] "), F.col("path"), F.lit(": "), F.array_join(rule_names(), ", ")).alias("line"))


def summary(stats: dict) -> str:
    """One line of a run's numbers."""
    return ", ".join(f"{k}: {stats.get(k, 0)}" for k in ("total_files", "scanned_files", "matched_files", "skipped_files", "errors", "total_matches"))


def text_report(results: DataFrame, root: str, stats: dict) -> str:
    """Header, numbers, a line per file with hits and one per hit, with paths below the root. For reports of one document."""
    lines = [root, summary(stats), ""]
    for r in results.where(F.size("hits") > 0).select("path", max_severity().alias("s"), "hits").orderBy("path").toLocalIterator():
        lines.append(f"[{r['s']}] {r['path'].removeprefix(root).lstrip('/')}")
        lines += [f"  - {h['rule_name']} ({h['severity']}) x{h['match_count']}: {h['match_text']}" for h in r["hits"]]
    return "\n".join(lines)


def json_report(results: DataFrame, root: str, stats: dict, cancelled: bool = False) -> str:
    """The whole document: root, stats, cancelled, hits. For reports of one document; ``save`` writes any size."""
    import json

    hits = [json.loads(r["json"]) for r in json_rows(results).orderBy("path").toLocalIterator()]
    return json.dumps({"root": root, "stats": stats, "cancelled": cancelled, "hits": hits}, ensure_ascii=False, indent=2)


HITS = "array<struct<rule_ord:int,rule_name:string,severity:string,match_text:string,match_count:int,target:string,match_texts:array<string>,match_description:string>>"


def load_json(spark, path: str) -> tuple[DataFrame, dict]:
    """Results (path, size, hits) and stats of a document that ``json_report`` made; files without hits aren't in it."""
    import json

    with open(path, encoding="utf-8") as f:
        stats = json.load(f).get("stats", {})
    rows = spark.read.option("multiLine", True).schema(f"hits array<struct<path:string,size:long,rules:{HITS}>>").json(path)
    return rows.select(F.explode("hits").alias("h")).select("h.path", "h.size", F.col("h.rules").alias("hits")), stats


def csv_report(results: DataFrame) -> str:
    """All rows as one CSV text, with a header. For reports of one document."""
    import csv
    import io

    rows, out = csv_rows(results), io.StringIO()
    writer = csv.writer(out)
    writer.writerow(rows.columns)
    writer.writerows(rows.orderBy("path", "rule").toLocalIterator())
    return out.getvalue()


def save(results: DataFrame, path: str, kind: str) -> None:
    """Into a folder, by the executors: csv, json, sarif (rows) or text."""
    rows = {"csv": csv_rows, "json": json_rows, "sarif": sarif_rows}.get(kind, text_rows)(results)
    if kind == "csv":
        rows.write.option("header", True).csv(path)
    elif kind == "json":
        rows.select("json").write.text(path)
    elif kind == "sarif":
        rows.write.json(path)
    else:
        rows.write.text(path)


def flat_rows(results: DataFrame) -> DataFrame:
    return results.where(F.size("hits") > 0).select("path", F.col("hits")[0]["rule_name"].alias("first_rule"), max_severity().alias("severity"), F.size("hits").alias("hit_count"))
