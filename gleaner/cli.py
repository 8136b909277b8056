"""The command line: scan, benchmark, rules, cache. Exit codes: 0 fine, 1 an error or a regression, 2 broken rules, 130 interrupted."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys

from .plans import templates
from .plans.builtin import load_with_builtin
from .plans.model import RuleError, RuleSet, merge

OK, FAILED, BAD_RULES, INTERRUPTED = 0, 1, 2, 130


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("gleaner", description="Scan files by rules, on Spark.")
    sub = p.add_subparsers(dest="command", required=True)
    rules = argparse.ArgumentParser(add_help=False)
    rules.add_argument("-r", "--rules", action="append", default=[], help="rule files, later ones on top")
    rules.add_argument("--template", action="append", default=[], choices=templates.names(), help="named templates, below the files")
    rules.add_argument("--no-builtin", action="store_true")
    s = sub.add_parser("scan", parents=[rules])
    s.add_argument("path", nargs="+")
    s.add_argument("-o", "--output", default="text", choices=["text", "json", "csv", "sarif"])
    s.add_argument("-f", "--file")
    s.add_argument("--max-depth", type=int)
    s.add_argument("--max-file-size", type=float, help="MB")
    s.add_argument("--ignore-dir", action="append", default=[])
    s.add_argument("--state", help="folder of the manifest, results and history: later scans read changed files only")
    s.add_argument("--perf", action="store_true", help="times of the stages, to stderr")
    s.add_argument("--perf-save")
    b = sub.add_parser("benchmark", aliases=["bench"], parents=[rules])
    b.add_argument("path")
    b.add_argument("--rounds", type=int, default=3)
    b.add_argument("--warmup", type=int, default=1)
    b.add_argument("--save-baseline")
    b.add_argument("--baseline")
    b.add_argument("-o", "--output", default="table", choices=["table", "json"])
    sub.add_parser("rules", parents=[rules])
    c = sub.add_parser("cache")
    c.add_argument("action", choices=["stats", "clear", "prune"])
    c.add_argument("--cache-path", default=os.path.join(os.path.expanduser("~"), ".gleaner-cache"))
    c.add_argument("--max-age-days", type=int, default=30)
    return p


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("gleaner").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def ruleset(args: argparse.Namespace) -> RuleSet:
    out = load_with_builtin([], not args.no_builtin)
    for name in args.template:
        out = merge(out, templates.template(name))
    for path in args.rules:
        out = merge(out, load_with_builtin([path], False))
    return out


def write(text: str, path: str | None) -> None:
    if not path:
        print(text)
        return
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def scan(args: argparse.Namespace) -> int:
    from .engine import Scanner
    from .operators import stores

    if missing := [p for p in args.path if not os.path.exists(p)]:
        print(f"no such path: {', '.join(missing)}", file=sys.stderr)
        return FAILED
    rules, spark = ruleset(args), session()
    most = None if args.max_file_size is None else int(args.max_file_size * 1024 * 1024)
    scanner = Scanner(spark, rules, max_depth=args.max_depth, max_file_size=most, ignore_dirs=tuple(args.ignore_dir))
    for name, why in scanner.broken:
        print(f"rule {name} doesn't run: {why}", file=sys.stderr)
    place = lambda n: os.path.join(args.state, n)
    before = manifest = None
    if args.state:
        before, manifest = stores.load_table(spark, place("results")), stores.load_table(spark, place("manifest"), stores.MANIFEST)
    report = scanner.scan(*args.path, previous=before, manifest=manifest)
    if args.state:
        for name, df in (("results", report.results), ("manifest", report.manifest)):
            stores.save_table(df, place(name + ".new"))
            stores.save_table(spark.read.parquet(place(name + ".new")), place(name))
        stores.HistoryStore(place("history.json")).add(report.history_entry(args.path[0]))
    write(report.render(args.output), args.file)
    if args.perf:
        print("\n".join(f"{k}: {v:.1f} ms" for k, v in report.stages.items()), file=sys.stderr)
    if args.perf_save:
        stores.write_json(args.perf_save, {"timestamp": stores.now(), "stages": report.stages, "meta": {"paths": args.path}})
    return OK


def benchmark(args: argparse.Namespace) -> int:
    from .engine import Scanner
    from .operators import state, stores

    spark, rows = session(), []
    scanner = Scanner(spark, ruleset(args))
    for n in range(-args.warmup, args.rounds):
        stages = scanner.scan(args.path).stages
        rows += [(n, k, v) for k, v in stages.items() if n >= 0]
    samples = spark.createDataFrame(rows, "round int, stage string, total_ms double")
    result = state.stage_stats(samples)
    if args.save_baseline:
        stores.save_baseline(result, args.save_baseline)
    out = [r.asDict() for r in result.orderBy("stage").collect()]
    regressed = []
    if args.baseline:
        compared = state.compare_to_baseline(result, stores.load_baseline(spark, args.baseline))
        regressed = [r["stage"] for r in compared.where("regressed").collect()]
    if args.output == "json":
        print(json.dumps({"stages": out, "regressed": regressed}, indent=2))
    else:
        print("\n".join(f"{r['stage']:10} {r['mean_ms']:10.1f} ms ({r['min_ms']:.1f} to {r['max_ms']:.1f}, {r['n']} rounds)" for r in out))
        print("\n".join(f"slower than the baseline: {s}" for s in regressed))
    return FAILED if regressed else OK


def rules(args: argparse.Namespace) -> int:
    own = ruleset(args)
    for r in own.rules:
        print(f"{r.severity:9} {r.name}")
    print(f"{len(own.rules)} rules")
    return OK


def cache(args: argparse.Namespace) -> int:
    from .operators.cache import CacheStore

    store = CacheStore(session(), args.cache_path)
    if args.action == "stats":
        print(json.dumps(store.stats()))
    elif args.action == "clear":
        store.clear()
    else:
        print(store.prune((dt.datetime.now() - dt.timedelta(days=args.max_age_days)).isoformat(timespec="seconds")))
    return OK


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return {"scan": scan, "benchmark": benchmark, "bench": benchmark, "rules": rules, "cache": cache}[args.command](args)
    except RuleError as e:
        print(f"rules: {e}", file=sys.stderr)
        return BAD_RULES
    except KeyboardInterrupt:
        return INTERRUPTED
    except Exception as e:  # noqa: BLE001  the command's last word; the exit code tells
        print(f"{type(e).__name__}: {str(e)[:200]}", file=sys.stderr)
        return FAILED
