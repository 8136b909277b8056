import random
import re

import pytest
from gleaner.plans import model as M
from gleaner.plans.compile import column, java_pattern
from gleaner.plans.evaluate import evaluate

TEXTS = ["password=AKIA1234\nhello", "", "Ärger MIT License mit", "aaa.b(a)+", "x\ny\n", "the the THE", "é́ ÉA 12٣"]
WORDS = ["a", "the", "mit", "A.b", "=", "ä", "(a)", "x", "12"]


def spec(r: random.Random, depth: int = 0) -> M.Spec:
    kind = r.randrange(6 if depth < 2 else 3)
    if kind < 3:
        mode = r.choice(M.MODES)
        pattern = r.choice(WORDS) if mode != "regex" else r.choice([r"a+", r"(?i)mit\s+license", r"\bthe\b", r"[0-9]+", "x|y", r"\d+", "(a|b)*c"])
        return M.Leaf(r.choice(M.TARGETS), mode, pattern, r.random() < 0.5)
    if kind == 3:
        return M.Not(spec(r, depth + 1))
    return (M.And if kind == 4 else M.Or)(tuple(spec(r, depth + 1) for _ in range(r.randint(1, 3))))


def test_columns_mean_what_python_means(spark):
    r = random.Random(5)
    specs = [spec(r) for _ in range(40)]
    rows = [(f"f{i}.txt", f"dir/f{i}.txt", "txt", t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "name string, path string, extension string, content string")
    got = df.select("path", *[column(s).alias(f"m{i}") for i, s in enumerate(specs)]).collect()
    for row, (name, path, _, content) in zip(got, rows, strict=True):
        for i, s in enumerate(specs):
            want, m = evaluate(s, name, path, content), row[f"m{i}"]
            assert (m["matched"], m["match_text"], m["match_count"], m["target"], tuple(m["match_texts"])) == want[:5], (s, content)


def test_overlapping_rules_are_independent():
    text = "password=AKIA1234"
    assert evaluate(M.Leaf("content", "regex", r"password=\S+"), "", "", text).matched
    assert evaluate(M.Leaf("content", "regex", r"AKIA\d+"), "", "", text).match_text == "AKIA1234"


def test_patterns_that_java_reads_differently_go_to_python():
    assert java_pattern(r"(?P<a>x)", True) is None
    assert java_pattern("(a|b)*c", True) is None
    assert java_pattern("(?i)abc", True) == "(?dUiu)abc"
    with pytest.raises(ValueError):
        java_pattern("(", True)


def test_merge_keeps_order_and_overrides():
    leaf = M.Leaf("content", "contains", "x")
    a = M.RuleSet(rules=(M.Rule("p", leaf), M.Rule("q", leaf)), ignore_dirs=("x",), scan_extensions=("py",), scan_params=M.ScanParams(max_depth=3, max_workers=2))
    b = M.RuleSet(rules=(M.Rule("p", leaf, "critical"),), ignore_dirs=("y", "x"), scan_params=M.ScanParams(max_depth=0), whitelist=(M.AllowEntry("*", "p"),))
    m = M.merge(a, b)
    assert [(r.name, r.severity) for r in m.rules] == [("q", "info"), ("p", "critical")]
    assert (m.ignore_dirs, m.scan_extensions, m.scan_params.max_depth, m.scan_params.max_workers) == (("x", "y"), ("py",), 0, 2)


def test_parse_and_serialise_round_trip():
    data = {"version": "1.0", "rules": [{"name": "r", "severity": "warning", "match": {"type": "and", "children": [{"type": "content", "mode": "regex", "pattern": "a+"}, {"type": "not", "child": {"type": "path", "mode": "endswith", "pattern": ".json"}}]}}], "scan_extensions": [".PY"]}
    rs = M.parse_ruleset(data)
    assert rs.scan_extensions == ("py",)
    assert M.parse_ruleset(M.ruleset_dict(rs)) == rs
    assert M.rule_hash(rs.rules[0]) == M.rule_hash(M.replace(rs.rules[0], replace=True))


@pytest.mark.parametrize("bad", [None, {"version": "9"}, {"rules": [{"name": "", "match": {}}]}, {"rules": [{"name": "a", "match": {"type": "and", "children": []}}]}, {"scan_params": {"max_depth": True}}])
def test_bad_rule_sets_are_refused(bad):
    with pytest.raises(M.RuleError):
        M.parse_ruleset(bad)


def test_templates_inherit_and_cycles_are_refused():
    t = {"a": {"ignore_dirs": ["x"]}, "b": {"extends": ["a"], "ignore_dirs": ["y"]}, "c": {"extends": ["c"]}}
    assert M.resolve_template("b", t).ignore_dirs == ("x", "y")
    with pytest.raises(M.RuleError):
        M.resolve_template("c", t)


def test_required_extensions():
    f = lambda p: M.Leaf("filename", "endswith", p)
    assert M.required_extensions(M.Or((f(".py"), f(".js")))) == {"py", "js"}
    assert M.required_extensions(M.Or((f(".py"), M.Leaf("content", "contains", "x")))) is None
    assert M.required_extensions(M.And((f(".py"), M.Leaf("content", "contains", "x")))) == {"py"}


def test_globs():
    from gleaner.functions.text import glob_regex

    to = lambda g: glob_regex(g).replace("\\z", "\\Z")
    assert re.match(to("src*/[!a]?.txt"), "src/x/bc.txt")
    assert not re.match(to("*.txt"), "a.txt\n")
