"""Rules as data: predicate trees, rules and rule sets; parsing, merging, serialising, hashing."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from typing import Any

TARGETS = ("filename", "content", "path")
MODES = ("contains", "equals", "startswith", "endswith", "regex")
SEVERITIES = ("info", "warning", "critical")
VERSIONS = ("1.0",)


class RuleError(ValueError):
    """A rule set that can't be read or has no valid meaning."""


@dataclass(frozen=True)
class Leaf:
    target: str
    mode: str
    pattern: str
    case_sensitive: bool = False
    description: str = ""


@dataclass(frozen=True)
class And:
    children: tuple[Spec, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Spec, ...]


@dataclass(frozen=True)
class Not:
    child: Spec


Spec = Leaf | And | Or | Not


@dataclass(frozen=True)
class Rule:
    name: str
    match: Spec
    severity: str = "info"
    description: str = ""
    replace: bool = False
    replace_with: str | None = None


@dataclass(frozen=True)
class AllowEntry:
    path_glob: str
    rule_name: str = "*"
    note: str = ""
    source: str = "rules"


@dataclass(frozen=True)
class ScanParams:
    """None: not set, which a merge leaves to the other side."""

    max_workers: int | None = None
    max_depth: int | None = None
    max_file_size: int | None = None
    scan_archives: bool | None = None
    use_cache: bool | None = None
    perf: bool | None = None


@dataclass(frozen=True)
class RuleSet:
    version: str = "1.0"
    rules: tuple[Rule, ...] = ()
    ignore_paths: tuple[str, ...] = ()
    ignore_dirs: tuple[str, ...] = ()
    scan_extensions: tuple[str, ...] | None = None
    scan_params: ScanParams = field(default_factory=ScanParams)
    whitelist: tuple[AllowEntry, ...] = ()


def _need(data: dict, key: str, kind: type, default: Any = None) -> Any:
    value = data.get(key, default)
    if value is None or not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise RuleError(f"{key} must be of type {kind.__name__}")
    return value


def parse_match(data: Any) -> Spec:
    if not isinstance(data, dict):
        raise RuleError("a match must be a mapping")
    kind = str(data.get("type", "leaf" if "pattern" in data else "")).lower()
    if kind in ("and", "or"):
        children = data.get("children")
        if not isinstance(children, list) or not children:
            raise RuleError(f"{kind} needs children")
        return (And if kind == "and" else Or)(tuple(parse_match(c) for c in children))
    if kind == "not":
        child = data.get("child", (data.get("children") or [None])[0])
        return Not(parse_match(child))
    target = kind if kind in TARGETS else data.get("target", "content")
    mode = _need(data, "mode", str).lower()
    if target not in TARGETS or mode not in MODES:
        raise RuleError(f"unknown target or mode: {target}, {mode}")
    return Leaf(target, mode, _need(data, "pattern", str), bool(data.get("case_sensitive", False)), str(data.get("description", "")))


def parse_rule(data: Any) -> Rule:
    if not isinstance(data, dict):
        raise RuleError("a rule must be a mapping")
    name = _need(data, "name", str)
    severity = str(data.get("severity", "info")).lower()
    if not name.strip() or severity not in SEVERITIES:
        raise RuleError(f"bad name or severity: {name!r}, {severity!r}")
    return Rule(name, parse_match(data.get("match")), severity, str(data.get("description", "")), bool(data.get("replace", False)), data.get("replace_with"))


def _strings(data: dict, key: str) -> tuple[str, ...]:
    value = data.get(key) or []
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise RuleError(f"{key} must be a list of strings")
    return tuple(value)


def parse_ruleset(data: Any) -> RuleSet:
    if not isinstance(data, dict):
        raise RuleError("a rule set must be a mapping")
    version = str(data.get("version", "1.0"))
    if version not in VERSIONS:
        raise RuleError(f"unknown version {version}")
    params = data.get("scan_params") or {}
    for key, value in params.items():
        kind = bool if key in ("scan_archives", "use_cache", "perf") else int
        if value is not None and (not isinstance(value, kind) or (kind is int and isinstance(value, bool))):
            raise RuleError(f"scan_params.{key} must be of type {kind.__name__}")
    extensions = data.get("scan_extensions")
    return RuleSet(
        version,
        tuple(parse_rule(r) for r in data.get("rules") or []),
        _strings(data, "ignore_paths"),
        _strings(data, "ignore_dirs"),
        None if extensions is None else tuple(x.lower().lstrip(".") for x in _strings(data, "scan_extensions")),
        ScanParams(**{k: v for k, v in params.items() if k in ScanParams.__dataclass_fields__}),
        tuple(AllowEntry(w["path_glob"], w.get("rule_name", "*"), w.get("note", "")) for w in data.get("whitelist") or []),
    )


def load_ruleset(path: str) -> RuleSet:
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f)
    except (OSError, yaml.YAMLError) as e:
        raise RuleError(str(e)) from e
    if not data:
        raise RuleError(f"{path} is empty")
    return parse_ruleset(data)


def merge(base: RuleSet, over: RuleSet) -> RuleSet:
    """Rules of base that over doesn't name again, then over's; lists united; single values over's where set."""
    names = {r.name for r in over.rules}
    allowed = {(w.path_glob, w.rule_name): w for w in base.whitelist}
    allowed.update({(w.path_glob, w.rule_name): w for w in over.whitelist})
    params = {k: v for k, v in vars(over.scan_params).items() if v is not None}
    return RuleSet(
        over.version,
        tuple(r for r in base.rules if r.name not in names) + over.rules,
        tuple(dict.fromkeys(base.ignore_paths + over.ignore_paths)),
        tuple(dict.fromkeys(base.ignore_dirs + over.ignore_dirs)),
        base.scan_extensions if over.scan_extensions is None else over.scan_extensions,
        replace(base.scan_params, **params),
        tuple(allowed.values()),
    )


def resolve_template(name: str, templates: dict[str, dict], seen: tuple[str, ...] = ()) -> RuleSet:
    """A named template over its parents, in order; its own data last. Cycles and unknown parents are errors."""
    if name in seen or name not in templates:
        raise RuleError(f"{'cycle at' if name in seen else 'unknown'} template {name}")
    data = templates[name]
    out = RuleSet()
    for parent in data.get("extends") or []:
        out = merge(out, resolve_template(parent, templates, (*seen, name)))
    return merge(out, parse_ruleset({k: v for k, v in data.items() if k != "extends"}))


def match_dict(spec: Spec) -> dict:
    if isinstance(spec, Leaf):
        out: dict = {"type": spec.target, "mode": spec.mode, "pattern": spec.pattern}
        if spec.case_sensitive:
            out["case_sensitive"] = True
        if spec.description:
            out["description"] = spec.description
        return out
    if isinstance(spec, Not):
        return {"type": "not", "child": match_dict(spec.child)}
    return {"type": "and" if isinstance(spec, And) else "or", "children": [match_dict(c) for c in spec.children]}


def rule_dict(rule: Rule) -> dict:
    out = {"name": rule.name, "severity": rule.severity, "match": match_dict(rule.match)}
    if rule.description:
        out["description"] = rule.description
    if rule.replace:
        out |= {"replace": True, "replace_with": rule.replace_with}
    return out


def ruleset_dict(rs: RuleSet) -> dict:
    out: dict = {"version": rs.version, "rules": [rule_dict(r) for r in rs.rules]}
    for key in ("ignore_paths", "ignore_dirs"):
        if getattr(rs, key):
            out[key] = list(getattr(rs, key))
    if rs.scan_extensions is not None:
        out["scan_extensions"] = list(rs.scan_extensions)
    if params := {k: v for k, v in vars(rs.scan_params).items() if v is not None}:
        out["scan_params"] = params
    if rs.whitelist:
        out["whitelist"] = [{"path_glob": w.path_glob, "rule_name": w.rule_name, "note": w.note} for w in rs.whitelist]
    return out


def save_ruleset(rs: RuleSet, path: str) -> None:
    import yaml

    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(ruleset_dict(rs), f, allow_unicode=True, sort_keys=False)


def rule_hash(rule: Rule) -> str:
    """What a rule finds, without what it replaces."""
    data = {"name": rule.name, "match": match_dict(rule.match), "description": rule.description, "severity": rule.severity}
    return hashlib.sha256(json.dumps(data, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def leaves(spec: Spec) -> list[Leaf]:
    if isinstance(spec, Leaf):
        return [spec]
    return [x for c in (spec.children if isinstance(spec, And | Or) else (spec.child,)) for x in leaves(c)]


def needs_content(spec: Spec) -> bool:
    return any(x.target == "content" for x in leaves(spec))


def required_extensions(spec: Spec) -> frozenset[str] | None:
    """Extensions outside which the predicate can't match; None: any."""
    if isinstance(spec, Leaf) and spec.target == "filename" and spec.mode in ("endswith", "equals") and "." in spec.pattern:
        return frozenset([spec.pattern.lower().rsplit(".", 1)[1]]) if spec.pattern.rsplit(".", 1)[1] else None
    if isinstance(spec, And):
        known = [x for c in spec.children if (x := required_extensions(c)) is not None]
        return frozenset.intersection(*known) if known else None
    if isinstance(spec, Or):
        all_ = [required_extensions(c) for c in spec.children]
        return frozenset().union(*all_) if all_ and None not in all_ else None  # type: ignore[arg-type]
    return None
