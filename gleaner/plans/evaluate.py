"""The meaning of predicates in plain Python: for expressions that Java can't run alike, and for tests."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from .model import And, Leaf, Not, Or, Spec


class Match(NamedTuple):
    matched: bool
    match_text: str = ""
    match_count: int = 0
    target: str = ""
    match_texts: tuple[str, ...] = ()
    detail: str = ""


MISS = Match(False)


@lru_cache(maxsize=512)
def regex(pattern: str, case_sensitive: bool) -> re.Pattern:
    return re.compile(pattern, 0 if case_sensitive else re.IGNORECASE)


def _leaf(leaf: Leaf, text: str) -> Match:
    if leaf.mode in ("regex", "contains"):
        literal = leaf.mode == "contains"
        found = [m.group(0) for m in regex(re.escape(leaf.pattern) if literal else leaf.pattern, leaf.case_sensitive).finditer(text)]
        if not found:
            return MISS
        first = leaf.pattern if literal else found[0]
        return Match(True, first, len(found), leaf.target, (first,) if first else (), f"包含 {first!r}" if literal else f"正则命中: {first!r}")
    t, p = (text, leaf.pattern) if leaf.case_sensitive else (text.lower(), leaf.pattern.lower())
    ok = {"equals": t == p, "startswith": t.startswith(p), "endswith": t.endswith(p)}[leaf.mode]
    detail = {"equals": "完全相等", "startswith": f"以 {p!r} 开头", "endswith": f"以 {p!r} 结尾"}[leaf.mode]
    return Match(True, p, 1, leaf.target, (p,) if p else (), detail) if ok else MISS


def evaluate(spec: Spec, filename: str, path: str, content: str) -> Match:
    if isinstance(spec, Leaf):
        return _leaf(spec, {"filename": filename, "path": path, "content": content}[spec.target] or "")
    if isinstance(spec, Not):
        inner = evaluate(spec.child, filename, path, content)
        return MISS if inner.matched else Match(True, "", 1, "", (), "子条件未命中")
    every = [evaluate(c, filename, path, content) for c in spec.children]
    hits = [m for m in every if m.matched]
    if (isinstance(spec, And) and len(hits) < len(every)) or (isinstance(spec, Or) and not hits):
        return MISS
    texts = tuple(dict.fromkeys(t for m in hits for t in m.match_texts if t))
    joined = (" AND " if isinstance(spec, And) else " OR ").join(m.detail for m in hits if m.detail)
    target = "" if isinstance(spec, And) else hits[0].target
    return Match(True, texts[0] if texts else "", sum(m.match_count for m in hits), target, texts, joined or ("全部命中" if isinstance(spec, And) else "任一命中"))
