"""Predicates to Catalyst expressions. Regular expressions that Java runs differently go to one Arrow UDF of Python's."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain
from re import _constants as _op, _parser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluate import evaluate
from .model import And, Leaf, Not, Rule, Spec, leaves, match_dict, needs_content, parse_match, required_extensions

MATCH = T.StructType(
    [
        T.StructField("matched", T.BooleanType()),
        T.StructField("match_text", T.StringType()),
        T.StructField("match_count", T.IntegerType()),
        T.StructField("target", T.StringType()),
        T.StructField("match_texts", T.ArrayType(T.StringType())),
    ]
)
_COLUMNS = {"filename": "name", "path": "path", "content": "content"}


def java_pattern(pattern: str, case_sensitive: bool) -> str | None:
    """The same expression for Java; None where it wouldn't mean the same or could exhaust the stack."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad regular expression {pattern!r}: {e}") from e
    if re.search(r"\(\?[^:i)]|\\[1-9AZ]|\[\[|&&|\)[*+{]|\\N|\(\?\(", pattern):
        return None
    flags = "iu" if not case_sensitive or "(?i)" in pattern else ""
    body = _classes(pattern.replace("(?i)", ""))
    return None if body is None else f"(?dU{flags})" + body


#: What Python's classes hold of all characters, in Java's terms: words are letters, numbers and _, white space has four separators more.
_WORD, _WHITE = r"\p{L}\p{N}_", r"\s\x1c-\x1f"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_INSIDE = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"


def _classes(pattern: str) -> str | None:
    """\\w \\W \\s \\S \\b \\B spelt out; None for what can't be said within a set."""
    outside = {"w": f"[{_WORD}]", "W": f"[^{_WORD}]", "s": f"[{_WHITE}]", "S": f"[^{_WHITE}]", "b": _EDGE, "B": _INSIDE}
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            e = pattern[at + 1]
            if inside and e in "WSbB":
                return None
            out.append({"w": _WORD, "s": _WHITE}.get(e, c + e) if inside else outside.get(e, c + e))
            at += 2
            continue
        if c == "[" and not inside:
            inside = True
            if pattern[at + 1 : at + 2] == "]" or pattern[at + 1 : at + 3] == "^]":  # a bracket that is a member
                return None
        elif c == "]":
            inside = False
        out.append(c)
        at += 1
    return "".join(out)


#: Characters beyond ASCII that equal i, k or s where case is ignored, and that the lower case of a text needn't show.
_LIKE_ASCII = "\u0130\u0131\u017f\u212a"
LEAST_LITERAL, MOST_LITERALS = 2, 12


def required_literals(pattern: str, case_sensitive: bool) -> tuple[str, ...]:
    """Texts of which at least one is part of whatever the expression matches; () where that can't be told.

    In lower case if the expression ignores case: then the lower case of a matching text holds one of them, or the text
    has one of the characters of _LIKE_ASCII.
    """
    tree = _parser.parse(pattern, 0 if case_sensitive else re.IGNORECASE)
    found = _needed(tree, bool(tree.state.flags & re.IGNORECASE))
    return found if found and len(found) <= MOST_LITERALS and min(map(len, found)) >= LEAST_LITERAL else ()


def _needed(nodes, fold: bool) -> tuple[str, ...]:
    """Of all parts that a match must have, the one whose shortest literal is longest."""
    found: list[tuple[str, ...]] = []
    run = ""
    for op, arg in [*nodes, (None, None)]:
        c = chr(arg) if op is _op.LITERAL else ""
        if c and (not fold or c.isascii() or c.lower() == c.upper()):
            run += c.lower() if fold else c
            continue
        found += [(run,)] if run else []
        run = ""
        if op is _op.SUBPATTERN and not arg[1] and not arg[2]:  # no flags of its own
            found.append(_needed(arg[3], fold))
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT) and arg[0] > 0:
            found.append(_needed(arg[2], fold))
        elif op is _op.BRANCH:
            ways = [_needed(way, fold) for way in arg[1]]
            found.append(tuple(dict.fromkeys(chain(*ways))) if all(ways) else ())
    return max((x for x in found if x), key=lambda x: (min(map(len, x)), -len(x)), default=())


def _guarded(count: Column, t: Column, pattern: str, case_sensitive: bool) -> Column:
    """The count of matches, taken only in texts that hold a literal which the expression needs."""
    literals = required_literals(pattern, case_sensitive)
    if not literals:
        return count
    fold = not case_sensitive or "(?i)" in pattern
    may = [F.contains(F.lower(t) if fold else t, F.lit(x)) for x in literals]
    may += [F.contains(t, F.lit(c)) for c in _LIKE_ASCII] if fold else []
    may = reduce(Column.__or__, may)
    return F.when(may, count).otherwise(0)


class Parts(NamedTuple):
    """A match's fields as expressions of their own: as fields of nested structs, trees of rules would grow exponentially."""

    matched: Column
    match_text: Column
    match_count: Column
    target: Column
    match_texts: Column


def _leaf(leaf: Leaf) -> Parts:
    t = F.coalesce(F.col(_COLUMNS[leaf.target]), F.lit(""))
    empty = F.array().cast("array<string>")
    if leaf.mode in ("regex", "contains"):
        if leaf.mode == "regex":
            expression = java_pattern(leaf.pattern, leaf.case_sensitive)
            if expression is None:
                m = python_match(leaf)
                return Parts(*[m[f] for f in Parts._fields])
            count, text = F.regexp_count(t, F.lit(expression)), F.coalesce(F.regexp_substr(t, F.lit(expression)), F.lit(""))
            count = _guarded(count, t, leaf.pattern, leaf.case_sensitive)
        else:
            expression = ("" if leaf.case_sensitive else "(?iu)") + "\\Q" + leaf.pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
            count, text = F.regexp_count(t, F.lit(expression)), F.lit(leaf.pattern)
            count = _guarded(count, t, re.escape(leaf.pattern), leaf.case_sensitive)
        hit = count > 0
    else:
        p = F.lit(leaf.pattern if leaf.case_sensitive else leaf.pattern.lower())
        own = t if leaf.case_sensitive else F.lower(t)
        hit = {"equals": own == p, "startswith": F.startswith(own, p), "endswith": F.endswith(own, p)}[leaf.mode]
        count, text = F.lit(1), p
    return Parts(hit, F.when(hit, text).otherwise(""), F.when(hit, count).otherwise(0), F.when(hit, F.lit(leaf.target)).otherwise(""), F.when(hit & (text != ""), F.array(text)).otherwise(empty))


def python_match(spec: Spec) -> Column:
    """The predicate in Python, in Arrow batches."""
    data = match_dict(spec)

    @F.pandas_udf(MATCH)
    def run(name: pd.Series, path: pd.Series, content: pd.Series) -> pd.DataFrame:
        own = parse_match(data)
        rows = [evaluate(own, n or "", p or "", c or "")[:5] for n, p, c in zip(name, path, content, strict=True)]
        return pd.DataFrame(rows, columns=MATCH.names)

    content = F.col("content") if needs_content(spec) else F.lit("")
    return run(F.col("name"), F.col("path"), content)


def parts(spec: Spec) -> Parts:
    if isinstance(spec, Leaf):
        return _leaf(spec)
    empty = F.array().cast("array<string>")
    if isinstance(spec, Not):
        hit = ~parts(spec.child).matched
        return Parts(hit, F.lit(""), F.when(hit, 1).otherwise(0), F.lit(""), empty)
    own = [parts(c) for c in spec.children]
    hit = F.lit(isinstance(spec, And))
    for p in own:
        hit = hit & p.matched if isinstance(spec, And) else hit | p.matched
    count = sum((p.match_count for p in own), F.lit(0))
    texts = F.array_distinct(F.flatten(F.array(*[p.match_texts for p in own]))) if own else empty
    target = F.lit("") if isinstance(spec, And) else F.coalesce(*[F.when(p.matched, p.target) for p in own], F.lit(""))
    return Parts(hit, F.when(hit, F.coalesce(F.get(texts, F.lit(0)), F.lit(""))).otherwise(""), F.when(hit, count).otherwise(0), F.when(hit, target).otherwise(""), F.when(hit, texts).otherwise(empty))


def column(spec: Spec) -> Column:
    """A struct (matched, match_text, match_count, target, match_texts) for each row of (name, path, content)."""
    p = parts(spec)
    return F.struct(*[(c.cast("int") if f == "match_count" else c).alias(f) for f, c in zip(Parts._fields, p, strict=True)])


def hit(rule: Rule, order: int) -> Column:
    """The rule's hit, or null. Cheap extension guards come first, so that expressions run only where they can match."""
    m = parts(rule.match)
    made = F.struct(F.lit(order).alias("rule_ord"), F.lit(rule.name).alias("rule_name"), F.lit(rule.severity).alias("severity"), m.match_text.alias("match_text"), m.match_count.cast("int").alias("match_count"), m.target.alias("target"), m.match_texts.alias("match_texts"), F.lit(next((x.description for x in leaves(rule.match) if x.description), rule.description)).alias("match_description"))
    out = F.when(m.matched, made)
    only = required_extensions(rule.match)
    return out if only is None else F.when(F.lower(F.col("extension")).isin(sorted(only)), out)


__all__ = ["MATCH", "column", "hit", "java_pattern", "python_match", "required_literals"]
