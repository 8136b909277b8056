"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(name: Column) -> Column:
    """Lower-case suffix without its dot; '.env' has env, 'Makefile' none."""
    return F.regexp_extract(F.lower(name), r"\.([^.]+)$", 1)


def glob_regex(glob: str) -> str:
    """A file glob as an anchored expression; * crosses /."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return f"(?s)^{out}\\z"


def matches_glob(path: Column, glob: str) -> Column:
    return F.rlike(path, F.lit(glob_regex(glob)))


def is_minified(content: Column) -> Column:
    return (F.length(content) >= 2048) & F.exists(F.split(content, "\n"), lambda x: F.length(x) >= 5000)


def strip_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"[ \t\n\x0b\f\r]+", " "))


def truncate(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def format_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("long")))
        .when(n < 1024**2, F.format_string("%.1f KB", F.bround(n / 1024, 1)))
        .when(n < 1024**3, F.format_string("%.1f MB", F.bround(n / 1024**2, 1)))
        .otherwise(F.format_string("%.2f GB", F.bround(n / 1024**3, 2)))
    )


def format_elapsed(seconds: Column) -> Column:
    bad = seconds.isNull() | F.isnan(seconds) | (seconds < 0)
    whole = F.floor(seconds).cast("int")
    return (
        F.when(bad, "0ms")
        .when(seconds < 1, F.format_string("%dms", F.floor(seconds * 1000).cast("int")))
        .when(seconds < 60, F.format_string("%.1fs", F.bround(seconds, 1)))
        .otherwise(F.format_string("%d分%02d秒", F.floor(whole / 60).cast("int"), (whole % 60).cast("int")))
    )


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 2).when(severity == "warning", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("critical")), (rank + 1).cast("int"))


def rel_key(root: str, path: Column) -> Column:
    """Path relative to root with forward slashes; outside it, the path itself."""
    own, base = F.replace(path, F.lit("\\"), F.lit("/")), root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(own, F.lit(base)), F.substring(own, len(base) + 1, 1 << 30)).otherwise(own)


def context(content: Column, needle: Column, around: int = 5) -> Column:
    """The lines around the first one that holds the needle, that one marked; null if none does."""
    lines = F.split(content, "\n")
    at = F.array_position(F.transform(lines, lambda x: F.contains(x, needle)), True).cast("int")
    first = F.greatest(at - around, F.lit(1))
    part = F.slice(lines, first, F.least(at + around, F.size(lines)) - first + 1)
    return F.when(at > 0, F.array_join(F.transform(part, lambda x, i: F.concat(F.when(i + first == at, ">>> ").otherwise("    "), x)), "\n"))


def redact(content: Column, replacements: list[tuple[str, str]]) -> Column:
    """Literal replacements, longest first."""
    for old, new in sorted(replacements, key=lambda x: -len(x[0])):
        content = F.replace(content, F.lit(old), F.lit(new))
    return content
