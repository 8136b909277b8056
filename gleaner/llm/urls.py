"""URL filters by a Bloom filter cascade, in DataFrame operations only.

Level 1 is a Bloom filter of the listed keys. Level 2 holds the keys of the corpus's universe that pass level 1
by mistake, level 3 the listed keys that pass level 2 by mistake, and so on until a level lets no wrong key pass.
For every key of the universe, the first level that lacks it tells exactly whether it is listed: one that lacks it
at an odd level isn't, at an even level is. The levels are literals of the plan, so membership takes no join.

The universe of a table of urls is every (host suffix, path prefix) that a rule could name for one of its urls.
The size of the levels is proportional to the listed keys, times the logarithm of universe / listed, and is
checked against ``max_bytes``; a longer list is looked up by an equi-join instead (``lookup_by_join``).

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; a url that fits no
rule gets the cascade's verdict for keys that no list has: allow. Repeated rules count once; if one rule is both
allowed and blocked, block wins. Further columns of the table are ignored, repeated rows are judged each, and an empty
table gives an empty result. A host's suffixes are built for the label counts that rules have, so a long host costs
its length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, lower_ascii, materialise, release

MAX_BYTES = 1 << 20


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]

    def has(self, key: Column, number: int) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        out = F.lit(True)
        for at in positions(key, number, self.bits, self.hashes):
            out = out & (F.shiftrightunsigned(F.get(words, (F.floor(at / 64)).cast("int")), 0).bitwiseAND(bit(at)) != 0)
        return out


def bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))


def positions(key: Column, number: int, bits: int, hashes: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(number)), F.lit(bits))
    step = F.pmod(F.xxhash64(F.lit(number), key, F.lit("step")), F.lit(max(1, bits - 1))) + 1
    return [F.pmod(first + step * i, F.lit(bits)) for i in range(hashes)]


def level_of(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A Bloom filter of ``count`` keys: bits are set by one aggregate, and only its words reach the driver."""
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, 64 * math.ceil(count * math.log2(1 / rate) / math.log(2) / 64))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), number, bits, hashes))).alias("at"))
    words = [0] * (bits // 64)
    for row in at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("w")).collect():
        words[row["word"]] = row["w"]
    return Level(bits, hashes, tuple(words))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe it was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            out = F.when(self.levels[i - 1].has(key, i), out).otherwise(F.lit(i % 2 == 0))
        return out


def cascade(listed: DataFrame, universe: DataFrame, universe_size: int, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """Build over DataFrames with a column key; None if the levels would exceed max_bytes. universe may repeat keys."""
    listed = listed.select("key").distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    rate = min(0.5, max(n / max(universe_size, 1) * math.sqrt(0.5), 2.0**-40))
    if n * math.log2(1 / rate) * 1.5 / 8 * 2 > max_bytes:
        return None
    levels = [level_of(listed, n, rate, 1)]
    passing = materialise(universe.where(levels[0].has(F.col("key"), 1)).distinct())  # the universe is read once for all levels
    wrong = (
        passing.select("key", F.lit(0).alias("is")).unionByName(listed.select("key", F.lit(1).alias("is")))
        .groupBy("key").agg(F.max("is").alias("is")).where("is = 0").select("key")
    )
    right = listed
    while count := wrong.count():
        number = len(levels) + 1
        levels.append(level := level_of(wrong, count, 0.5, number))
        wrong, right = right.where(level.has(F.col("key"), number)), wrong
    release(passing)
    return Cascade(tuple(levels))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def labels(host: Column) -> Column:
    """How many labels a host has."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def candidates(counts: list[int], lengths: list[int]) -> Column:
    """Every rule key that could fit: host suffixes of as many labels as rules have, times path prefixes of the rules' lengths."""
    hosts = F.filter(F.array(*[F.when(labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in counts]), lambda h: h.isNotNull())
    paths = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths])
    return F.flatten(F.transform(hosts, lambda h: F.transform(F.filter(paths, lambda p: p.isNotNull()), lambda p: F.concat(h, p))))


def _split(pages: DataFrame) -> DataFrame:
    host, path = parts(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def judge(pages: DataFrame, rules: list[UrlRule], max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url)."""
    spark = pages.sparkSession
    blocked = {r.key for r in rules if r.verdict == "block"}
    keys = sorted({r.key for r in rules})
    urls = _split(pages)
    if not keys:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    urls = urls.withColumn("keys", candidates(sorted({r.host.count(".") + 1 for r in rules}), sorted({len(r.path) for r in rules})))
    universe = urls.select(F.explode("keys").alias("key"))
    size = urls.agg(F.sum(F.size("keys"))).first()[0] or 0
    table = spark.createDataFrame([(k,) for k in keys], "key string")
    lists = cascade(table, universe, size, max_bytes)
    if lists is None:
        return lookup_by_join(urls, rules)
    blocks = cascade(table.where(F.col("key").isin(sorted(blocked))) if len(blocked) < 1000 else spark.createDataFrame([(k,) for k in sorted(blocked)], "key string"), table, len(keys), max_bytes)
    fits = F.filter("keys", lists.contains)
    best = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    return urls.select("page_id", "host", "path", best.alias("rule")).select(
        "*", F.when(F.col("rule").isNotNull() & blocks.contains(F.coalesce("rule", F.lit(""))), "block").otherwise("allow").alias("verdict")
    )


def lookup_by_join(urls: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """The way for lists whose levels are too large to be literals: one equi-join on the candidate keys."""
    spark = urls.sparkSession
    verdicts: dict[str, str] = {}
    for r in rules:
        verdicts[r.key] = "block" if r.verdict == "block" or verdicts.get(r.key) == "block" else "allow"
    table = spark.createDataFrame(sorted(verdicts.items()), "key string, v string")
    rows = materialise(urls.withColumn("row", F.monotonically_increasing_id()))
    found = (
        join_skewed(rows.select("row", "page_id", "host", "path", F.explode_outer("keys").alias("key")), table, "key", "left", spread=["row"])
        .groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max(F.when(F.col("v").isNotNull(), F.struct(F.length("key").alias("n"), "key", "v"))).alias("best"))
    )
    return found.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.v", F.lit("allow")).alias("verdict"))
