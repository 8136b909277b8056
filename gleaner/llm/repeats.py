"""Removal of passages that repeat anywhere in a corpus, exactly, for windows of words (op4) or of bytes (op7).

A window is ``length`` consecutive symbols of one document. Suffixes are never shipped: with 200 bytes of context each
they would be hundreds of times the input. What is shipped are hashes, in three steps over a table of blocks (a block
holds the documents of some 2 MB of text, and is written once, so every step sees the same rows):

1. Anchors. A window's anchor is the least hash of the ``gram``-symbol strings in it, so equal windows have equal
   anchors. Consecutive windows with one anchor are a segment, some 1/50 (bytes) or 1/12 (words) of all windows.
   Each block sends its distinct (anchor, content hash) pairs; per anchor it is decided whether a content repeats
   (all its windows do), stands alone under an anchor that no other content has (none of them does), or must be
   compared further.
2. Suffixes. Only the windows of segments to be compared are suffixes that need sorting; of equal segments one block
   sends them. How they are dealt out and judged is the operator's:
   op4 splits them by variable-length prefixes into memory-sized groups (a prefix that is too frequent in a sample
   is extended by further words). Each group builds its suffix tree on names of the suffixes' beginnings (``Subtree``);
   suffixes below an internal node as deep as a window repeat.
   op7 deals them to buckets by sampled splitters, on their leading bytes and then a fingerprint of the window. A
   bucket is sorted by multikey quicksort, neighbours are compared, and the buckets' first and last suffixes are
   compared with each other: a window that is so frequent that several splitters equal it lies in several buckets.
3. The verdicts go back to the blocks as a byte for each hash sent, and the blocks' documents are cut.

Everything is pre-aggregated per block, so a passage that a third of all documents share is one entry of each block.
Windows are compared by 64-bit hashes of their whole content. maximal removed runs are the maximal repeats' spans.

Defined results: null texts have no symbols, texts shorter than a window lose nothing. Repeated rows repeat each
other's windows, so they lose all of them. Null doc_ids stay null. An empty table gives an empty result. A text longer
than a block is a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import materialise, release

U = np.uint64
BLOCK_BYTES = 2 << 20
#: Blocks whose samples choose the splitters or prefixes, and windows of each.
SAMPLED_BLOCKS, SAMPLED_WINDOWS = 512, 64
#: Numbers of leading words that a prefix may have; leading bytes of a suffix that are sorted by as they are.
DEPTHS, LEAD = (1, 2, 4, 8, 16), 8
#: Blocks whose hashes meet in a part; runs that the sort leaves to numpy.
PART_BLOCKS, SMALL = 32, 4096
ANSWER = "block long, part int, codes binary"


@dataclass(frozen=True)
class Unit:
    """What windows are made of."""

    words: bool
    length: int
    gram: int


class Flat:
    """The symbols of a block's texts, end to end."""

    def __init__(self, column: pa.Array, unit: Unit):
        self.data, at = arrays.flat(column)
        if unit.words:
            self.words = arrays.Words(self.data, at)
            self.values, self.first = self.words.hashes(), self.words.first
        else:
            self.values, self.first = arrays.TABLE[self.data], at
        self.sums = arrays.prefix(self.values)
        self.unit = unit
        self._segments()

    def _segments(self) -> None:
        """start and last window of each segment, its anchor and content hash."""
        n, length, gram = len(self.values), self.unit.length, self.unit.gram
        windows = max(0, n - length + 1)
        if not windows:
            self.start = self.last = np.zeros(0, np.int64)
            self.anchor = self.content = np.zeros(0, np.uint64)
            return
        self.grams = arrays.rough(self.values, gram)
        least = arrays.sliding_min(self.grams, length - gram + 1)
        inside = np.ones(windows + 2, bool)
        inside[0] = inside[-1] = False
        for end in np.unique(self.first[1:]).tolist():  # windows that would cross the end of a text
            inside[max(0, end - length + 1) + 1 : min(windows, end) + 1] = False
        change = np.ones(windows + 1, bool)
        change[1:-1] = least[1:] != least[:-1]
        self.start = np.flatnonzero(inside[1:-1] & (change[:-1] | ~inside[:-2]))
        self.last = np.flatnonzero(inside[1:-1] & (change[1:] | ~inside[2:]))
        self.anchor = arrays.mix(least[self.start])  # a minimum is small; mixed, anchors are dealt out evenly
        self.content = arrays.ranged(self.sums, self.start, self.last + length)

    def periodic(self) -> np.ndarray:
        """Segments that may hold a window twice: those with a window in which the anchor occurs at two places, and those
        longer than a window's grams: there the anchor may lie once in each window, at a distance of just as many symbols."""
        n, gram = len(self.values), self.unit.gram
        if not len(self.start):
            return np.zeros(0, bool)
        low = U((1 << n.bit_length()) - 1)
        high = self.grams & ~low
        at = np.arange(len(high), dtype=np.uint64)
        left, right = (arrays.sliding_min(high | x, self.unit.length - gram + 1) & low for x in (at, low - at))
        sums = np.zeros(len(left) + 1, np.int64)
        np.cumsum(left != low - right, out=sums[1:])
        return (sums[self.last + 1] > sums[self.start]) | (self.last - self.start > self.unit.length - gram)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the segments by (anchor, content), where each distinct pair begins in it, and its number for each segment."""
        order = np.lexsort((self.content, self.anchor))
        a, c = self.anchor[order], self.content[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return order, np.flatnonzero(new), number

    def leads(self, at: np.ndarray) -> np.ndarray:
        """The LEAD leading bytes of each window, in the order of texts."""
        key = np.zeros(len(at), np.uint64)
        for i in range(min(LEAD, self.unit.length)):
            key |= self.data[at + i].astype(np.uint64) << U(56 - 8 * i)
        return key

    def names(self, at: np.ndarray, depth: int) -> np.ndarray:
        """A name for the first ``depth`` symbols of each window: equal for equal ones."""
        return arrays.ranged(self.sums, at, at + min(depth, self.unit.length))

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Which symbols lie in a window that begins at one of ``at``."""
        steps = np.zeros(len(self.values) + 1, np.int32)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + self.unit.length, -1)
        return np.cumsum(steps)[:-1] > 0


def each(start: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, last], end to end."""
    size = last - start + 1
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


# op7: a suffix array in range-partitioned buckets.


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by their keys of several parts: three-way partitions by one part at a time.

    Rows equal in a part go on to the next one; those below and above its pivot stay with it. Runs of at most
    SMALL rows are left to numpy.
    """
    order, todo = np.arange(len(columns[0])), [(0, len(columns[0]), 0)]
    while todo:
        low, high, part = todo.pop()
        if part == len(columns) or high - low < 2:
            continue
        rows = order[low:high]
        if high - low <= SMALL:
            order[low:high] = rows[np.lexsort([c[rows] for c in columns[:part - 1 if part else None:-1]])]
            continue
        key = columns[part][rows]
        pivot = np.sort(key[:: max(1, len(key) // 31)])[len(key[:: max(1, len(key) // 31)]) // 2]
        below, above = key < pivot, key > pivot
        equal = ~(below | above)
        order[low:high] = np.concatenate([rows[below], rows[equal], rows[above]])
        first, second = low + int(below.sum()), high - int(above.sum())
        todo += [(low, first, part), (first, second, part + 1), (second, high, part)]
    return order


@dataclass(frozen=True)
class Splitters:
    """Ranges of suffixes: by their leading bytes, then by the fingerprint of the whole window."""

    leads: np.ndarray
    prints: np.ndarray
    kinds = (np.uint64, np.uint64)

    @staticmethod
    def sample(flat: Flat, at: np.ndarray) -> np.ndarray:
        return np.stack([flat.leads(at), flat.names(at, flat.unit.length)], axis=1).reshape(-1)

    @classmethod
    def choose(cls, sample: np.ndarray, parts: int) -> Splitters:
        rows = sample.reshape(-1, 2)
        rows = rows[multikey_quicksort([rows[:, 0], rows[:, 1]])]
        some = rows[(np.arange(1, parts) * len(rows)) // parts] if len(rows) else rows
        return cls(some[:, 0].copy(), some[:, 1].copy())

    def deal(self, flat: Flat, at: np.ndarray, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bucket and sort key of each suffix. One that several splitters equal goes to any of their buckets, by its block."""
        lead, fp = flat.leads(at), flat.names(at, flat.unit.length)
        part, high = (np.searchsorted(self.leads, lead, side=x) for x in ("left", "right"))
        close = np.flatnonzero(part < high)
        close = close[np.argsort(part[close], kind="stable")]
        for rows in np.split(close, np.flatnonzero(np.diff(part[close])) + 1) if len(close) else []:
            a, b = part[rows[0]], high[rows[0]]
            left, right = (a + np.searchsorted(self.prints[a:b], fp[rows], side=x) for x in ("left", "right"))
            part[rows] = np.where(right - left > 1, left + 1 + block % np.maximum(right - left, 1), right)
        return part.astype(np.int64), [lead, fp]

    @staticmethod
    def judge(entries: DataFrame) -> DataFrame:
        """Each bucket is sorted; then its first and last suffix are compared with those of the other buckets."""
        ends = entries.groupBy("part").applyInPandas(bucket_ends, "part int, end binary")
        across = ends.groupBy("end").agg(F.collect_set("part").alias("parts")).where(F.size("parts") > 1)
        bounds = across.select("end", F.explode("parts").alias("part"))
        return entries.groupBy("part").cogroup(bounds.groupBy("part")).applyInPandas(judge_bucket, ANSWER)


def _ends_of(lead: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return np.stack([lead, fp], axis=1).astype(">u8")


def bucket_ends(rows: pd.DataFrame) -> pd.DataFrame:
    """The least and the greatest suffix of a bucket."""
    (lead, fp, _), _ = _merge(rows, [*Splitters.kinds, np.uint8])
    low, high = lead == lead.min(), lead == lead.max()
    ends = {_ends_of(lead[m][:1], x[None]).tobytes() for m, x in ((low, fp[low].min()), (high, fp[high].max()))}
    return pd.DataFrame({"part": [rows["part"].iloc[0]] * len(ends), "end": sorted(ends)})


def judge_bucket(rows: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """For each suffix of a bucket, whether its window occurs again: beside it in the sorted bucket, or across a boundary."""
    if not len(rows):
        return pd.DataFrame({"block": [], "part": [], "codes": []})
    (lead, fp, twice), sizes = _merge(rows, [*Splitters.kinds, np.uint8])
    order = multikey_quicksort([lead, fp])
    x, y = lead[order], fp[order]
    same = (x[1:] == x[:-1]) & (y[1:] == y[:-1])  # neighbours in the suffix array with a common prefix of a whole window
    again = twice[order] > 0
    again[1:] |= same
    again[:-1] |= same
    codes = np.empty(len(order), np.uint8)
    codes[order] = again
    for end in bounds["end"]:  # such suffixes are some bucket's first or last, and another's too
        a, b = np.frombuffer(end, ">u8")
        codes[(lead == a) & (fp == b)] = 1
    # A suffix twice in its block, or beside an equal one, answers for all its equals in the bucket.
    run = np.cumsum(np.r_[True, ~same]) - 1
    codes[order] = np.maximum.reduceat(codes[order], np.flatnonzero(np.r_[True, ~same]))[run]
    return _answers(rows, codes, sizes)


# op4: suffix trees, split by prefixes.


@dataclass(frozen=True)
class Subtree:
    """The suffix tree of a prefix group, down to the depth of a window, on names of the suffixes' beginnings.

    ``order`` are the leaves from left to right. ``lcp`` tells for each leaf at how many of the tree's depths it shares
    the beginning with the leaf before it. A node at depth d is a maximal run of leaves whose lcp is above d.
    """

    order: np.ndarray
    lcp: np.ndarray
    depths: int

    @classmethod
    def build(cls, names: list[np.ndarray]) -> Subtree:
        order = np.lexsort(names[::-1])
        lcp, shared = np.zeros(len(order), np.int8), np.ones(max(0, len(order) - 1), bool)
        for name in names:
            shared &= name[order][1:] == name[order][:-1]
            lcp[1:] += shared
        return cls(order, lcp, len(names))

    def nodes(self, depth: int) -> np.ndarray:
        """The node above each leaf at a depth (from 0), numbered from left to right."""
        return np.cumsum(self.lcp <= depth) - 1

    def deep(self, weights: np.ndarray) -> np.ndarray:
        """Leaves (in the order of the input) below an internal node as deep as a window; weights: how often each leaf occurs."""
        node = self.nodes(self.depths - 1)
        out = np.empty(len(node), bool)
        out[self.order] = (np.bincount(node, weights=weights[self.order]) > 1)[node]
        return out


@dataclass(frozen=True)
class Prefixes:
    """Variable-length prefixes: those at each depth that are too frequent and go on."""

    frequent: tuple[np.ndarray, ...]
    parts: int
    #: The prefix, then the tree's depths as shares of a window.
    kinds = (np.uint64, np.uint64, np.uint64)
    shares = (2, 1)

    @staticmethod
    def sample(flat: Flat, at: np.ndarray) -> np.ndarray:
        return np.stack([flat.names(at, d) for d in DEPTHS], axis=1).reshape(-1)

    @classmethod
    def choose(cls, sample: np.ndarray, parts: int) -> Prefixes:
        rows = sample.reshape(-1, len(DEPTHS))
        most, out = max(2, len(rows) // (4 * parts)), []
        for d in range(len(DEPTHS)):
            values, counts = np.unique(rows[:, d], return_counts=True)
            out.append(values[counts > most])
            rows = rows[np.isin(rows[:, d], out[-1])]
        return cls(tuple(out), parts)

    def deal(self, flat: Flat, at: np.ndarray, block: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Group of each suffix, its prefix and its names at the tree's depths."""
        key = flat.names(at, DEPTHS[0])
        open_ = np.arange(len(at))
        for d, frequent in enumerate(self.frequent):
            open_ = open_[np.isin(key[open_], frequent)]
            if not len(open_):
                break
            depth = DEPTHS[d + 1] if d + 1 < len(DEPTHS) else flat.unit.length
            key[open_] = flat.names(at[open_], depth)
        return (key % U(self.parts)).astype(np.int64), [key, *(flat.names(at, flat.unit.length // x) for x in self.shares)]

    @staticmethod
    def judge(entries: DataFrame) -> DataFrame:
        return entries.groupBy("part").applyInPandas(judge_group, ANSWER)


def judge_group(rows: pd.DataFrame) -> pd.DataFrame:
    """For each suffix of a prefix group, whether a deep internal node of the group's suffix tree is above it."""
    (*names, twice), sizes = _merge(rows, [*Prefixes.kinds, np.uint8])
    return _answers(rows, Subtree.build(names).deep(1 + twice.astype(np.int64)).astype(np.uint8), sizes)


# The steps.


def blocks(docs: DataFrame) -> DataFrame:
    """block, payload: the rows of docs, with all their columns, as compressed Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, size, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def row() -> pa.RecordBatch:
            nonlocal made
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

        for batch in arrays.pieces(batches, "text", BLOCK_BYTES):
            n = int(arrays.flat(batch.column("text"))[1][-1])
            if held and size + n > BLOCK_BYTES:
                yield row()
                held, size = [], 0
            held.append(batch)
            size += n
        if held:
            yield row()

    return docs.mapInArrow(run, "block long, payload binary")


def load(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0]


def _entries(block: int, part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each part of a block: its entries' columns as bytes. part is in ascending order."""
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, int)
    blobs = [pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary()) for x in columns]
    names = ["part", "block", *[f"c{i}" for i in range(len(columns))]]
    return pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)), pa.array(np.full(len(edges) - 1, block), pa.int64()), *blobs], names=names)


def anchors(table: DataFrame, unit: Unit, parts: int, how: type) -> DataFrame:
    """Step 1, out: part, block, c0 anchors, c1 contents, c2 whether the block has a pair twice, plus 2 if it may repeat within; part -1: a sample of suffixes in c0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                flat = Flat(load(payload).column("text"), unit)
                order, new, _ = flat.distinct()
                a, c = flat.anchor[order][new], flat.content[order][new]
                twice = (np.diff(np.r_[new, len(order)]) > 1).astype(np.uint8) + 2 * flat.periodic()[order][new].astype(np.uint8)
                yield _entries(block, ((a >> U(32)) * U(parts) >> U(32)).astype(np.int64), [a, c, twice])
                if len(flat.start):
                    some = flat.start[:: max(1, len(flat.start) // SAMPLED_WINDOWS)][:SAMPLED_WINDOWS]
                    yield _entries(block, np.full(1, -1), [how.sample(flat, some)[None], np.zeros(1), np.zeros(1)])

    return table.mapInArrow(run, "part int, block long, c0 binary, c1 binary, c2 binary")


def _merge(rows: pd.DataFrame, kinds: list) -> tuple[list[np.ndarray], np.ndarray]:
    columns = [np.concatenate([np.frombuffer(x, k) for x in rows[f"c{i}"]]) for i, k in enumerate(kinds)]
    return columns, np.array([len(x) // np.dtype(kinds[0]).itemsize for x in rows["c0"]])


def _answers(rows: pd.DataFrame, codes: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"block": rows["block"].to_numpy(), "part": rows["part"].to_numpy(), "codes": [x.tobytes() for x in np.split(codes, np.cumsum(sizes)[:-1])]})


def judge_segments(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 1, in: for each pair sent, 1 if its content repeats, plus 2 if the block shall send its windows."""
    (a, c, twice), sizes = _merge(rows, [np.uint64, np.uint64, np.uint8])
    order = np.lexsort((c, a))
    a, c = a[order], c[order]
    new_a, new = np.ones(len(a), bool), np.ones(len(a), bool)
    new_a[1:] = a[1:] != a[:-1]
    new[1:] = new_a[1:] | (c[1:] != c[:-1])
    content, anchor = np.cumsum(new) - 1, np.cumsum(new_a) - 1
    repeats = (np.bincount(content) + np.bincount(content, weights=twice[order] & 1).astype(np.int64) > 1)[content]
    several = (np.bincount(anchor, weights=new) > 1)[anchor]
    codes = np.empty(len(a), np.uint8)
    codes[order] = repeats + 2 * ((several | ~repeats & (twice[order] > 1)) & new)
    return _answers(rows, codes, sizes)


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    """The answers of a block in one row: an entry for each part, whose bytes are as many as the block sent."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", "codes")).alias(name))


def _codes(rows: list | None) -> np.ndarray:
    return np.frombuffer(b"".join(r["codes"] for r in sorted(rows or [], key=lambda r: r["part"])), np.uint8)


def suffixes(table: DataFrame, unit: Unit, deal) -> DataFrame:
    """Step 2, out: part, block, c0 ... the columns that deal sorts by, and last whether the block has the window twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, codes in zip(*(batch.column(c).to_pylist() for c in ("block", "payload", "segments")), strict=True):
                part, columns, _, _ = _suffixes(Flat(load(payload).column("text"), unit), _codes(codes), deal, block)
                yield _entries(block, part, columns)

    return table.mapInArrow(run, ", ".join(["part int, block long", *(f"c{i} binary" for i in range(len(deal.kinds) + 1))]))


def _suffixes(flat: Flat, codes: np.ndarray, deal, block: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """What step 2 sends of a block, in order; and for step 3 the windows to be decided and the entry of each."""
    order, new, number = flat.distinct()
    first = order[new]  # one segment of each distinct content
    send = first[codes & 2 > 0]
    at = each(flat.start[send], flat.last[send])
    part, columns = deal.deal(flat, at, block)
    by = np.lexsort([*columns[::-1], part])
    part, columns = part[by], [c[by] for c in columns]
    fresh = np.ones(len(by), bool)
    fresh[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (part, *columns)])
    edges = np.flatnonzero(fresh)
    entry = np.empty(len(by), np.int64)
    entry[by] = np.cumsum(fresh) - 1
    twice = (np.diff(np.r_[edges, len(by)]) > 1).astype(np.uint8)
    return part[edges], [*(c[edges] for c in columns), twice], at, entry


def repeated(flat: Flat, segments: np.ndarray, windows: np.ndarray, deal, block: int) -> np.ndarray:
    """Starts of all repeated windows of a block, from the verdicts on its segments and suffixes."""
    _, _, number = flat.distinct()
    whole = segments[number] & 1 > 0 if len(number) else np.zeros(0, bool)
    out = each(flat.start[whole], flat.last[whole])
    *_, at, entry = _suffixes(flat, segments, deal, block)
    return np.concatenate([out, at[windows[entry] > 0]]) if len(at) else out


def cut(docs: DataFrame, unit: Unit, how: type, emit: Callable[[pa.RecordBatch, Flat, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """Find all repeated windows of docs.text and give each block's rows, with what is covered, to emit."""
    spark = docs.sparkSession
    table = materialise(blocks(docs))
    # The hashes of so many blocks for each part, so that its memory doesn't grow with the input.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table.count() // PART_BLOCKS)
    sent = materialise(anchors(table, unit, parts, how))
    sample = [r["c0"] for r in sent.where("part = -1").orderBy(F.xxhash64("block")).limit(SAMPLED_BLOCKS).select("c0").collect()]
    deal = how.choose(np.frombuffer(b"".join(sample), np.uint64), parts)
    segments = materialise(sent.where("part >= 0").groupBy("part").applyInPandas(judge_segments, ANSWER))
    release(sent)
    # One plan from here on: the payloads are shuffled to their answers once, and both steps read that.
    second = table.join(_by_block(segments, "segments"), "block", "left")
    windows = how.judge(suffixes(second, unit, deal))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, s, w in zip(*(batch.column(c).to_pylist() for c in ("block", "payload", "segments", "windows")), strict=True):
                rows = load(payload)
                flat = Flat(rows.column("text"), unit)
                yield emit(rows, flat, flat.covered(repeated(flat, _codes(s), _codes(w), deal, block)))

    return second.join(_by_block(windows, "windows"), "block", "left").mapInArrow(run, schema)


def _per_text(flat: Flat, marks: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[flat.first[1:]] - sums[flat.first[:-1]]


def _keep_words(rows: pa.RecordBatch, flat: Flat, covered: np.ndarray) -> pa.RecordBatch:
    removed, data, sums = _per_text(flat, covered), flat.data.tobytes(), []
    words, starts, ends = flat.words, flat.words.start, flat.words.end
    for i, (a, b) in enumerate(zip(flat.first[:-1].tolist(), flat.first[1:].tolist(), strict=True)):
        keep = np.flatnonzero(~covered[a:b]) + a if removed[i] else np.arange(a, b)
        sums.append(hashlib.sha256(b" ".join([data[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])).hexdigest())
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(words.first)), pa.array(removed), pa.array(sums, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _keep_bytes(rows: pa.RecordBatch, flat: Flat, covered: np.ndarray) -> pa.RecordBatch:
    begins = covered.copy()
    begins[1:] &= ~covered[:-1]
    begins[flat.first[:-1][flat.first[:-1] < len(covered)]] |= covered[flat.first[:-1][flat.first[:-1] < len(covered)]]
    sums = [hashlib.sha256(flat.data[a:b][~covered[a:b]].tobytes()).hexdigest() for a, b in zip(flat.first[:-1].tolist(), flat.first[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [rows.column("doc_id"), pa.array(np.diff(flat.first)), pa.array(_per_text(flat, covered)), pa.array(_per_text(flat, begins)), pa.array(sums, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def _keep_text(rows: pa.RecordBatch, flat: Flat, covered: np.ndarray) -> pa.RecordBatch:
    """All columns, the text without its covered words and the white space behind each; other texts as they are."""
    removed, texts = _per_text(flat, covered), rows.column("text").to_pylist()
    at = np.r_[flat.words.start, len(flat.data)]
    begin = arrays.flat(rows.column("text"))[1]
    for i in np.flatnonzero(removed).tolist():
        gone = np.zeros(int(begin[i + 1] - begin[i]), bool)
        for w in (np.flatnonzero(covered[flat.first[i] : flat.first[i + 1]]) + flat.first[i]).tolist():
            gone[at[w] - begin[i] : min(at[w + 1], begin[i + 1]) - begin[i]] = True
        texts[i] = flat.data[begin[i] : begin[i + 1]][~gone].tobytes().decode()
    where = rows.schema.get_field_index("text")
    return rows.set_column(where, "text", pa.array(texts, rows.column("text").type))


WORDS = Unit(True, 35, 12)
BYTES = Unit(False, 200, 64)


def substring_dedup(docs: DataFrame, length: int = WORDS.length, gram: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of docs (doc_id, text): op4."""
    unit = Unit(True, length, gram or max(1, length // 3))
    return cut(docs.select(F.col("doc_id").cast("long"), "text"), unit, Prefixes, _keep_words, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = WORDS.length) -> DataFrame:
    """docs with all its columns, its texts without repeated windows of words."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return cut(docs, Unit(True, length, max(1, length // 3)), Prefixes, _keep_text, schema)


def suffix_array_dedup(docs: DataFrame, length: int = BYTES.length, gram: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of docs (doc_id, text): op7."""
    unit = Unit(False, length, gram or max(1, length // 3))
    return cut(docs.select(F.col("doc_id").cast("long"), "text"), unit, Splitters, _keep_bytes, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
