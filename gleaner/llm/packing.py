"""Best-fit packing of tokenised documents into sequences, after dominance reduction.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver. There, Martello and Toth's
reduction fixes sets of one, two or three pieces that dominate every other set with their first piece, so that some
best packing has them. Best-fit decreasing packs the rest; both work on counts, so the time depends on the lengths, not
on the documents.
The outcome is a list of patterns (lengths in one sequence) with multiplicities. Each piece then gets its place from
its rank among the pieces of its length; ranks are counted in salted groups, so a common length is no hot spot.

Defined results: null and empty texts have the end id alone. Only texts longer than the capacity are cut. Repeated rows
are packed each. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import pieces as slices
from .common import materialise
from .tokens import MOST_CHUNKS, encoder

CAPACITY = 4096
VOCABULARY, END = "word_bpe_49k.json", 1
#: Pieces of a length, the full one first of all, are ranked in groups of about so many.
PIECES_PER_SALT, LEAST_SALTS = 200_000, 64


def cut(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end: int = END, added: bool = False, most: int = MOST_CHUNKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            ids, at = encoder(vocabulary, added, most).encode(batch.column("text"), end)
            size = np.diff(at)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, size[row] - start)
            begin = at[:-1][row] + start
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(raw[4 * b : 4 * (b + x)]) for b, x in zip(begin.tolist(), length.tolist(), strict=True)], pa.int64())}
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    times: int


def reduce_dominated(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix sets that dominate every other set with their largest piece; takes them out of counts (by length, changed in place).

    Passes go from the largest piece to the smallest, until one fixes nothing. See ``dominating`` for the sets.
    """
    out: list[Pattern] = []
    before = -1
    while len(out) != before:
        before = len(out)
        for j in np.flatnonzero(counts)[::-1].tolist():
            while counts[j] and (best := dominating(counts, j, capacity)):
                times = min(int(counts[x]) // best.count(x) for x in best)
                out.append(Pattern(best, times))
                for x in best:
                    counts[x] -= times
    return out


def dominating(counts: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set of j and at most two companions that dominates all sets with j, if there is one.

    Nothing fits beside j: {j}. The largest companion k that fits fills the room, or no two companions fit, or (no three
    fit) no two are longer than k together: {j, k}, as what stands beside j elsewhere can take k's place. No three fit,
    and of any two that fit the smaller isn't longer than the largest companion b that fits beside j and k: {j, k, b}.
    """
    room = capacity - j
    counts[j] -= 1  # the others only
    have = np.flatnonzero(counts[: room + 1])
    try:
        if not len(have):
            return (j,)
        k = int(have[-1])
        if k == room:
            return j, k
        small = np.repeat(have[:3], np.minimum(counts[have[:3]], 3))[:3]
        if len(small) < 2 or small[:2].sum() > room:
            return j, k
        if len(small) == 3 and small.sum() <= room:
            return None
        if _best_pair(counts, have, room) <= k:
            return j, k
        counts[k] -= 1
        beside = np.flatnonzero(counts[: room - k + 1])
        counts[k] += 1
        if not len(beside):
            return None
        b = int(beside[-1])
        return (j, k, b) if _longest_second(counts, have, room) <= b else None
    finally:
        counts[j] += 1


def _best_pair(counts: np.ndarray, have: np.ndarray, room: int) -> int:
    """The largest sum of two further pieces that fit into room; 0 if none do."""
    best, low, high = 0, 0, len(have) - 1
    while low <= high:
        total = int(have[low] + have[high])
        if total <= room:
            if low < high or counts[have[low]] > 1:
                best = max(best, total)
            low += 1
        else:
            high -= 1
    return best


def _longest_second(counts: np.ndarray, have: np.ndarray, room: int) -> int:
    """The longest that the smaller of two further pieces can be that fit into room."""
    partner = np.where(counts[have] > 1, have, np.r_[have[1:], room + 1])  # the smallest other piece that isn't smaller
    fits = have[have + partner <= room]
    return int(fits[-1]) if len(fits) else 0


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts; equal sequences are kept as one pattern with a multiplicity."""
    open_: dict[int, list[Pattern]] = {}
    for j in range(capacity, 0, -1):
        left = int(counts[j])
        while left:
            room = min((r for r in open_ if r >= j), default=None)
            if room is None:
                room, group = capacity, Pattern((), left)
            else:
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room]
            each = room // j
            full = min(group.times, left // each)
            rest = left - full * each if full < group.times else 0
            used = full
            if full:
                open_.setdefault(room - each * j, []).append(Pattern(group.lengths + (j,) * each, full))
            if 0 < rest < each:
                open_.setdefault(room - rest * j, []).append(Pattern(group.lengths + (j,) * rest, 1))
                used += 1
            else:
                rest = 0
            if group.lengths and used < group.times:
                open_.setdefault(room, []).append(Pattern(group.lengths, group.times - used))
            left -= full * each + rest
    return [p for group in open_.values() for p in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    fixed = reduce_dominated(counts, capacity)
    return fixed + best_fit(counts, capacity)


def slots(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: from which rank on a slot of a pattern is used, its first sequence, its offset there."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for x in p.lengths:
            rows.setdefault(x, []).append((taken.get(x, 0), sequence, offset))
            taken[x] = taken.get(x, 0) + p.times
            offset += x
        sequence += p.times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def pack(cuts: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Pieces (with doc_id, piece, length) with sequence_id and offset; cuts is read several times."""
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = slots(plan(histogram, capacity))
    salts = salts or max(LEAST_SALTS, sum(histogram.values()) // PIECES_PER_SALT)
    salted = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("own", own).join(first, ["length", "salt"]).select(*cuts.columns, (F.col("first") + F.col("own") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(length[order])) + 1, len(order)] if len(order) else np.zeros(1, int)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = order[a:b]
                starts, base, off = places[int(length[rows[0]])]
                i = np.searchsorted(starts, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = base[i] + rank[rows] - starts[i], off[i]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def best_fit_pack(docs: DataFrame, capacity: int = CAPACITY, added: bool = False, most: int = MOST_CHUNKS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A worker keeps ``most`` chunks of text with their ids; that is a matter of memory and time only.
    """
    return pack(materialise(cut(docs, capacity, added=added, most=most)), capacity)

