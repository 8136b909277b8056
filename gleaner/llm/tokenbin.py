"""Token ids in a word-aligned binary format: Simple-8b with escapes and per-block offsets.

A frame holds the documents of a stretch of the corpus:

    magic "S8B1", flags u32, documents u64, ids u64, blocks u64, words u64, escapes u64
    document ids i64[documents]; their numbers of ids u32[documents]
    first word of each block u32[blocks]; words u64[words]; escaped values u64[escapes]

A word has a 4-bit selector and 60 bits of payload: as many ids of equal width as the selector says, the first id in
the lowest bits. A block holds BLOCK ids (the last one of a frame may hold fewer) and starts at a word of its own, so
blocks can be decoded on their own, or all at once. A 60-bit payload of all ones is an escape: the next escaped value
stands there, so any 64-bit id can be stored.

Frames are rows of Parquet files (shard, frame, first document, ids, payload), written by Spark into the folder the
cluster shares, in ascending doc_id order: shard, then frame, then document.

Defined results: null and empty texts have the end id alone. Null doc_ids come first. Repeated rows are stored each.
An empty table gives no frames. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrays import pieces
from .common import materialise
from .tokens import MOST_CHUNKS, encoder, forget

BLOCK = 240
VOCABULARY, END = "byte_bpe_50k.json", 2
#: The format's selectors, a fixed table: how many ids a word holds, and how wide each is.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = np.uint64((1 << 60) - 1)
#: The narrowest width for each id of 16 bits.
_NEED = np.unique(WIDTH)[np.searchsorted((1 << np.unique(WIDTH)) - 1, np.arange(1 << 16))].astype(np.uint8)
_HEAD = struct.Struct("<4sIQQQQQ")
_NULL = np.iinfo(np.int64).min


def _words(padded: np.ndarray, need: np.ndarray, pos: np.ndarray, stop: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The fullest words that begin at pos, of the selectors from ``least`` on; what lies beyond stop counts as zero."""
    ahead = np.arange(COUNT[least])
    near = np.minimum(pos[:, None] + ahead, len(padded) - 1)
    inside = near < stop[:, None]
    widest = np.maximum.accumulate(np.where(inside, need[near], 0), axis=1)
    select = least + np.argmax(widest[:, COUNT[least:] - 1] <= WIDTH[least:], axis=1)
    values = np.where(inside & (ahead < COUNT[select][:, None]), padded[near], np.uint64(0))
    shift = np.minimum(ahead * WIDTH[select][:, None], 63).astype(np.uint64)
    return select, np.bitwise_or.reduce(values << shift, axis=1) | select.astype(np.uint64) << np.uint64(60)


def pack_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, escaped values. All blocks are filled in step, one word of each at a time."""
    ids = ids.astype(np.uint64)
    escaped = ids >= ESCAPE
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.zeros(blocks * BLOCK + BLOCK, np.uint64)
    padded[:n] = np.where(escaped, ESCAPE, ids)
    need = _NEED[np.minimum(padded, np.uint64(0xFFFF)).astype(np.intp)]
    wide = np.flatnonzero(padded > np.uint64(0xFFFF))
    if len(wide):
        need[wide] = np.where(padded[wide] < np.uint64(1 << 20), 20, np.where(padded[wide] < np.uint64(1 << 30), 30, 60))
    at = np.arange(blocks) * BLOCK
    end = np.minimum(at + BLOCK, n)
    live, made, owner = np.arange(blocks), [], []
    while len(live):
        pos, stop = at[live], end[live]
        # Most words hold few ids; longer looks ahead only where these are narrow.
        select, word = _words(padded, need, pos, stop, 9)
        for least in (5, 0):
            if len(rows := np.flatnonzero(select == (9 if least else 5))):
                select[rows], word[rows] = _words(padded, need, pos[rows], stop[rows], least)
        made.append(word)
        owner.append(live)
        at[live] = pos + COUNT[select]
        live = live[at[live] < end[live]]
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    order = np.argsort(np.concatenate(owner), kind="stable")
    counts = np.bincount(np.concatenate(owner), minlength=blocks)
    return np.concatenate(made)[order], (np.cumsum(counts) - counts).astype(np.uint32), ids[escaped]


def unpack_words(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """All blocks at once."""
    if not n:
        return np.zeros(0, np.uint64)
    select = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first.astype(np.int64), len(words))))
    before = np.cumsum(COUNT[select]) - COUNT[select]
    inside = before - before[first.astype(np.int64)][block]  # where in its block a word's ids begin
    size = np.where(block == len(first) - 1, n - (len(first) - 1) * BLOCK, BLOCK)
    count = np.minimum(COUNT[select], size - inside)
    slot = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    shift = (np.repeat(WIDTH[select], count) * slot).astype(np.uint64)
    mask = np.array([(1 << int(w)) - 1 for w in WIDTH], np.uint64)
    out = (np.repeat(words, count) >> shift) & np.repeat(mask[select], count)
    if len(escapes):
        out[out == ESCAPE] = escapes
    return out


def write_frame(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, first, escapes = pack_words(ids)
    head = _HEAD.pack(b"S8B1", 0, len(doc_ids), len(ids), len(first), len(words), len(escapes))
    return b"".join([head, *(np.ascontiguousarray(x, t).tobytes() for x, t in ((doc_ids, "<i8"), (lengths, "<u4"), (first, "<u4"), (words, "<u8"), (escapes, "<u8")))])


def read_frame(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, all ids."""
    magic, _, docs, n, blocks, words, escapes = _HEAD.unpack_from(raw)
    if magic != b"S8B1":
        raise ValueError("not a frame of token ids")
    at, out = _HEAD.size, []
    for count, kind in ((docs, "<i8"), (docs, "<u4"), (blocks, "<u4"), (words, "<u8"), (escapes, "<u8")):
        out.append(np.frombuffer(raw, kind, count, at))
        at += out[-1].nbytes
    return out[0], out[1], unpack_words(out[3], out[2], out[4], n)


def write_ids(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, frame_bytes: int = 4 << 20, added: bool = False, most: int = MOST_CHUNKS) -> DataFrame:
    """The frames of docs (doc_id, text) as a DataFrame over the files written: shard, frame, ids, payload.

    A worker keeps ``most`` chunks of text with their ids and works on ``frame_bytes`` of text at a time, with some 30
    bytes of memory for each; both are a matter of memory and time only.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for frame, batch in enumerate(pieces(batches, "text", frame_bytes)):
            ids, at = encoder(vocabulary, added, most).encode(batch.column("text"), end)
            names = batch.column("doc_id").fill_null(_NULL).to_numpy()
            yield _row(shard, frame, len(ids), write_frame(names, np.diff(at), ids))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialise(ordered.mapInArrow(run, "shard int, frame int, ids long, payload binary"))


def _row(shard: int, frame: int, ids: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([frame], pa.int32()), pa.array([ids], pa.int64()), pa.array([payload], pa.binary())], names=["shard", "frame", "ids", "payload"])


def read_ids(frames: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i in range(batch.num_rows):
                names, lengths, ids = read_frame(batch.column("payload")[i].as_py())
                at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                raw = memoryview(ids.astype("<u4")).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, batch.column(c)[i].as_py(), np.int32)) for c in ("shard", "frame")]
                    + [pa.array(names, mask=names == _NULL), pa.array(at[:-1]), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["shard", "frame", "doc_id", "own", "n_tokens", "ids_crc32"],
                )

    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Two levels of prefix sums: over the shards, a row each, and within a shard over its frames.
    shards = frames.groupBy("shard").agg(F.sum("ids").alias("ids")).select("shard", before(Window.orderBy("shard")).alias("base"))
    bases = frames.select("shard", "frame", before(Window.partitionBy("shard").orderBy("frame")).alias("inside")).join(shards, "shard")
    docs = frames.select("shard", "frame", "payload").mapInArrow(run, "shard int, frame int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return docs.join(bases, ["shard", "frame"]).select("doc_id", (F.col("base") + F.col("inside") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
