"""Nearest neighbours by a block matrix join with int8 tiles; the result is exact.

Vectors are cut into blocks. A tile is a block of queries times a block of candidates. Each side is quantised to
int8 with one scale per vector; with x = s q + e the inner product differs from s s' (q . q') by at most
|e| |y| + |s q| |e'|. A pair survives a tile if its upper bound reaches the query's 20th best lower bound there;
survivors are recomputed in double precision from the original components, and a heap keeps the tile's best.
The heaps of a query's tiles (at most k rows each) are merged by a second aggregate of bounded heaps.

Blocks hold a fixed number of vectors, so a task's memory is bounded; query blocks are sent to every candidate
block, which is a stated query set against all rows, in blocks.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part. Vectors of another
dimension than the query aren't its candidates. Rows with the query's own vec_id aren't its candidates. Ties go to
the smaller vec_id. Of rows with one vec_id, that with the greatest vector (by its components, from the first on) counts.
Further columns are ignored. A table without vectors gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 8192
#: Surviving pairs that are recomputed at a time.
SURVIVORS = 1 << 16
SCHEMA = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms of what quantisation loses, norms of what it keeps."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    kept = code * scale[:, None]
    return code, scale, np.linalg.norm(x - kept, axis=1) * (1 + 1e-9), np.linalg.norm(kept, axis=1)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up from the first component to the last: the same for the same vectors, wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query within a tile: query ids, candidate ids, scores."""
    qc, qs, qe, qk = quantise(q)
    cc, cs, ce, ck = quantise(c)
    kind = np.float32 if c.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products are exact in it
    cf, cn = cc.astype(kind), ck + ce
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 128):  # strips of the tile, so that its bounds stay small
        s = slice(at, at + 128)
        near = (qc[s].astype(kind) @ cf.T).astype(np.float64) * qs[s, None] * cs[None, :]
        bound = qe[s, None] * cn[None, :] + qk[s, None] * ce[None, :] + 1e-9 * (qk[s] + qe[s])[:, None] * cn[None, :]
        own = qid[s, None] == cid[None, :]
        low = np.where(own, -np.inf, near - bound)
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((near + bound >= least[:, None]) & ~own)
        score = np.concatenate([exact(q[s][i[x : x + SURVIVORS]], c[j[x : x + SURVIVORS]]) for x in range(0, len(i), SURVIVORS)] or [np.zeros(0)])
        order = np.lexsort((cid[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        best = rank < k
        out.append((qid[s][i[best]], cid[j[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _matrix(ids: list[bytes], blobs: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.frombuffer(x, np.int64) for x in ids]), np.concatenate([np.frombuffer(x, np.float64).reshape(-1, dim) for x in blobs])


def _blocks(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a partition as blocks of at most ``size`` vectors of one dimension, one row each.

        All rows with a vec_id are in one partition; the greatest of their vectors stands for it.
        """
        one: dict[int, np.ndarray] = {}

        for batch in batches:
            column = batch.column("v")
            values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, vec in enumerate(batch.column("vec_id").to_pylist()):
                x = values[offsets[i] : offsets[i + 1]]
                if vec not in one or one[vec].tolist() < x.tolist():
                    one[vec] = x.copy()
        for dim in sorted({len(x) for x in one.values()}):
            ids = sorted(vec for vec, x in one.items() if len(x) == dim)
            for at in range(0, len(ids), size):
                some = ids[at : at + size]
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [np.array(some, np.int64).tobytes()], "blob": [np.stack([one[x] for x in some]).tobytes()]})

    return pack


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product for each query; both sides have vec_id, embedding."""
    packed = "dim int, ids binary, blob binary"
    n = max(1, -(-vectors.count() // block))
    g = max(1, -(-queries.count() // block))
    # A tile's key: the part of the candidates (dealt by id, a block or two) and the group of query blocks.
    groups, parts = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (g, n))
    cand = usable(vectors).repartition(n, "vec_id").mapInArrow(_blocks(block), packed).select(F.spark_partition_id().alias("part"), groups.alias("grp"), "*")
    quer = usable(queries).repartition(max(1, -(-queries.count() // 1024)), "vec_id").mapInArrow(_blocks(1024), packed).select(F.pmod(F.xxhash64("ids"), F.lit(g)).cast("int").alias("grp"), parts.alias("part"), "*")

    def join(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim in set(left["dim"]) & set(right["dim"]):
            cid, c = _matrix(list(left.loc[left["dim"] == dim, "ids"]), list(left.loc[left["dim"] == dim, "blob"]), dim)
            for ids, blob in right.loc[right["dim"] == dim, ["ids", "blob"]].itertuples(index=False):
                qid, q = _matrix([ids], [blob], dim)
                out.append(pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), tile(qid, q, cid, c, k), strict=True))))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    tiles = cand.groupBy("part", "grp").cogroup(quer.groupBy("part", "grp")).applyInPandas(join, SCHEMA)
    # One row per tile and query, so that the merge gets heaps, not pairs.
    heaps = tiles.groupBy("query_id", F.spark_partition_id().alias("tile")).agg(F.collect_list(F.struct((-F.col("score")).alias("m"), "vec_id")).alias("heap"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"query_id": [], "rank": [], "vec_id": [], "score": []}
            for qid, lists in zip(batch.column("query_id").to_pylist(), batch.column("heaps").to_pylist(), strict=True):
                best = heapq.nsmallest(k, ((x["m"], x["vec_id"]) for heap in lists for x in heap))
                for rank, (m, vec) in enumerate(best, 1):
                    out["query_id"].append(qid), out["rank"].append(rank), out["vec_id"].append(vec), out["score"].append(-m)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    return heaps.groupBy("query_id").agg(F.collect_list("heap").alias("heaps")).mapInArrow(merge, "query_id long, rank int, vec_id long, score double")
