"""A quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a small network on features of the text alone, by the non-negative
unbiased risk: prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)). The class prior is
estimated from the two samples: a first classifier tells positives from unlabelled rows, and the prior is the share
of the unlabelled rows that score like nearly all positives do. No row is ever taken as a trusted negative.

Training takes a bounded sample: at most ``sample`` positives and about as many unlabelled rows, chosen by a hash of
doc_id; every row is scored, over its whole text.

Defined results: null and empty texts get the score of a text without words. Labels that are null, or of rows that
aren't in the table, are ignored; repeated labels count once. Without positives, all rows score 0.5 and are accepted; an
empty table gives an empty result. Rows are scored one by one, so repeated rows, ties and further columns have no
influence on one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays

SAMPLE = 12_000
#: Words in a stretch; the worst stretch of a text is a feature of its own.
STRETCH = 24
HIDDEN = 24

_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.int64)  # 0: other control characters
_CLASS[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = 1
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 2
_CLASS[[ord(c) for c in "0123456789"]] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[0x80:0xC0] = 6
_CLASS[0xC0:] = 7
for _i, _c in enumerate(_SIGNS):
    _CLASS[_c] = 8 + _i
CLASSES = 8 + len(_SIGNS)
_ODD = np.array([chr(c) in "#$%&*+<=>@[]^_`{|}~\\" for c in range(256)])
_BANG = np.array([chr(c) in "!?" for c in range(256)])
_PLAIN = np.array([chr(c) in ".,;:'\"-()" for c in range(256)])
STRETCHES = 7
FEATURES = CLASSES + 6 + 2 * STRETCHES


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers for each text: shares of kinds of characters, of words, and of the worst stretch."""
    data, at = arrays.flat(column)
    n, sizes = len(column), np.diff(at)
    out = np.zeros((n, FEATURES))
    text = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(text * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
    out[:, :CLASSES] = np.sqrt(kinds / np.maximum(sizes, 1)[:, None])
    words = arrays.Words(data, at)
    count = np.diff(words.first)
    c = CLASSES
    out[:, c] = np.log1p(sizes) / 10
    out[:, c + 1] = np.log1p(count) / 10
    out[:, c + 2] = np.log1p(kinds[:, 5]) / 5
    if not len(words):
        return out
    own, hashes = words.texts(), words.hashes()

    def inside(mark: np.ndarray) -> np.ndarray:
        """How many marked bytes each word has."""
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mark[data], out=sums[1:])
        return sums[words.end] - sums[words.start]

    size = words.end - words.start
    upper, odd, bang, plain = (inside(x) for x in (_CLASS == 2, _ODD, _BANG, _PLAIN))
    letters = inside((_CLASS == 1) | (_CLASS == 2) | (_CLASS >= 6) & (_CLASS < 8))
    same = np.zeros(len(words), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    marks = np.stack([(upper >= 2) & (upper * 2 > letters), odd > 0, odd == size, bang > 0, same, plain > 0, size >= 16], axis=1).astype(np.float64)
    order = np.lexsort((hashes, own))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.bincount(own[order], weights=fresh, minlength=n)
    most = np.maximum(count, 1)
    out[:, c + 3] = distinct / most
    out[:, c + 4] = np.bincount(own, weights=size, minlength=n) / most / 10
    out[:, c + 5] = np.log1p(np.maximum.reduceat(np.append(size, 0), np.minimum(words.first[:-1], len(size)))) / 10 * (count > 0)
    total = np.stack([np.bincount(own, weights=m, minlength=n) for m in marks.T], axis=1)
    out[:, c + 6 : c + 6 + STRETCHES] = np.sqrt(total / most[:, None])
    within = (np.arange(len(words)) - words.first[own]) // STRETCH
    begin = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (within[1:] != within[:-1])])
    stretch = np.add.reduceat(marks, begin, axis=0) / STRETCH
    worst = np.zeros((n, STRETCHES))
    np.maximum.at(worst, own[begin], stretch)
    out[:, c + 6 + STRETCHES :] = worst
    return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_forward((x - self.mean) / self.scale, self.weights)[1], -30, 30)))


def _forward(x: np.ndarray, w: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ w[0] + w[1])
    return hidden, hidden @ w[2] + w[3][0]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, epochs: int = 60, seed: int = 7) -> Network:
    """Minimise the non-negative PU risk by Adam in mini-batches; prior None: estimate it first."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    if prior is None:
        first = _train(p, u, None, max(10, epochs // 3), seed)
        sp, su = _forward(p, first)[1], _forward(u, first)[1]
        cut = np.quantile(sp, 0.05)
        prior = float(np.clip((su >= cut).mean() / 0.95, 0.05, 0.98))
    return Network(mean, scale, _train(p, u, prior, epochs, seed), prior)


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, epochs: int, seed: int) -> tuple[np.ndarray, ...]:
    """prior None: plain logistic loss of positives against unlabelled rows."""
    rng = np.random.default_rng(seed)
    d = p.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    batch = 512
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        ip, iu = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(max(1, -(-max(len(p), len(u)) // batch))):
            xp, xu = p[ip.take(range(k * batch, (k + 1) * batch), mode="wrap")], u[iu.take(range(k * batch, (k + 1) * batch), mode="wrap")]
            (hp, zp), (hu, zu) = _forward(xp, w), _forward(xu, w)
            up, uu = 1 / (1 + np.exp(-np.clip(zp, -30, 30))), 1 / (1 + np.exp(-np.clip(zu, -30, 30)))
            if prior is None:
                gp, gu = (up - 1) / len(zp), uu / len(zu)
            else:
                rest = _softplus(zu).mean() - prior * _softplus(zp).mean()
                if rest >= 0:
                    gp, gu = (prior * (up - 1) - prior * up) / len(zp), uu / len(zu)
                else:  # the estimate of the negatives' risk went below zero: step back along it
                    gp, gu = prior * up / len(zp), -uu / len(zu)
            grads = [0, 0, 0, 0]
            for x, h, g in ((xp, hp, gp), (xu, hu, gu)):
                back = np.outer(g, w[2]) * (1 - h * h)
                for i, y in enumerate((x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()]))):
                    grads[i] = grads[i] + y
            step += 1
            for i in range(4):
                g = grads[i] + 1e-4 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _gather(docs: DataFrame) -> np.ndarray:
    """Features of a bounded sample, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches, "text"):
            x = features(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"]))
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float64).reshape(-1, FEATURES)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Fit on the rows whose fold isn't 1; None without a positive. docs: doc_id, text; labels: doc_id, quality."""
    spread = F.xxhash64("doc_id", F.lit("sample"))
    mine = labels.select("doc_id", "quality").where((F.col("quality") == 1) & (fold(F.col("doc_id")) != 1)).select("doc_id").distinct()
    ids = mine.orderBy(spread, "doc_id").limit(sample)  # at most ``sample`` ids, which bounds the broadcast
    positive = _gather(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi"))
    if not len(positive):
        return None
    pool = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 1)
    share = min(1.0, sample * 1.5 / max(1, docs.count()))
    # A share of all hashes: about 1.5 times ``sample`` rows, however many there are.
    most = int((share * 2 - 1) * 2.0**63) if share < 1 else 2**63 - 1
    unlabelled = _gather(pool.where(spread <= F.lit(most)))
    return fit(positive, unlabelled if len(unlabelled) else positive)


def score(docs: DataFrame, network: Network | None, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text) with score (0 to 1) and predicted (1 if score >= 0.5); keep: the columns to carry along."""
    keep = keep or ["doc_id"]
    if network is None:
        return docs.select(*keep, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    own = docs.select(*keep, "text") if "text" not in keep else docs.select(*keep)
    column = "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches, column):
            s = network.score(features(batch.column(column)))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name in keep] + ["score double", "predicted int"])
    return own.mapInArrow(run, schema)


def accepted(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns, whatever their names."""
    if network is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches, "text"):
            yield batch.filter(pa.array(network.score(features(batch.column("text"))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    network = train(docs, labels, sample)
    out = score(docs.select("doc_id", "text"), network)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
