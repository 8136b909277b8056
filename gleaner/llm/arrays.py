"""Texts as flat numpy arrays: words, rolling hashes and sliding minima, all without a loop over rows.

Hashes have 62 bits: two polynomials over random values of the symbols, each modulo the prime 2^31 - 1, with a mixer
behind them. (Modulo 2^64 there would be texts, such as the Thue-Morse word and its complement, that collide under
every base.) They depend on fixed seeds only, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: What separates words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
PRIME = U(2**31 - 1)
BASES = (0x5DEECE66, 0x2F0B4C47)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME in part: from below 2**62 to below 2**32."""
    return (x & PRIME) + (x >> U(31))


def residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for any x."""
    x = fold(fold(x))
    x -= (x >= PRIME) * PRIME
    return x


def powers(lane: int, down: bool, n: int) -> np.ndarray:
    """The first n powers of a lane's base, or of its inverse, kept between calls."""
    kept = _powers.get((lane, down), ())
    if len(kept) < n:
        base = pow(BASES[lane], -1 if down else 1, int(PRIME))
        kept, m = np.ones(max(1 << 16, 1 << (n - 1).bit_length()), np.uint32), 1
        while m < len(kept):
            kept[m : 2 * m] = residue(kept[:m] * U(pow(base, m, int(PRIME))))
            m *= 2
        _powers[lane, down] = kept
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer (the finaliser of splitmix64), in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Symbols that are hashed at a time, so that what lies between stays in the processor's cache.
STRIP = 1 << 14


def prefix(values: np.ndarray) -> np.ndarray:
    """For each lane, prefix sums of its share of values[i] times its base's power i; one longer than values."""
    n = len(values)
    out = np.zeros((2, n + 1), np.uint64)
    for lane in (0, 1):
        up, sums = powers(lane, False, n), out[lane]
        for at in range(0, n, STRIP):
            x = values[at : at + STRIP]
            x = (x >> U(33) if lane else x & PRIME) * up[at : at + STRIP]
            np.cumsum(fold(x), out=sums[at + 1 : at + 1 + len(x)])
            sums[at + 1 : at + 1 + len(x)] += sums[at]
    return out


def ranged(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [start, end), from their prefix sums."""
    out = np.empty(len(start), np.uint64)
    down = [powers(lane, True, sums.shape[1]) for lane in (0, 1)]
    for at in range(0, len(start), STRIP):
        a, b = start[at : at + STRIP], end[at : at + STRIP]
        lanes = [residue(fold(fold(sums[lane][b] - sums[lane][a])) * down[lane][a]) for lane in (0, 1)]
        out[at : at + STRIP] = mix(lanes[0] << U(31) | lanes[1])
    return out


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all len(values) - k + 1 runs of k symbols."""
    n = max(0, len(values) - k + 1)
    sums, out = prefix(values), np.empty(n, np.uint64)
    down = [powers(lane, True, n) for lane in (0, 1)]
    for at in range(0, n, STRIP):
        end = min(n, at + STRIP)
        lanes = [residue(fold(fold(sums[lane][at + k : end + k] - sums[lane][at:end])) * down[lane][at:end]) for lane in (0, 1)]
        out[at:end] = mix(lanes[0] << U(31) | lanes[1])
    return out


def rough(values: np.ndarray, k: int) -> np.ndarray:
    """Cheap hashes of all runs of k symbols, for choosing among them only: different runs may well collide."""
    n = max(0, len(values) - k + 1)
    out = np.zeros(n, np.uint64)
    for at in range(0, n, STRIP):  # runs of doubling length, put together by the bits of k
        x = values[at : min(n, at + STRIP) + k - 1]
        h, size, left, total, length = x, 1, 0, None, min(n, at + STRIP) - at
        while True:
            if k & size:
                part = h[left : left + length]
                total = part if total is None else total * U(0x9E3779B97F4A7C15) + part
                left += size
            if size * 2 > k:
                break
            h = h[:-size] * U(0xD1342543DE82EF95 + 2 * size) + h[size:]
            size *= 2
        out[at : at + length] = mix(total.copy())
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w elements, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, w)
    left = np.minimum.accumulate(padded, axis=1).reshape(-1)
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column, end to end, and its n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(column.type) else column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of a text column (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """The words of texts: start and end in the data, the text of each, and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begins = solid[1:] & (~solid[:-1] | cut)
        ends = solid[:-1] & (~solid[1:] | cut)
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets)
        self.data = data

    def __len__(self) -> int:
        return len(self.start)

    def texts(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, lower: bool = False) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return ranged(prefix(TABLE[data]), self.start, self.end)
