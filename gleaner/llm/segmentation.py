"""SentencePiece encoding and decoding with distinct sampled segmentations: Gumbel top-k without replacement.

All segmentations of a text form a lattice. A piece weighs ``-alpha * log(rank + 2)``, and a segmentation's probability
is proportional to the exponential of its pieces' sum. Each segmentation has an independent Gumbel variable shifted by
its log-probability; the k largest are a sample of k without replacement. They are found by a best-first (A*) search
from the top down: the maximum over the whole lattice is drawn first, the chosen piece at each node inherits it, and
all other pieces of a node together get one maximum of their own, truncated at the node's. The entry of the frontier
with the largest maximum is opened next, so each finished path is the next largest, and none comes twice. The
(k+1)-th maximum gives each sample its inclusion probability 1 - exp(-exp(log_prob - threshold)).

Pieces don't cross word starts, so a text's lattice is a chain of its words' lattices; those are built once
for each batch of rows, for its distinct words, and all rows of a batch are searched in step. The random numbers depend
on the row's key, the seed and the place only. Characters without a piece fall back to their bytes.

Defined results: null and empty texts have one segmentation, without pieces (log_prob 0, inclusion 1). A text with fewer
than k segmentations gives all of them, each with inclusion 1. Rows with equal keys and texts give equal samples. An
empty table gives an empty result. Only the keys and the text are read, so further columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import mix, pieces, prefix, ranged
from .tokens import ranges, vocabulary

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Steps between the random numbers of places, samples and purposes.
_PLACE, _SAMPLE, _PURPOSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03)
_FEW = np.uint64((1 << 20) - 1)


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _values(symbols: np.ndarray) -> np.ndarray:
    return mix(symbols.astype(np.uint64) + _PLACE)


def _hashes(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums for hashes of ranges of symbols."""
    return prefix(_values(symbols))


def _best(owner: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
    """Where the ``most`` largest values of each run of equal owners are, in order of place; of equal values the first."""
    if not len(owner):
        return np.zeros(0, np.int64)
    heads, value, found = _first_of(owner), value.copy(), []
    runs = np.diff(np.r_[heads, len(owner)])
    for _ in range(most):
        top = np.flatnonzero(value == np.repeat(np.maximum.reduceat(value, heads), runs))
        top = top[_first_of(owner[top])]
        found.append(top)
        value[top] = -np.inf
    return np.unique(np.concatenate(found))


def _first_of(owner: np.ndarray) -> np.ndarray:
    """Where each run of equal owners begins."""
    return np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)


class Lattices:
    """The word lattices of many texts. A word that comes again shares its lattice.

    Edges lie by node, nodes by their distance from their word's end. Each edge has the unit of ids that it stands for,
    the node behind it (``end`` behind a word), its log-probability and the sum of its node's probabilities up to it.
    """

    def __init__(self, surfaces: list[str], seg: Segmenter):
        self.rows = len(surfaces)
        symbols = _symbols("".join(surfaces))
        at = np.r_[0, np.cumsum([len(s) for s in surfaces], dtype=np.int64)]
        marks = symbols == ord(MARK)
        begins = marks & ~np.r_[False, marks[:-1]]
        begins[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.r_[start, len(symbols)])
        self.row = np.searchsorted(at, start, side="right") - 1
        self.place = start - at[self.row]
        key = ranged(_hashes(symbols), start, start + length)
        order = np.argsort(key)
        heads = _first_of(key[order])
        word, some = np.empty(len(key), np.int64), order[heads]
        word[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(key)]))
        length = length[some]
        first = np.cumsum(length) - length
        self.node, self.start = first[word], first[word]
        self._build(symbols[ranges(start[some], length)], np.repeat(first + length, length), seg)

    def _build(self, symbols: np.ndarray, end: np.ndarray, seg: Segmenter) -> None:
        n = len(symbols)
        self.end, self.units, self.unit_size, self.longest = n, seg.units, seg.unit_size, seg.longest
        values, node, key, room = _values(symbols), np.arange(n), np.zeros(n, np.uint64), end - np.arange(n)
        found = []
        for size in range(1, seg.longest + 1):  # from each node on, as long as a piece begins like this
            key = mix(key + values[node + (size - 1)])
            slot = seg.slots[key & _FEW]
            likely = np.flatnonzero(slot)
            node, key, spot = node[likely], key[likely], slot[likely] - 1
            there = seg.keys[spot] == key
            other = np.flatnonzero(~there & seg.shared[spot])
            spot[other] = np.minimum(np.searchsorted(seg.keys, key[other]), len(seg.keys) - 1)
            there[other] = seg.keys[spot[other]] == key[other]
            node, key, piece = node[there], key[there], seg.key_ids[spot[there]]
            hit = piece >= 0
            own = node[hit]
            found.append((own, own + size, piece[hit]))
            going = room[node] > size
            node, key = node[going], key[going]
        none = np.ones(n, bool)
        for own, _, _ in found:
            none[own] = False
        bare = np.flatnonzero(none)  # characters without a piece are spelt in bytes
        kinds, kind = np.unique(symbols[bare], return_inverse=True)
        raw = [[seg.raw[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
        found.append((bare, bare + 1, len(seg.unit_size) + kind))
        if raw:
            self.units = np.concatenate([seg.units, np.concatenate(raw)])
            self.unit_size = np.concatenate([seg.unit_size, [len(x) for x in raw]])
        self.unit_at = np.cumsum(self.unit_size) - self.unit_size
        weights = np.concatenate([seg.weights, [sum(seg.weights[x]) for x in raw]])
        node, behind, unit = (np.concatenate([f[i] for f in found]) for i in range(3))
        distance, size = room[node], behind - node
        if n < 1 << 28:  # by distance, node and size in one number
            order = np.argsort((distance * n + node) * 64 + (63 - size))
        else:
            order = np.lexsort((-size, node, distance))
        # Longer pieces first: they are likelier.
        node, behind, self.unit = node[order], behind[order], unit[order]
        self.behind = np.where(behind == end[node], n, behind)
        distance = distance[order]
        heads = _first_of(node)
        degree = np.diff(np.r_[heads, len(node)])
        self.first, self.degree, self.rank = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.first[node[heads]], self.degree[node[heads]], self.rank[node[heads]] = heads, degree, np.arange(len(heads))
        weight, rest = weights[self.unit], np.zeros(n + 1)
        self.log = np.empty(len(node))
        levels = np.r_[_first_of(distance), len(node)]
        level_heads = np.searchsorted(heads, levels)
        for lo, hi, a, b in zip(levels[:-1].tolist(), levels[1:].tolist(), level_heads[:-1].tolist(), level_heads[1:].tolist(), strict=True):
            score = weight[lo:hi] + rest[self.behind[lo:hi]]
            cut, times = heads[a:b] - lo, degree[a:b]
            top = np.maximum.reduceat(score, cut)
            total = top + np.log(np.add.reduceat(np.exp(score - np.repeat(top, times)), cut))
            rest[node[heads[a:b]]] = total
            self.log[lo:hi] = score - np.repeat(total, times)
        mass = np.cumsum(np.exp(self.log))
        inside = np.minimum(mass - np.repeat(np.r_[0.0, mass][heads], degree), 1.0)
        inside[heads + degree - 1] = 1.0
        self.upto = inside + np.repeat(np.arange(len(heads)), degree)
        self.of = node

    def sample(self, seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """At most k distinct segmentations of each row, most perturbed first.

        Their rows, numbers (from 0), log-probabilities, how many edges each has and the edges end to end; and for each
        row the maximum that would come next.
        """

        def uniform(occ: np.ndarray, node: np.ndarray, number: int, purpose: int) -> np.ndarray:
            place = (self.place[occ] + node - self.start[occ] + 1).astype(np.uint64)
            x = seeds[self.row[occ]] + np.uint64(number + 1) * _SAMPLE + np.uint64(purpose) * _PURPOSE
            return ((mix(mix(x) + place * _PLACE) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

        old = np.seterr(over="ignore")
        words = np.searchsorted(self.row, np.arange(self.rows + 1))
        top = -np.log(-np.log((mix(seeds + _PURPOSE * np.uint64(7)) >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54))
        rows = np.arange(self.rows)
        # All paths so far, end to end: for each edge the word's occurrence; where each row's path of each sample begins.
        steps_occ, steps_edge, begun = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((k, self.rows), np.int64)
        frontier = [np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, np.int64)]  # row, maximum, sample, step, edges taken
        out, number = [], 0
        pre_occ, pre_edge, pre_size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.rows, np.int64)
        branch_left, branch_mask = np.zeros(0), np.zeros(0, np.int64)
        while True:
            # From where the prefixes end to the rows' ends: the rest of the word that is open, then all later words.
            if number:
                last = np.cumsum(pre_size) - 1
                open_node, nxt = self.behind[pre_edge[last]], pre_occ[last] + 1
                going = np.flatnonzero(open_node < self.end)
                occ = np.concatenate([pre_occ[last][going], ranges(nxt, words[rows + 1] - nxt)])
                node = np.concatenate([open_node[going], self.node[occ[len(going) :]]])
            else:
                occ, node = np.arange(len(self.node)), self.node
            made_occ, made_edge = [pre_occ], [pre_edge]
            while len(occ):
                edge, drawn = self.first[node], self.rank[node] + uniform(occ, node, number, 0)
                ahead = np.flatnonzero(self.upto[edge] < drawn)
                while len(ahead):
                    edge[ahead] += 1
                    ahead = ahead[self.upto[edge[ahead]] < drawn[ahead]]
                made_occ.append(occ), made_edge.append(edge)
                node = self.behind[edge]
                occ, node = occ[live := node < self.end], node[live]
            occ, edge = np.concatenate(made_occ), np.concatenate(made_edge)
            order = np.argsort(occ, kind="stable")
            occ, edge = occ[order], edge[order]
            owner = np.searchsorted(rows, self.row[occ])
            size = np.bincount(owner, minlength=len(rows))
            at = np.cumsum(size) - size
            log = self.log[edge]
            sums = np.r_[0.0, np.cumsum(log)]
            out.append((rows, np.full(len(rows), number), sums[at + size] - sums[at], size, edge))
            begun[number, rows] = len(steps_occ) + at
            steps_occ, steps_edge = np.concatenate([steps_occ, occ]), np.concatenate([steps_edge, edge])
            # What is left of each node behind the prefix, and of the node where it branched off.
            index = np.arange(len(occ)) - at[owner]
            open_at = self.of[edge]
            left = np.where(self.degree[open_at] > 1, np.maximum(-np.expm1(log), 1e-17), 0.0)
            fresh = index >= pre_size[owner]
            if number:
                spot = at + pre_size - 1
                left[spot], fresh[spot] = branch_left, True
            new = np.flatnonzero(fresh & (left > 0))
            before = sums[new] - sums[at[owner[new]]]
            g = before + np.log(left[new]) - np.log(-np.log(uniform(occ[new], open_at[new], number, 1)))
            # A row's maxima grow with g, and only its best k + 1 can come up.
            some = _best(owner[new], g, k + 1)
            new, g = new[some], g[some]
            best = top[owner[new]] - np.logaddexp(0, top[owner[new]] - g)
            mask = np.int64(1) << (edge[new] - self.first[open_at[new]])
            if number:
                again = np.flatnonzero(new == spot[owner[new]])
                mask[again] = branch_mask[owner[new[again]]]
            joined = [np.concatenate([a, b]) for a, b in zip(frontier, (rows[owner[new]], best, np.full(len(new), number), index[new], mask), strict=True)]
            # Only the best k + 1 of a row can come up again. The best is opened next.
            order = np.lexsort((-joined[1], joined[0]))
            heads = _first_of(joined[0][order])
            rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
            chosen = [x[order[rank == 0]] for x in joined]
            frontier = [x[order[(rank > 0) & (rank <= k)]] for x in joined]
            number += 1
            if number == k or not len(chosen[0]):
                break
            rows, top, parent, step, taken = chosen
            begin = begun[parent, rows]
            spot = begin + step
            node = self.of[steps_edge[spot]]
            edges = self.first[node][:, None] + np.arange(self.longest)
            free = (np.arange(self.longest) < self.degree[node][:, None]) & (taken[:, None] >> np.arange(self.longest) & 1 == 0)
            mass = np.where(free, np.exp(self.log[np.minimum(edges, len(self.log) - 1)]), 0.0)
            upto = np.cumsum(mass, axis=1)
            choice = np.argmax(free & (upto >= (uniform(steps_occ[spot], node, number, 2) * upto[:, -1])[:, None]), axis=1)
            line = np.arange(len(rows))
            free[line, choice] = False
            branch_left = np.where(free, mass, 0.0).sum(axis=1)
            branch_mask = taken | np.int64(1) << choice
            pre_size = step + 1
            pre = ranges(begin, pre_size)
            pre_occ, pre_edge = steps_occ[pre], steps_edge[pre]
            pre_edge[np.cumsum(pre_size) - 1] = self.first[node] + choice
        np.seterr(**old)
        bound = np.full(self.rows, -np.inf)
        bound[chosen[0]] = chosen[1]
        return *(np.concatenate([x[i] for x in out]) for i in range(5)), bound

    def ids(self, edges: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of paths of ``size`` edges each, end to end, and the offset of each path."""
        units = self.unit[edges]
        lengths = np.r_[0, np.cumsum(self.unit_size[units])]
        at = lengths[np.r_[0, np.cumsum(size)]]
        return self.units[ranges(self.unit_at[units], self.unit_size[units])].astype(np.int32), at


class Segmenter:
    def __init__(self, path: str, alpha: float = 1.0):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        plain = [i for i in range(size) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.raw = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.units, self.unit_size = np.arange(size), np.ones(size, np.int64)
        self.weights = -alpha * np.log(np.arange(size) + 2.0)
        texts = [self.library.id_to_piece(i) for i in plain]
        self.longest = max(map(len, texts))  # a node has at most so many edges
        if self.longest > 62:
            raise ValueError(f"pieces of up to {self.longest} letters: the search marks a node's edges in 62 bits")
        # Keys of the beginnings of all pieces, each with the piece that it is (or -1).
        letters = np.array([len(t) for t in texts])
        first, values, key, found = np.cumsum(letters) - letters, _values(_symbols("".join(texts))), np.zeros(len(texts), np.uint64), []
        for n in range(1, self.longest + 1):
            live = np.flatnonzero(letters >= n)
            key[live] = mix(key[live] + values[first[live] + (n - 1)])
            found.append((key[live], np.where(letters[live] == n, np.array(plain)[live], -1)))
        keys, ids = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        order = np.lexsort((-ids, keys))
        order = order[_first_of(keys[order])]
        self.keys, self.key_ids = keys[order], ids[order]
        # By the low bits of a key, its number (from 1); keys that share these bits are searched for.
        low = self.keys & _FEW
        self.slots = np.zeros(1 << 20, np.int32)
        self.slots[low] = np.arange(1, len(low) + 1)
        self.shared = np.bincount(low.astype(np.int64), minlength=1 << 20)[low] > 1
        spelt = [b""] * size
        for i, t in zip(plain, texts, strict=True):
            spelt[i] = t.encode()
        for b, i in enumerate(self.raw):
            spelt[i] = bytes([b])
        self.spelt, self.spelt_size = np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt])
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size

    def surface(self, text: str) -> str:
        """The text as the model normalises it, with the mark that the model puts before it."""
        return self.library.normalize(text) if text else ""

    def split(self, surface: str) -> Lattices:
        return Lattices([surface], self)

    def sample(self, words: Lattices, k: int, rng: np.random.Generator) -> tuple[list[tuple[list[int], float]], float]:
        """At most k distinct segmentations (ids, log-probability) of one text, most perturbed first, and the next maximum."""
        _, _, logs, size, edges, bound = words.sample(rng.integers(0, 1 << 64, 1, np.uint64), k)
        ids, at = words.ids(edges, size)
        return [(ids[a:b].tolist(), float(lp)) for a, b, lp in zip(at[:-1], at[1:], logs, strict=True)], float(bound[0])

    def spell(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """What each run of ids spells."""
        lengths = np.r_[0, np.cumsum(self.spelt_size[ids])][at].tolist()
        raw = self.spelt[ranges(self.spelt_at[ids], self.spelt_size[ids])].tobytes()
        return [raw[a:b] for a, b in zip(lengths[:-1], lengths[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=1)
def segmenter(name: str) -> Segmenter:
    return Segmenter(vocabulary(name) if "/" not in name else name)


def sample_segmentations(rows: DataFrame, keys: list[str], k: int = 2, seed: int = 0, model: str = MODEL) -> DataFrame:
    """keys, sample (from 1), n_pieces, ids, log_prob, inclusion, decoded (whether the ids spell the text) of rows (keys, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(model)
        for batch in pieces(batches, "text", 1 << 20):
            surfaces = [seg.surface(t or "") for t in batch.column("text").to_pylist()]
            names = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            seeds = np.array([xxhash.xxh64_intdigest(repr(x), seed) for x in names], np.uint64)
            words = Lattices(surfaces, seg)
            row, number, logs, size, edges, bound = words.sample(seeds, k)
            ids, at = words.ids(edges, size)
            with np.errstate(over="ignore"):
                inclusion = -np.expm1(-np.exp(np.minimum(logs - bound[row], 700)))
            target = [s.encode("utf-8", "surrogatepass") for s in surfaces]
            fine = [x == target[r] for x, r in zip(seg.spell(ids, at), row.tolist(), strict=True)]
            raw, cuts = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B") if len(ids) else b"", at.tolist()
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(pa.array(row)) for c in keys], pa.array(number + 1, pa.int32()), pa.array(np.diff(at), pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(logs), pa.array(inclusion), pa.array(fine, pa.bool_()), pa.array(sums, pa.int64())],
                names=[*keys, "sample", "n_pieces", "ids", "log_prob", "inclusion", "decoded", "ids_crc32"],
            )

    own = rows.select(*keys, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name in keys)
    return own.mapInArrow(run, f"{schema}, sample int, n_pieces int, ids array<int>, log_prob double, inclusion double, decoded boolean, ids_crc32 long")


def decode_ids(rows: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """rows with all their columns and ``text``: what the ids spell, as the model's library decodes it. Null ids spell nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = segmenter(model).library
        for batch in batches:
            texts = [library.decode([int(i) for i in x]) if x else "" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    kept = rows.drop("text")
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())]))
