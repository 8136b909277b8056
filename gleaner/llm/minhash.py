"""Near-duplicate detection by HyperMinHash registers.

A document's set are its distinct shingles of five words. Each shingle falls into one of REGISTERS buckets; a bucket
keeps the smallest hash in it as 16 bits: how many leading zeros it has (6 bits, stored so that smaller hashes have
smaller registers) and the bits behind them (10 bits). Eight neighbouring registers merge into one of 96 wider ones
by their minimum, and four of those make a band. The estimates use all registers, shortened to 8 bits (3 of the zeros'
count, 5 behind them). Documents that share a band are candidates; a band of four empty registers is none.
With 24 bands, a pair of similarity 0.85 shares no band in 2 of 10^8 cases.

1. Documents with the same set are one class: classes, not copies, go on, each under its smallest doc_id.
2. In every bucket of a band, each class is paired with one head: the class whose buckets are fullest, which in a
   family of near copies is the one in the middle. Their registers give an estimate of the similarity, corrected for
   equal registers of different hashes; what is more than five standard deviations below the threshold is dropped,
   the rest is verified on the full sets.
3. Components of the links found so far. A bucket whose classes all lie in one component is settled: a further link
   there would change nothing. In any other bucket all pairs of classes of different components are estimated in tiles
   of chunks, in which classes with a plausible partner are marked; their full sets come back to the tile, where all
   pairs of them are verified and a spanning forest of the links between components is emitted. So no such link is
   lost, and what a tile emits grows with its classes, not with their pairs. The tiles of a bucket go to different tasks.
4. Components again, and back to the documents by class.

Sets are held as 64-bit hashes of shingles. Defined results: null and empty texts, and texts without words, have an
empty set and are linked with nothing; fewer than five words are one shingle. A doc_id names a text; where it
has several, each row counts with the class of its own set, and the least of the texts speaks for classes that have
no other name. Rows without a doc_id take part through rows with the same set that have one.
Further columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .common import join_skewed, materialise, release, rows_of

WORDS = 5
BANDS, ROWS = 24, 4
FINE = 8
REGISTERS = BANDS * ROWS * FINE
MANTISSA = 10
EMPTY = 0xFFFF
PERCENT = 85
#: A tile of a bucket holds two chunks of its classes at most: about so many classes, and bytes of their sets.
CHUNK, CHUNK_BYTES = 512, 4 << 20
#: Equal short registers by chance: the same number of leading zeros (1 in 3) and the same five bits.
NONE, CHANCE = 0xFF, 1 / (3 * 2**5)


def shingle_sets(column: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, at = arrays.flat(column)
    words = arrays.Words(data, at)
    hashes = words.hashes(lower=True)
    sums = arrays.prefix(hashes)
    rolled = arrays.rolling(hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(arrays.ranged(sums, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS 16-bit registers for each set."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    bucket = ((flat >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    value = (flat << np.uint64(32) | flat >> np.uint64(32)) >> np.uint64(11)  # 53 bits
    least = np.full(len(sets) * REGISTERS, 1 << 53, np.uint64)
    np.minimum.at(least, np.repeat(np.arange(len(sets)) * REGISTERS, sizes) + bucket, value)
    length = np.frexp(least.astype(np.float64))[1]
    zeros = np.minimum(53 - length, 62)
    mantissa = (least << np.maximum(zeros, 0).astype(np.uint64) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out = (62 - zeros).astype(np.uint16) << np.uint16(MANTISSA) | mantissa.astype(np.uint16)
    return np.where(least == 1 << 53, np.uint16(EMPTY), out).reshape(-1, REGISTERS)


def short(regs: np.ndarray) -> np.ndarray:
    """Registers in 8 bits, for estimates."""
    out = ((regs >> np.uint16(MANTISSA) & np.uint16(7)) << np.uint16(5) | (regs >> np.uint16(MANTISSA - 5) & np.uint16(31))).astype(np.uint8)
    return np.where(regs == EMPTY, np.uint8(NONE), np.minimum(out, np.uint8(NONE - 1)))


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of rows of registers, corrected for chance, and how many registers it rests on."""
    used = (a != NONE) | (b != NONE)
    m = np.maximum(used.sum(axis=1), 1)
    share = ((a == b) & used).sum(axis=1) / m
    return (share - CHANCE) / (1 - CHANCE), m


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    j, m = estimate(a, b)
    t = percent / 100
    union = (na + nb) / (1 + t)  # of two sets at the threshold; m of its members were drawn, without replacement
    left = np.clip((union - m) / np.maximum(union - 1, 1), 0, 1)
    return (j >= t - 5 * np.sqrt(t * (1 - t) / m * left + CHANCE / m)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A row of BANDS 64-bit keys for each row of registers; all ones where a band is empty throughout."""
    wide = np.ascontiguousarray(regs.reshape(-1, BANDS * ROWS, FINE).min(axis=2)).view(np.uint64)
    band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(wide == np.uint64(2**64 - 1), wide, arrays.mix(arrays.mix(wide.copy()) + band))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), cls (128-bit digest of the set), keys of the bands, regs; the last three null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches, "text"):
            sets = shingle_sets(batch.column("text"))
            regs = registers(sets)
            blobs = lambda rows: pa.array([r.tobytes() if len(s) else None for r, s in zip(rows, sets, strict=True)], pa.binary())  # noqa: B023, E731
            cls = pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), cls, blobs(band_keys(regs)), blobs(short(regs))], names=["doc_id", "n", "cls", "keys", "regs"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, cls binary, keys binary, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def bands(classes: DataFrame) -> DataFrame:
    """key, id: a row for each band of each class (id, keys) that isn't empty throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                keys = np.frombuffer(b"".join(part.column("keys").to_pylist()), np.uint64).reshape(-1, BANDS)
                row, band = np.nonzero(keys != np.uint64(2**64 - 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, band].view(np.int64)), part.column("id").take(pa.array(row))], names=["key", "id"])

    return classes.select("id", "keys").mapInArrow(run, "key long, id long")


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers and set sizes allow a link; b may be the same in any number of them."""
    own = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    heads = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fine = plausible(_matrix(batch.column("ra")), _matrix(batch.column("rb")), batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(fine))

    return join_skewed(pairs.join(own, "a"), heads, "b", counted=pairs, spread=["a"]).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, on their full sets. texts: id, text."""
    own = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    heads = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches, "ta"):
            sa, heads_seen = shingle_sets(batch.column("ta")), {}
            fine = []
            for i, (a, b) in enumerate(zip(sa, batch.column("b").to_pylist(), strict=True)):
                if b not in heads_seen:
                    heads_seen = {b: shingle_sets(batch.column("tb").slice(i, 1))[0]}
                sb = heads_seen[b]
                both = len(np.intersect1d(a, sb, assume_unique=True))
                fine.append(100 * both >= PERCENT * (len(a) + len(sb) - both))
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    return join_skewed(pairs.join(own, "a"), heads, "b", counted=pairs, spread=["a"]).select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame, seed: int = 1) -> DataFrame:
    """node, root for every node of links (a, b): contraction to random neighbours, in a logarithmic number of rounds.

    In each round every node joins the neighbour (or itself) of least hash; the links are renamed accordingly, and what
    is left of them goes into the next round. All tables are written to the shared folder, none is collected.
    """
    links = materialise(links.select("a", "b"))
    labels = materialise(links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")))
    while links.limit(1).count():
        seed += 1
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        step = materialise(both.groupBy("a").agg(F.least(F.min(order("b")), F.min(order("a")))["to"].alias("to")))
        old = [labels, links, step]
        labels = materialise(join_skewed(labels, step.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        renamed = join_skewed(links, step, "a").select(F.col("to").alias("na"), "b")
        renamed = join_skewed(renamed, step.withColumnRenamed("a", "b"), "b").select(F.col("na").alias("a"), F.col("to").alias("b"))
        links = materialise(renamed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        release(*old)
    release(links)
    return labels


def _dealt(open_: DataFrame) -> DataFrame:
    """open_ (key, id, root, n) with tile: the buckets' classes in chunks (chunk), and each chunk once for each chunk of its bucket."""
    sizes = open_.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") * 8 / CHUNK_BYTES)).alias("chunks"))
    rows = join_skewed(open_, sizes, "key", spread=["id"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    return rows.withColumn("other", other).select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "id", "root", "n")


def _tiles(rows: DataFrame, wide: DataFrame) -> DataFrame:
    """key, low, high, rows: the tiles' classes with their columns of wide (id, ...). A tile's size is bounded by that of chunks."""
    columns = [c for c in wide.columns if c != "id"]
    return rows.join(wide, "id").groupBy("key", "low", "high").agg(F.collect_list(F.struct("id", "chunk", "root", *columns)).alias("rows")).where(F.size("rows") > 1)


def suspects(dealt: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of dealt (key, low, high, id) that have a plausible partner of another component in their tile.

    A pair is looked at in the first bucket that it shares. What is emitted are classes, not pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, names = batch.column("rows"), [batch.column(c).to_numpy() for c in ("key", "low", "high")]
            edges, flat = rows.offsets.to_numpy(), rows.flatten()
            first = edges[0]
            regs, keys = _matrix(flat.field("regs")), np.frombuffer(b"".join(flat.field("keys").to_pylist()), np.uint64).reshape(-1, BANDS)
            n, ids, root, chunk = (flat.field(c).to_numpy() for c in ("n", "id", "root", "chunk"))
            for t in range(batch.num_rows):
                at, end = edges[t] - first, edges[t + 1] - first
                key, low, high = (x[t] for x in names)
                left, right = (np.flatnonzero(chunk[at:end] == c) + at for c in (low, high))
                marked = np.zeros(end - at, bool)
                step = max(1, 20_000 // max(1, len(right)))
                for s in range(0, len(left), step):
                    i, j = np.repeat(left[s : s + step], len(right)), np.tile(right, len(left[s : s + step]))
                    apart = (root[i] != root[j]) & ((low != high) | (i < j)) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
                    i, j = i[apart], j[apart]
                    near = plausible(regs[i], regs[j], n[i], n[j])
                    i, j = i[near], j[near]
                    same = (keys[i] == keys[j]) & (keys[i] != np.uint64(2**64 - 1))
                    home = keys[i, same.argmax(axis=1)] == np.int64(key).view(np.uint64)
                    marked[i[home] - at] = marked[j[home] - at] = True
                found = np.flatnonzero(marked) + at
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), x[t])) for x in names] + [pa.array(ids[found])], names=["key", "low", "high", "id"])

    return _tiles(dealt.drop("n"), known.select("id", "n", "regs", "keys")).mapInArrow(run, "key long, low long, high long, id long")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a, b) between components form a spanning forest of them."""
    names, pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1, return_index=True)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    keep = []
    for x, y, at in zip(names[0].tolist(), names[1].tolist(), pair.tolist(), strict=True):
        if (x := top(x)) != (y := top(y)):
            above[x] = y
            keep.append(at)
    return np.array(keep, np.int64)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over the shingles that more than one set has."""
    members, count = np.unique(np.concatenate(sets), return_counts=True)
    members = members[count > 1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(members), 8192):
        some = members[at : at + 8192]
        held = np.zeros((len(sets), len(some)), np.float32)
        for i, s in enumerate(sets):
            held[i] = np.isin(some, s, assume_unique=True)
        out += held @ held.T
    return out.astype(np.int64)


def settled(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components, on full sets: a spanning forest of those in each tile. rows: key, low, high, id, root, chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.column("rows"):
                flat = pa.RecordBatch.from_struct_array(tile.values)
                ids, root, chunk = (flat.column(c).to_numpy() for c in ("id", "root", "chunk"))
                held = [np.frombuffer(x, np.uint64) for x in flat.column("set").to_pylist()]
                n, both = np.array([len(s) for s in held]), _overlaps(held)
                i, j = np.nonzero(np.triu(100 * both >= PERCENT * (n[:, None] + n[None, :] - both), 1))
                across = (root[i] != root[j]) & ((chunk[i] != chunk[j]) | (chunk[i] == chunk.max()) & (chunk.min() == chunk.max()))
                i, j = i[across], j[across]
                if len(i):
                    keep = _forest(root[i], root[j])
                    a, b = ids[i[keep]], ids[j[keep]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return _tiles(rows, sets).mapInArrow(run, "a long, b long")


def set_table(texts: DataFrame) -> DataFrame:
    """id, set (sorted 64-bit hashes) of texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())], names=["id", "set"])

    return texts.mapInArrow(run, "id long, set binary")


def rest_links(shared: DataFrame, labels: DataFrame, known: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links between classes that share a bucket but no component yet; enough of them to join all components that have one."""
    own = materialise(join_skewed(shared.select("key", "id"), labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")))
    mixed = own.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key", F.lit(True).alias("open"))
    open_ = materialise(join_skewed(own, mixed, "key", spread=["id"]).select("key", "id", "root").join(known.select("id", "n"), "id"))
    dealt = materialise(_dealt(open_))
    found = materialise(suspects(dealt, known))
    scratch, links = [own, open_, dealt, found], None
    if found.limit(1).count():
        sets = materialise(set_table(rows_of(texts, found.select("id").distinct(), ["id"])))
        links = materialise(settled(dealt.drop("n").join(found, ["key", "low", "high", "id"], "left_semi"), sets))
        scratch.append(sets)
    release(*scratch)
    return links


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = materialise(sketch(docs))
    least = F.min(F.struct("doc_id", "keys")).alias("least")
    classes = materialise(sketches.where("cls is not null AND doc_id is not null").groupBy("cls").agg(least).select("cls", F.col("least.doc_id").alias("id"), "least.keys"))
    repeated = classes.groupBy("id").count().where("count > 1").limit(1).count() > 0
    named = classes.groupBy("id").agg(F.min(F.struct("cls", "keys")).alias("m")).select("id", "m.keys") if repeated else classes.select("id", "keys")
    rows = materialise(bands(named))
    sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    twice = materialise(join_skewed(rows, sizes, "key", spread=["id"]))
    middle = twice.groupBy("id").agg(F.sum("size").alias("c"))
    shared = materialise(twice.select("key", "id").join(middle, "id"))
    heads = materialise(shared.groupBy("key").agg(F.max(F.struct("c", F.xxhash64("id").alias("h"), F.col("id").alias("b"))).alias("head")).select("key", "head.b"))
    stars = materialise(join_skewed(shared, heads, "key", spread=["id"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct())
    ids = materialise(shared.select("id").distinct())
    known = rows_of(sketches.where("regs is not null").select(F.col("doc_id").alias("id"), "n", "regs", "keys"), ids, ["id"])
    texts = rows_of(docs.select(F.col("doc_id").alias("id"), "text"), ids, ["id"])
    if _repeats(docs, ids):
        known = known.groupBy("id").agg(F.min(F.struct("n", "regs", "keys")).alias("m")).select("id", "m.*")
        texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    known, texts = materialise(known), materialise(texts)
    pairs = materialise(likely(stars, known))
    links = materialise(verified(pairs, texts))
    labels = components(links)
    if (more := rest_links(shared, labels, known, texts)) is not None:
        if more.limit(1).count():
            release(labels)
            labels = components(links.unionByName(more), seed=100)
        release(more)
    names = labels.groupBy("root").agg(F.min("node").alias("component"))
    found = join_skewed(labels, names, "root").select(F.col("node").alias("id"), "component")
    by_class = materialise(classes.select("cls", "id").join(found, "id", "left").select("cls", F.coalesce("component", "id").alias("component")))
    component = F.coalesce("component", "doc_id")
    out = join_skewed(sketches.select("doc_id", "n", "cls"), by_class, "cls", "left", spread=["doc_id"])
    out = materialise(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    release(sketches, classes, rows, sizes, twice, shared, heads, stars, ids, known, texts, pairs, links, labels, by_class)
    return out


def _repeats(docs: DataFrame, ids: DataFrame) -> bool:
    """Whether an id of a class is that of several rows."""
    own = rows_of(docs.select(F.col("doc_id").alias("id")), ids, ["id"])
    return own.groupBy("id").count().where("count > 1").limit(1).count() > 0
