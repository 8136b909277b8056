"""The operators against plain versions on small tables with awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

SPLIT = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(400))
TEXTS = [None, "", "  \n", "A b", "a B", "a b c d e f", LONG, LONG.upper(), LONG.replace("w399", "x"), "pre " + " ".join(f"w{i}" for i in range(40)) + " post", "é " * 300, "é " * 300, "it's <|endoftext|>  x\n\ny " * 20]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string, score long").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_exact(docs, none):
    from gleaner.llm.exact import exact_dedup

    for salts in (1, 32):
        got = {r["doc_id"]: r for r in exact_dedup(docs, salts).collect()}
        for i, t in enumerate(TEXTS):
            same = [j for j, x in enumerate(TEXTS) if low(x) == low(t)]
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))
            assert got[i]["text_sha256"] == hashlib.sha256(low(t).encode()).hexdigest()
    assert exact_dedup(none).count() == 0


def test_urls(spark):
    from gleaner.llm.queries import URL_RULES
    from gleaner.llm.urls import candidates, cascade, judge, lookup_by_join, parts
    from pyspark.sql import functions as F

    urls = [None, "x", "http://", "http://A.com", "http://A.com/x", "HTTP://www.EXAMPLE.com/en/1?q", "http://example.com/en/", "http://a.example.com/EN/", "http://b.net/es/1#f", "http://net/fr/", "ftp://com/?/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in judge(df, URL_RULES).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: ("com/", "allow"), 5: ("www.example.com/en/", "allow"), 6: ("example.com/en/", "block"), 7: ("com/", "allow"), 8: ("net/es/", "block"), 9: ("net/fr/", "block"), 10: ("com/", "allow")}
    host, path = parts(F.col("url"))
    split = df.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidates([1, 2, 3], [1, 4]))
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in lookup_by_join(split, URL_RULES).collect()} == got
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("pmod(hash(key), 7) = 0")
    found = cascade(listed, universe, 3000)
    assert len(found.levels) > 1
    assert universe.where(found.contains(F.col("key"))).exceptAll(listed).count() == 0 == listed.where(~found.contains(F.col("key"))).count()
    assert judge(df.limit(0), URL_RULES).count() == 0


def test_near(docs, none):
    from gleaner.llm.minhash import near_dedup

    sets = []
    for t in TEXTS:
        w = SPLIT.findall(low(t).encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup(docs).collect()}
    assert got == {i: (len(s), group[i], group[i] == i) for i, s in enumerate(sets)}
    assert near_dedup(none).count() == 0


def test_estimates_are_corrected():
    from gleaner.llm import minhash as M

    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = M.short(M.registers([x[:2000]])), M.short(M.registers([x[1000:]]))
    assert abs(M.estimate(a, b)[0][0] - 1 / 3) < 0.08


def _cover(symbols, length, counts):
    keep = [True] * len(symbols)
    for i in range(len(symbols) - length + 1):
        if counts[symbols[i : i + length]] > 1:
            keep[i : i + length] = [False] * length
    return keep


def test_repeats(docs, none):
    from gleaner.llm.repeats import substring_dedup, suffix_array_dedup, without_repeats

    words = [tuple(SPLIT.findall((t or "").encode())) for t in TEXTS]
    counts = Counter(w[i : i + 35] for w in words for i in range(len(w) - 34))
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(docs).collect()}
    for i, w in enumerate(words):
        keep = _cover(w, 35, counts)
        assert got[i] == (len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(x for x, k in zip(w, keep, strict=True) if k)).hexdigest()), i
    raw = [(t or "").encode() for t in TEXTS]
    counts = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_array_dedup(docs).collect()}
    for i, b in enumerate(raw):
        keep = _cover(b, 200, counts)
        spans = sum(not k and (j == 0 or keep[j - 1]) for j, k in enumerate(keep))
        assert got[i] == (len(b), len(b) - sum(keep), spans, hashlib.sha256(bytes(x for x, k in zip(b, keep, strict=True) if k)).hexdigest()), i
    kept = {r["doc_id"]: r["text"] for r in without_repeats(docs).collect()}
    assert kept[9] == "pre post" and kept[5] == TEXTS[5] and kept[0] is None
    assert substring_dedup(none).count() == suffix_array_dedup(none).count() == 0


def _line(size, seed):
    return "".join(np.random.default_rng(seed).choice(list("abcdefghij"), size))


def test_repeats_within_one_text_at_every_period(spark):
    from gleaner.llm.repeats import BYTES, WORDS, substring_dedup, suffix_array_dedup, without_repeats

    texts = [" ".join([" ".join(f"p{p}x{i}" for i in range(p))] * 5) for p in range(20, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(df, WORDS.length, WORDS.gram).collect()}
    assert got == {i: len(t.split()) for i, t in enumerate(texts)}
    assert {r["text"] for r in without_repeats(df).collect()} == {""}
    raw = [_line(p - 1, p) + "\n" for p in range(BYTES.length - BYTES.gram - 3, BYTES.length - BYTES.gram + 6)]
    df = spark.createDataFrame([(i, x * 4 + "#" + _line(300, 999 + i)) for i, x in enumerate(raw)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_array_dedup(df, BYTES.length, BYTES.gram).collect()} == {i: 4 * len(x) for i, x in enumerate(raw)}


def test_tokens_are_the_librarys():
    from gleaner.llm import tokens
    from tokenizers import Tokenizer

    odd = [t or "" for t in TEXTS] + [" a", "a ", "a\n b", "x  y", "É́ á", "a\x1c b", "\r\n q\r", "日本 語", "12 345 'll's"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e, t = tokens.Encoder(tokens.vocabulary(name)), Tokenizer.from_file(tokens.vocabulary(name))
        t.encode_special_tokens = True
        for _ in range(2):
            ids, at = e.encode(pa.array(odd), 2)
            for i, x in enumerate(odd):
                assert ids[at[i] : at[i + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 2], x
            e._shrink()


def test_token_files(docs, none):
    from gleaner.llm import tokenbin as B
    from tokenizers import Tokenizer
    from gleaner.llm.tokens import vocabulary

    t = Tokenizer.from_file(vocabulary(B.VOCABULARY))
    t.encode_special_tokens = True
    start = 0
    for r in sorted(B.read_ids(B.write_ids(docs, frame_bytes=500)).collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*t.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert B.read_ids(B.write_ids(none)).count() == 0
    g = np.random.default_rng(0)
    for _ in range(40):
        ids = g.integers(0, 2**63, g.integers(0, 900), dtype=np.uint64) * np.uint64(2) + np.uint64(1) >> g.integers(0, 64, 1).astype(np.uint64)
        assert (B.unpack_words(*B.pack_words(ids), len(ids)) == ids).all()


def test_queries_have_the_plain_librarys_ids(spark, tmp_path):
    import corpus_pipeline
    from gleaner.llm import packing as P, queries, tokenbin as B
    from gleaner.llm.tokens import Encoder, vocabulary
    from tokenizers import Tokenizer

    texts = [t or "" for t in TEXTS] + ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b\nc", "<|startoftext|> x", "<|EndOfText|>", "x\n<|endoftext|>\n<|endoftext|>", "<|endoftext| > y"]
    plain = {n: Tokenizer.from_file(vocabulary(n)) for n in (P.VOCABULARY, B.VOCABULARY)}
    ids = lambda n, i, end: np.array([*plain[n].encode(texts[i], add_special_tokens=False).ids, end], "<u4")
    for n in plain:
        got, at = Encoder(vocabulary(n), added=True).encode(pa.array(texts), 2)
        assert all((got[at[i] : at[i + 1]] == ids(n, i, 2)).all() for i in range(len(texts))) and at[-1] == len(got)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for rows in (queries.op5_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, df, "")):
        want = {(i, len(x := ids(P.VOCABULARY, i, P.END)), zlib.crc32(x)) for i in range(len(texts))}
        assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in rows.collect()} == want
    want, start = set(), 0
    for i in range(len(texts)):
        x = ids(B.VOCABULARY, i, B.END)
        want.add((i, start, len(x), zlib.crc32(x)))
        start += len(x)
    assert {tuple(r) for r in queries.op6_token_binary(spark, str(tmp_path)).collect()} == want


def test_packing(docs, none):
    from gleaner.llm import packing as P

    rows = P.best_fit_pack(docs, 16).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == 16 or r["start"] + r["length"] == max(x["start"] + x["length"] for x in rows if x["doc_id"] == r["doc_id"])
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 16
    assert P.best_fit_pack(none).count() == 0
    r = np.random.default_rng(1)
    for _ in range(60):
        c = int(r.integers(5, 50))
        h = {int(x): int(r.integers(1, 30)) for x in r.integers(1, c + 1, 12)}
        got = Counter()
        for p in P.plan(h, c):
            assert sum(p.lengths) <= c
            for x in p.lengths:
                got[x] += p.times
        assert got == h


def test_nearest(spark):
    from gleaner.llm.ann import nearest

    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8)).astype(np.float32)
    v[10] = v[20] = v[30]
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)] + [(300, None), (301, [0.0] * 8), (302, [1.0] * 7 + [None]), (303, [math.nan] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(x["query_id"], x["rank"]): (x["vec_id"], x["score"]) for x in nearest(df, df.where("vec_id % 20 = 0"), 20, 64).collect()}
    w = v.astype(np.float64)
    for q in range(0, 300, 20):
        s = sorted((-math.fsum(a * b for a, b in zip(w[q], w[i], strict=True)), i) for i in range(300) if i != q)
        assert [got[q, k + 1][0] for k in range(20)] == [i for _, i in s[:20]]
    assert len(got) == 15 * 20 and nearest(df.limit(0), df.limit(0)).count() == 0


def test_quality(spark):
    from gleaner.llm import quality as Q

    r = np.random.default_rng(0)
    text = lambda bad: " ".join(("XX" + "!!" if bad else "word") + str(x) for x in r.integers(0, 99, 60))
    rows = [(i, text(i % 5 == 0) if i else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(1, 600) if i % 2] + [(None, 1), (3, None), (9999, 1)], "doc_id long, quality int")
    out = [x for x in Q.classify(docs, labels, 200).collect()]
    held = [x for x in out if x["held_out"] and x["doc_id"]]
    assert len(out) == 600 and np.mean([x["predicted"] == (x["doc_id"] % 5 != 0) for x in held]) > 0.95
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in out)
    assert {x["score"] for x in Q.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_sampled_segmentations(spark):
    from gleaner.llm import segmentation as S

    seg = S.segmenter(S.MODEL)
    words = seg.split("▁the▁in")
    weight = Counter()
    for i in range(4000):
        found, threshold = seg.sample(words, 3, np.random.default_rng(i))
        assert len({tuple(x) for x, _ in found}) == 3
        for x, lp in found:
            weight[tuple(x)] += math.exp(lp) / -math.expm1(-math.exp(lp - threshold)) / 4000
    assert abs(sum(weight.values()) - 1) < 0.02
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "k int, text string")
    rows = S.sample_segmentations(df, ["k"], 2).collect()
    assert all(r["decoded"] for r in rows) and {r["k"] for r in rows} == set(range(len(TEXTS)))
    assert rows == S.sample_segmentations(df, ["k"], 2).collect()


def test_segmentations_do_not_depend_on_the_batch():
    from gleaner.llm import segmentation as S

    seg = S.segmenter(S.MODEL)
    texts = ["", "a", "the cat sat", " ", "\n\t", "é😀 x  y", "z" * 3000] + [f"word{i} in the house" for i in range(20)]
    surfaces, seeds = [seg.surface(t) for t in texts], np.arange(len(texts), dtype=np.uint64) * np.uint64(99991)

    def found(surfaces, seeds):
        words = S.Lattices(surfaces, seg)
        row, number, _, size, edges, _ = words.sample(seeds, 3)
        ids, at = words.ids(edges, size)
        return {(r, n): ids[a:b].tolist() for r, n, a, b in zip(row.tolist(), number.tolist(), at[:-1], at[1:], strict=True)}

    together = found(surfaces, seeds)
    for i, text in enumerate(texts):
        alone = found(surfaces[i : i + 1], seeds[i : i + 1])
        assert [together[i, n] for _, n in sorted(alone)] == [x for _, x in sorted(alone.items())]
        assert len({tuple(x) for x in alone.values()}) == len(alone) and all(seg.decode(x) == text for x in alone.values())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    frames = [i * 7 for i in range(60)]
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    texts = [" ".join(word() for _ in range(120)) for _ in frames]
    texts[1], texts[2] = texts[0], texts[0].replace(texts[0].split()[60], "zz", 1)
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(frames, texts, strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in frames], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    ids = {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 7, 14} & ids in ({7}, {14}) and ids <= set(frames)


def _plain_pipeline(rows):
    """exact, near and substring over (doc_id, text) in plain Python; (doc_id, text) of what is left."""
    best = {}
    for i, t in rows:
        key = low(t)
        if key not in best or (-1 if i is None else i, t or "") > (-1 if best[key][0] is None else best[key][0], best[key][1] or ""):
            best[key] = (i, t)
    digest = lambda t: hashlib.sha256(low(t).encode()).hexdigest()
    rows = sorted(best.values(), key=lambda r: (math.inf if r[0] is None else r[0], digest(r[1])))
    first = {}
    for k, (i, _) in enumerate(rows):
        first.setdefault(i, k)
    rows = [r for k, r in enumerate(rows) if r[0] is not None and first[r[0]] == k] + [r for k, r in enumerate(rows) if r[0] is None or first[r[0]] != k]
    sets = []
    for _, t in rows:
        w = SPLIT.findall(low(t).encode())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b)]
    group, before = list(range(len(rows))), None
    while before != group:
        before = list(group)
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    spans = [[(m.start(), m.group()) for m in SPLIT.finditer((t or "").encode())] for _, t in rows]
    words = [tuple(w for _, w in s) for s in spans]
    counts = Counter(w[i : i + 35] for w in words for i in range(len(w) - 34))
    out = []
    for (i, t), s, w in zip(rows, spans, words, strict=True):
        keep, raw = _cover(w, 35, counts), (t or "").encode()
        at = [x for x, _ in s] + [len(raw)]
        out.append((i, t if all(keep) else (raw[: at[0]] + b"".join(raw[at[k] : at[k + 1]] for k in range(len(w)) if keep[k])).decode()))
    return out


def test_pipeline_is_the_plain_version(spark, tmp_path, monkeypatch):
    import corpus_pipeline as C
    from gleaner.llm import packing as P
    from gleaner.llm.tokens import vocabulary
    from tokenizers import Tokenizer

    r = np.random.default_rng(5)
    fresh = lambda n: " ".join("".join(r.choice(list("abcdefgh"), 6)) for _ in range(n))
    shared, period = fresh(50), fresh(25)
    rows = [(i, fresh(120)) for i in range(40)]
    rows += [(40, rows[3][1].upper()), (None, rows[4][1]), (5, rows[5][1]), (5, rows[6][1]), (7, rows[7][1]), (None, None), (41, ""), (None, " x ")]
    rows += [(50 + i, fresh(30) + " " + shared + "  \n" + fresh(20)) for i in range(4)] + [(60, fresh(10) + " " + " ".join([period] * 3))]
    for i, k in ((70, 10), (None, 11), (12, 13), (71, 70)):
        base = next(t for j, t in rows if j == k).split()
        rows.append((i, " ".join([*base[:60], "zz", *base[61:]])))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, own in (("full", rows), ("empty", [])):
        d = str(tmp_path / name)
        spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in own], schema).repartition(3).write.parquet(d + "/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(40) if own], "doc_id long, quality int, toxic int").write.parquet(d + "/labels.parquet")
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    network = C.quality.train(docs, spark.read.parquet(str(tmp_path / "full" / "labels.parquet")))
    monkeypatch.setattr(C.quality, "train", lambda *_: network)
    accepted = [(x["doc_id"], x["text"]) for x in C.quality_stage(spark, docs, str(tmp_path / "full")).collect()]
    assert len(accepted) > 40
    plain, want = Tokenizer.from_file(vocabulary(P.VOCABULARY)), Counter()
    for i, t in _plain_pipeline(accepted):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, P.END], "<u4")
        want[i, 0, 0, len(ids), zlib.crc32(ids)] += 1
    got = C.run(spark, str(tmp_path / "full")).collect()
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in got) == want
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for s in map(sorted, by.values()):
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= P.CAPACITY
    assert C.run(spark, str(tmp_path / "empty")).count() == 0


def test_pipeline_drops_copies_by_row(spark):
    import corpus_pipeline as C

    text = [" ".join(f"t{i}x{j}" for j in range(100)) for i in range(9)]
    near = lambda i: text[i].replace(f"t{i}x50", "zz")
    rows = [(1, text[0]), (None, text[0].upper())]  # a copy without an id
    rows += [(2, text[1])] * 3 + [(None, text[2])] * 2  # rows that repeat
    rows += [(3, text[3]), (3, text[4]), (4, text[3])]  # one id, two texts, one of them a copy
    rows += [(5, text[5]), (None, near(5)), (None, text[6]), (None, near(6))]  # near copies without an id
    rows += [(6, text[7]), (7, text[8]), (7, near(7))]  # one id, two texts, one of them a near copy
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = C.exact_stage(spark, df, "")
    low_ = lambda df: sorted((r["doc_id"] or -1, low(r["text"])) for r in df.collect())
    assert low_(out) == sorted({(i or -1, t) for i, t in rows if t != text[0].upper()} - {(3, text[3])})
    out = C.near_stage(spark, out, "")
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(kept) == 9 and {(5, text[5]), (6, text[7]), (7, text[8]), (3, text[4]), (4, text[3])} <= set(kept)
    assert sorted(map(repr, kept)) == sorted(repr((r["doc_id"], r["text"])) for r in C.substring_stage(spark, out, "").collect())
    for stage in (C.exact_stage, C.near_stage):
        assert stage(spark, df.limit(0), "").columns == df.columns and stage(spark, df.limit(0), "").count() == 0


def test_queries_against_sql(spark):
    import duckdb
    from gleaner.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df, want = QUERIES[name](spark, sf), con.execute(sql)
        order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
        columns = [c[0] for c in want.description]
        own = sorted(range(len(columns)), key=lambda i: columns[i])
        assert sorted(map(repr, ([r[i] for i in order] for r in df.collect()))) == sorted(map(repr, ([r[i] for i in own] for r in want.fetchall())))


def test_hashes_tell_the_thue_morse_word_from_its_complement(spark):
    from gleaner.llm.repeats import substring_dedup
    from gleaner.llm.segmentation import sample_segmentations

    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([*(f"x{i}" for i in range(20)), w, *(f"y{i}" for i in range(15))]) for w in (word, other)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["n_removed"] for r in substring_dedup(df).collect()} == {0}
    both = spark.createDataFrame([(1, word + " " + other)], "k int, text string")
    assert all(r["decoded"] for r in sample_segmentations(both, ["k"], 2).collect())


def test_multikey_quicksort_and_subtrees():
    from gleaner.llm import repeats as R

    r = np.random.default_rng(0)
    for n in (0, 1, 5000, 30_000):
        a, b = (r.integers(0, 40, n).astype(np.uint64) for _ in range(2))
        order = R.multikey_quicksort([a, b])
        want = np.lexsort((b, a))
        assert sorted(order.tolist()) == list(range(n)) and (a[order] == a[want]).all() and (b[order] == b[want]).all()
    names = [r.integers(0, 3, 500).astype(np.uint64) for _ in range(3)]
    names = [names[0], names[0] * np.uint64(3) + names[1], (names[0] * np.uint64(3) + names[1]) * np.uint64(30) + names[2]]
    tree = R.Subtree.build(names)
    for d in range(3):
        assert len(set(tree.nodes(d).tolist())) == len(set(names[d].tolist()))
    times = Counter(names[2].tolist())
    assert tree.deep(np.ones(500, np.int64)).tolist() == [times[x] > 1 for x in names[2].tolist()]


def test_a_window_that_fills_several_buckets(spark, monkeypatch):
    from gleaner.llm import repeats as R

    monkeypatch.setattr(R, "BLOCK_BYTES", 300)
    shared = _line(220, 1)
    rows = [(i, shared + _line(90, 10 + i)) for i in range(40)] + [(100 + i, _line(400, 900 + i)) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for dedup, words in ((R.suffix_array_dedup, False),):
        got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in dedup(docs, 200, 64).collect()}
        assert {k: v for k, v in got.items() if k >= 100} == {100 + i: (0, 0) for i in range(5)}
        raw = [t for _, t in rows]
        counts = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
        for k, t in rows:
            keep = _cover(t, 200, counts)
            assert got[k][0] == len(t) - sum(keep)
    s = R.Splitters(np.array([3, 5, 5, 5, 9], np.uint64), np.array([1, 7, 7, 7, 2], np.uint64))

    class Two:
        unit = R.BYTES

        def leads(self, at):
            return np.array([5, 5, 5, 1, 9, 9], np.uint64)

        def names(self, at, depth):
            return np.array([7, 6, 8, 0, 2, 3], np.uint64)

    for block in range(6):
        assert s.deal(Two(), np.arange(6), block)[0].tolist() == [2 + block % 3, 1, 4, 0, 5, 5]


def test_pipeline_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline as C

    names = ["score", "predicted", "text to score", "removed words", "own digest x", "keep_id", "kept", "n", "salt", "digest", "norm"]
    text = lambda i: " ".join(f"t{i}x{j}" for j in range(60))
    rows = [(i, text(i // 2), "en", "s", 1, *range(len(names))) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.strip("`") for c in re.findall(r"(`[^`]+`|\w+) (?:long|string|int)", schema)], name
    assert docs.count() == 20 and {r["n_chars"] for r in docs.collect()} == {len(text(i)) for i in range(20)}
    assert C.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 20


def test_quality_of_few_or_no_rows(spark):
    from gleaner.llm import quality as Q

    docs = spark.createDataFrame([(0, "only one text")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert Q.classify(docs, labels).count() == 1 and Q.classify(docs.limit(0), labels).count() == 0
    assert Q.accepted(docs.limit(0), None).count() == 0


def _fewest(sizes, capacity):
    """The least number of sequences, over all subsets."""
    n = len(sizes)
    total = [sum(sizes[i] for i in range(n) if m >> i & 1) for m in range(1 << n)]
    best = [0] + [99] * ((1 << n) - 1)
    for m in range(1, 1 << n):
        first, rest = m & -m, m & ~(m & -m)
        s = rest
        while True:
            if total[s | first] <= capacity:
                best[m] = min(best[m], best[m & ~(s | first)] + 1)
            if not s:
                break
            s = (s - 1) & rest
    return best[-1]


def test_reduction_keeps_the_optimum():
    from gleaner.llm import packing as P

    r = np.random.default_rng(4)
    kinds = Counter()
    for _ in range(250):
        capacity = int(r.integers(10, 60))
        sizes = r.integers(1 if r.random() < 0.3 else capacity // 5 + 1, capacity + 1, 9).tolist()
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed = P.reduce_dominated(counts, capacity)
        kinds.update(len(p.lengths) for p in fixed)
        rest = np.repeat(np.arange(capacity + 1), counts).tolist()
        assert sum(p.times for p in fixed) + _fewest(rest, capacity) == _fewest(sizes, capacity), (sizes, capacity, fixed)
    assert set(kinds) == {1, 2, 3}
    assert sum(p.times for p in P.plan({72: 1, 71: 1, 20: 1, 9: 4}, 100)) <= 3


def test_nearest_takes_one_row_of_a_vec_id(spark):
    from gleaner.llm.ann import nearest

    r = np.random.default_rng(3)
    v = r.normal(size=(61, 1100))
    rows = [(i, [float(x) for x in v[i]]) for i in range(61)]
    df = spark.createDataFrame(rows + [(0, rows[0][1]), (7, [-99.0] * 1100), (50, [math.inf] + [0.0] * 1099)], "vec_id long, embedding array<double>").withColumnRenamed("vec_id", "vec_id")
    got = nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    for q in (0, 20, 40, 60):
        want = sorted((-math.fsum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in range(61) if i != q)[:20]
        assert [x["vec_id"] for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == [i for _, i in want]


def test_sampled_segmentations_against_all_of_them(spark):
    from itertools import combinations
    from gleaner.llm import segmentation as S

    seg = S.segmenter(S.MODEL)
    surface, n = "\u2581then", 5
    words, known = seg.split(surface), {seg.library.id_to_piece(i): i for i in range(seg.library.get_piece_size())}
    found = {}
    for k in range(n):
        for cuts in combinations(range(1, n), k):
            at = [0, *cuts, n]
            pieces = [surface[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            if all(p in known for p in pieces):
                ids = tuple(known[p] for p in pieces)
                found[ids] = math.exp(sum(seg.weights[i] for i in ids))
    total, times, draws = sum(found.values()), Counter(), 20_000
    for i in range(draws):
        (ids, lp), *_ = seg.sample(words, 2, np.random.default_rng(i))[0]
        times[tuple(ids)] += 1
        assert abs(lp - math.log(found[tuple(ids)] / total)) < 1e-9
    for ids, p in found.items():
        p /= total
        assert abs(times[ids] / draws - p) < 5 * math.sqrt(p * (1 - p) / draws) + 1e-4
    assert len(seg.sample(words, 999, np.random.default_rng(1))[0]) == len(found)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t != "  \n"], "k int, text string")
    back = S.decode_ids(S.sample_segmentations(df, ["k"], 2).select("k", "ids"))
    assert {(r["k"], r["text"]) for r in back.collect()} == {(r["k"], seg.library.decode(seg.library.encode(r["text"] or ""))) for r in df.collect()}
    assert S.sample_segmentations(df.limit(0), ["k"]).count() == 0 == S.decode_ids(back.limit(0).select("k", "k").toDF("k", "x").selectExpr("k", "array(x) AS ids")).count()


def test_long_hosts_and_repeated_pages(spark):
    from gleaner.llm.queries import URL_RULES
    from gleaner.llm.urls import judge

    host = "a." * 20_000 + "example.com"
    rows = [(1, "http://" + host + "/en/x"), (1, "http://" + host + "/en/x"), (2, "http://" + "b" * 100_000 + ".net/fr/"), (3, "http://.com/"), (4, "http://com./")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "page_id int, url string, host string, keys int").select("page_id", "url", "host", "keys")
    got = [(r["page_id"], r["rule"], r["verdict"]) for r in judge(df, URL_RULES).collect()]
    assert sorted(got) == [(1, "example.com/en/", "block")] * 2 + [(2, "net/fr/", "block"), (3, "com/", "allow"), (4, None, "allow")]


def test_the_query_segments_documents_and_turns(spark, tmp_path):
    from gleaner.llm import queries, segmentation as S

    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(1000, "the house in the wood " * 5000), (1001, "x" * 4000)]
    turns = [(1, 0, "how are you"), (1, 1, None), (2, 0, ""), (2, 1, "é😀 x  y"), (0, 0, TEXTS[-1])]
    docs, turns = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(turns, "conv_id long, turn long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    rows = queries.op2_sentencepiece_sampling(spark, str(tmp_path)).collect()
    for source, table, keys in (("documents", docs, ["doc_id"]), ("conversations", turns, ["conv_id", "turn"])):
        want = S.sample_segmentations(table, keys, 2).drop("ids")
        digits = lambda r: repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in want.columns])  # noqa: B023, E731
        assert sorted(digits(r) for r in rows if r["source"] == source) == sorted(map(digits, want.collect()))
        assert {tuple(r[c] for c in keys) for r in rows if r["source"] == source} == {tuple(r) for r in table.select(*keys).collect()}
    assert all(r["decoded"] for r in rows) and {r["source"] for r in rows} == {"documents", "conversations"}
    assert sum(r["doc_id"] == 1000 for r in rows) == 2


def test_frames_take_little_memory():
    import inspect
    import tracemalloc
    from gleaner.llm import tokenbin as B, tokens
    from gleaner.llm.arrays import pieces

    g = np.random.default_rng(0)
    words = [f"w{i:x}" for i in range(3000)]
    texts = [" ".join(words[i] for i in g.integers(0, 3000, 500)) for _ in range(4000)]
    batch, e, found = pa.record_batch([pa.array(texts)], names=["text"]), tokens.Encoder(tokens.vocabulary(B.VOCABULARY), added=True), []
    tracemalloc.start()
    for part in pieces(iter([batch]), "text", inspect.signature(B.write_ids).parameters["frame_bytes"].default):
        ids, at = e.encode(part.column("text"), B.END)
        lengths, back = B.read_frame(B.write_frame(np.arange(len(part)), np.diff(at), ids))[1:]
        found += np.split(back.astype(np.uint32), np.cumsum(lengths)[:-1])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(texts) and most - 4 * sum(map(len, found)) < 150e6, most
    tokens.encoder(B.VOCABULARY)
    tokens.forget()
    assert tokens.encoder.cache_info().currsize == 0


def test_best_of_each_row_and_beginnings_of_pieces():
    from gleaner.llm import segmentation as S

    g = np.random.default_rng(0)
    for _ in range(50):
        owner, value = np.sort(g.integers(0, 6, n := g.integers(0, 40))), g.integers(0, 9, n).astype(float)
        want = [i for o in set(owner.tolist()) for i in sorted(np.flatnonzero(owner == o).tolist(), key=lambda i: (-value[i], i))[:3]]
        assert S._best(owner, value, 3).tolist() == sorted(want)
    seg, text = S.segmenter(S.MODEL), "▁internationalisation▁über▁x9"
    words, plain = seg.split(text), {seg.library.id_to_piece(i): i for i in seg.key_ids[seg.key_ids >= 0].tolist()}
    want = Counter(plain[w[a:b]] for w in ("▁internationalisation", "▁über", "▁x9") for a in range(len(w)) for b in range(a + 1, len(w) + 1) if w[a:b] in plain)
    assert Counter(u for u in words.unit.tolist() if u in plain.values()) == want
