"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact, minhash, packing, quality, repeats, segmentation, tokenbin, urls
from .common import read

#: Chunks of text that a worker of op5 and op6 keeps: some 200 MB.
CHUNKS = 1_000_000

#: Fixed values of the query op1: (host, path, verdict).
URL_RULES = [
    urls.UrlRule("com", "/", "allow"),
    urls.UrlRule("example.com", "/en/", "block"),
    urls.UrlRule("www.example.com", "/en/", "allow"),
    urls.UrlRule("net", "/es/", "block"),
    urls.UrlRule("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document (doc_id) and of every turn of the conversations (conv_id, turn)."""
    docs = segmentation.sample_segmentations(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], k=2)
    turns = segmentation.sample_segmentations(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], k=2)
    both = docs.withColumn("source", F.lit("documents")).unionByName(turns.withColumn("source", F.lit("conversations")), allowMissingColumns=True)
    names = ["source", "doc_id", "conv_id", "turn"]
    return both.select(*names, *[c for c in docs.columns if c not in (*names, "ids")])


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), repeats.WORDS.length, repeats.WORDS.gram)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read(spark, sf_dir, "documents").select("doc_id", "text"), added=True, most=CHUNKS)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.read_ids(tokenbin.write_ids(read(spark, sf_dir, "documents").select("doc_id", "text"), added=True, most=CHUNKS))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.suffix_array_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"), repeats.BYTES.length, repeats.BYTES.gram)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_sentencepiece_sampling, op3_minhash_near_dedup, op4_substring_dedup, op5_best_fit_packing, op6_token_binary, op7_suffix_array_dedup, op8_nearest, op9_quality_classifier, op10_exact_dedup)}

ORACLE_SQL = {
    "op1_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(h, s, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS v
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id
""",
    "op8_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
}
