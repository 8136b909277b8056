"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import exact, minhash, packing, quality, repeats
from gleaner.llm.common import materialise, read, release, rows_of

OWN_ID = "own id"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled rows of all folds but the held-out one."""
    network = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.accepted(docs, network)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), one row, that with the largest doc_id; rows without one come last."""
    return exact.keep_one(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """docs and an id of its own for each (doc_id, text): the doc_id; beyond the largest one where that is null or taken."""
    odd = materialise(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("odd id")))
    if not odd.limit(1).count():
        return docs.withColumn(OWN_ID, F.col("doc_id"))
    digest = docs.select("*", F.sha2(exact.normalised("text"), 256).alias("own digest"))
    texts = digest.join(odd, F.col("doc_id").eqNullSafe(F.col("odd id")), "left_semi").select(F.col("doc_id").alias("odd id"), F.col("own digest").alias("odd digest")).distinct()
    texts = materialise(texts)
    first = texts.where("`odd id` IS NOT NULL").groupBy("odd id").agg(F.min("odd digest").alias("odd digest"))
    others = texts.join(first, ["odd id", "odd digest"], "left_anti").orderBy(F.col("odd id").asc_nulls_last(), "odd digest")
    most = docs.agg(F.coalesce(F.max("doc_id"), F.lit(-1))).first()[0]
    ids = materialise(others.withColumn(OWN_ID, F.monotonically_increasing_id() + F.lit(most + 1)))
    same = F.col("doc_id").eqNullSafe(F.col("odd id")) & (F.col("own digest") == F.col("odd digest"))
    return materialise(digest.join(ids, same, "left").select(*docs.columns, F.coalesce(OWN_ID, "doc_id").alias(OWN_ID)))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the document that gives its component the name. Texts are judged each, whatever ids they share."""
    rows = _numbered(docs)
    verdicts = minhash.near_dedup(rows.select(F.col(OWN_ID).alias("doc_id"), "text"))
    dropped = materialise(verdicts.where("NOT kept").select(F.col("doc_id").alias(OWN_ID)).distinct())
    release(verdicts)
    return rows_of(rows, dropped, [OWN_ID], "left_anti").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the windows of 35 words that repeat anywhere in them; n_chars follows the text."""
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    return packing.best_fit_pack(docs.select("doc_id", "text"), added=True)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("substring", substring_stage),
    ("packing", packing_stage),
]

#: No stage but the second can be said in SQL; tests/llm holds the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
