"""Exact deduplication by skew-safe combining, in DataFrame operations only.

1. Locally: the partial aggregate over (digest, salt, full text) leaves one row per text and map task.
2. Salted: those rows meet by (digest, salt, full text). The salt is a hash of the document's id, so that
   a group of copies, however large, is spread over ``salts`` tasks.
3. Globally: the winners of the salted groups, at most ``salts`` rows per text, are combined by (digest, full text).

Every stage groups by the whole text beside its digest, so two texts with the same digest are never merged.
What is sent back to the documents is small: (digest, salt) -> (keep_id, group_size).

Defined results: a null text counts as empty; all empty texts are one group. Rows that repeat both doc_id and
text are one document and all carry the same verdict. A null doc_id never wins while its group has another id.
Further columns of the input are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, lower_ascii, materialise, release

#: A third of the rows in one group must leave each salt's share small: one salt more for so many documents.
DOCUMENTS_PER_SALT = 200_000
LEAST_SALTS = 32
#: The columns that carry verdicts to rows; no input has columns of such names.
ROW_ID, DIGEST, OWN_DIGEST = "verdict on id", "verdict on digest", "own digest"
#: Bytes of a row's key: id and digest.
KEY_BYTES = 48


def salts_for(rows: int) -> int:
    return max(LEAST_SALTS, rows // DOCUMENTS_PER_SALT)


def normalised(text: str | F.Column):
    return lower_ascii(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def winners(docs: DataFrame, salts: int) -> DataFrame:
    """One row for each distinct normalised text: digest, keep_id, group_size, salts (where its copies are)."""
    local = docs.select("doc_id", normalised("text").alias("norm")).select(
        "doc_id", "norm", F.sha2(F.col("norm"), 256).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt")
    )
    salted = local.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("winner"), F.count("*").alias("n"))
    return salted.groupBy("digest", "norm").agg(
        F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )


def exact_dedup(docs: DataFrame, salts: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast(T.LongType()), "text")
    salts = salts or salts_for(docs.count())
    groups = materialise(
        winners(docs, salts)
        .where("group_size > 1")
        .select("digest", "keep_id", "group_size", "salts", F.xxhash64("norm", F.length("norm")).alias("check"))
    )
    # More than one text under a digest (never seen with SHA-256): such documents are told apart by a second hash and their length.
    collided = groups.groupBy("digest").count().where("count > 1").count() > 0
    keys = ["digest", "salt"] + (["check"] if collided else [])
    found = groups.select(F.explode("salts").alias("salt"), *[k for k in keys if k != "salt"], "keep_id", "group_size")
    own = docs.select("doc_id", normalised("text").alias("norm")).select(
        "doc_id",
        F.sha2(F.col("norm"), 256).alias("digest"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
        *([F.xxhash64("norm", F.length("norm")).alias("check")] if collided else []),
    )
    return own.join(found, keys, "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with all its columns, one row for each normalised text: that of the largest doc_id.

    Verdicts hold for (doc_id, digest), so neither rows without an id nor several texts of one id are mixed up. Rows
    that still have a text in common have the same id or all none; the largest by all columns stays.
    """
    columns = docs.columns
    judged = exact_dedup(docs).where("group_size > 1")
    verdicts = materialise(judged.select(F.col("doc_id").alias(ROW_ID), F.unhex("text_sha256").alias(DIGEST), "kept"))
    gone = materialise(verdicts.where("NOT kept").select(ROW_ID, DIGEST).distinct())
    own = docs.select("*", F.unhex(F.sha2(normalised("text"), 256)).alias(OWN_DIGEST))
    same = F.col("doc_id").cast(T.LongType()).eqNullSafe(F.col(ROW_ID)) & (F.col(OWN_DIGEST) == F.col(DIGEST))
    # So long as the keys are few, the texts stay where they are; else they move once more.
    few = gone.count() * KEY_BYTES <= BROADCAST_BYTES
    rest = own.join(F.broadcast(gone) if few else gone, same, "left_anti")
    clean = not verdicts.where("kept").groupBy(DIGEST).count().where("count > 1").limit(1).count()
    release(verdicts)
    if clean:
        return rest.select(*columns)
    check = F.xxhash64(normalised("text"), F.length(normalised("text")))  # as above, for texts with the same digest
    one = rest.groupBy(OWN_DIGEST, check).agg(F.max(F.struct(*columns)).alias("row"))
    return one.select("row.*")
