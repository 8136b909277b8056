"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gleaner-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch
        return


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write a DataFrame as Parquet into the shared folder and read it back: cuts lineage and survives lost executors.

    The folder is scratch and is deleted when the driver's Python ends; ``release`` deletes it sooner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleaner-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    atexit.register(_forget, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once nothing reads it any more."""
    for df in tables:
        delete(df.sparkSession, df.scratch_path)


def lower_ascii(column):
    """Lower-case A-Z only, whatever the locale; native."""
    return F.translate(column, UPPER, UPPER.lower())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more rows than this, or than this share of all rows, is split: its rows go to several tasks.
HOT_ROWS, HOT_SHARE = 20_000, 50_000
#: Keys of at most this many bytes in all are broadcast to find their rows; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None, spread: list[str] | None = None) -> DataFrame:
    """left join right on key, where a key may hold any share of left's rows and at most one row of right's.

    Hot keys are counted first, in counted: a table with the same keys as left that is cheaper to read. There are at
    most HOT_SHARE of them whatever the input, which bounds what is broadcast: the keys and a number of salts each. A hot
    key's rows are dealt over its salts by the columns ``spread`` (default: all others), and its row of right is
    repeated for each salt, so no task gets more than about HOT_ROWS of them, or 1 / HOT_SHARE of all rows.
    """
    counted = left if counted is None else counted
    rows = counted.count()
    most = max(HOT_ROWS, rows // HOT_SHARE)
    if rows <= most:
        return left.join(right, key, how)
    hot = counted.groupBy(key).count().where((F.col("count") > most) & F.col(key).isNotNull()).collect()
    if not hot:
        return left.join(right, key, how)
    salts = left.sparkSession.createDataFrame([(r[key], -(-r["count"] // most)) for r in hot], f"`{key}` {left.schema[key].dataType.simpleString()}, `its salts` long")
    by = F.xxhash64(*(spread or [c for c in left.columns if c != key]))
    own = left.join(F.broadcast(salts), key, "left").withColumn("own salt", F.coalesce(F.pmod(by, F.col("its salts")), F.lit(0))).drop("its salts")
    copies = right.join(F.broadcast(salts), key, "left").withColumn("own salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("its salts", F.lit(1)) - 1))).drop("its salts")
    return own.join(copies, [key, "own salt"], how).drop("own salt")


def rows_of(table: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", width: int = 8) -> DataFrame:
    """The rows of a wide table that have one of the keys (or, left_anti, that have none).

    Keys of at most BROADCAST_BYTES are counted and broadcast, so that the wide rows stay where they are; more are
    joined by a shuffle. ``width``: bytes of a key.
    """
    return table.join(F.broadcast(keys) if keys.count() * width <= BROADCAST_BYTES else keys, on, how)
