"""Where intermediate tables live, so that a lost executor costs a re-read and not a wrong or failed job."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="sparkcube-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sparkcube/{label}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch, on its way to a worker and in the executor's own buffers.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches by bytes, whatever the texts' length: bounds the session's Arrow batches to BATCH_BYTES (64 MB by default), and leaves a
    smaller bound as it is. The setting stays, as plans read it when they run."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, is computed once and outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def posix_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder of the shared one as a path that workers can open and memory-map; it must be mounted."""
    path = fresh_path(spark, label)
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped models need a mounted shared folder in spark.checkpoint.dir")
    return path


def discard(spark: SparkSession) -> None:
    """Deletes all tables and arrays that the operators have written to the shared folder; results that still read them are lost."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparkcube")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot when it has more than one in HOT of all rows, so there are fewer than HOT hot keys, whatever the data.
HOT = 1000


def join_skewed(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of left with right, which has one narrow row per key and, in `rows`, how many rows left has of it (total: in all).

    Hot keys, fewer than HOT, are broadcast, so their rows stay where they are; the others are joined by shuffle. left is read twice.
    """
    hot = right.where(F.col(rows) > max(1, total) / HOT)
    names = [F.col(c).alias(f"_hot_{c}") for c in on]
    matched = left.join(F.broadcast(hot), on)
    same = [left[c] == F.col(f"_hot_{c}") for c in on]
    rest = left.join(F.broadcast(hot.select(*names)), same, "left_anti").join(right, on)
    return matched.unionByName(rest)


def join_salted(pairs: DataFrame, side: DataFrame, key: str, other: str, hot: DataFrame) -> DataFrame:
    """pairs with the columns of side (by its column of the name in `key`), where some keys have very many pairs: hot_keys(pairs, key).

    A hot key's pairs are spread by a hash of their `other`, and its rows of side are repeated for each part.
    """
    hot = F.broadcast(hot)
    left = pairs.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("_salts")), F.lit(0))).drop("_salts")
    right = side.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts") - 1, F.lit(0).cast("long"))))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def hot_keys(pairs: DataFrame, key: str, least: int = 5_000) -> DataFrame:
    """(key, _salts): the fewer than HOT keys with more than `least` pairs and one in HOT of all, and in how many parts to cut them."""
    limit = max(least, pairs.count() / HOT)
    return pairs.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / limit).alias("_salts")).where("_salts > 1")


#: Ids that are broadcast at most (about 32 bytes each); beyond, rows are matched with ids by shuffle.
BROADCAST_IDS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """ids to be broadcast if they are few; the count reads them, so they should be a written table."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
