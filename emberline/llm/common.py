"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key with one part in so many of all rows is hot.
HOT_SHARE = 1000
#: Bits of the filter of ``split_by_keys``, in rows of 32768 bits.
FILTER_BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session in one process may have one of our own instead."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_by_key(many: DataFrame, one: DataFrame, key: str, rows: str) -> DataFrame:
    """The inner join of ``many`` with ``one``, which has a row for each key and in ``rows`` how many of ``many`` have it.

    Keys with a ``HOT_SHARE``-th of all rows or more, of which there are at most ``HOT_SHARE``, are broadcast, so that
    no key's rows meet in one task; the others meet in a shuffle.
    """
    total = one.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(one.where(F.col(rows) * HOT_SHARE >= total))
    cold = one.where(F.col(rows) * HOT_SHARE < total)
    here = many.join(hot, key)
    return here.unionByName(many.join(hot.select(key), key, "left_anti").join(cold, key)).drop(rows)


def split_by_keys(df: DataFrame, keys: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """Two parts of ``df``: rows whose ``key``, a hash, may be among ``keys`` (one column of hashes), and rows whose key surely isn't.

    A bit stands for all hashes that end alike, so the first part holds every row whose key is there and a few others.
    The bits are ``FILTER_BITS`` at most, 8 MB, whatever the input, and are broadcast; beyond that many keys the first
    part only grows. It spares the shuffle of what a join with ``keys`` would leave out.
    """
    bucket, bits = fresh(df, "filter_bucket", "filter_bits")
    place = key.bitwiseAND(F.lit(FILTER_BITS - 1))
    at = keys.toDF("k").select(F.col("k").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("p"))
    at = at.select(F.shiftright("p", 15).alias(bucket), F.col("p").bitwiseAND(F.lit(32767)).alias("p")).repartition(bucket)
    known = F.broadcast(at.groupBy(bucket).agg(F.bitmap_construct_agg("p").alias(bits)))
    within = place.bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring(bits, (F.floor(within / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, within.bitwiseAND(F.lit(7)).cast("int")) == 1, F.lit(False))
    looked = df.withColumn(bucket, F.shiftright(place, 15)).join(known, bucket, "left")
    return looked.where(there).select(*df.columns), looked.where(~there).select(*df.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def held_out(doc_id: str | Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id's text, modulo ``folds``, is ``fold``; a null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % folds == fold, F.lit(False))


def hash_unit(*cols: str | Column) -> Column:
    """A number in [0, 1) drawn from the columns' values, the same on every run."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / float(1 << 53)
