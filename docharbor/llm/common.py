"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch. Texts can be long, so batches are kept short.
TEXT_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all tasks run in this machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docharbor-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Keep Arrow batches of texts short, so that a Python worker's memory is bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Written:
    """A DataFrame cut from its lineage: a Parquet table in the shared folder, which outlives lost executors."""

    def __init__(self, df: DataFrame, tag: str, **options):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(self.path, **options)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    return Written(df, tag).df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(key, n: int):
    """crc32 of an id as text, modulo n: the folds of the held-out tests."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))


#: Shares of a group that are ranked apart before the group is.
SALTS = 16


def first_of_groups(rows: DataFrame, group: str, n: int, *order: str) -> DataFrame:
    """The first n rows of each group by order, all if there are fewer. A group is ranked in SALTS shares, then over what these leave."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    for part in ([group, "_salt"], [group]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        salted = salted.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    return salted.drop("_salt")


def smallest_hashes(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Of rows (group, h, more) exactly the n of each group with the smallest hashes h as unsigned numbers, all if there are fewer; which of equal hashes is open.

    The hashes of a group are counted in 4,096 ranges of their first bits; only rows up to the range that holds the n-th are dealt by group
    and ranked. So a group's size doesn't matter; equal rows, which share a range, are cut to n by each task that reads them.
    """
    rows = rows.withColumn("_range", F.shiftrightunsigned("h", 52))
    sizes = rows.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy("_range"))
    most = sizes.withColumn("_upto", upto).groupBy(group).agg(F.coalesce(F.min(F.when(F.col("_upto") >= n, F.col("_range"))), F.lit(4095)).alias("_most"))
    most = Written(most, "ranges").df  # a row a group: sent to all tasks if it is small
    near = rows.join(most, group).where(F.col("_range") <= F.col("_most")).drop("_most")
    return first_of_groups(near, group, n, "_range", "h").drop("_range")


def release() -> None:
    """Gives memory that is free inside this process back to the system. A worker calls it at the end of a task, as it may wait long for the next."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back
        pass
