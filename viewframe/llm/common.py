"""What the operators of this subpackage share: word classes, shared scratch tables, sized joins."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word and a run of white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named a folder of this machine would do only
    if it were the only one, so that is refused on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    folders = {os.path.dirname(p) for p in df.inputFiles()}
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows that Spark hands to Python at a time; its own default is made for narrow rows, not for whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's default of 10,000 rows a batch; a value of the user's own stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH_ROWS))


def released() -> None:
    """Gives a Python worker's free memory back at the end of a task; it may wait long for the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


#: A side of a join is sent to every executor only if a count has shown that it is at most so large.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8_000_000
#: Beyond that, the rows of a key are dealt over so many tasks, and the other side is repeated as often.
SALTS = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df has at most so many rows and bytes, as measured; at most rows + 1 of its rows are looked at."""
    wide = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    row = df.limit(rows + 1).select(sum(wide, F.lit(0)).alias("size")).agg(F.count("*"), F.sum("size")).first()
    return row[0] <= rows and (row[1] or 0) <= size


def unsent(right: DataFrame) -> DataFrame:
    """right for a join that must not broadcast it. Spark itself goes by the bytes of files, where rows are packed, and before they are repeated."""
    return right.hint("merge")


def attach(left: DataFrame, right: DataFrame, on: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined to right, whose key is unique, null matching null. The key may be skewed in left. rows: most rows of a broadcast side.

    A right side that has been measured as small is broadcast. Otherwise each of its rows is
    repeated for SALTS salts, and left's rows carry a salt made of their own columns; it is never broadcast then.
    """
    key, = free(left, f"__{on}")
    right = right.withColumnRenamed(on, key)
    if how == "left_semi":
        right = right.select(key)
    if is_small(right, BROADCAST_ROWS if rows is None else rows):
        out = left.join(F.broadcast(right), left[on].eqNullSafe(right[key]), how)
        return out if how == "left_semi" else out.drop(key)
    hashed = [F.col(f"`{f.name}`") for f in left.schema if not isinstance(f.dataType, T.MapType)]
    salt, = free(left, "__salt")
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(SALTS)).cast("int"))
    many = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = salted.join(unsent(many), salted[on].eqNullSafe(many[key]) & (salted[salt] == many["__s"]), how).drop(salt)
    return out if how == "left_semi" else out.drop(key, "__s")
