"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separators of "words" in most contracts here.
WORD_SEPARATORS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data, by a path that only Spark's readers need to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own setting, or, on a local master only, a temporary one."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(configured)
    return configured


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, which the JVM deletes as it ends, or discard() before.

    Unlike a checkpointed plan, whose size estimate multiplies through every join of a loop, the table has its own
    size, so later joins are planned by what is really there.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, place = _folder(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of checkpoint() whose every reader has written its own result."""
    for t in tables:
        fs, place = _folder(t.sparkSession, t._table_path)
        fs.delete(place, True)


#: What is sent to every executor, hints and broadcast variables alike, holds so many bytes at most.
BROADCAST_BYTES = 64 << 20


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory, about: strings and arrays by what they hold, all else by its width."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint") + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.ArrayType | T.StructType | T.BinaryType):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("bigint"), lambda s, x: s + _value_bytes(x, kind.elementType)), F.lit(0)) + 24
        return F.greatest(F.size(value), F.lit(0)).cast("bigint") * 8 + 24
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8).cast("bigint"))
    return F.lit(8).cast("bigint")


def bytes_of(df: DataFrame) -> int:
    """Bytes that a materialised table takes in memory, with 24 a row for the row itself."""
    width = sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(24).cast("bigint"))
    return df.agg(F.sum(width)).first()[0] or 0


def broadcast_below(df: DataFrame, most: int | None = None) -> DataFrame:
    """Hint a broadcast of a materialised table only if it is measured to take `most` bytes at most."""
    return F.broadcast(df) if bytes_of(df) <= (BROADCAST_BYTES if most is None else most) else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), lambda w: w != F.lit(""))
