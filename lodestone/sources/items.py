"""Reading and writing items (id, vector), and the files that hold them."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_csv(line: Column, kind: str = "float") -> Column:
    """struct(id, vector) of `id,f0,f1,...`; a field that is no number is an error."""
    parts = F.split(line, ",")
    number = lambda x, to: F.when(x.try_cast(to).isNotNull(), x.try_cast(to)).otherwise(F.raise_error(F.concat(F.lit("not a number: "), x)).cast(to))
    short = F.raise_error(F.concat(F.lit("not enough values: "), line))
    return F.struct(F.when(F.size(parts) >= 2, number(F.get(parts, F.lit(0)), "bigint")).otherwise(short.cast("bigint")).alias("id"), F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: number(x, kind)).alias("vector"))


def read_csv(spark: SparkSession, path: str | list[str], kind: str = "float") -> DataFrame:
    """Items of CSV files without a header; empty lines are skipped, ragged rows are left to the dimension check."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("value <> ''")
    return lines.select(parse_csv(F.col("value"), kind).alias("item"), "file").select("item.id", "item.vector", "file")


def read_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Items of JSON lines {"id": ..., "value": [...]}; names in any case, a missing id is 0, a missing value empty."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.from_json(F.regexp_replace(F.regexp_replace("value", r'(?i)"id"\s*:', '"id":'), r'(?i)"value"\s*:', '"value":'), "id bigint, value array<float>", {"mode": "FAILFAST"}).alias("j"))
    return raw.select(F.coalesce("j.id", F.lit(0)).alias("id"), F.coalesce("j.value", F.array().cast("array<float>")).alias("vector"), "file")


def read_parquet(spark: SparkSession, path: str | list[str], id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    paths = [path] if isinstance(path, str) else path
    df = spark.read.parquet(*paths)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("vector"), F.col("_metadata.file_path").alias("file"))


READERS = {"csv": read_csv, "json": read_json, "parquet": read_parquet}


def read_items(spark: SparkSession, path: str | list[str], file_format: str) -> DataFrame:
    if file_format not in READERS:
        raise ValueError(f"unknown format {file_format!r}; there are {', '.join(READERS)}")
    return READERS[file_format](spark, path)


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, nn) of a ground truth file `row_id,nn0,nn1,...`."""
    return read_csv(spark, path, "bigint").select(F.col("id").alias("row_id"), F.col("vector").alias("nn"))


def to_csv(item_id: Column, vector: Column) -> Column:
    return F.concat_ws(",", item_id.cast("string"), F.array_join(F.transform(vector, lambda x: x.cast("string")), ","))


def write_items(items: DataFrame, path: str, file_format: str) -> None:
    """Items as files of a format that read_items reads."""
    if file_format == "csv":
        items.select(to_csv(F.col("id"), F.col("vector"))).write.mode("overwrite").text(path)
    elif file_format == "json":
        items.select("id", F.col("vector").alias("value")).write.mode("overwrite").json(path)
    elif file_format == "parquet":
        items.select("id", "vector").write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown format {file_format!r}; there are {', '.join(READERS)}")


def is_wildcard(path: Column) -> Column:
    return path.rlike("[*?]")


def _matches(spark: SparkSession, path: str) -> list:
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(sc._jsc.hadoopConfiguration())
    found = fs.globStatus(place)
    return [(fs, s) for s in found] if found else []


def exists(spark: SparkSession, path: str) -> bool:
    """Does a path, or for a wildcard any, exist, in whatever file system Hadoop knows by its scheme."""
    return bool(_matches(spark, path))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The sorted paths that a wildcard matches, of a directory's entries, or of one file. An error if there are none."""
    found = _matches(spark, path)
    if not found:
        raise FileNotFoundError(path)
    if len(found) == 1 and found[0][1].isDirectory() and not any(c in path for c in "*?"):
        fs, status = found[0]
        return sorted(s.getPath().toString() for s in fs.listStatus(status.getPath()))
    return sorted(s.getPath().toString() for _, s in found)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def publish(spark: SparkSession, source: str, target: str, replace: bool = False) -> bool:
    """Move a finished file or folder to its name at once. False, and nothing moved, if the name is taken and stays."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    old, new = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    rename = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
    options = gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), int(replace))
    if replace:
        options[0] = next(x for x in rename if x.name() == "OVERWRITE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(fs.makeQualified(old), fs.makeQualified(new), options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def write_file(spark: SparkSession, path: str, content: str) -> bool:
    """Create a small file; False if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(place, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return True


def seconds_old(spark: SparkSession, path: str) -> float | None:
    """Seconds since a path was written; None if there is none."""
    found = _matches(spark, path)
    return max(0.0, time.time() - found[0][1].getModificationTime() / 1000) if found else None


# What an index accepts.


def right_size(items: DataFrame, size: int) -> DataFrame:
    return items.where(F.size("vector") == size)


def first_of_id(items: DataFrame, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """The first row of each id, in each partition, by an order that the rows carry."""
    keys = ", ".join([*(partition or []), "id"])
    return items.selectExpr("*", f"row_number() over (partition by {keys} order by {', '.join(order)}) as _n").where("_n = 1").drop("_n")


def accept(items: DataFrame, size: int, order: list[str], partition: list[str] | None = None) -> DataFrame:
    """Rows an index of this size takes in: right dimension, first of their id; others are skipped."""
    return first_of_id(right_size(items, size), order, partition)


def count_rejects(items: DataFrame, size: int, partition: list[str] | None = None) -> DataFrame:
    """One row: wrong_size, duplicate_id."""
    keys = [*(partition or []), "id"]
    good = right_size(items, size).groupBy(*keys).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_id"))
    return items.agg(F.count(F.when(F.size("vector") != size, 1)).alias("wrong_size")).crossJoin(F.broadcast(good))


def stats(items: DataFrame) -> DataFrame:
    """One row: len, size, byte_size."""
    return items.agg(F.count("*").alias("len"), F.coalesce(F.max(F.size("vector")), F.lit(0)).cast("bigint").alias("size")).select("len", "size", (4 * F.col("len") * F.col("size")).alias("byte_size"))
