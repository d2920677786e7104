"""Vector and scalar kernels as Column expressions; all arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def same_size(a: Column, b: Column, value: Column, kind: str = "double") -> Column:
    """value, or an error where the sizes differ; zip_with alone would pad with nulls."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vector sizes do not match")).cast(kind))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return same_size(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def length(a: Column) -> Column:
    return F.sqrt(total(F.transform(doubles(a), lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    return same_size(a, b, F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))))


def manhattan(a: Column, b: Column) -> Column:
    return same_size(a, b, total(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, which the metric of this name ranks ascending; NaN beside a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), length(a) * length(b)), F.lit(float("nan")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def unrolled(metric: str, dim: int) -> Callable[[Column, Column], Column]:
    """The metric over a known dimension as one expression, which code generation compiles; higher-order functions are not."""

    def parts(v: Column) -> list[Column]:
        return [F.get(v, F.lit(i)).cast("double") for i in range(dim)]

    def add(xs: list[Column]) -> Column:
        return reduce(lambda s, x: s + x, xs, F.lit(0.0))

    def distance(a: Column, b: Column) -> Column:
        x, y = parts(a), parts(b)
        if metric == "euclidean":
            return F.sqrt(add([(p - q) * (p - q) for p, q in zip(x, y, strict=True)]))
        if metric == "manhattan":
            return add([F.abs(p - q) for p, q in zip(x, y, strict=True)])
        norm = F.sqrt(add([p * p for p in x])) * F.sqrt(add([q * q for q in y]))
        similar = F.coalesce(F.try_divide(add([p * q for p, q in zip(x, y, strict=True)]), norm), F.lit(float("nan")))
        return similar if metric == "cosine" else 1 - similar

    return distance


SPACES: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "manhattan": manhattan, "cosine": cosine, "cosine_distance": cosine_distance}


def space(name: str) -> Callable[[Column, Column], Column]:
    if name not in SPACES:
        raise ValueError(f"unknown space {name!r}; there are {', '.join(SPACES)}")
    return SPACES[name]


def register_space(name: str, distance: Callable[[Column, Column], Column]) -> None:
    SPACES[name] = distance


def vector_op(op: str, a: Column, b: Column) -> Column:
    """Element-wise add, subtract, multiply or divide; a division by zero gives null."""
    fs = {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": lambda x, y: F.try_divide(x, y)}
    return same_size(a, b, F.zip_with(doubles(a), doubles(b), fs[op]), "array<double>")


def scalar_op(op: str, a: Column, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    fs = {"add": lambda x: x + s, "subtract": lambda x: x - s, "multiply": lambda x: x * s, "divide": lambda x: F.try_divide(x, s)}
    return F.transform(doubles(a), fs[op])


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), n)


def ones(n: int) -> Column:
    return F.array_repeat(F.lit(1.0).cast("float"), n)


def sort_vector(a: Column) -> Column:
    return F.array_sort(a)


def square(x: Column) -> Column:
    return x * x


def trunc(x: Column) -> Column:
    return x.cast("bigint")


def floor(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def equidistant_plane(a: Column, b: Column) -> Column:
    """struct(normal, d): b - a, and its product with the middle of both."""
    normal = vector_op("subtract", b, a)
    middle = F.zip_with(doubles(a), doubles(b), lambda x, y: (x + y) / 2)
    return F.struct(normal.alias("normal"), total(F.zip_with(normal, middle, lambda x, y: x * y)).alias("d"))


def point_plane_distance(x: Column, normal: Column, d: Column) -> Column:
    """Signed distance; the plane without direction is at distance 0 from all."""
    return (dot(x, normal) - d) / (length(normal) + F.lit(1e-12))


def push_both(distance: Column, norm: Column) -> Column:
    """Is a query so near a plane that both sides are searched; never for norms up to 1."""
    return F.coalesce(F.abs(distance) <= F.ln(norm) / 10, F.lit(False))


def near_cell(distance: Column, nearest: Column) -> Column:
    """Is a cell less than a tenth farther than the nearest one; never if that is at distance 0."""
    return F.coalesce(F.try_divide(distance - nearest, nearest) < 0.1, F.lit(False))


def big_endian_floats(data: Column) -> Column:
    """Floats of a binary column of 4-byte big-endian numbers; Spark has no such function, so an Arrow UDF reads them."""
    @F.pandas_udf("array<float>")
    def read(s: pd.Series) -> pd.Series:
        import numpy as np

        if s.isna().any() or s.str.len().nunique() != 1:  # rows of one length are read at once
            return s.map(lambda b: None if b is None else np.frombuffer(b, ">f4").astype("f4"))
        return pd.Series(list(np.frombuffer(b"".join(s), ">f4").astype("f4").reshape(len(s), -1)), index=s.index)

    return read(data)


# Random numbers that depend on a seed and a row's own key alone, so no plan or retry changes them.


def hash32(tag: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}:"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def uniform(tag: str, key: Column) -> Column:
    return hash32(tag, key) / F.lit(4294967296.0)


def exponential(tag: str, key: Column, scale: float = 1.0) -> Column:
    return -F.ln((hash32(tag, key) + 1) / F.lit(4294967296.0)) * scale


def normal(tag: str, key: Column, mean: float = 0.0, deviation: float = 1.0) -> Column:
    radius = F.sqrt(2 * exponential(f"{tag}/r", key))
    return mean + deviation * radius * F.cos(2 * F.pi() * uniform(f"{tag}/a", key))


def uniform_vector(tag: str, key: Column, n: int) -> Column:
    return F.array(*(uniform(f"{tag}/{i}", key) for i in range(n)))


def normal_vector(tag: str, key: Column, n: int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    return F.array(*(normal(f"{tag}/{i}", key, mean, deviation) for i in range(n)))


def graph_level(tag: str, key: Column, multiplier: float) -> Column:
    return F.floor(exponential(tag, key) * multiplier).cast("int")


def split_items(text: Column) -> Column:
    """Comma-separated items, trimmed; those empty before trimming are dropped."""
    return F.transform(F.filter(F.split(text, ","), lambda x: x != F.lit("")), lambda x: F.trim(x))


def _guarded(value: str) -> str:
    return f"CASE WHEN size(a) = size(b) THEN {value} ELSE cast(raise_error('vector sizes do not match') AS DOUBLE) END"


SQL_FUNCTIONS = {
    "vec_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _guarded("aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_length(a ARRAY<DOUBLE>) RETURNS DOUBLE": "sqrt(aggregate(transform(a, x -> x * x), 0D, (s, x) -> s + x))",
    "vec_l2(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _guarded("sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "vec_l1(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": _guarded("aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"),
    "vec_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "coalesce(try_divide(vec_dot(a, b), vec_length(a) * vec_length(b)), double('NaN'))",
    "vec_plane_dist(x ARRAY<DOUBLE>, n ARRAY<DOUBLE>, d DOUBLE) RETURNS DOUBLE": "(vec_dot(x, n) - d) / (vec_length(n) + 1e-12D)",
}


def register_sql_functions(spark: SparkSession) -> None:
    """vec_dot, vec_length, vec_l2, vec_l1, vec_cosine and vec_plane_dist for SQL; Catalyst inlines them."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
