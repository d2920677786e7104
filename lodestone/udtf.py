"""knn(query, k) for SQL over a registered dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.kernels import register_sql_functions


def register_knn(spark: SparkSession, name: str, items: DataFrame) -> None:
    """A SQL table function `name(query ARRAY<DOUBLE>, k INT)` of (id, distance) over items, by Euclidean distance."""
    register_sql_functions(spark)
    items.selectExpr("id", "cast(vector as array<double>) as vector").createOrReplaceTempView(f"{name}_items")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(query ARRAY<DOUBLE>, k INT) RETURNS TABLE(id BIGINT, distance DOUBLE)
        RETURN SELECT id, distance FROM (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS r
        FROM (SELECT id, vec_l2(vector, {name}.query) AS distance FROM {name}_items)) WHERE r <= {name}.k""")
