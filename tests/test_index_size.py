"""What indexes cost: one build a search, partitions of bounded size in tasks of their own, and no copies of planes."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators.indexes import CellTree, Forest, Graph, VectorIndex


def table(spark, n):
    return spark.range(n).select("id", F.array(*(F.rand(i) for i in range(3))).alias("vector"))


def test_a_search_builds_once(spark):
    df = table(spark, 300)
    found = VectorIndex.fit(df, Graph(4), 3).search(df.where("id < 2").select(F.col("id").alias("query_id"), "vector"), 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    assert sorted(found.columns) == ["distance", "id", "query_id", "rank", "scanned"]
    assert [(r["query_id"], r["rank"]) for r in found.orderBy("query_id", "rank").collect()] == [(q, r) for q in (0, 1) for r in (1, 2, 3)]


def test_walks_measure_as_the_metrics_do():
    from lodestone.operators.indexes import Near
    from lodestone.operators.search import distances

    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((50, 5)), rng.standard_normal(5)
    for metric in ("euclidean", "manhattan", "cosine", "cosine_distance"):
        to = Near(x, metric).ask(q)
        keys = to.keys(list(range(50)))
        want = distances(metric, q[None], x)[0]
        assert np.allclose(to.distances(keys.tolist()), want) and (np.argsort(keys) == np.argsort(want)).all()


def test_partitions_are_bounded_and_apart(spark):
    rows = VectorIndex.fit(table(spark, 25_000), CellTree(4, 1000), 3).rows
    at = rows.select("n", F.spark_partition_id().alias("task")).collect()
    assert sum(r["n"] for r in at) == 25_000 and max(r["n"] for r in at) < 12_000
    assert len({r["task"] for r in at}) == len(at) == 3


def test_a_forest_keeps_no_planes():
    x = np.random.default_rng(0).standard_normal((2000, 64))
    forest = Forest(5, 32)
    s = forest.build(x, "euclidean", np.random.default_rng(0))
    assert sum(v.nbytes for v in s.values()) < 3 * 4 * 5 * 2000
    s["_x"] = x.astype("f4").astype(float)
    assert all(i in forest.candidates(s, s["_x"][i], 3) for i in range(0, 2000, 100))
