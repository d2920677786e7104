"""Joins by boxes against brute force, and the work they do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import boxes, search


def brute(items, q, k, metric):
    """(distance, id) of the k nearest, NaN last, ties by id."""
    with np.errstate(invalid="ignore"):
        d = boxes.measured(metric, np.array(q)[None], np.array([v for _, v in items]))
    return sorted(zip(np.isnan(d).tolist(), np.nan_to_num(d, nan=0.0).tolist(), (i for i, _ in items), strict=True))[:k]


def ranked(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((bool(np.isnan(r["distance"])), 0.0 if np.isnan(r["distance"]) else r["distance"], r["id"]))
    return got


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_boxed_join(spark, monkeypatch, metric):
    monkeypatch.setattr(boxes, "BOX_ROWS", 500)
    monkeypatch.setattr(search, "FEW_QUERIES", 20)
    rng = np.random.default_rng(1)
    x = [[float(a), float(b), float(c)] for a, b, c in zip(rng.integers(0, 40, 9000), rng.random(9000) * 50, rng.integers(0, 5, 9000))]
    rows = list(enumerate(x)) + [(9000 + i, x[i % 3]) for i in range(900)]  # three vectors 301 times each
    rows += [(20_000, [float("nan"), 1.0, 1.0]), (20_001, [float("inf"), 1.0, 1.0])]
    asked = [(i, v) for i, v in rows if i % 97 == 0] + [(1, x[1]), (50_001, [float("nan"), 0.0, 0.0]), (50_002, [-1000.0, 9e9, 3.0])]
    items = spark.createDataFrame([*rows, (30_000, None), (30_001, [1.0])], "id long, vector array<double>").repartition(5)
    df = search.knn_join(items, spark.createDataFrame(asked, "query_id long, vector array<double>"), 10, metric)
    assert "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().toString()
    assert ranked(df) == {i: brute(rows, v, 10, metric) for i, v in asked}
    few = items.where("id in (4, 7, 20000)")  # fewer items than k, one at no distance
    got = ranked(search.knn_join(few, spark.createDataFrame(asked[:30], "query_id long, vector array<double>"), 10, metric))
    assert got == {i: brute([r for r in rows if r[0] in (4, 7, 20_000)], v, 10, metric) for i, v in asked[:30]}
    none = search.knn_join(items.where("false"), spark.createDataFrame(asked, "query_id long, vector array<double>"), 10, metric)
    assert none.count() == 0


def test_work_does_not_grow_with_pairs(monkeypatch):
    """Four times the items and queries cost about four times the distances, not sixteen times."""
    counted = []
    plain = boxes.measured
    monkeypatch.setattr(boxes, "measured", lambda m, q, x: counted.append(np.broadcast(q, x).size) or plain(m, q, x))
    work = []
    for n in (20_000, 80_000):
        counted.clear()
        x = np.random.default_rng(0).random((n, 4))
        who, ids, d = boxes.Leaves(np.arange(n), x, 10, "euclidean").search(x[::100], np.full(len(x[::100]), np.inf))
        work.append(sum(counted))
        assert len(who) == 10 * n // 100 and (np.bincount(who) == 10).all()
    assert work[1] < 7 * work[0] and work[1] < 4 * 80_000 * 800 / 4


def test_copies_leave_k_of_each():
    ids, x = np.arange(1000)[::-1], np.array([[i % 2, 0.0] for i in range(1000)])
    kept = boxes.smallest(ids, x, 3)
    assert sorted(ids[kept].tolist()) == [0, 1, 2, 3, 4, 5]
    leaves = boxes.Leaves(ids, x, 3, "euclidean")
    assert sorted(leaves.search(np.array([[0.2, 0.0]]), np.array([np.inf]))[1].tolist()) == [1, 3, 5]


def test_every_row_of_a_join_is_dealt_once(spark, monkeypatch):
    """Both rounds read one exchange of the items."""
    monkeypatch.setattr(search, "FEW_QUERIES", 20)
    df = spark.range(3000).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
    out = search.knn_join(df, df.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), 3)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
