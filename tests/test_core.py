"""Golden values of kernels and structures, invariants of indexes, and every query against its SQL."""

import glob
import json
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lodestone import queries as core
from lodestone.functions import collections as sets
from lodestone.functions import kernels as K
from lodestone.functions.murmur import murmur3_32
from lodestone.operators import search, steps
from lodestone.operators.indexes import CellTree, Forest, Graph, VectorIndex
from lodestone.plans import catalog, placement
from lodestone.sources import items as source
from lodestone.streaming.search import search_stream
from lodestone.udtf import register_knn


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def vec(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_distances(spark):
    a, z, b = vec(1, 2, 2), vec(0, 0, 0), vec(1, 2, 3)
    got = one(spark, K.euclidean(a, z), K.euclidean(b, b), K.manhattan(b, z), K.manhattan(b, b), K.cosine(vec(1, 1), vec(1, 1)), K.cosine(vec(0, 1), vec(1, 0)), K.cosine(z, a), K.cosine_distance(vec(1, 0), vec(1, 0)))
    assert got[:4] == (3, 0, 6, 0) and got[4] == pytest.approx(1) and got[5] == pytest.approx(0) and math.isnan(got[6]) and got[7] == pytest.approx(0)
    with pytest.raises(Exception, match="sizes do not match"):
        one(spark, K.euclidean(a, vec(1)))
    with pytest.raises(ValueError):
        K.space("none")


def test_vectors(spark):
    a, b = vec(1, 2, 3, 4), vec(5, 6, 7, 8)
    got = one(spark, K.dot(vec(1, 2, 3), vec(4, 5, 6)), K.length(vec(1, 1, 1, 1)), *(K.vector_op(o, a, b) for o in ("add", "subtract", "multiply", "divide")), *(K.scalar_op(o, a, 10) for o in ("add", "subtract", "multiply", "divide")), K.sort_vector(vec(3, 1, 2)), K.zeros(2), K.ones(2))
    assert got[:6] == (32, 2, [6, 8, 10, 12], [-4] * 4, [5, 12, 21, 32], [1 / 5, 2 / 6, 3 / 7, 4 / 8])
    assert got[6:10] == ([11, 12, 13, 14], [-9, -8, -7, -6], [10, 20, 30, 40], [0.1, 0.2, 0.3, 0.4]) and got[10:] == ([1, 2, 3], [0, 0], [1, 1])
    p = one(spark, K.equidistant_plane(vec(1, 2, 3), vec(0, 1, 2)))[0]
    assert p["normal"] == [-1, -1, -1] and p["d"] == -4.5
    assert one(spark, K.point_plane_distance(vec(1, 1), vec(0, 0), F.lit(0.0)), K.trunc(F.lit(2.9)), K.trunc(F.lit(-2.9)), K.floor(F.lit(-2.1)))[:] == (0, 2, -2, -3)
    assert one(spark, K.near_cell(F.lit(0.5), F.lit(0.0)), K.near_cell(F.lit(1.05), F.lit(1.0)), K.push_both(F.lit(0.0), F.lit(0.0)), K.push_both(F.lit(0.1), F.lit(9.0))) == (False, True, False, True)
    import struct

    assert one(spark, K.big_endian_floats(F.lit(bytearray(struct.pack(">3f", 1, 2.5, -3)))))[0] == [1, 2.5, -3]
    assert one(spark, K.split_items(F.lit("a, b,,c")))[:] == (["a", "b", "c"],)


def test_random_columns(spark):
    df = spark.range(4000).select(K.uniform("t", F.col("id")).alias("u"), K.exponential("t", F.col("id"), 2.0).alias("e"), K.normal("t", F.col("id"), 1, 3).alias("n"), K.normal_vector("v", F.col("id"), 3).alias("v"), K.uniform_vector("v", F.col("id"), 2).alias("w"))
    m = df.agg(F.avg("u"), F.avg("e"), F.avg("n"), F.stddev("n"), F.min("u"), F.max("u")).first()
    assert abs(m[0] - 0.5) < 0.02 and abs(m[1] - 2) < 0.15 and abs(m[2] - 1) < 0.2 and abs(m[3] - 3) < 0.15 and 0 <= m[4] and m[5] < 1
    assert df.repartition(7).orderBy("u").collect() == df.orderBy("u").collect()


def test_collections(spark):
    a, b = (F.array(*map(F.lit, x)) for x in (["foo", "bar", "baz"], ["bar", "baz", "bag"]))
    got = one(spark, sets.difference(a, b), sets.union(a, b), sets.equal(a, F.reverse(a)), sets.equal(a, b), sets.render(a), sets.pick(F.array().cast("array<string>")))
    assert got == (["foo"], ["foo", "bar", "baz", "bag"], True, False, "{foo, bar, baz}", None)
    rows = [(3, "foo"), (1, "bar"), (2, "bag")]
    for largest, order in ((False, ["bar", "bag", "foo"]), (True, ["foo", "bag", "bar"])):
        q = sets.PriorityQueue(largest)
        for p, v in rows:
            q.push(p, v)
        assert q.values() == order and q.peek() == order[0] and list(q.reversed().drain()) == order[::-1] and list(q.drain()) == order and not len(q)
    s = sets.Stack()
    s.push(1), s.push(2)
    assert (s.pop(), s.pop()) == (2, 1)
    with pytest.raises(IndexError):
        s.pop()


def test_rendezvous(spark):
    assert murmur3_32(b"") == 0 and murmur3_32(b"hello") == 0x248BFA47
    nodes = spark.createDataFrame([("aaa", 1.0), ("bbb", 1.0), ("ccc", 1.0)], "uuid string, weight double")
    keys = spark.createDataFrame([("foo",), ("ccc",)], "key string")
    got = {(r["key"], r["rank"]): r["uuid"] for r in placement.owners(keys, nodes, 2).collect()}
    assert got["foo", 1] == "ccc" and {got["ccc", 1], got["ccc", 2]} == {"aaa", "ccc"}
    light, heavy = (placement.scores(keys, nodes.withColumn("weight", F.lit(w))).orderBy("key", "uuid").collect() for w in (1.0, 10.0))
    assert all(a["score"] < b["score"] for a, b in zip(light, heavy, strict=True))


def test_sources(spark, tmp_path):
    items = spark.createDataFrame([(1, [0.5, 1.5]), (2, [float("inf"), -2.0])], "id long, vector array<float>")
    for kind in ("csv", "json", "parquet"):
        source.write_items(items, f"{tmp_path}/{kind}", kind)
        assert sorted((r["id"], r["vector"]) for r in source.read_items(spark, f"{tmp_path}/{kind}", kind).collect()) == [(1, [0.5, 1.5]), (2, [float("inf"), -2.0])]
    (tmp_path / "a.csv").write_text("1,2,NaN\n\n2,3,4\n")
    assert source.read_csv(spark, str(tmp_path / "a.csv")).count() == 2
    (tmp_path / "j.json").write_text('{"ID": 3, "Value": [1]}\n{"value": []}\n')
    assert sorted((r["id"], r["vector"]) for r in source.read_json(spark, str(tmp_path / "j.json")).collect()) == [(0, []), (3, [1.0])]
    for bad in ("1\n", "x,1\n", "1,y\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(Exception, match="not"):
            source.read_csv(spark, str(tmp_path / "b.csv")).collect()
    with pytest.raises(ValueError):
        source.read_items(spark, "x", "avro")
    assert source.exists(spark, f"{tmp_path}/*.csv") and not source.exists(spark, f"{tmp_path}/none*")
    assert [os.path.basename(f) for f in source.list_files(spark, f"{tmp_path}/?.csv")] == ["a.csv", "b.csv"] and len(source.list_files(spark, str(tmp_path))) == 6
    with pytest.raises(FileNotFoundError):
        source.list_files(spark, f"{tmp_path}/none")
    (tmp_path / "n.csv").write_text("0,5,6\n")
    assert source.read_neighbours(spark, str(tmp_path / "n.csv")).first()["nn"] == [5, 6]


def brute(items, q, k):
    d = sorted((math.dist(q, v), i) for i, v in items)
    return [i for _, i in d[:k]]


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)]
    return rows, spark.createDataFrame(rows, "id long, vector array<double>")


def test_knn(spark, points):
    rows, df = points
    q = df.where("id < 7").select(F.col("id").alias("query_id"), "vector")
    for f in (search.knn_join, search.knn_expression):
        got = {}
        for r in f(df.repartition(5), q, 9).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == {i: brute(rows, rows[i][1], 9) for i in range(7)}
    assert search.knn_join(df, q, 0).count() == 0 and search.knn_join(df, q, 1000).count() == 7 * 600 and search.knn_join(df, q.where("false"), 3).count() == 0 and search.knn_join(df.where("false"), q, 3).count() == 0
    with pytest.raises(ValueError):
        search.knn_join(df, q, -1)
    odd = df.union(spark.createDataFrame([(9001, None), (9002, [1.0, 2.0]), (7, rows[7][1])], df.schema))  # no vector, another dimension, again
    assert search.knn_join(odd, q, 1000).count() == 7 * 601
    equal = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(500)], "id long, vector array<double>").repartition(3)
    got = search.knn_join(equal, spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<double>"), 20).orderBy("rank").collect()
    assert [r["id"] for r in got] == list(range(0, 40, 2))  # ties go by id
    metrics = [[(r["query_id"], r["id"]) for r in f(df, q, 5, m).orderBy("query_id", "rank").collect()] for m in ("manhattan", "cosine", "cosine_distance") for f in (search.knn_join, search.knn_expression)]
    assert metrics[::2] == metrics[1::2]


@pytest.mark.parametrize("config", [Forest(12, 16), CellTree(5, 40, max_candidates=120), CellTree(3, 40, max_candidates=120), Graph(8, ef=60), Graph(8, ef=60, select="diverse"), Graph(8, ef=60, select="heuristic")])
def test_indexes(spark, points, tmp_path, config):
    rows, df = points
    base, q = df.where("id >= 50"), df.where("id < 50").select(F.col("id").alias("query_id"), "vector")
    index = VectorIndex.fit(base.union(spark.createDataFrame([(9999, [1.0])], df.schema)), config, 8, partition_rows=200)
    got = index.search(q, 10).collect()
    assert {r["id"] for r in got} <= {i for i, _ in rows[50:]} and len(got) == 500
    at = dict(rows)
    assert all(abs(r["distance"] - math.dist(at[r["query_id"]], at[r["id"]])) < 1e-5 for r in got)
    truth = {i: set(brute(rows[50:], rows[i][1], 10)) for i in range(50)}
    hit = sum(r["id"] in truth[r["query_id"]] for r in got) / 500
    assert hit >= 0.9 and all(r["scanned"] <= 550 for r in got)
    index.save(f"{tmp_path}/i")
    again = VectorIndex.load(spark, f"{tmp_path}/i")
    assert again.describe() == index.describe() and sorted(map(tuple, again.search(q, 10).collect())) == sorted(map(tuple, got))
    if config.kind == "hnsw":
        e = index.edges()
        assert e.where("src = dst").count() == 0 and e.where("level = 0").groupBy("partition_id", "src").count().agg(F.max("count")).first()[0] <= 16
    else:
        leaves = index.leaves()
        trees = config.num_trees if config.kind == "btree" else 1
        per = leaves.groupBy("tree", "id").count()
        assert per.count() == trees * 550 and per.where("count <> 1").count() == 0
        assert leaves.groupBy("partition_id", "tree", "leaf").count().agg(F.max("count")).first()[0] <= (16 if config.kind == "btree" else 40)
    assert {r["id"] % 1 for r in index.search(q, 3, [0]).collect()} == {0} and index.search(q, 0).count() == 0


def test_registered_space(spark, points):
    rows, df = points
    K.register_space("chebyshev", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))
    try:
        q = df.where("id < 3").select(F.col("id").alias("query_id"), "vector")
        got = search.knn_join(df, q, 4, "chebyshev").collect()
    finally:
        del K.SPACES["chebyshev"]
    x = np.array([np.float32(v) for _, v in rows], float)
    for who in (0, 1, 2):
        at = next(n for n, (i, _) in enumerate(rows) if i == who)
        far = np.abs(x - x[at]).max(1)
        want = sorted(zip(far.tolist(), (i for i, _ in rows), strict=True))[:4]
        mine = sorted((r["rank"], r["distance"], r["id"]) for r in got if r["query_id"] == who)
        assert [i for _, _, i in mine] == [i for _, i in want] and np.allclose([d for _, d, _ in mine], [d for d, _ in want], atol=1e-6)
    with pytest.raises(ValueError):
        search.knn_join(df, q, 4, "chebyshev")


@pytest.mark.parametrize("config", [Forest(2, 4), CellTree(3, 4), Graph(4)])
def test_small_and_equal_items(spark, config):
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id long, vector array<double>")
    for n in (0, 1, 2, 30):
        df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(n)], "id long, vector array<double>")
        assert VectorIndex.fit(df, config, 2).search(q, 3).count() == min(n, 3)


def test_catalog(spark, points, tmp_path):
    rows, df = points
    for i in range(5):
        (tmp_path / f"part-{i}.csv").write_text("".join(f"{a},{','.join(map(str, v))}\n" for a, v in rows[i * 100 : i * 100 + 100]) + "1,2\n" + f"{i * 100},{','.join(['9'] * 8)}\n")
    c = catalog.Catalog(spark, f"{tmp_path}/catalog")
    d = catalog.Dataset("points", f"{tmp_path}/part-*", 2, 8, index="btree", options=json.dumps({"num_trees": 20, "max_leaf_items": 32}))
    c.create(d)
    with pytest.raises(catalog.DatasetExists):
        c.create(d)
    with pytest.raises(catalog.DatasetNotFound):
        c.get("other")
    with pytest.raises(ValueError):
        c.create(catalog.Dataset("more", f"{tmp_path}/part-*", 9, 8))
    assert [len(p["files"]) for p in c.partitions("points")] == [2, 3] and c.list() == [d] and c.as_table().count() == 1
    q = df.where("id between 500 and 509").select(F.col("id").alias("query_id"), "vector")
    exact = c.search("points", q, 5, exact=True)
    near = c.search("points", q, 5)
    assert c.items("points").count() == 500 and search.mean_recall(near, exact).first()[0] > 0.8
    assert {r["id"] // 200 for r in c.search("points", q, 5, [0]).collect()} == {0}
    with pytest.raises(catalog.PartitionNotFound):
        c.search("points", q, 5, [7])
    again = catalog.Catalog(spark, f"{tmp_path}/catalog")
    assert sorted(map(tuple, again.search("points", q, 5).collect())) == sorted(map(tuple, near.collect()))
    paths = [c._index_path("points", p) for p in c.partitions("points")]
    ages = [os.path.getmtime(p) for p in paths]
    assert c.build("points") == []
    # A file that comes makes a partition of its own, and the others keep their indexes; one that goes rebuilds its own.
    more = df.where("id < 60").select((F.col("id") + 10_000).alias("id"), "vector").coalesce(1)
    source.write_items(more, f"{tmp_path}/more", "csv")
    os.rename(next(glob.iglob(f"{tmp_path}/more/part-*")), f"{tmp_path}/part-9.csv")
    c.refresh("points")
    assert c.build("points") == [2] and [os.path.getmtime(p) for p in paths] == ages
    assert c.items("points").count() == 560 and c.get("points").num_partitions == 3
    assert {r["id"] >= 10_000 for r in c.search("points", q, 5, [2]).collect()} == {True}
    os.remove(f"{tmp_path}/part-9.csv")
    c.refresh("points")
    assert c.build("points") == [] and len(c.partitions("points")) == 2
    c.delete("points")
    assert c.list() == [] and not any(map(os.path.exists, paths)) and os.listdir(f"{tmp_path}/catalog/indexes") == []


def test_catalog_locks(spark, points, tmp_path):
    (tmp_path / "part-0.csv").write_text("".join(f"{a},{','.join(map(str, v))}\n" for a, v in points[0][:40]))
    (tmp_path / "part-1.csv").write_text("")
    c = catalog.Catalog(spark, f"{tmp_path}/catalog", lease=0.5)
    c.create(catalog.Dataset("a", f"{tmp_path}/part-*", 2, 8, index="btree"))
    # A lock that a lost session left behind is taken over after the lease; none is left by a build or by its failure.
    with c._building("a"):
        assert c.build("a") == [0, 1]
    assert os.listdir(f"{tmp_path}/catalog/locks") == [] and c.build("a") == []
    assert c.index("a").rows.count() == 1  # of the partition that holds items
    with pytest.raises(ZeroDivisionError), c._building("a"):
        1 / 0
    assert os.listdir(f"{tmp_path}/catalog/locks") == []
    # What is there is not replaced, unless that is asked for.
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    assert source.write_file(spark, one, "1") and not source.write_file(spark, one, "x") and source.write_file(spark, two, "2")
    assert not source.publish(spark, one, two) and open(two).read() == "2"
    assert source.publish(spark, one, two, replace=True) and open(two).read() == "1" and not os.path.exists(one)


def test_streaming_and_sql(spark, points, tmp_path):
    rows, df = points
    q = df.where("id < 6").select(F.col("id").alias("query_id"), "vector")
    q.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    search_stream(stream, df, 4, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("query_id").count().collect()
    assert sorted((r[0], r[1]) for r in got) == [(i, 4) for i in range(6)]
    register_knn(spark, "near_points", df)
    text = ", ".join(f"{x!r}D" for x in rows[3][1])
    assert [r["id"] for r in spark.sql(f"SELECT * FROM near_points(array({text}), 4) ORDER BY distance").collect()] == brute(rows, rows[3][1], 4)


def test_steps(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "src long, dst long, distance double")
    assert sorted(map(tuple, steps.two_hop(edges).collect())) == [(1, 2), (1, 3), (2, 3)]
    assert sorted(map(tuple, steps.prune(edges, 1).select("src", "dst").collect())) == [(1, 2), (2, 1), (3, 2)]
    old = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "cell int, centroid array<double>")
    assert dict(map(tuple, steps.keep_empty(old, old.where("cell = 0").withColumn("centroid", F.array(F.lit(7.0)))).collect())) == {0: [7.0], 1: [2.0]}


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return round(float(v), 6) if isinstance(v, (float, np.floating)) else str(v)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(core.ORACLES[name]).df()
    got = core.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted((tuple(norm(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    assert key(got) == key(want)


def test_contract(spark):
    assert contract.entry(spark).count() == 50
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["rp_forest_search", "voronoi_search", "hnsw_search"])
def test_index_searches_hold_all_rows(spark, sf_dir, name):
    df = core.items(spark, sf_dir)
    vectors = {r["id"]: np.array(r["vector"], float) for r in df.collect()}
    got = {}
    for r in core.QUERIES[name](spark, sf_dir).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert set(got) == {i for i in vectors if i % 100 == 0}
    right = 0
    for i, found in got.items():
        assert i in found and len(found) == 10
        right += len(found & set(sorted(vectors, key=lambda j: (np.linalg.norm(vectors[j] - vectors[i]), j))[:10]))
    assert right >= 0.8 * 10 * len(got)
