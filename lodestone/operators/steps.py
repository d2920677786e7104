"""Single steps of index building as DataFrame operators: clustering, planes and neighbour graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.kernels import equidistant_plane, euclidean, hash32, length, near_cell, point_plane_distance, push_both, space, uniform
from lodestone.operators.search import distances

# k-means


def assign(items: DataFrame, centroids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(id, vector, cell, distance): the nearest of a few centroids (cell, centroid), ties by the smaller cell.

    The centroids are one broadcast row, and each item takes the smallest of its distances by itself: no shuffle.
    """
    row = centroids.agg(F.array_sort(F.collect_list(F.struct("cell", "centroid"))).alias("cells"))
    d = F.array_min(F.transform("cells", lambda c: F.struct(space(metric)(F.col("vector"), c["centroid"]).alias("distance"), c["cell"].alias("cell"))))
    return items.crossJoin(F.broadcast(row)).select("id", "vector", d.alias("best")).select("id", "vector", "best.cell", "best.distance")


def update(assigned: DataFrame, dim: int) -> DataFrame:
    """(cell, centroid): mean of each cell's vectors, one average a dimension, combined before the shuffle."""
    means = [F.avg(F.get("vector", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(dim)]
    return assigned.groupBy("cell").agg(*means).select("cell", F.array(*(f"c{i}" for i in range(dim))).alias("centroid"))


def keep_empty(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new centroids, and the old one of each cell that has none."""
    fresh = new.withColumnRenamed("centroid", "fresh")
    return old.join(fresh, "cell", "left").select("cell", F.coalesce("fresh", "centroid").alias("centroid"))


def cost(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cell").agg(F.count("*").alias("n"), F.sum("distance").alias("cost"))


def lloyd(items: DataFrame, centroids: DataFrame, dim: int, rounds: int, metric: str = "euclidean") -> DataFrame:
    """Centroids after some rounds of assign(), update() and keep_empty(), by matrix products over Arrow batches.

    A task sends a row of counts and sums for each cell. The centroids are few, so each round's come to the driver and
    the next starts from them; a plan that nested the rounds would scan the items twice as often with every one. Items
    without a vector of this dimension are left out.
    """
    spark = items.sparkSession
    start = sorted((r["cell"], r["centroid"]) for r in centroids.select("cell", "centroid").collect())
    cells, means = [c for c, _ in start], np.array([v for _, v in start], float).reshape(len(start), dim)
    vectors = items.select("vector").where(F.size("vector") == dim)
    for _ in range(rounds if cells else 0):
        shared = spark.sparkContext.broadcast(means)

        def tally(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            n, sums = np.zeros(len(m), np.int64), np.zeros(m.shape)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().astype(float).reshape(len(batch), -1)
                cell = distances(metric, x, m).argmin(1) if len(x) else np.zeros(0, int)
                n += np.bincount(cell, minlength=len(m))
                np.add.at(sums, cell, x)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m))), pa.array(n), pa.array(list(sums))], ["at", "n", "sums"])

        parts = vectors.mapInArrow(tally, "at long, n long, sums array<double>")
        total = parts.groupBy("at").agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim))).collect()
        means = means.copy()
        for r in total:
            if r["n"]:
                means[r["at"]] = np.array(r[2:]) / r["n"]
    return spark.createDataFrame(list(zip(cells, means.tolist(), strict=True)), centroids.select("cell", "centroid").schema)


def weighted_pick(weighted: DataFrame, tag: str) -> DataFrame:
    """One row (id, weight), drawn by weight: the first whose running sum by id reaches a share of the total.

    The running sum passes through one task; race_pick draws by weight without one."""
    u = uniform(tag, F.lit("draw"))
    run = weighted.selectExpr("*", "sum(weight) over (order by id rows unbounded preceding) as running", "sum(weight) over () as total")
    return run.where(F.col("running") >= u * F.col("total")).orderBy("id").limit(1)


def race_pick(weighted: DataFrame, tag: str, by: list[str]) -> DataFrame:
    """One row of each group, drawn by weight: the smallest exponential draw over weight. It needs no order and no
    running sum, so each group is one partial aggregate."""
    draw = F.try_divide(-F.ln((hash32(tag, F.col("id")) + 1) / F.lit(4294967296.0)), F.col("weight"))
    return weighted.where("weight > 0").groupBy(*by).agg(F.min_by(F.struct("id", "vector"), F.struct(draw, F.col("id"))).alias("p")).select(*by, "p.id", "p.vector")


def near_cells(assigned_to: DataFrame, centroids: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(query_id, cell, distance, rank, is_near): cells by distance of each query; near: of the k first, or within a tenth."""
    d = space(metric)(F.col("vector"), F.col("centroid"))
    pairs = assigned_to.select("query_id", "vector").crossJoin(F.broadcast(centroids)).select("query_id", "cell", d.alias("distance"))
    ranked = pairs.selectExpr("*", "row_number() over (partition by query_id order by distance, cell) as rank", "min(distance) over (partition by query_id) as nearest")
    return ranked.select("query_id", "cell", "distance", "rank", ((F.col("rank") <= k) | near_cell(F.col("distance"), F.col("nearest"))).alias("is_near"))


# planes


def pivots(items: DataFrame, tag: str, by: list[str]) -> DataFrame:
    """Each node's plane between its two items of the smallest hashes."""
    ranked = items.select(*by, "id", "vector", hash32(tag, F.col("id")).alias("h"))
    two = ranked.selectExpr("*", f"row_number() over (partition by {', '.join(by)} order by h, id) as r").where("r <= 2")
    sides = two.groupBy(*by).agg(F.max_by("vector", F.when(F.col("r") == 1, 1).otherwise(0)).alias("a"), F.max_by("vector", F.col("r")).alias("b"), F.count("*").alias("n"))
    return sides.where("n = 2").select(*by, equidistant_plane(F.col("a"), F.col("b")).alias("plane"))


def split(items: DataFrame, planes: DataFrame, by: str = "node") -> DataFrame:
    """Items of each node sent to 2 * node, at or behind the plane, or 2 * node + 1."""
    d = point_plane_distance(F.col("vector"), F.col("plane.normal"), F.col("plane.d"))
    return items.join(F.broadcast(planes), by).select("id", "vector", (2 * F.col(by) + F.when(d <= 0, 0).otherwise(1)).alias(by))


def sides(queries: DataFrame, plane: DataFrame) -> DataFrame:
    """(query_id, distance, left, right): which sides of a plane a query searches."""
    d = point_plane_distance(F.col("vector"), F.col("plane.normal"), F.col("plane.d"))
    both = push_both(F.col("distance"), length(F.col("vector")))
    at = queries.crossJoin(F.broadcast(plane)).withColumn("distance", d)
    return at.select("query_id", "distance", ((F.col("distance") <= 0) | both).alias("left"), ((F.col("distance") > 0) | both).alias("right"))


# neighbour graphs, edges (src, dst, distance)


def select_nearest(edges: DataFrame, m: int) -> DataFrame:
    """The m shortest edges of each source."""
    return edges.selectExpr("src", "dst", "distance", "row_number() over (partition by src order by distance, dst) as rank").where(F.col("rank") <= m).select("src", "dst", "distance")


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance")).distinct()


def prune(edges: DataFrame, m: int) -> DataFrame:
    """Edges in both directions, of which each vertex keeps its m shortest."""
    return select_nearest(symmetric(edges), m)


def two_hop(edges: DataFrame) -> DataFrame:
    """(src, dst): vertices at one or two hops, not oneself."""
    far = edges.select("src", F.col("dst").alias("via")).join(edges.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
    return edges.select("src", "dst").union(far).where("src <> dst").distinct()


def greedy_step(frontier: DataFrame, edges: DataFrame, items: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(query_id, vertex, distance): each query moves to the nearest of its vertex and that vertex's neighbours."""
    near = frontier.join(edges.select(F.col("src").alias("vertex"), "dst"), "vertex").select("query_id", "vector", F.col("dst").alias("vertex"))
    both = frontier.select("query_id", "vector", "vertex").union(near).join(items.select(F.col("id").alias("vertex"), F.col("vector").alias("x")), "vertex")
    d = both.select("query_id", "vertex", space(metric)(F.col("vector"), F.col("x")).alias("distance"))
    return d.selectExpr("*", "row_number() over (partition by query_id order by distance, vertex) as r").where("r = 1").drop("r")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


__all__ = ["assign", "cost", "degrees", "euclidean", "greedy_step", "keep_empty", "lloyd", "near_cells", "pivots", "prune", "race_pick", "select_nearest", "sides", "split", "symmetric", "two_hop", "update", "weighted_pick"]
