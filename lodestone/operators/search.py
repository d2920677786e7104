"""Exact k-nearest-neighbour joins, top-k, re-ranking and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.kernels import space
from lodestone.operators.boxes import boxed_join, groups, measured

#: A block of queries that is sent to every executor holds so many values at most: 32 MB of doubles.
BLOCK_VALUES = 4_000_000
#: Metrics that are measured by matrix products; those registered besides are measured by their expressions.
BY_PRODUCTS = ("euclidean", "manhattan", "cosine", "cosine_distance")
#: More queries than these, of so few dimensions, meet only the boxes of items that they reach.
FEW_QUERIES, FEW_DIMENSIONS = 1000, 6
#: So many queries are measured by expressions in knn.
HANDFUL = 8
#: A task merges what it finds for so many queries at a time; for more, there are no more tasks than cores.
MANY_QUERIES = 4096


def top_k(results: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k smallest distances of each query, ties by id, with rank from 1. Spark limits each task's rows before it shuffles them."""
    if k < 0:
        raise ValueError("k is negative")
    ranked = results.selectExpr("*", f"row_number() over (partition by {by} order by distance, id) as rank")
    return ranked.where(F.col("rank") <= k)


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, vectors, and any further columns) of all queries, BLOCK_VALUES values at a time at most, however many there are.

    Executors send packed arrays, many rows in one. One block comes in one job, more come partition by partition."""
    n, least, most = queries.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if n and (least != most or least < 0):
        raise ValueError("vectors of queries are missing or differ in size")
    rows = max(1, BLOCK_VALUES // max(1, most or 0))
    more = [c for c in queries.columns if c not in ("query_id", "vector")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, rows) for i in range(0, len(whole), rows)):
                longs = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for i in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([pa.array([longs], pa.list_(pa.binary())), pa.array([vectors(batch.column(1), most).tobytes()], pa.binary())], ["longs", "vectors"])

    packed = queries.select("query_id", "vector", *more).mapInArrow(pack, "longs array<binary>, vectors binary")
    found, held = [], 0
    for r in packed.collect() if n <= rows else packed.toLocalIterator(prefetchPartitions=True):
        longs = [np.frombuffer(c, np.int64) for c in r[0]]
        if held and held + len(longs[0]) > rows:
            yield tuple(np.concatenate(c) for c in zip(*found, strict=True))
            found, held = [], 0
        found.append((longs[0], np.frombuffer(r[1]).reshape(-1, most), *longs[1:]))
        held += len(longs[0])
    if found:
        yield tuple(np.concatenate(c) for c in zip(*found, strict=True))


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances of the rows of q to those of x."""
    if metric == "manhattan":
        out = np.zeros((len(q), len(x)))
        for a, b in zip(q.T, x.T, strict=True):  # a dimension at a time: nothing larger than the result
            out += np.abs(a[:, None] - b[None, :])
        return out
    if metric == "euclidean":
        flat = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
        return np.sqrt(np.maximum(flat, 0))
    if metric in ("cosine", "cosine_distance"):
        norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            similar = (q @ x.T) / norm
        return similar if metric == "cosine" else 1 - similar
    raise ValueError(f"unknown space {metric!r}")


def nearest(d: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of d the positions of its k smallest values, ties by id; NaN is last."""
    out = []
    for row in d:
        if len(row) > k:
            edge = np.partition(row, k - 1)[k - 1] if k else 0.0
            some = np.flatnonzero(row <= edge) if k and not np.isnan(edge) else np.arange(len(row))
        else:
            some = np.arange(len(row))
        out.append(some[np.lexsort((ids[some], row[some]))][:k])
    return out


def knn_expression(items: DataFrame, queries: DataFrame, k: int, metric: str | Column = "euclidean") -> DataFrame:
    """(query_id, id, distance, rank) by expressions alone: every query of a broadcast set against all items."""
    d = space(metric)(F.col("q_vector"), F.col("vector")) if isinstance(metric, str) else metric
    small = F.broadcast(queries.select("query_id", F.col("vector").alias("q_vector")))
    return top_k(items.select("id", "vector").crossJoin(small).select("query_id", "id", d.alias("distance")), k)


def pair_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of rows of q to the rows of x beside them, summed in the order of dimensions, as the expressions sum them."""
    if metric in ("euclidean", "manhattan"):
        return measured(metric, q, x)
    dot, qq, xx = (sum((a[:, i] * b[:, i] for i in range(q.shape[1])), np.zeros(len(q))) for a, b in ((q, x), (q, q), (x, x)))
    with np.errstate(divide="ignore", invalid="ignore"):
        similar = dot / (np.sqrt(qq) * np.sqrt(xx))
    return similar if metric == "cosine" else 1 - similar


class Best:
    """The k nearest items that each query has met. Items are measured by matrix products, in single precision once each
    query has k, and only those that may be nearer than a query's k-th so far, for all that rounding may do, are measured
    again by pair_distances and merged."""

    QUERIES, ITEMS, PAIRS = 256, 1024, 4096

    def __init__(self, metric: str, q: np.ndarray, k: int):
        self.metric, self.q, self.k = metric, q, k
        self.who, self.ids, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.limit = np.full(len(q), np.inf)
        self.norms = np.sqrt((q * q).sum(1))

    def _left(self, part: slice, kind: str) -> np.ndarray:
        q = self.q[part]
        if self.metric == "euclidean":
            return np.append(q, np.ones((len(q), 1)), 1).astype(kind)
        if self.metric == "manhattan":
            return q.astype(kind)
        with np.errstate(divide="ignore", invalid="ignore"):
            return (q / self.norms[part, None]).astype(kind)

    def _right(self, x: np.ndarray, kind: str) -> np.ndarray:
        """What _estimate meets, a column an item."""
        if self.metric == "euclidean":  # d * d = |q|^2 + 2 * (|x|^2 / 2 - qx)
            return np.append(-x, (x * x).sum(1)[:, None] / 2, 1).T.astype(kind, order="C")
        if self.metric == "manhattan":
            return x.T.astype(kind, order="C")
        with np.errstate(divide="ignore", invalid="ignore"):
            x = x / np.sqrt((x * x).sum(1))[:, None]
        return (x if self.metric == "cosine" else -x).T.astype(kind, order="C")

    def _estimate(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers that order a query's items as their distances do, but for rounding."""
        if self.metric != "manhattan":
            return left @ right
        out = np.zeros((len(left), right.shape[1]), left.dtype)
        one = np.empty_like(out)
        for a, b in zip(left.T, right, strict=True):  # a dimension at a time: nothing larger than the result
            np.subtract(a[:, None], b[None, :], out=one)
            out += np.abs(one, out=one)
        return out

    def _bounds(self, reach: float, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's limit as _estimate has it, what rounding may add, and what the latter is to be small beside."""
        dim, limit = self.q.shape[1], np.nan_to_num(self.limit, posinf=0.0)
        off, scale = (dim + 16) * float(np.finfo(kind).eps), self.norms + reach
        if self.metric == "euclidean":
            return (self.limit**2 - self.norms**2) / 2, off * (scale**2 + limit**2), limit**2
        if self.metric == "manhattan":
            return self.limit, off * (np.sqrt(dim) * scale + limit), limit
        return (self.limit if self.metric == "cosine" else self.limit - 1), np.full(len(self.q), 4 * off), np.ones(len(self.q))

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """The first items are met a few at a time, so that limits are near before most are met."""
        at, step = 0, self.ITEMS if np.isinf(self.limit).any() else len(ids)
        while at < len(ids):
            self._add(ids[at : at + step], x[at : at + step])
            at, step = at + step, 4 * step

    def _add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(self.q):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            reach = float(np.sqrt((x * x).sum(1)).max(initial=0.0))
            open_ = np.isinf(self.limit)
            _, off, beside = self._bounds(reach, "f4")
            kind = "f4" if not open_.any() and self.norms.max() + reach < 1e15 and np.median(off) <= 1e-3 * np.median(beside) else "f8"
            most, off, _ = self._bounds(reach, kind)
        most = most + off
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        rights = [(j, self._right(x[j : j + self.ITEMS], kind)) for j in range(0, len(x), self.ITEMS)]
        for i in range(0, len(self.q), self.QUERIES):
            part = slice(i, i + self.QUERIES)
            new, left = np.flatnonzero(open_[part]), self._left(part, kind)
            for j, right in rights:
                with np.errstate(over="ignore", invalid="ignore"):
                    e = self._estimate(left, right)
                    limit = most[part]
                    if len(new):
                        e = np.where(np.isnan(e), np.inf, e)
                        limit = limit.copy()
                        limit[new] = np.partition(e[new], self.k - 1, axis=1)[:, self.k - 1] + 2 * off[part][new] if e.shape[1] > self.k else np.inf
                    flat = np.flatnonzero(e <= limit.astype(kind)[:, None])
                rows, cols = np.divmod(flat, e.shape[1])
                found.append((rows + i, cols + j))
        rows, cols = (np.concatenate(c) for c in zip(*found, strict=True))
        if len(rows):
            d = np.concatenate([pair_distances(self.metric, self.q[rows[i : i + self.PAIRS]], x[cols[i : i + self.PAIRS]]) for i in range(0, len(rows), self.PAIRS)])
            self._merge(rows, ids[cols], d)

    def _merge(self, rows: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        met = np.zeros(len(self.q), bool)
        met[rows] = True
        old = met[self.who]
        who, ids, d = np.concatenate([self.who[old], rows]), np.concatenate([self.ids[old], ids]), np.concatenate([self.d[old], d])
        order = np.lexsort((ids, d, who))
        who, ids, d = who[order], ids[order], d[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        last = who[rank == self.k - 1]
        self.limit[last] = np.nan_to_num(d[rank == self.k - 1], nan=np.inf)
        keep = rank < self.k
        self.who, self.ids, self.d = (np.concatenate([a[~old], b[keep]]) for a, b in ((self.who, who), (self.ids, ids), (self.d, d)))


def knn_join(items: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest items of every query, exactly.

    Blocks of queries of a bounded size go to the executors in turn. Each task meets batches of items by matrix products,
    keeps its own k best of each query, and only these are shuffled. Items without a vector, or with one of another
    dimension than the queries', are at no distance and are left out. A table in fewer parts than there are cores is
    dealt out first. A metric of register_space is measured by its expression, block by block too. Many queries of few
    dimensions are joined by boxes in place of blocks (boxed_join).
    """
    space(metric)
    if k < 0:
        raise ValueError("k is negative")
    if k and metric in ("euclidean", "manhattan"):
        n, least, most = queries.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if n > FEW_QUERIES and 0 < least == most <= FEW_DIMENSIONS:
            return top_k(boxed_join(items, queries, k, metric, most), k)
    return top_k(_met(items, queries, k, metric), k)


def _met(items: DataFrame, queries: DataFrame, k: int, metric: str, by: str | None = None, own: bool = False) -> DataFrame:
    """(query_id, id, distance, by): each task's k best of every query, and of each value of the column `by` if there is one.

    own: a query meets only the items of its own value of `by`. Of the values that a task meets it keeps some at a time.
    """
    spark, found = items.sparkSession, None
    sc = spark.sparkContext
    value = F.lit(0) if by is None else F.col(by)
    items = items.select("id", "vector", value.cast("long").alias("by"))
    items = items.where("by is not null") if own else items.fillna(-(2**63), "by")
    queries = queries.select("query_id", "vector", *([F.col(by).cast("long").alias("by")] if own else []))
    queries = queries.where("by is not null") if own else queries
    n = items.rdd.getNumPartitions()
    if n < sc.defaultParallelism:
        items = items.repartition(sc.defaultParallelism)
    for block in query_blocks(queries):
        if len(block[0]) > MANY_QUERIES and n > sc.defaultParallelism:
            items = items.coalesce(sc.defaultParallelism)  # each task finds and sends k of every query
        same = items.where(F.size("vector") == block[1].shape[1])
        if metric not in BY_PRODUCTS:
            asked = pa.table({"query_id": block[0], "vector": list(block[1]), **({"by": block[2]} if own else {})})
            d = space(metric)(F.col("q_vector"), F.col("vector"))
            some = F.broadcast(spark.createDataFrame(asked).withColumnRenamed("vector", "q_vector"))
            pairs = same.join(some, "by") if own else same.crossJoin(some)
            part = top_k(pairs.select("query_id", "id", d.alias("distance"), "by"), k, "query_id, by").drop("rank")
            found = part if found is None else found.unionByName(part)
            continue
        shared = sc.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q, *which = shared.value
            kept: dict[int, list[tuple[np.ndarray, Best]]] = {}

            def answer(at: int) -> Iterator[pa.RecordBatch]:
                for name, best in kept.pop(at):
                    yield pa.RecordBatch.from_arrays([pa.array(name[best.who]), pa.array(best.ids), pa.array(best.d), pa.array(np.full(len(best.d), at))], ["query_id", "id", "distance", "by"])

            for batch in batches if k else ():
                ids, x = batch.column(0).to_numpy(zero_copy_only=False), vectors(batch.column(1), q.shape[1])
                for at, rows in groups(batch.column(2).to_numpy()):
                    if at not in kept:
                        mine = np.flatnonzero(which[0] == at) if own else np.arange(len(qid))
                        kept[at] = [(qid[some], Best(metric, q[some], k)) for some in np.split(mine, range(MANY_QUERIES, len(mine), MANY_QUERIES))]
                    for _, best in kept[at]:
                        best.add(ids[rows], x[rows])
                while len(kept) > 1 and sum(b.q.size + 3 * k * len(b.q) for value in kept.values() for _, b in value) > 2 * BLOCK_VALUES:
                    yield from answer(next(iter(kept)))
            while kept:
                yield from answer(next(iter(kept)))

        part = same.mapInArrow(search, "query_id long, id long, distance double, by long")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id long, id long, distance double, by long") if found is None else found


def search_one(items: DataFrame, query: list[float], k: int, metric: str = "euclidean") -> DataFrame:
    """(id, distance) of the k nearest items of one query, ascending."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return items.select("id", space(metric)(q, F.col("vector")).alias("distance")).orderBy("distance", "id").limit(k)


def knn(items: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """(query_id, id, distance, rank): by expressions for a handful of queries, by knn_join for more: a pair costs
    expressions microseconds, and matrix products nanoseconds."""
    handful = queries.limit(HANDFUL + 1).count() <= HANDFUL
    return knn_expression(items, queries, k, metric) if handful else knn_join(items, queries, k, metric)


def search_partitions(items: DataFrame, queries: DataFrame, k: int, partitions: list, metric: str = "euclidean") -> DataFrame:
    """As knn, over some partitions; the predicate reaches the scan of a table laid out by partition_id."""
    return knn(items.where(F.col("partition_id").isin(*partitions)), queries, k, metric)


def partitioned_top_k(items: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """The k best of each query in each partition, then the k best of these."""
    space(metric)
    each = top_k(_met(items, queries, k, metric, "partition_id"), k, "query_id, by")
    return top_k(each.drop("rank", "by"), k)


def rerank(candidates: DataFrame, items: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean") -> DataFrame:
    """Exact distances of distinct candidates (query_id, id), and the k best of each query."""
    q = queries.select("query_id", F.col("vector").alias("q_vector"))
    met = candidates.select("query_id", "id").distinct().join(items.select("id", "vector"), "id").join(q, "query_id")
    return top_k(met.select("query_id", "id", space(metric)(F.col("q_vector"), F.col("vector")).alias("distance")), k)


def rerank_by(items: DataFrame, queries: DataFrame, k: int, by: str, metric: str = "euclidean") -> DataFrame:
    """As rerank, where a query's candidates are all items that have its value of a whole-number column `by`. The pairs,
    which grow with the square of a value's rows, are met in blocks and never made into rows."""
    space(metric)
    return top_k(_met(items, queries, k, metric, by, own=True).drop("by"), k)


def candidate_counts(items: DataFrame, queries: DataFrame, by: str) -> DataFrame:
    """(query_id, n): how many different items have a value of `by` that a query has; queries without any are left out.

    Queries of equal values have equal candidates, so the items are counted for each set of values, not for each query."""
    asked = queries.where(F.col(by).isNotNull()).groupBy("query_id").agg(F.array_sort(F.collect_set(by)).alias("_values"))
    sets = asked.select("_values").distinct().select("_values", F.explode("_values").alias(by))
    n = items.select(by, "id").join(sets, by).groupBy("_values").agg(F.countDistinct("id").alias("n"))
    return asked.join(n, "_values").select("query_id", "n")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): share of a query's true neighbours that were found."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id").distinct().withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    return recall(found, truth).agg(F.avg("recall").alias("recall"))


def label_vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(query_id, label, votes): the most frequent label of each query's neighbours, ties by the smaller label."""
    votes = neighbours.join(labels, "id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    return votes.selectExpr("*", "row_number() over (partition by query_id order by votes desc, label) as _n").where("_n = 1").drop("_n")
