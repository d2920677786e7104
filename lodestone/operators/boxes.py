"""Exact k-nearest-neighbour joins in few dimensions.

Items are dealt to the boxes of a tree, and a query meets only the boxes that its k-th distance reaches: each row is
shuffled once, and a query about as often as its ball crosses a box. A box is searched in the same way once more, by a
tree over its own items. In many dimensions a ball crosses most boxes, and matrix products do better (search.knn_join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a box, about; of a leaf of the tree over a box's items; boxes at most, beyond which they become larger.
BOX_ROWS, LEAF_ROWS, MOST_BOXES = 32_768, 1024, 4096
#: Distances that are held at once.
HELD = 2_000_000


def measured(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances along the last axis, summed in the order of dimensions, as the expressions sum them."""
    total = 0.0
    for i in range(q.shape[-1]):
        d = q[..., i] - x[..., i]
        total = total + (np.abs(d) if metric == "manhattan" else d * d)
    return total if metric == "manhattan" else np.sqrt(total)


def smallest(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Positions of the rows left when of equal vectors only the k smallest ids stay; the others are nobody's neighbours."""
    order = np.lexsort((ids, *x.T))
    new = np.ones(len(order), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(1)
    starts = np.flatnonzero(new)
    return order[np.arange(len(order)) - starts[np.cumsum(new) - 1] < k]


class Boxes:
    """A tree of boxes, each halved along its widest axis until it has `most` rows at most or all are equal.

    Its boxes are those of the cuts, which together hold any vector, or the bounds of its own rows if `tight`.
    """

    def __init__(self, x: np.ndarray, most: int, tight: bool = False):
        self.axis, self.cut, self.left, self.leaf, self.rows = [0], [0.0], [-1], [-1], []
        low, high = [np.full(x.shape[1], -np.inf)], [np.full(x.shape[1], np.inf)]
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            own = x[rows]
            least, largest = (own.min(0), own.max(0)) if len(rows) else (low[at], high[at])
            if tight:
                low[at], high[at] = least, largest
            with np.errstate(invalid="ignore"):
                wide = largest - least
            a = int(np.argmax(np.where(np.isfinite(wide), wide, -1)))
            if len(rows) <= most or not 0 < wide[a] < np.inf:
                self.leaf[at] = len(self.rows)
                self.rows.append(rows)
                continue
            v = own[:, a]
            cut = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            cut = cut if cut < largest[a] else v[v < cut].max()
            self.axis[at], self.cut[at], self.left[at] = a, cut, len(self.left)
            for side, there in ((high, v <= cut), (low, v > cut)):
                self.axis.append(0), self.cut.append(0.0), self.left.append(-1), self.leaf.append(-1)
                low.append(low[at].copy()), high.append(high[at].copy())
                side[-1][a] = cut
                todo.append((len(self.left) - 1, rows[there]))
        self.axis, self.cut, self.left, self.leaf = (np.array(v) for v in (self.axis, self.cut, self.left, self.leaf))
        self.low, self.high = np.array(low), np.array(high)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all cuts each vector lies."""
        at = np.zeros(len(x), int)
        inner = np.flatnonzero(self.left[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = self.left[node] + ~(x[inner, self.axis[node]] <= self.cut[node])
            inner = inner[self.left[at[inner]] >= 0]
        return self.leaf[at]

    def reached(self, q: np.ndarray, limit: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, position in q) of all leaves whose box is no farther from a query than its limit.

        The way to a box is summed like a distance, and rounding keeps order, so no item within the limit is missed."""
        node, who, leaves = np.zeros(len(q), int), np.arange(len(q)), []
        while len(node):
            with np.errstate(invalid="ignore"):
                inside = np.fmin(np.fmax(q[who], self.low[node]), self.high[node])
                near = ~(measured(metric, q[who], inside) > limit[who])
            node, who = node[near], who[near]
            end = self.left[node] < 0
            leaves.append((self.leaf[node[end]], who[end]))
            node, who = self.left[node[~end]], who[~end]
            node, who = np.concatenate([node, node + 1]), np.concatenate([who, who])
        return tuple(np.concatenate(c) for c in zip(*leaves, strict=True)) if leaves else (node, who)


def groups(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its positions)."""
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part):
            yield int(key[part[0]]), part


def best(who: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest distances of each `who`, ties by id, NaN last."""
    order = np.lexsort((ids, d, who))
    who = who[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who) < k]


class Leaves:
    """The items of one box, for searches."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, metric: str):
        some = smallest(ids, x, k)
        self.ids, self.x, self.k, self.metric = ids[some], x[some], k, metric
        self.tree = Boxes(self.x, LEAF_ROWS, tight=True)

    def _meet(self, leaf: np.ndarray, who: np.ndarray, q: np.ndarray, limit: np.ndarray, closer: bool) -> list[np.ndarray]:
        """(position in q, id, distance) of the items of each leaf within the limit of the query beside it, or of its k-th there if closer."""
        found = [(np.zeros(0, int), self.ids[:0], np.zeros(0))]
        for at, some in groups(leaf):
            rows = self.tree.rows[at]
            step = max(1, HELD // max(1, len(rows)))
            for part in (who[some[i : i + step]] for i in range(0, len(some), step)):
                with np.errstate(invalid="ignore", over="ignore"):
                    d = measured(self.metric, q[part][:, None], self.x[rows][None])
                most = limit[part]
                if closer and d.shape[1] > self.k:
                    most = np.fmin(most, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
                i, j = np.nonzero(~(d > most[:, None]))
                found.append((part[i], self.ids[rows[j]], d[i, j]))
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    def search(self, q: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in q, id, distance): each query's k best of this box within its limit, by position and distance."""
        if not len(self.ids) or not len(q):
            return np.zeros(0, int), self.ids[:0], np.zeros(0)
        home = self.tree.home(q)
        who, ids, d = self._meet(home, np.arange(len(q)), q, limit, True)
        some = best(who, ids, d, self.k)
        who, ids, d = who[some], ids[some], d[some]
        last = np.arange(len(who)) - np.searchsorted(who, who) == self.k - 1
        limit = limit.copy()
        limit[who[last]] = np.fmin(limit[who[last]], d[last])
        leaf, row = self.tree.reached(q, limit, self.metric)
        other = leaf != home[row]
        more = self._meet(leaf[other], row[other], q, limit, False)
        who, ids, d = (np.concatenate(c) for c in zip((who, ids, d), more, strict=True))
        some = best(who, ids, d, self.k)
        return who[some], ids[some], d[some]


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def lists(values: np.ndarray, who: np.ndarray, n: int) -> pa.Array:
    """Of sorted positions `who`, the values of each of n."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def boxed_join(items: DataFrame, queries: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
    """(query_id, id, distance): for each query at least its k nearest items, k >= 1, and few others.

    The cuts come from a hash sample of the items, of some 65,000 at most; all items are dealt out by them. In the first
    round a query meets its own box, in the second the others that its k-th distance so far reaches.
    """
    spark = items.sparkSession
    items = items.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == dim)
    n = items.count()
    some = items.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // 65_536))) == 0).select("vector").toArrow().column(0)
    sample = matrix(some, dim)
    sample = sample[np.isfinite(sample).all(1)]
    tree = Boxes(sample, max(1, -(-len(sample) // max(1, min(MOST_BOXES, n // BOX_ROWS)))))
    shared = spark.sparkContext.broadcast(tree)
    row = "cell long, id long, vector array<double>"
    visit = "cell long, query_id long, vector array<double>, reach double, ids array<long>, distances array<double>"

    def deal(batches: Iterator[pa.RecordBatch], thin: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dim)
            if thin and len(x) > k:
                keep = np.sort(smallest(batch.column(0).to_numpy(zero_copy_only=False), x, k))
                if len(keep) < len(x):
                    batch, x = batch.take(pa.array(keep)), x[keep]
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.home(x)), *batch.columns], ["cell", "id", "vector"])

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        """Each query with its own box's answer, and once more for each other box that it has to meet."""
        q = matrix(right["vector"], dim)
        if not len(q):
            return pa.Table.from_batches([], schema=VISIT)
        tree, own = shared.value, right["cell"][0].as_py()
        who, ids, d = Leaves(left["id"].to_numpy(), matrix(left["vector"], dim), k, metric).search(q, np.full(len(q), np.inf))
        reach = np.full(len(q), np.inf)
        last = np.arange(len(who)) - np.searchsorted(who, who) == k - 1
        reach[who[last]] = np.nan_to_num(d[last], nan=np.inf)
        home = pa.table([right["cell"], right["id"], right["vector"], pa.array(reach), lists(ids, who, len(q)), lists(d, who, len(q))], schema=VISIT)
        cell, row = tree.reached(q, reach, metric)
        cell, row = cell[cell != own], row[cell != own]
        there = right.take(pa.array(row))
        none = pa.nulls(len(row))
        return pa.concat_tables([home, pa.table([pa.array(cell), there["id"], there["vector"], pa.array(reach[row]), none.cast(VISIT.field(4).type), none.cast(VISIT.field(5).type)], schema=VISIT)])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        """The answers that visitors find in this box, and those that its own queries have."""
        ask = right.filter(right["ids"].is_null())
        home = right.filter(right["ids"].is_valid())
        parts = []
        if len(home):
            counts = home["ids"].combine_chunks().value_lengths().to_numpy()
            parts.append((np.repeat(home["query_id"].to_numpy(), counts), home["ids"].combine_chunks().flatten().to_numpy(), home["distances"].combine_chunks().flatten().to_numpy()))
        if len(ask):
            who, ids, d = Leaves(left["id"].to_numpy(), matrix(left["vector"], dim), k, metric).search(matrix(ask["vector"], dim), ask["reach"].to_numpy())
            parts.append((ask["query_id"].to_numpy()[who], ids, d))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in columns], names=["query_id", "id", "distance"])

    many, one = pa.list_(pa.int64()), pa.list_(pa.float64())
    VISIT = pa.schema([("cell", pa.int64()), ("query_id", pa.int64()), ("vector", one), ("reach", pa.float64()), ("ids", many), ("distances", one)])
    dealt = items.mapInArrow(lambda b: deal(b, True), row)
    asked = queries.select(F.col("query_id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(lambda b: deal(b, False), row)
    visits = dealt.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(first, visit)
    return dealt.groupBy("cell").cogroup(visits.groupBy("cell")).applyInArrow(second, "query_id long, id long, distance double")
