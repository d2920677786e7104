"""Approximate indexes: a neighbour graph, a forest of random planes, and a tree of k-means cells.

The unit of an index is a partition of the items, as it is of every search: a task builds one partition's index from
its vectors, a search asks all partitions and takes the best of their answers. Partitions have about `partition_rows`
rows however many items there are, so a larger table has more tasks and no larger ones.
"""

from __future__ import annotations

import heapq
import io
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import distances, nearest, query_blocks

PARTITION_ROWS = 10_000
INDEX_SCHEMA = "partition_id int, n long, data binary"
MAX_DEPTH = 64


@dataclass
class Forest:
    """Trees of planes half way between two random items; leaves of up to max_leaf_items."""

    num_trees: int = 50
    max_leaf_items: int = 128
    max_candidates: int | None = None
    kind: str = "btree"

    def __post_init__(self):
        if self.num_trees < 1 or self.max_leaf_items < 1:
            raise ValueError("a forest needs a tree, and leaves an item")

    def build(self, x: np.ndarray, metric: str, rng: np.random.Generator) -> dict[str, np.ndarray]:
        """A plane is kept as the two items that it lies between, so vectors are taken as an index keeps them."""
        x = x.astype("f4").astype(float)
        left, right, pairs, leaf_of, leaves, roots = [], [], [], [], [], []

        def node() -> int:
            for a, v in ((left, -1), (right, -1), (pairs, (-1, -1)), (leaf_of, -1)):
                a.append(v)
            return len(left) - 1

        for _ in range(self.num_trees):
            roots.append(node())
            todo = [(roots[-1], np.arange(len(x)), 0)]
            while todo:
                at, rows, depth = todo.pop()
                pair = self._pair(x, rows, rng) if depth < MAX_DEPTH and (len(rows) > self.max_leaf_items or not depth) else None
                side = None
                if pair is not None:
                    a, b = x[pair]
                    side = x[rows] @ (b - a) - (b - a) @ (a + b) / 2 > 0
                if side is None or side.all() or not side.any():
                    leaf_of[at] = len(leaves)
                    leaves.append(rows)
                    continue
                pairs[at], left[at], right[at] = tuple(pair), node(), node()
                todo += [(left[at], rows[~side], depth + 1), (right[at], rows[side], depth + 1)]
        small = lambda v: np.array(v, np.int32)
        return {"roots": small(roots), "left": small(left), "right": small(right), "leaf_of": small(leaf_of), "pairs": small(pairs), "leaf_ends": np.cumsum([len(r) for r in leaves]), "leaf_rows": small(np.concatenate(leaves))}

    @staticmethod
    def _pair(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
        """Two different items; None if no draw finds such."""
        if len(rows) < 2:
            return None
        for _ in range(8):
            pair = rng.choice(rows, 2, replace=False)
            if (x[pair[0]] != x[pair[1]]).any():
                return pair
        return None

    @staticmethod
    def _planes(s: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place of each node, normals, offsets, lengths) of the planes, which indexes saved earlier have themselves."""
        if "planes" in s:
            inner = np.arange(len(s["planes"]))
            normals, offsets = s["planes"][:, :-1], s["planes"][:, -1]
        else:
            inner = np.flatnonzero(s["pairs"][:, 0] >= 0)
            a, b = s["_x"][s["pairs"][inner, 0]], s["_x"][s["pairs"][inner, 1]]
            normals = b - a
            offsets = np.einsum("ij,ij->i", normals, (a + b) / 2)
        place = np.zeros(len(s["left"]), int)
        place[inner] = np.arange(len(inner))
        return place, normals, offsets, np.sqrt(np.einsum("ij,ij->i", normals, normals)) + 1e-12

    def candidates(self, s: dict, q: np.ndarray, k: int) -> np.ndarray:
        norm = math.sqrt(q @ q)
        margin = math.log(norm) / 10 if norm > 0 else -math.inf
        seen: list[np.ndarray] = []
        if "_planes" not in s:
            s["_planes"] = self._planes(s)
        place, normals, offsets, lengths = s["_planes"]
        for root in s["roots"]:
            todo = [root]
            while todo:
                at = todo.pop()
                leaf = s["leaf_of"][at]
                if leaf >= 0:
                    end = s["leaf_ends"][leaf]
                    seen.append(s["leaf_rows"][s["leaf_ends"][leaf - 1] if leaf else 0 : end])
                    continue
                n = place[at]
                d = (q @ normals[n] - offsets[n]) / lengths[n]
                near, far = (s["left"][at], s["right"][at]) if d <= 0 else (s["right"][at], s["left"][at])
                todo += [far, near] if abs(d) <= margin else [near]
        found = list(dict.fromkeys(np.concatenate(seen).tolist()))
        return np.array(found[: self.max_candidates] if self.max_candidates else found)


@dataclass
class CellTree:
    """A hierarchy of k-means cells; cells of up to max_cell_items."""

    split_factor: int = 10
    max_cell_items: int = 1024
    tolerance: float = 1e-4
    max_rounds: int = 100
    max_candidates: int | None = None
    kind: str = "voronoi"

    def build(self, x: np.ndarray, metric: str, rng: np.random.Generator) -> dict[str, np.ndarray]:
        centroids, parent, first, last, rows_of = [np.zeros(x.shape[1])], [-1], [-1], [-1], [np.zeros(0, int)]
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            parts = self._split(x[rows], metric, rng) if len(rows) > self.max_cell_items and depth < MAX_DEPTH else None
            if parts is None:
                rows_of[at] = rows
                continue
            means, cell = parts
            first[at] = len(centroids)
            for c in range(len(means)):
                centroids.append(means[c])
                parent.append(at)
                first.append(-1)
                last.append(-1)
                rows_of.append(np.zeros(0, int))
                todo.append((len(centroids) - 1, rows[cell == c], depth + 1))
            last[at] = len(centroids)
        return {"centroids": np.array(centroids), "parent": np.array(parent), "first": np.array(first), "last": np.array(last), "row_ends": np.cumsum([len(r) for r in rows_of]), "rows": np.concatenate(rows_of)}

    def _split(self, x: np.ndarray, metric: str, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
        """Centroids and cells, or None if the items can't be told apart."""
        chosen = [x[rng.integers(len(x))]]
        d = np.maximum(distances(metric, np.array(chosen), x)[0], 0)
        while len(chosen) < max(2, self.split_factor) and d.sum() > 0:
            chosen.append(x[rng.choice(len(x), p=d / d.sum())])
            d = np.minimum(d, np.maximum(distances(metric, np.array(chosen[-1:]), x)[0], 0))
        means, before = np.array(chosen), math.inf
        for _ in range(self.max_rounds):
            dist = distances(metric, x, means)
            cell = dist.argmin(1)
            total = dist[np.arange(len(x)), cell].sum()
            for c in range(len(means)):
                if (cell == c).any():
                    means[c] = x[cell == c].mean(0)
            if abs(before - total) <= self.tolerance * max(total, 1e-12):
                break
            before = total
        used, cell = np.unique(cell, return_inverse=True)
        return (means[used], cell) if len(used) > 1 else None

    def candidates(self, s: dict, q: np.ndarray, k: int) -> np.ndarray:
        """Items of the nearest cells and of those within a tenth of the nearest, then of the others, up to the cap."""
        breadth = max(1, self.split_factor // 5)
        most = max(k, self.max_candidates or breadth * self.max_cell_items)
        todo, seen, n = [(False, 0.0, 0)], [], 0
        while todo and n < most:
            later, _, at = heapq.heappop(todo)
            if s["first"][at] < 0:
                seen.append(s["rows"][s["row_ends"][at - 1] if at else 0 : s["row_ends"][at]])
                n += len(seen[-1])
                continue
            kids = np.arange(s["first"][at], s["last"][at])
            d = distances(s["_metric"], q[None], s["centroids"][kids])[0]
            order = np.argsort(d, kind="stable")
            for r, i in enumerate(order):
                near = r < breadth or (d[order[0]] > 0 and (d[i] - d[order[0]]) / d[order[0]] < 0.1)
                heapq.heappush(todo, (bool(later or not near), float(d[i]), int(kids[i])))
        return np.concatenate(seen) if seen else np.zeros(0, int)


class Near:
    """Distances of a query to rows of x, as a walk needs them: a look-up and a product for some rows at a time."""

    def __init__(self, x: np.ndarray, metric: str):
        self.metric, self.rows = metric, x
        if metric == "euclidean":  # d * d = |q|^2 + 2 * (|x|^2 / 2 - qx)
            self.rows = np.append(x, (x * x).sum(1)[:, None] / 2, 1)
        elif metric != "manhattan":
            with np.errstate(divide="ignore", invalid="ignore"):
                self.rows = x / np.sqrt((x * x).sum(1))[:, None]

    def ask(self, q: np.ndarray) -> Near:
        """self, set on the query q."""
        self.add = float(q @ q)
        if self.metric == "euclidean":
            self.q = np.append(-q, 1.0)
        elif self.metric == "manhattan":
            self.q = q
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                self.q = q / np.sqrt(self.add) if self.metric == "cosine" else -q / np.sqrt(self.add)
        return self

    def keys(self, some: list[int]) -> np.ndarray:
        """Numbers that order rows as their distances do."""
        rows = self.rows.take(some, 0)
        return np.abs(rows - self.q).sum(1) if self.metric == "manhattan" else rows @ self.q

    def distances(self, keys: list[float]) -> list[float]:
        k = np.array(keys)
        if self.metric == "euclidean":
            return np.sqrt(np.maximum(2 * k + self.add, 0)).tolist()
        return (1 + k if self.metric == "cosine_distance" else k).tolist()


@dataclass
class Graph:
    """A hierarchy of neighbour graphs: greedy descent, then a beam of width ef on the lowest level."""

    m: int = 16
    ef: int = 20
    ef_construction: int = 200
    level_multiplier: float = -1.0
    m_max: int = -1
    m_max_0: int = -1
    select: str = "simple"
    kind: str = "hnsw"

    def __post_init__(self):
        if self.select not in ("simple", "heuristic", "diverse"):
            raise ValueError("select is simple, heuristic or diverse")
        self.level_multiplier = self.level_multiplier if self.level_multiplier >= 0 else 1 / math.log(max(self.m, 2))
        self.m_max = self.m_max if self.m_max >= 0 else self.m
        self.m_max_0 = self.m_max_0 if self.m_max_0 >= 0 else 2 * self.m

    def build(self, x: np.ndarray, metric: str, rng: np.random.Generator) -> dict[str, np.ndarray]:
        n = len(x)
        levels = np.floor(-np.log(1 - rng.random(n)) * self.level_multiplier).astype(int)
        if n:
            levels[0] = 0
        links: list[dict[int, dict[int, float]]] = [{} for _ in range(n)]
        entry, top = 0, 0
        far = Near(x, metric)
        for v in range(n):
            for level in range(levels[v] + 1):
                links[v][level] = {}
            if not v:
                continue
            at, to = entry, far.ask(x[v])
            for level in range(top, levels[v], -1):
                at = self._greedy(links, to, at, level)
            for level in range(min(top, levels[v]), -1, -1):
                found = self._beam(links, to, at, level, self.ef_construction)
                chosen = self._choose(links, x, metric, v, found, level)
                for d, u in chosen:
                    links[v][level][u] = d
                    links[u][level][v] = d
                    most = self.m_max if level else self.m_max_0
                    if len(links[u][level]) > most:
                        kept = self._choose(links, x, metric, u, sorted((d, w) for w, d in links[u][level].items()), level, most)
                        links[u][level] = {w: d for d, w in kept}
                at = found[0][1]
            if levels[v] > top:
                entry, top = v, int(levels[v])
        src, dst, lev, dist = [], [], [], []
        for v in range(n):
            for level, near in links[v].items():
                for u, d in near.items():
                    src.append(v), dst.append(u), lev.append(level), dist.append(d)
        return {"levels": levels, "entry": np.array([entry, top]), "src": np.array(src, int), "dst": np.array(dst, int), "level": np.array(lev, int), "distance": np.array(dist, float)}

    def _choose(self, links, x, metric, v, found, level, most=None) -> list[tuple[float, int]]:
        most = most or self.m
        found = [(d, u) for d, u in found if u != v]
        if self.select == "heuristic":  # two hops count as candidates too
            more = {w for _, u in found for w in links[u].get(level, {})} - {u for _, u in found} - {v}
            if more:
                more = sorted(more)
                found = sorted([*found, *zip(distances(metric, x[v][None], x[more])[0].tolist(), more, strict=True)])
        if self.select != "diverse":
            return found[:most]
        kept: list[tuple[float, int]] = []
        for d, u in found:  # keep what is nearer to the vertex than to all that is kept
            if len(kept) < most and (not kept or (distances(metric, x[u][None], x[[w for _, w in kept]])[0] >= d).all()):
                kept.append((d, u))
        rest = [c for c in found if c not in kept]
        return (kept + rest)[:most]

    @staticmethod
    def _greedy(links, to: Near, at: int, level: int) -> int:
        best = to.keys([at])[0]
        while near := list(links[at].get(level, ())):
            d = to.keys(near)
            i = int(d.argmin())
            if d[i] >= best:
                break
            best, at = d[i], near[i]
        return at

    @staticmethod
    def _beam(links, to: Near, entry: int, level: int, ef: int) -> list[tuple[float, int]]:
        """The ef nearest vertices that the walk meets, ascending."""
        first = float(to.keys([entry])[0])
        ahead, kept, seen, full = [(first, entry)], [(-first, entry)], {entry}, ef <= 1
        while ahead:
            a, at = heapq.heappop(ahead)
            if full and a > -kept[0][0]:
                break
            near = [u for u in links[at].get(level, ()) if u not in seen]
            if not near:
                continue
            seen.update(near)
            worst = -kept[0][0]
            for b, u in zip(to.keys(near).tolist(), near, strict=True):
                if not full:
                    heapq.heappush(ahead, (b, u))
                    heapq.heappush(kept, (-b, u))
                    full, worst = len(kept) >= ef, -kept[0][0]
                elif b < worst:
                    heapq.heappush(ahead, (b, u))
                    heapq.heapreplace(kept, (-b, u))
                    worst = -kept[0][0]
        order = sorted((-a, u) for a, u in kept)
        return list(zip(to.distances([a for a, _ in order]), [u for _, u in order], strict=True))

    def walk(self, s: dict) -> list[dict[int, list[int]]]:
        links: list[dict[int, list[int]]] = [{} for _ in s["levels"]]
        for a, b, level in zip(s["src"].tolist(), s["dst"].tolist(), s["level"].tolist(), strict=True):
            links[a].setdefault(level, []).append(b)
        return links

    def candidates(self, s: dict, q: np.ndarray, k: int) -> np.ndarray:
        if not len(s["levels"]):
            return np.zeros(0, int)
        if "_links" not in s:
            s["_links"], s["_near"] = self.walk(s), Near(s["_x"], s["_metric"])
        at, top = (int(v) for v in s["entry"])
        to = s["_near"].ask(q)
        for level in range(top, 0, -1):
            at = self._greedy(s["_links"], to, at, level)
        return np.array([u for _, u in self._beam(s["_links"], to, at, 0, max(self.ef, k))], int)


KINDS = {"btree": Forest, "voronoi": CellTree, "hnsw": Graph}


def _pack(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return dict(z)


@dataclass
class VectorIndex:
    """An index over all partitions: a table of one row a partition, with its vectors and its structure."""

    config: Forest | CellTree | Graph
    metric: str
    size: int
    rows: DataFrame = field(repr=False)

    @classmethod
    def fit(cls, items: DataFrame, config: Forest | CellTree | Graph, size: int, metric: str = "euclidean", seed: int = 0, partition_rows: int = PARTITION_ROWS) -> VectorIndex:
        """Index all items (id, vector, maybe partition_id); rows of another dimension are skipped.

        Without partition_id, items are dealt by a hash of their id to as many partitions as partition_rows asks for.
        """
        good = items.where(F.size("vector") == size)
        if "partition_id" not in items.columns:
            n = max(1, -(-good.count() // partition_rows))
            good = good.withColumn("partition_id", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartitionById(n, "partition_id")

        def build(group: pd.DataFrame) -> pd.DataFrame:
            # Of an id that is there more than once, the smallest vector is taken in, whatever order rows come in.
            if group["id"].duplicated().any():
                group = group.assign(_by=group["vector"].map(tuple)).sort_values(["id", "_by"]).drop_duplicates("id")
            group = group.sort_values("id")
            x = np.array(group["vector"].tolist(), float)
            part = int(group["partition_id"].iloc[0])
            arrays = config.build(x, metric, np.random.default_rng([seed, part & 0xFFFFFFFF]))
            return pd.DataFrame({"partition_id": [part], "n": [len(x)], "data": [_pack({**arrays, "_ids": group["id"].to_numpy(), "_vectors": x.astype("f4")})]})

        rows = good.select("id", "vector", F.col("partition_id").cast("int").alias("partition_id")).groupBy("partition_id").applyInPandas(build, INDEX_SCHEMA)
        return cls(config, metric, size, rows)

    def persist(self) -> VectorIndex:
        self.rows = self.rows.persist()
        return self

    def search(self, queries: DataFrame, k: int, partitions: list[int] | None = None) -> DataFrame:
        """(query_id, id, distance, rank, scanned): ascending by distance; scanned: items measured for the query."""
        if k < 0:
            raise ValueError("k is negative")
        rows = self.rows if partitions is None else self.rows.where(F.col("partition_id").isin(*partitions))
        spark, config, metric, found = rows.sparkSession, self.config, self.metric, None
        for block in query_blocks(queries):
            shared = spark.sparkContext.broadcast(block)

            def ask(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                qid, qs = shared.value
                for frame in frames:
                    for part, data in zip(frame["partition_id"], frame["data"], strict=True):
                        s = _unpack(data)
                        ids, x = s["_ids"], s["_vectors"].astype(float)
                        s |= {"_x": x, "_metric": metric}
                        out = []
                        for name, q in zip(qid.tolist(), qs, strict=True):
                            some = config.candidates(s, q, k)
                            d = distances(metric, q[None], x[some])
                            best = nearest(d, ids[some], k)[0]
                            out += [(name, int(ids[some[i]]), float(d[0, i]), 0 if at else len(some)) for at, i in enumerate(best)]
                        yield pd.DataFrame(out, columns=["query_id", "id", "distance", "scanned"])

            part = rows.select("partition_id", "data").mapInPandas(ask, "query_id long, id long, distance double, scanned long")
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = spark.createDataFrame([], "query_id long, id long, distance double, scanned long")
        # Both come of one pass: the first row of a partition's answer has what was measured for the query there.
        both = found.selectExpr("query_id", "id", "distance", "row_number() over (partition by query_id order by distance, id) as rank", "sum(scanned) over (partition by query_id) as scanned")
        return both.where(F.col("rank") <= k)

    def leaves(self) -> DataFrame:
        """(partition_id, tree, leaf, id) of a forest, or of the cells of a tree."""
        kind = self.config.kind

        def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for part, data in zip(frame["partition_id"], frame["data"], strict=True):
                    s = _unpack(data)
                    ends, rows = (s["leaf_ends"], s["leaf_rows"]) if kind == "btree" else (s["row_ends"], s["rows"])
                    leaf = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
                    tree = np.zeros(len(rows), int)
                    if kind == "btree":
                        node = np.argsort(s["leaf_of"], kind="stable")[-len(ends) :]
                        tree = (np.searchsorted(s["roots"], node, side="right") - 1)[leaf]
                    yield pd.DataFrame({"partition_id": part, "tree": tree, "leaf": leaf, "id": s["_ids"][rows]})

        return self.rows.select("partition_id", "data").mapInPandas(spread, "partition_id int, tree long, leaf long, id long")

    def edges(self) -> DataFrame:
        """(partition_id, level, src, dst, distance) of a graph."""

        def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for part, data in zip(frame["partition_id"], frame["data"], strict=True):
                    s = _unpack(data)
                    yield pd.DataFrame({"partition_id": part, "level": s["level"], "src": s["_ids"][s["src"]], "dst": s["_ids"][s["dst"]], "distance": s["distance"]})

        return self.rows.select("partition_id", "data").mapInPandas(spread, "partition_id int, level int, src long, dst long, distance double")

    def describe(self) -> dict:
        return {"kind": self.config.kind, "metric": self.metric, "size": self.size, "options": {k: v for k, v in asdict(self.config).items() if k != "kind"}}

    def save(self, path: str) -> None:
        """Parquet rows, and one line of JSON that says what they are."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        spark = self.rows.sparkSession
        spark.createDataFrame([(json.dumps(self.describe()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        return cls(KINDS[about["kind"]](**about["options"]), about["metric"], about["size"], spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/rows"))
