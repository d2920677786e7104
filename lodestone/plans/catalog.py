"""Datasets: files split into partitions, each with an index that is loaded if it was built before."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.indexes import INDEX_SCHEMA, KINDS, VectorIndex
from lodestone.operators.search import knn_join
from lodestone.sources.items import accept, delete_path, exists, list_files, publish, read_items, seconds_old, write_file


class DatasetNotFound(LookupError):
    pass


class DatasetExists(ValueError):
    pass


class PartitionNotFound(LookupError):
    pass


@dataclass
class Dataset:
    """What is known of a dataset. index: kind, and the options of that kind of index."""

    name: str
    path: str
    num_partitions: int
    size: int
    metric: str = "euclidean"
    num_replicas: int = 1
    index: str = "hnsw"
    options: str = "{}"
    format: str = "csv"


def plan_partitions(files: DataFrame, n: int) -> DataFrame:
    """(file, partition_id): sorted files in n even runs, the last of which takes what is left."""
    ranked = files.selectExpr("file", "row_number() over (order by file) - 1 as place", "count(*) over () as total")
    return ranked.select("file", F.least(F.floor(F.col("place") / F.floor(F.col("total") / n)), F.lit(n - 1)).cast("int").alias("partition_id"))


def index_key(name: str, partition_id: int, files: list[str]) -> str:
    return hashlib.sha256(".".join([name, str(partition_id), *sorted(files)]).encode()).hexdigest()


class Catalog:
    """Datasets and the indexes of their partitions, under a folder.

    A dataset is one file, which holds its partitions too and gets its name when it is whole, so a dataset is there with
    all of them or not at all. An index belongs to one partition and its files; it too gets its name when it is whole.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, lease: float = 600):
        """lease: seconds for which one session waits for another that builds the same dataset's indexes."""
        self.spark = spark
        self.root = root or spark.conf.get("spark.lodestone.indices.path", None)
        if not self.root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.lodestone.indices.path to a folder that all executors share")
            self.root = "/tmp/lodestone"
        self.lease = lease
        self.loaded: dict[str, VectorIndex] = {}

    def _entry(self, name: str) -> str:
        return f"{self.root}/datasets/{hashlib.sha256(name.encode()).hexdigest()}.json"

    def _entries(self, path: str) -> list[dict]:
        if not exists(self.spark, path):
            return []
        return [json.loads(r[0]) for r in self.spark.read.text(path).collect()]  # of datasets, not of items

    def _store(self, dataset: Dataset, partitions: list[dict], replace: bool) -> bool:
        draft = f"{self.root}/drafts/{uuid.uuid4().hex}"
        write_file(self.spark, draft, json.dumps({"dataset": asdict(dataset), "partitions": partitions}))
        stored = publish(self.spark, draft, self._entry(dataset.name), replace)
        if not stored:
            delete_path(self.spark, draft)
        return stored

    def list(self) -> list[Dataset]:
        return sorted((Dataset(**e["dataset"]) for e in self._entries(f"{self.root}/datasets/*.json")), key=lambda d: d.name)

    def as_table(self) -> DataFrame:
        fields = {"int": T.IntegerType(), "str": T.StringType()}
        schema = T.StructType([T.StructField(n, fields[f.type]) for n, f in Dataset.__dataclass_fields__.items()])
        return self.spark.createDataFrame([tuple(asdict(d).values()) for d in self.list()], schema)

    def _find(self, name: str) -> dict:
        for entry in self._entries(self._entry(name)):
            return entry
        raise DatasetNotFound(name)

    def get(self, name: str) -> Dataset:
        return Dataset(**self._find(name)["dataset"])

    def create(self, dataset: Dataset) -> None:
        if exists(self.spark, self._entry(dataset.name)):
            raise DatasetExists(dataset.name)
        if dataset.index not in KINDS:
            raise ValueError(f"unknown index {dataset.index!r}; there are {', '.join(KINDS)}")
        files = list_files(self.spark, dataset.path)
        if not 0 < dataset.num_partitions <= len(files):
            raise ValueError(f"{len(files)} files do not make {dataset.num_partitions} partitions")
        planned = plan_partitions(self.spark.createDataFrame([(f,) for f in files], "file string"), dataset.num_partitions)
        parts: dict[int, list[str]] = {}
        for f, p in planned.collect():
            parts.setdefault(p, []).append(f)
        if not self._store(dataset, [{"id": p, "files": sorted(fs)} for p, fs in sorted(parts.items())], replace=False):
            raise DatasetExists(dataset.name)  # by another session, meanwhile

    def refresh(self, name: str) -> None:
        """Follow the files: those that went leave their partition, those that came make a new one. Partitions whose files
        stayed keep their index."""
        dataset, before = self.get(name), self.partitions(name)
        files = set(list_files(self.spark, dataset.path))
        after = [p | {"files": [f for f in p["files"] if f in files]} for p in before]
        came = sorted(files - {f for p in before for f in p["files"]})
        after = [p for p in after if p["files"]] + ([{"id": max(p["id"] for p in before) + 1, "files": came}] if came else [])
        dataset.num_partitions = len(after)
        self.unload(name)
        self._store(dataset, after, replace=True)
        for path in {self._index_path(name, p) for p in before} - {self._index_path(name, p) for p in after}:
            delete_path(self.spark, path)

    def delete(self, name: str) -> None:
        """Forget a dataset, first its entry, then its indexes, so that a failure leaves nothing listed."""
        paths = [self._index_path(name, p) for p in self.partitions(name)]
        self.unload(name)
        for path in [self._entry(name), *paths]:
            delete_path(self.spark, path)

    def partitions(self, name: str) -> list[dict]:
        return self._find(name)["partitions"]

    def items(self, name: str, partitions: list[int] | None = None) -> DataFrame:
        """(partition_id, id, vector) that the indexes take in: in each partition the first of an id, of the right size."""
        dataset = self.get(name)
        pairs = [(f, p["id"]) for p in self.partitions(name) for f in p["files"] if partitions is None or p["id"] in partitions]
        where = self.spark.createDataFrame(pairs, "file string, partition_id int")
        found = read_items(self.spark, [f for f, _ in pairs], dataset.format)
        tail = lambda c: F.regexp_replace(c, "^file:/*", "/")
        placed = found.withColumn("file", tail(F.col("file"))).withColumn("line", F.monotonically_increasing_id()).join(F.broadcast(where.withColumn("file", tail(F.col("file")))), "file")
        return accept(placed, dataset.size, ["file", "line"], ["partition_id"]).select("partition_id", "id", "vector")

    def _index_path(self, name: str, partition: dict) -> str:
        return f"{self.root}/indexes/{index_key(name, partition['id'], partition['files'])}"

    @contextmanager
    def _building(self, name: str) -> Iterator[None]:
        """Hold the dataset's lock, once no other session has held it for less than the lease."""
        lock = f"{self.root}/locks/{hashlib.sha256(name.encode()).hexdigest()}"
        while not write_file(self.spark, lock, "building"):
            age = seconds_old(self.spark, lock)
            if age is not None and age > self.lease:
                delete_path(self.spark, lock)
            else:
                time.sleep(1)
        try:
            yield
        finally:
            delete_path(self.spark, lock)

    def build(self, name: str) -> list[int]:
        """Build the indexes that partitions lack, all in one job, and return those partitions."""
        lacking = lambda: [p for p in self.partitions(name) if not exists(self.spark, self._index_path(name, p))]
        if not lacking():
            return []
        with self._building(name):
            missing = lacking()  # another session may have built them meanwhile
            if not missing:
                return []
            dataset, draft = self.get(name), f"{self.root}/drafts/{uuid.uuid4().hex}"
            made = VectorIndex.fit(self.items(name, [p["id"] for p in missing]), KINDS[dataset.index](**json.loads(dataset.options)), dataset.size, dataset.metric)
            made.rows.withColumn("folder", F.col("partition_id")).write.partitionBy("folder").parquet(draft)
            for p in missing:
                if exists(self.spark, f"{draft}/folder={p['id']}"):
                    publish(self.spark, f"{draft}/folder={p['id']}", self._index_path(name, p))
                else:  # a partition without items
                    write_file(self.spark, f"{self._index_path(name, p)}/_empty", "")
            delete_path(self.spark, draft)
            return [p["id"] for p in missing]

    def index(self, name: str) -> VectorIndex:
        """The dataset's index: partitions' indexes are read if they were built under the same files, else built and kept."""
        if name not in self.loaded:
            self.build(name)
            dataset = self.get(name)
            rows = self.spark.read.schema(INDEX_SCHEMA).parquet(*(self._index_path(name, p) for p in self.partitions(name)))
            self.loaded[name] = VectorIndex(KINDS[dataset.index](**json.loads(dataset.options)), dataset.metric, dataset.size, rows).persist()
        return self.loaded[name]

    def unload(self, name: str | None = None) -> None:
        for n in [name] if name else list(self.loaded):
            if n in self.loaded:
                self.loaded.pop(n).rows.unpersist()

    def search(self, name: str, queries: DataFrame, k: int, partitions: list[int] | None = None, exact: bool = False) -> DataFrame:
        """(query_id, id, distance, rank, ...) of the k nearest items of every query."""
        dataset = self.get(name)
        known = {p["id"] for p in self.partitions(name)}
        if partitions is not None and not set(partitions) <= known:
            raise PartitionNotFound(f"{sorted(set(partitions) - known)} of {name}")
        if exact:
            items = self.items(name)
            return knn_join(items if partitions is None else items.where(F.col("partition_id").isin(*partitions)), queries, k, dataset.metric)
        return self.index(name).search(queries, k, partitions)
