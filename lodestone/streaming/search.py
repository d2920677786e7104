"""Searches of a stream of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.indexes import VectorIndex
from lodestone.operators.search import knn_join


def search_stream(queries: DataFrame, against: VectorIndex | DataFrame, k: int, out: str, checkpoint: str, metric: str = "euclidean") -> StreamingQuery:
    """Answer each micro-batch of (query_id, vector) from an index, or exactly from items, into a Parquet folder.

    A batch writes a folder of its own, overwritten if it is run again, so each query is answered once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        found = against.search(batch, k) if isinstance(against, VectorIndex) else knn_join(against, batch, k, metric)
        found.select("query_id", "id", "distance", "rank").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
