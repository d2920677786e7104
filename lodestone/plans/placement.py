"""Which nodes own which partitions, where to send a search, and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.kernels import hash32
from lodestone.functions.murmur import rendezvous_score


def scores(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, uuid, score) of every key beside every node of a small table (uuid, maybe weight)."""
    weight = F.col("weight") if "weight" in nodes.columns else None
    met = keys.select("key").crossJoin(F.broadcast(nodes))
    return met.select("key", "uuid", rendezvous_score(F.col("uuid"), F.col("key"), weight).alias("score"))


def owners(keys: DataFrame, nodes: DataFrame, replicas: int) -> DataFrame:
    """(key, uuid, score, rank): each key's nodes of the highest scores; all nodes if there are fewer."""
    return scores(keys, nodes).selectExpr("*", "row_number() over (partition by key order by score desc, uuid) as rank").where(F.col("rank") <= replicas)


def rebalance(current: DataFrame, wanted: DataFrame, node: str) -> DataFrame:
    """(key, action) for one node: acquire what it should own and doesn't hold, release what it holds and shouldn't."""
    mine = wanted.where(F.col("uuid") == node).select("key")
    gain = mine.join(current.select("key"), "key", "left_anti").select("key", F.lit("acquire").alias("action"))
    return gain.union(current.select("key").join(mine, "key", "left_anti").select("key", F.lit("release").alias("action")))


def route(replicas: DataFrame, tag: str = "route") -> DataFrame:
    """(uuid, partitions): one replica of each partition (partition_id, uuid), and what each node is asked for."""
    h = hash32(tag, F.concat_ws("/", F.col("partition_id").cast("string"), F.col("uuid")))
    one = replicas.withColumn("h", h).selectExpr("*", "row_number() over (partition by partition_id order by h, uuid) as r").where("r = 1")
    return one.groupBy("uuid").agg(F.array_sort(F.collect_list("partition_id")).alias("partitions"))


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, event): created and deleted members between two snapshots."""
    new = after.select(key).join(before.select(key), key, "left_anti").select(key, F.lit("created").alias("event"))
    return new.union(before.select(key).join(after.select(key), key, "left_anti").select(key, F.lit("deleted").alias("event")))
