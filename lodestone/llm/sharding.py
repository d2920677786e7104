"""Placement by a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import checkpoint, read_table

BASE_SHARDS, RACKS_PER_REGION, SHARDS_PER_RACK = 16, 2, 2
#: Rows that one slot bucket holds on average; slots are numbered bucket by bucket.
BUCKET_ROWS = 50_000


def topology(shards: int, base: int = BASE_SHARDS, weights: dict[int, float] | None = None) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight. The first `base` shards fill regions of racks; every later one opens a region.

    A shard weighs 1 unless `weights` says otherwise, a node as much as all below it; what weighs nothing gets no rows.
    As a later shard brings a region of its own, growth changes no weight inside the old regions, and so moves rows into
    the new shard only. A shard of another weight moves rows between its region and the others, within its region
    between its rack and the others, and within its rack between itself and the others; all else stays.
    """
    weights = weights or {}
    if any(w < 0 for w in weights.values()) or not any(weights.get(s, 1.0) > 0 for s in range(shards)):
        raise ValueError("weights are not negative, and some shard has one")
    tree: dict[int, dict[int, dict[int, float]]] = {}
    per_region = RACKS_PER_REGION * SHARDS_PER_RACK
    first_new = -(-min(base, shards) // per_region)
    for s in range(shards):
        region, rack = (s // per_region, s % per_region // SHARDS_PER_RACK) if s < base else (first_new + s - base, 0)
        if weights.get(s, 1.0) > 0:
            tree.setdefault(region, {}).setdefault(rack, {})[s] = float(weights.get(s, 1.0))
    return tree


def _draw(key: Column, level: str, names: dict[int, float]) -> Column:
    """The name with the smallest weighted exponential draw -ln(u) / weight; u comes from the key, level and name."""
    if len(names) == 1:
        return F.lit(next(iter(names)))

    def score(name: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / weight).alias("draw"), F.lit(name).alias("name"))

    return F.least(*(score(n, w) for n, w in names.items()))["name"]


def shard_of(key: Column, shards: int, base: int = BASE_SHARDS, weights: dict[int, float] | None = None) -> Column:
    """Descend regions, racks and shards by weighted draws. A null key is a key like any other."""
    tree = topology(shards, base, weights)
    weigh = lambda node: sum(weigh(x) if isinstance(x, dict) else x for x in node.values())

    def descend(node: dict, path: str) -> Column:
        kids = {name: weigh(x) if isinstance(x, dict) else x for name, x in node.items()}
        chosen = _draw(key, path, kids)
        if not isinstance(next(iter(node.values())), dict):
            return chosen
        names = list(node)
        below = {n: descend(node[n], f"{path}/{n}") for n in names}
        out = below[names[-1]]
        for n in reversed(names[:-1]):
            out = F.when(chosen == n, below[n]).otherwise(out)
        return out

    return descend(tree, "root")


def place(docs: DataFrame, shards: int = BASE_SHARDS, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, by doc_id and the shards' weights alone.

    Null and empty texts have size 1 and the checksum 0. Rows with equal doc_id, null included, share a shard and keep
    slots of their own. Slots count from 0 without gaps in each shard, in hash buckets of about BUCKET_ROWS rows, so no
    task sorts a whole shard. The text itself is never shuffled. An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), shard_of(F.col("doc_id"), shards, weights=weights).cast("int").alias("shard"), shard_of(F.col("doc_id"), shards + 1, weights=weights).cast("int").alias("grown_shard"))
    rows = checkpoint(rows)
    buckets = max(1, -(-rows.count() // (shards * BUCKET_ROWS))) * 4
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("slot"), "text_crc32"), F.lit(buckets)).cast("int"))
    before = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).selectExpr("shard", "bucket", "sum(n) over (partition by shard order by bucket) - n as before")
    numbered = rows.selectExpr("*", "row_number() over (partition by shard, bucket order by doc_id, text_crc32, size) - 1 as within")
    return numbered.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("within")).cast("bigint").alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place() of all documents in 16 shards of equal weight."""
    return place(read_table(spark, sf_dir, "documents"))
