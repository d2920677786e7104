"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, checkpoint, read_table, words_of
from lodestone.llm.graph import connected_components

BITS = 64


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, times, fp): SimHash of the XXH64 hashes (seed 42) of all word shingles, repeats included.

    A text with fewer words than a shingle is one shingle; null and empty texts, and texts of white space, have the
    fingerprint zero. Rows that repeat (doc_id, text) count once more, which changes no majority; they give one row, and
    times says how many they are.
    """
    words = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(ascii_lower(F.col("text"))).alias("w"))
    w = F.col("w")
    n = F.size(w)
    slid = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + k) for k in range(shingle)))))
    hashes = F.when(n == 0, F.array().cast("array<bigint>")).when(n < shingle, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(slid)
    rows = words.select("doc_id", "text_hash", F.posexplode_outer(hashes).alias("i", "h"))
    # Two 32-bit lanes in each sum: bits k and k + 32.
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit((1 << 32) | 1))).alias(f"s{k}") for k in range(32)]
    summed = rows.groupBy("doc_id", "text_hash").agg(F.count("h").alias("n"), F.count(F.when(F.coalesce("i", F.lit(0)) == 0, 1)).alias("times"), *lanes)
    fp = F.lit(0).cast("bigint")
    for bit in range(BITS):
        lane = F.col(f"s{bit % 32}")
        ones = lane.bitwiseAND(F.lit(0xFFFFFFFF)) if bit < 32 else F.shiftrightunsigned(lane, 32)
        fp = fp.bitwiseOR(F.when(2 * ones > F.col("n"), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return summed.select("doc_id", "text_hash", "times", fp.alias("fp"))


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of blocks - distance of the blocks: two fingerprints within the distance agree under at least one."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def link_components(fps: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, component): components of the distinct fingerprints fp that link at `distance` or fewer differing bits.

    Candidates share blocks - distance of the blocks. Within such a bucket every member is first held against the
    smallest and the largest one, which are as many pairs as members. Only buckets that still hold several
    components go on: there, members outside the bucket's largest component meet the rest of the bucket, with the
    distance tested inside the join, so a group of near copies never becomes all its pairs, yet no link is lost.
    """
    spark = fps.sparkSession
    masks = spark.createDataFrame([(i, m) for i, m in enumerate(block_masks(blocks, distance))], "k int, mask long")
    keys = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("v")) for k, m in enumerate(r["mask"] for r in masks.collect())))).alias("e")).select("fp", "e.k", "e.v")
    shared = keys.groupBy("k", "v").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    rows = checkpoint(keys.join(shared, ["k", "v"]).select("k", "v", "fp", "lo", "hi"))
    stars = rows.select("fp", F.explode(F.array("lo", "hi")).alias("pivot")).where((F.col("fp") != F.col("pivot")) & (_far("fp", "pivot") <= distance))
    first = checkpoint(connected_components(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b"))).withColumnRenamed("node", "fp"))
    named = rows.join(first, "fp", "left").select("k", "v", "fp", F.coalesce("component", "fp").alias("c"))
    mixed = named.groupBy("k", "v", "c").agg(F.count("*").alias("n")).groupBy("k", "v").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("n", "c")).alias("main")).where("parts > 1").select("k", "v", "main")
    left = checkpoint(named.join(mixed, ["k", "v"]))
    a = left.where("c <> main").select("k", "v", F.col("fp").alias("x"), F.col("c").alias("a"))
    b = left.select("k", "v", F.col("fp").alias("y"), F.col("c").alias("b"))
    meet = (F.col("a") != F.col("b")) & (_far("x", "y") <= distance)
    more = a.join(b, (a.k == b.k) & (a.v == b.v) & meet).select("a", "b").distinct()
    merged = connected_components(more).select(F.col("node").alias("c"), F.col("component").alias("c2"))
    final = fps.join(first, "fp", "left").select("fp", F.coalesce("component", "fp").alias("c")).join(merged, "c", "left")
    return final.select("fp", F.coalesce("c2", "c").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, text_hash, times, fp, component, component_id, n_links) of every different (doc_id, text); times: its rows."""
    prints = checkpoint(fingerprints(docs, shingle))
    kinds = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.sum("times").alias("copies"))
    groups = link_components(checkpoint(prints.select("fp").distinct()), distance, blocks)
    named = checkpoint(kinds.join(groups, "fp"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    out = named.join(ids, "component").select("fp", "component", "component_id", (F.col("copies") - 1).alias("n_links"))
    return prints.join(out, "fp")


def simhash_components(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), n_links.

    n_links is the number of other documents with the very same fingerprint. Documents with a null doc_id take
    part; a component of nothing else has a null id. An empty table gives an empty result. Repeated rows stay.
    Other columns of the table play no part.
    """
    rows = near_duplicates(docs, shingle, distance, blocks)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_t")).drop("_t")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_components() of all documents."""
    return simhash_components(read_table(spark, sf_dir, "documents"))
