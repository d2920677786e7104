"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, broadcast_below, checkpoint, discard, read_table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, KGRAM = 8, 4


def item_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != F.lit(""))


def _kgrams(w: str, k: int) -> Column:
    """Hash of the k words from each position on; none if there are fewer words."""
    last = F.size(w) - k
    at = lambda i: F.xxhash64(*(F.get(w, i + d) for d in range(k)), F.lit(k))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), at)).otherwise(F.array().cast("array<bigint>"))


def _minima(kg: str, width: int) -> Column:
    """The distinct minima of each window of `width` k-gram hashes: winnowing."""
    last = F.size(kg) - width
    low = lambda i: F.least(*(F.get(kg, i + d) for d in range(width))) if width > 1 else F.get(kg, i)
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), low))).otherwise(F.array().cast("array<bigint>"))


def _run(left: str, right: str, length: int) -> Column:
    """How many leading elements of two arrays are equal; arrays may be shorter than `length`."""
    out = F.lit(length)
    for i in reversed(range(length)):
        out = F.when(F.coalesce(F.get(left, F.lit(i)) == F.get(right, F.lit(i)), F.lit(False)), out).otherwise(i)
    return out


def _context(w: str, pos: Column, k: int, reach: int) -> list[Column]:
    """The k words at pos, up to `reach` words before it (nearest first) and after them."""
    before = F.reverse(F.slice(w, F.greatest(pos - reach, F.lit(0)) + 1, F.least(pos, F.lit(reach))))
    return [F.slice(w, pos + 1, F.lit(k)).alias("core"), before.alias("before"), F.slice(w, pos + k + 1, F.lit(reach)).alias("after")]


def hits(docs: DataFrame, items: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """(doc_id, text_hash, item_id, lo, hi): document words lo..hi-1 lie in windows that the item has.

    docs: doc_id, text_hash, text. items: item_id, w, n: windows of n words are looked for, n one of the lengths. Both
    sides keep the smallest k-gram hash of every n - k + 1 adjacent ones (of n words if these are fewer than k), so two
    equal windows of n words share a fingerprint. The documents' words are split once for all lengths. Only documents
    that share a fingerprint are looked at again: there each k-gram of a shared hash is compared word by word and
    extended by up to n - k words on either side, which covers every window that holds it.
    """
    gram = {n: min(k, n) for n in lengths}
    reach = max(n - gram[n] for n in lengths)
    sizes = sorted(set(gram.values()))
    grams = lambda df, *more: df.select(*more, "w", *(_kgrams("w", g).alias(f"kg{g}") for g in sizes))
    each = lambda f: F.flatten(F.array(*(f(n, gram[n], F.lit(n)) for n in lengths)))
    held = lambda x, n: F.exists("hs", lambda y: (y["n"] == n) & (y["h"] == x))

    known = None
    for n in lengths:
        g = gram[n]
        part = items.where(F.col("n") == n).select("item_id", "w", _kgrams("w", g).alias("kg"))
        part = part.select("item_id", "w", "kg", _minima("kg", n - g + 1).alias("mins")).select("item_id", "w", F.posexplode("kg").alias("ipos", "h"), "mins").where(F.array_contains("mins", F.col("h")))
        part = part.select(F.lit(n).alias("n"), "item_id", "h", *_context("w", F.col("ipos"), g, n - g))
        known = part if known is None else known.union(part)
    known = checkpoint(known.distinct())
    hashes = checkpoint(known.select("n", "h").distinct())
    words = docs.select("doc_id", "text_hash", item_words(F.col("text")).alias("w"))
    minima = each(lambda n, g, name: F.transform(_minima(f"kg{g}", n - g + 1), lambda h: F.struct(name.alias("n"), h.alias("h"))))
    prints = grams(words, "doc_id", "text_hash").select("doc_id", "text_hash", F.explode(minima).alias("e")).select("doc_id", "text_hash", "e.n", "e.h")
    shared = checkpoint(prints.join(broadcast_below(hashes), ["n", "h"]).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("n", "h")).alias("hs")))
    marked = broadcast_below(shared.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}))
    again = docs.join(marked, docs.doc_id.eqNullSafe(F.col("d")) & (docs.text_hash == F.col("t")))
    again = grams(again.select("doc_id", "text_hash", item_words(F.col("text")).alias("w"), "hs"), "doc_id", "text_hash", "hs")

    def spots(n: int, g: int, name: Column) -> Column:
        places = F.filter(F.transform(f"kg{g}", lambda h, i: F.when(held(h, n), i)), lambda i: i.isNotNull())
        return F.transform(places, lambda i: F.struct(name.alias("n"), F.lit(g).alias("g"), i.alias("pos"), F.get(f"kg{g}", i).alias("h"), *_context("w", i, g, n - g)))

    near = again.select("doc_id", "text_hash", F.explode(each(spots)).alias("s"))
    near = near.select("doc_id", "text_hash", "s.n", "s.g", "s.pos", "s.h", F.col("s.core").alias("c"), F.col("s.before").alias("b"), F.col("s.after").alias("a"))
    met = near.join(broadcast_below(known), ["n", "h"]).where(F.col("c") == F.col("core"))
    grown = met.select("doc_id", "text_hash", "item_id", "n", "g", "pos", _run("b", "before", reach).alias("l"), _run("a", "after", reach).alias("r"))
    found = grown.where(F.col("l") + F.col("g") + F.col("r") >= F.col("n")).select("doc_id", "text_hash", "item_id", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("g") + F.col("r")).alias("hi"))
    out = checkpoint(found.distinct())
    discard(known, hashes, shared)
    return out


def windows_found(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = KGRAM) -> DataFrame:
    """hits() of all items: of `span` words, or of the whole item where it has fewer. No items give no rows.

    Null and empty texts have no words, and an item without words has no window. Items that share an item_id are one;
    a null item_id reads as the empty string. Documents of equal doc_id are told apart by text_hash, XXH64 of the text.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = checkpoint(items.withColumn("n", F.least(F.size("w"), F.lit(span))))
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # span values at most
    if not lengths:
        return base.where("false").select("doc_id", "text_hash", F.lit("").alias("item_id"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    out = hits(base, items, lengths, k)
    discard(items)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = KGRAM, min_items: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_items >= min_items).

    What windows_found() says of nulls and empty texts holds. Repeated documents give repeated rows. An empty benchmark
    leaves every document clean, no documents give no rows. Other columns play no part.
    """
    found = windows_found(docs, benchmark, span, k)
    places = found.select("doc_id", "text_hash", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos")).distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_hit"))
    names = found.select("doc_id", "text_hash", "item_id").distinct().groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    same = lambda x, y: x.doc_id.eqNullSafe(y.doc_id) & (x.text_hash == y.text_hash)
    both = checkpoint(places.where("n_hit > 0").join(names, same(places, names)).select(places.doc_id.alias("d"), places.text_hash.alias("t"), "n_hit", "n_items", "ids"))
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(item_words(F.col("text"))).cast("bigint").alias("n_words"))
    out = counted.join(broadcast_below(both), counted.doc_id.eqNullSafe(F.col("d")) & (counted.text_hash == F.col("t")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_items", F.lit(0)) >= min_items).alias("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination() of all documents by all items of the benchmark."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH ws AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(list_slice(w, i, i + least(len(w), 8) - 1), ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM ws, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hit AS (SELECT g.doc_id, g.i, g.n, x.item_id FROM grams g JOIN wins x ON g.n = x.n AND g.s = x.s),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT ws.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM ws LEFT JOIN places USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
