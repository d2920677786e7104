"""Quality rules: counts of each text, and perplexity bands from a modified Kneser-Ney model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, broadcast_below, checkpoint, discard, read_table
from lodestone.llm.textcodes import chunks, code_points, mix64, rolling, words

#: Order of the model, and bits of a code point: an n-gram is two longs, (first three, last two), aligned to the right.
ORDER, BITS = 5, 21
SYMBOL_MARKS = "#*$%&|<>"
#: A kept text's log perplexity lies within BAND times the distance from its language's median to the quartile on that side.
BAND = 10.0
#: Characters that counting and scoring handle at once; a worker holds about 100 bytes for each.
BLOCK_CHARS = 1_000_000
MASK = (1 << BITS) - 1


def ngrams(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams of some texts as rows of ORDER code points, which of them ends at each symbol, and where each
    text's symbols begin. Symbols are code points; a run of ASCII white space is one space; each text is led by spaces."""
    white = (cps == 32) | ((cps >= 9) & (cps <= 13))
    keep = ~white
    keep[1:] |= ~white[:-1]
    first = offsets[:-1][offsets[:-1] < len(cps)]
    keep[first] = ~white[first]
    sym = np.where(white, np.uint32(32), cps)[keep]
    kept = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    ends = kept[offsets]
    seen = np.zeros(max(32, int(sym.max(initial=0))) + 1, bool)
    seen[sym], seen[32] = True, True
    letters = np.flatnonzero(seen).astype(np.uint32)
    rank = np.zeros(len(seen), np.uint32)
    rank[letters] = np.arange(len(letters))
    bits = max(1, int(len(letters) - 1).bit_length())
    pad = ORDER - 1
    places = np.arange(len(sym)) + np.repeat(np.arange(1, len(ends)) * pad, np.diff(ends))
    padded = np.full(len(sym) + (len(ends) - 1) * pad + 1, rank[32], np.uint64)
    padded[places] = rank[sym]
    if bits * ORDER <= 64:
        codes = np.zeros(len(sym), np.uint64)
        for k in range(ORDER):
            codes |= padded[places - k] << np.uint64(bits * k)
        order = np.argsort(codes)
        inside = codes[order]
        begins = np.ones(len(codes), bool)
        begins[1:] = inside[1:] != inside[:-1]
        kinds, which = inside[begins], np.empty(len(codes), np.int64)
        which[order] = np.cumsum(begins) - 1
        parts = [(kinds >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1) for k in reversed(range(ORDER))]
        rows = letters[np.column_stack(parts).astype(np.int64)] if len(kinds) else np.zeros((0, ORDER), np.uint32)
    else:  # thousands of different symbols at once
        wide = np.column_stack([padded[places - k] for k in reversed(range(ORDER))])
        rows, which = np.unique(wide, axis=0, return_inverse=True)
        rows, which = letters[rows.astype(np.int64)], which.ravel()
    return rows, which, ends


def two_longs(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = rows.astype(np.int64)
    return c[:, 0] << 2 * BITS | c[:, 1] << BITS | c[:, 2], c[:, 3] << BITS | c[:, 4]


def gram_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a.astype(np.uint64) + mix64(b.astype(np.uint64)))


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(a, b, n) of every n-gram of the highest order in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0), BLOCK_CHARS):
                rows, which, _ = ngrams(*code_points(texts))
                a, b = two_longs(rows)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.bincount(which, minlength=len(rows)))], ["a", "b", "n"])

    return docs.select("text").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _suffix(k: int) -> tuple[Column, Column]:
    """The last k symbols of an n-gram (a, b)."""
    a = F.col("a").bitwiseAND(F.lit((1 << BITS * max(0, k - 2)) - 1)) if k > 2 else F.lit(0).cast("bigint")
    return a, F.col("b") if k > 1 else F.col("b").bitwiseAND(F.lit(MASK))


def discounts(n: list[int]) -> list[float]:
    """What counts of 1, 2, and 3 or more lose, by how many n-grams occur once to four times; tame where these are few."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(r, low), high) for r, low, high in zip(raw, (0.05, 0.1, 0.15), (0.95, 1.9, 2.85), strict=True)]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(a, b, p): the interpolated modified Kneser-Ney probability of each n-gram's last symbol after the ones before.

    counts: (a, b, n) of the highest order. Every lower order counts the different symbols before its n-grams, by Spark.
    The lowest order is mixed with an even share of all symbols and one that never occurred.
    """
    orders = [counts]
    for k in range(ORDER - 1, 0, -1):
        a, b = _suffix(k)
        orders.insert(0, checkpoint(orders[0].select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))))
    even = 1.0 / (orders[0].count() + 1)
    below = None
    for k, table in enumerate(orders, 1):
        d = discounts(list(table.agg(*(F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4))).first()))
        taken = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = table.select("a", "b", F.shiftright("b", BITS).alias("c"), "n", taken.alias("taken"))
        contexts = rows.groupBy("a", "c").agg(F.sum("n").alias("total"), F.sum("taken").alias("left"))
        rows = rows.join(contexts, ["a", "c"])
        if below is None:
            rows = rows.withColumn("q", F.lit(even))
        else:
            a, b = _suffix(k - 1)
            rows = rows.withColumns({"sa": a, "sb": b}).join(below.toDF("sa", "sb", "q"), ["sa", "sb"])
        made = checkpoint(rows.select("a", "b", ((F.col("n") - F.col("taken") + F.col("left") * F.col("q")) / F.col("total")).alias("p")))
        if below is not None:
            discard(below)
        if k < ORDER:
            discard(table)
        below = made
    return below


def text_rules(texts: list[str], cps: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    w = words(cps, offsets)
    marks = np.zeros(128, bool)
    marks[[ord(c) for c in SYMBOL_MARKS]] = True
    totals = lambda per_char: np.diff(np.concatenate([[0], np.cumsum(per_char)])[offsets])
    solid = ~((cps == 32) | ((cps >= 9) & (cps <= 13)))
    out = {"n_words": w.counts, "word_chars": totals(solid), "n_symbols": totals(marks[np.minimum(cps, 127)])}
    n = len(w.hashes)
    doc = np.repeat(np.arange(len(texts)), w.counts)
    last = w.first[1:][doc]
    window = np.flatnonzero(np.arange(n) + 3 <= last)
    key = mix64(rolling(w.hashes, 3)[window] + mix64(doc[window].astype(np.uint64)))
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = window[times[back] > 1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=len(texts))
    # Lines are split by \n alone, so the same hashing over other separators.
    dup = np.zeros(len(texts), np.int64)
    breaks = np.flatnonzero(cps == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_start = line_start[line_start < len(cps)]
    if len(line_start):
        line_end = np.append(line_start[1:], len(cps))
        line = np.repeat(np.arange(len(line_start)), line_end - line_start)
        place = (np.arange(len(cps)) - line_start[line]).astype(np.uint64)
        terms = mix64(cps.astype(np.uint64) | (place << np.uint64(21)))
        terms[cps == 10] = 0  # the break that ends a line is no part of it
        h = np.add.reduceat(terms, line_start)
        some = np.add.reduceat(solid.astype(np.int64), line_start) > 0
        owner = np.searchsorted(offsets, line_start, side="right") - 1
        key = mix64(h[some] + mix64(owner[some].astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        dup = np.bincount(owner[some], minlength=len(texts)) - np.bincount(owner[some][first], minlength=len(texts))
    out["n_dup_lines"] = dup
    return out


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_texts(docs: DataFrame, model: DataFrame, most: int) -> DataFrame:
    """The rules' counts and log_ppl, the mean negative log probability of a symbol (null without symbols).

    model: kneser_ney() of these texts, so it has all their n-grams. It goes to all executors as a sorted array of hashes
    beside the logarithms if it takes `most` bytes at most. Beyond, the different n-grams of each different text are
    joined with it.
    """
    small = 12 * model.count() <= most
    arrays = None
    if small:
        found = model.toArrow()
        keys = gram_hash(found["a"].to_numpy(), found["b"].to_numpy())
        order = np.argsort(keys)
        arrays = docs.sparkSession.sparkContext.broadcast((keys[order], -np.log(found["p"].to_numpy()[order]).astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(2), BLOCK_CHARS):
                cps, offsets = code_points(texts)
                rules = text_rules(texts, cps, offsets)
                loss, n = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
                if small:
                    keys, logs = arrays.value
                    rows, which, ends = ngrams(cps, offsets)
                    n = np.diff(ends)
                    if len(rows):
                        each = logs[np.searchsorted(keys, gram_hash(*two_longs(rows)))]
                        sums = np.concatenate([[0], np.cumsum(each[which], dtype=np.float64)])
                        loss = np.where(n > 0, np.diff(sums[ends]) / np.maximum(n, 1), np.nan)
                head = batch.slice(at, len(texts))
                cols = [head.column(0), head.column(1), head.column(3), *(pa.array(rules[c].astype(np.int64)) for c in RULES), pa.array(loss, mask=n == 0)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang", "text_key", *RULES, "log_ppl"])

    keyed = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_key"))
    rows = keyed.mapInArrow(score, f"doc_id long, lang string, text_key long, {', '.join(f'{c} long' for c in RULES)}, log_ppl double")
    if small:
        return rows.drop("text_key")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(0), BLOCK_CHARS):
                rows, which, ends = ngrams(*code_points(texts))
                if not len(rows):
                    continue
                pair = np.unique(np.repeat(np.arange(len(texts)), np.diff(ends)) * len(rows) + which, return_counts=True)
                a, b = two_longs(rows[pair[0] % len(rows)])
                keys = batch.column(1).take(pa.array(at + pair[0] // len(rows)))
                yield pa.RecordBatch.from_arrays([keys, pa.array(a), pa.array(b), pa.array(pair[1])], ["text_key", "a", "b", "n"])

    # Equal texts are counted together; their mean is that of one.
    met = keyed.where("text is not null").select("text", "text_key").mapInArrow(bags, "text_key long, a long, b long, n long").join(model, ["a", "b"])
    means = checkpoint(met.groupBy("text_key").agg((F.sum(-F.log("p") * F.col("n")) / F.sum("n")).alias("mean")))
    return rows.drop("log_ppl").join(broadcast_below(means, most), "text_key", "left").withColumnRenamed("mean", "log_ppl").drop("text_key")


def judge(docs: DataFrame, band: float = BAND, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, the counts of RULES, base_failed, kept, log_ppl, perplexity for every row.

    The n-grams of all texts are counted by Spark. A text that passes the base rules is kept if its log perplexity lies
    in the band of its language: `band` times as far from the median as the quartile on that side, over the texts that
    pass them. Null texts are empty; a null lang is a language of its own. Repeated rows stay and count as often. No rows
    give no rows; other columns play no part.
    """
    model = kneser_ney(checkpoint(count_ngrams(docs)))
    rows = score_texts(docs, model, most).select("*", (F.col("lang").isNull()).alias("no_lang"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = checkpoint(rows.withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("base_failed", failed))
    q = F.percentile_approx("log_ppl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 10000)
    bands = rows.where(~F.col("base_failed")).groupBy("no_lang", "lang").agg(q.alias("q"))
    edge = lambda i: F.col("q")[1] + band * (F.col("q")[i] - F.col("q")[1])
    bands = checkpoint(bands.select("no_lang", "lang", edge(0).alias("low"), edge(2).alias("high")))
    out = rows.join(broadcast_below(bands), ["no_lang", "lang"], "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", *RULES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", F.exp("log_ppl").alias("perplexity"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all documents."""
    return judge(read_table(spark, sf_dir, "documents"))
