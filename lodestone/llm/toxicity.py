"""Toxicity by class-conditional Kneser-Ney models of words and their stems."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import broadcast_below, checkpoint, read_table
from lodestone.llm.textcodes import chunks, code_points, mix64

DISCOUNT = 0.9
#: Letters at the head of a word that stand for it in the class's own lower-order model.
STEM = 5
#: Entries whose counts say less than this about the class (likelihood ratio statistic) could be pruned from both models,
#: as could those that favour a class by less than LEAST_RATIO; nothing is.
PRUNE = 0.0
LEAST_RATIO = 0.0
#: Log ratios are broadcast, as sorted keys of 64 bits beside weights, up to this many entries (64 MB), and joined beyond.
MODEL_ROWS = 4_000_000
#: Labelled doc_ids, those of the smallest checksums, that fit the three numbers that turn ratios into a probability.
CALIBRATION_ROWS = 20_000


def fold_table() -> np.ndarray:
    """Lower-case letters and digits as themselves; 0 is what ends a word."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def expressions(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, below 2 ** 63, of each word and of its first STEM letters, and each text's first word."""
    cps, offsets = code_points(texts)
    sym = table[cps]
    solid = sym != 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = offsets[:-1][offsets[:-1] < len(cps)]
    begins[edges] |= solid[edges]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, first
    at = np.flatnonzero(solid)
    place = at - starts[np.cumsum(begins[at]) - 1]
    terms = mix64(sym[at].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(21)))
    heads = np.searchsorted(at, starts)
    whole = np.add.reduceat(terms, heads)
    terms[place >= STEM] = 0
    stem = np.add.reduceat(terms, heads)
    return (whole >> np.uint64(1)).astype(np.int64), (stem >> np.uint64(1)).astype(np.int64), first


def checksum(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def count_types(labelled: DataFrame) -> DataFrame:
    """(word, stem, t, o): Kneser-Ney counts of each word in toxic and ordinary texts. labelled: text, toxic.

    A word counts once for each different word before it, the start of a text being one; so copies of a text do not make
    its words look frequent. Spark counts the different (class, word before, word).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table()
        for batch in batches:
            toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
            for at, texts in chunks(batch.column(0), 4_000_000):
                word, stem, first = expressions(texts, table)
                if not len(word):
                    continue
                before = np.concatenate([[0], word[:-1]])
                before[first[:-1][first[:-1] < len(word)]] = 0
                order = np.lexsort((before, word))
                word, before, stem = word[order], before[order], stem[order]
                head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (before[1:] != before[:-1])]))
                of = np.repeat(toxic[at : at + len(texts)], np.diff(first))[order]
                marks = [np.logical_or.reduceat(mask, head).astype(np.int8) for mask in (of, ~of)]
                cols = [word[head], before[head], stem[head], *marks]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["word", "before", "stem", "t", "o"])

    pairs = labelled.select("text", "toxic").mapInArrow(count, "word long, before long, stem long, t byte, o byte")
    pairs = pairs.groupBy("word", "before").agg(F.first("stem").alias("stem"), F.max("t").alias("t"), F.max("o").alias("o"))
    return pairs.groupBy("word").agg(F.first("stem").alias("stem"), F.sum("t").alias("t"), F.sum("o").alias("o"))


def weigh(types: DataFrame, prune: float = PRUNE, least_ratio: float = LEAST_RATIO) -> tuple[DataFrame, DataFrame]:
    """(key, w) of words, and of stems for words without an entry: log of toxic over ordinary probability.

    Every word and stem has an entry. Only a caller that sets `prune` or `least_ratio` above 0 leaves entries of less to
    the backoff that both classes share, so they add the same to both log-likelihoods of a text.
    """
    return class_models(types, prune, least_ratio)[:2]


def class_models(types: DataFrame, prune: float = PRUNE, least_ratio: float = LEAST_RATIO) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """What weigh gives, and the log ratios of the backoff: of a new word, beside its stem's, and of a new stem.

    In each class a word's discounted share backs off to the class's share of its stem times the word's shared share
    of the stem; a stem's discounted share backs off to what both classes share, the different words that have it. So a
    new word has the share that its class discounts, times its stem's; a new stem what the class discounts of both. Where
    entries are pruned they can't be told from new ones, and both ratios are 0.
    """
    stems = checkpoint(types.groupBy("stem").agg(F.sum("t").alias("st"), F.sum("o").alias("so"), F.count("*").alias("words")))
    w = types.agg(F.sum("t"), F.sum("o"), F.count(F.when(F.col("t") > 0, 1)), F.count(F.when(F.col("o") > 0, 1))).first()
    s = stems.agg(F.count(F.when(F.col("st") > 0, 1)), F.count(F.when(F.col("so") > 0, 1)), F.sum("words")).first()
    if not w[0] or not w[1]:
        empty = types.where("false").select(F.lit(0).cast("bigint").alias("key"), F.lit(0.0).alias("w"))
        return empty, empty, (0.0, 0.0)
    share = lambda c, n, left, lower: F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / float(n) + left * lower
    spread = F.col("words") / float(s[2])
    stems = stems.select("stem", "st", "so", (F.col("st") + F.col("so")).alias("n"), share("st", w[0], DISCOUNT * s[0] / w[0], spread).alias("pt"), share("so", w[1], DISCOUNT * s[1] / w[1], spread).alias("po"))
    tox = w[0] / (w[0] + w[1])

    def telling(t: Column, o: Column) -> Column:
        if prune <= 0:
            return F.lit(True)
        part = lambda x, p: F.when(x > 0, x * F.log(x / ((t + o) * p))).otherwise(F.lit(0.0))
        return 2 * (part(t, tox) + part(o, 1 - tox)) >= prune

    wide = types.where(telling(F.col("t"), F.col("o"))).join(broadcast_below(stems), "stem")
    part = (F.col("t") + F.col("o")) / F.col("n")
    ratio = F.log(share("t", w[0], DISCOUNT * w[2] / w[0], F.col("pt") * part)) - F.log(share("o", w[1], DISCOUNT * w[3] / w[1], F.col("po") * part))
    stems = stems.where(telling(F.col("st"), F.col("so")))
    entries = lambda df, c, x: df.select(F.col(c).alias("key"), x.alias("w")).where(F.abs("w") >= least_ratio)
    word = log((w[2] / w[0]) / (w[3] / w[1]))
    new = (word, word + log((s[0] / w[0]) / (s[1] / w[1]))) if prune <= 0 and least_ratio <= 0 else (0.0, 0.0)
    return entries(wide, "word", ratio), entries(stems, "stem", F.log("pt") - F.log("po")), new


class Model:
    """Weights of words and stems, tables of (key, w): broadcast while they are few, else kept to be joined.

    new: what class_models gives for words and stems without an entry.
    """

    def __init__(self, words: DataFrame, stems: DataFrame, new: tuple[float, float] = (0.0, 0.0)):
        self.tables, self.arrays, self.new = [words, stems], None, new
        if sum(t.count() for t in self.tables) <= MODEL_ROWS:
            found = [(f["key"].to_numpy(), f["w"].to_numpy()) for f in (t.toArrow() for t in self.tables)]
            orders = [np.argsort(keys) for keys, _ in found]
            self.arrays = words.sparkSession.sparkContext.broadcast([(k[o], w[o]) for (k, w), o in zip(found, orders, strict=True)])
        else:
            self.tables = [checkpoint(t) for t in self.tables]


def look_up(keys: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The weight of each wanted key, NaN without an entry; keys are sorted."""
    if not len(keys):
        return np.full(len(wanted), np.nan)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, weights[at], np.nan)


def joined_ratio(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """What mean_ratio gives, by joins of the different words of each different text with the model's tables."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table()
        for batch in batches:
            for at, texts in chunks(batch.column(0)):
                word, stem, first = expressions(texts, table)
                if not len(word):
                    continue
                text = np.repeat(batch.column(1).to_numpy(zero_copy_only=False)[at : at + len(texts)], np.diff(first))
                order = np.lexsort((word, text))
                text, word, stem = text[order], word[order], stem[order]
                head = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (word[1:] != word[:-1])]))
                n = np.diff(np.append(head, len(text)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (text[head], word[head], stem[head], n)], ["_h", "word", "stem", "n"])

    hashed = docs.withColumn("_h", F.xxhash64("text"))
    rows = hashed.where("text is not null").select("text", "_h").mapInArrow(bags, "_h long, word long, stem long, n long")
    words, stems = (t.select(F.col("key").alias(c), F.col("w").alias(f"w_{c}")) for t, c in zip(model.tables, ("word", "stem"), strict=True))
    rows = rows.join(words, "word", "left").join(stems, "stem", "left")
    # Equal texts were counted together; their share of the weights is that of one.
    w = F.coalesce(F.col("w_word"), F.col("w_stem") + model.new[0], F.lit(model.new[1]))
    sums = rows.groupBy("_h").agg(F.sum(w * F.col("n")).alias("total"), F.sum(F.exp(w) * F.col("n")).alias("odds"), F.sum("n").alias("all"))
    times = hashed.groupBy("_h").agg(F.count("*").alias("times"))
    sums = checkpoint(sums.join(times, "_h").select(F.col("_h").alias("_k"), (F.col("total") / F.col("times")).alias("_total"), (F.col("all") / F.col("times")).alias("_n"), F.log(F.col("odds") / F.col("all")).alias("_e")))
    over = lambda x: F.coalesce(F.col("_total") / x, F.lit(0.0))
    return hashed.join(sums, F.col("_h") == F.col("_k"), "left").select(*keep, over(F.col("_n")).alias("x"), over(F.sqrt("_n")).alias("r"), F.coalesce("_e", F.lit(0.0)).alias("e"))


def mean_ratio(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of `keep`, and of the log ratios of all words of a text the mean, which is the difference of the text's
    log-likelihoods by both classes, each divided by its length (x), the sum over the root of the length (r), and the log
    of the mean ratio (e); 0 without any word."""
    arrays, (new_word, new_stem) = model.arrays, model.new
    if arrays is None:
        return joined_ratio(docs, model, keep)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (words, stems) = fold_table(), arrays.value
        for batch in batches:
            for at, texts in chunks(batch.column(0)):
                word, stem, first = expressions(texts, table)
                w = look_up(*words, word)
                new = np.isnan(w)
                w[new] = np.nan_to_num(look_up(*stems, stem[new]) + new_word, nan=new_stem)
                n = np.diff(first)
                of, some = np.repeat(np.arange(len(n)), n), np.maximum(n, 1)
                total, odds = (np.bincount(of, v, minlength=len(n)) for v in (w, np.exp(w)))
                x, r, e = total / some, total / np.sqrt(some), np.log(np.where(n > 0, odds, 1.0) / some)
                head = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*(head.column(i + 1) for i in range(len(keep))), pa.array(x), pa.array(r), pa.array(e)], [*keep, "x", "r", "e"])

    fields = [docs.schema[c] for c in keep]
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(score, T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in ("x", "r", "e"))]))


def logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Slopes of the columns of x, then the intercept, of the most likely logistic curve, slightly ridged, by Newton."""
    scale = np.where(x.std(0) > 0, x.std(0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - 0.01 * beta
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(beta)), grad)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return [float(b) for b in [*(beta[:-1] / scale), beta[-1]]]


def toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, then held_out, score, predicted for every row of docs. `keep` has doc_id.

    corpus: the texts that labels are about, by default docs. Labels of rows whose checksum leaves 0 modulo 5 are never
    read; of those that leave 1, the CALIBRATION_ROWS doc_ids of the smallest checksums calibrate; words of all others
    are counted, all of them, by Spark. Of several labels of one doc_id the larger holds; null labels and null doc_ids
    label nothing. Null and empty texts score as the prior. Without labels of either class every score is 0. Repeated rows stay; other columns play no part.
    """
    spark = docs.sparkSession
    fold = checksum(F.col("doc_id")) % 5
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(fold != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = checkpoint(known)
    texts = (corpus if corpus is not None else docs).select("doc_id", "text").where(fold != 0).join(broadcast_below(known), "doc_id")
    tune = texts.where(fold == 1).select("doc_id", checksum(F.col("doc_id")).alias("c")).distinct()
    chosen = checkpoint(tune.orderBy("c", "doc_id").limit(CALIBRATION_ROWS).select("doc_id"))
    counted = texts.join(F.broadcast(chosen), "doc_id", "left_anti").select("text", (F.col("toxic") > 0).alias("toxic"))
    model = Model(*class_models(checkpoint(count_types(counted))))
    fit = mean_ratio(texts.join(F.broadcast(chosen), "doc_id", "left_semi"), model, ["toxic"]).toArrow()
    x, y = np.column_stack([fit["x"].to_numpy(), fit["e"].to_numpy()]), (fit["toxic"].to_numpy() > 0).astype(float)
    scored = mean_ratio(docs, model, list(keep))
    if len(y) and 0 < y.sum() < len(y):
        by_mean, by_odds, shift = logistic(x, y)
        score = 1 / (1 + F.exp(-(F.col("x") * by_mean + F.col("e") * by_odds + shift)))
    else:
        score = F.lit(0.0)
    return scored.select(*keep, (fold == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """toxicity() of all documents, learnt from their labels."""
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
