"""Substring dedup by level-wise doubling of repeated windows.

A window can repeat only if both its halves do. So windows of half the length are counted first, over all texts, and
only those that repeat are extended to twice their length, until the wanted length is reached or none is left. Of the
halves of a window one stands for all: the smallest hash among the windows of half the length inside it. Equal windows
have it at the same place, so a half that is counted once ends the search for every window that it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, broadcast_below, checkpoint, discard, read_table
from lodestone.llm.textcodes import Words, chunks, code_points, mix64, rolling, words

WINDOW, FIRST = 20, 10
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW32 = 0xFFFFFFFF


def doubled_lengths(window: int, first: int) -> list[int]:
    """The lengths of the levels: window, and its halves down to no less than `first` words."""
    out = [window]
    while out[0] % 2 == 0 and out[0] // 2 >= first:
        out.insert(0, out[0] // 2)
    return out


def _ahead(x: np.ndarray, k: int, fill) -> np.ndarray:
    out = np.full(len(x), fill, x.dtype)
    if k < len(x):
        out[: len(x) - k] = x[k:]
    return out


def _member(h: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Is each hash among the sorted known ones; None knows all."""
    if known is None:
        return np.ones(len(h), bool)
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Level:
    """All windows of one length in some texts: their hash at each word, and which of them are still open."""

    def __init__(self, w: Words, n_texts: int, length: int):
        self.text = np.repeat(np.arange(n_texts), w.counts)
        self.last = w.first[1:][self.text]
        self.at = np.arange(len(w.hashes))
        self.length, self.hash = length, rolling(w.hashes, length)
        self.open = self.at + length <= self.last

    def picks(self) -> tuple[np.ndarray, np.ndarray]:
        """For windows of twice the length: where the leftmost smallest of their halves is, and are all of them open."""
        n, span, width = len(self.at), 1, self.length + 1
        low = np.where(self.open, self.hash, NONE)
        best = self.at.copy()
        while span < width:  # smallest of `span` windows from each word on, by doubling
            step = min(span, width - span)
            other = np.minimum(_ahead(best, step, n - 1), n - 1)
            best = np.where(low[other] < low[best], other, best)
            span += step
        shut = np.concatenate([[0], np.cumsum(~self.open)])
        inside = self.at + 2 * self.length <= self.last
        end = np.minimum(self.at + width, n)
        return best, inside & (shut[end] == shut[self.at])

    def double(self, known: np.ndarray | None) -> None:
        """Windows of twice the length; open are those whose picked half is known to repeat."""
        best, can = self.picks()
        can[can] = _member(self.hash[best[can]], known)
        self.hash = mix64(self.hash * np.uint64(3) + mix64(_ahead(self.hash, self.length, 0)))
        self.length, self.open = 2 * self.length, can


def _levels(texts: list[str], lengths: list[int], known: list[np.ndarray | None]) -> Level:
    w = words(*code_points(texts))
    level = Level(w, len(texts), lengths[0])
    for k in known:
        level.double(k)
    return level


def count_halves(docs: DataFrame, lengths: list[int], known) -> DataFrame:
    """(h, doc_id, text_key) of the halves that stand for windows of the next length. known: a broadcast list of the
    repeated halves of the levels below. Once for every place where a half stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for at, texts in chunks(batch.column(2)):
                level = _levels(texts, lengths, known.value)
                best, can = level.picks()
                place = np.unique(best[can])
                of = pa.array(level.text[place] + at)
                yield pa.RecordBatch.from_arrays([pa.array(level.hash[place].view(np.int64)), ids.take(of), keys.take(of)], ["h", "doc_id", "text_key"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(count, "h long, doc_id long, text_key long")


def find_windows(docs: DataFrame, lengths: list[int], known) -> DataFrame:
    """(k1, k2, doc_id, place, run) of the open windows of the last length that are new in their text, where run is 0, and of
    runs of `run` windows that stand before in the same text. place: text_key << 32 | first word. docs may have `halves`,
    the repeated halves of each text, for the last doubling; others do no harm, as they only say what is left out."""
    own = "halves" in docs.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy()
            for at, texts in chunks(batch.column(2)):
                repeated = list(known.value)
                if own:
                    here = batch.column(3).slice(at, len(texts)).flatten().to_numpy(zero_copy_only=False)
                    repeated.append(np.unique(here.astype(np.int64).view(np.uint64)))
                w = words(*code_points(texts))
                level = Level(w, len(texts), lengths[0])
                for k in repeated:
                    level.double(k)
                start = np.flatnonzero(level.open)
                if not len(start):
                    continue
                text = level.text[start]
                k1 = level.hash[start]
                k2 = rolling(mix64(w.hashes ^ np.uint64(0x5DEECE66D)), lengths[-1])[start]
                _, first = np.unique(mix64(k1 + mix64(text.astype(np.uint64))), return_index=True)
                later = np.ones(len(start), bool)
                later[first] = False
                place = keys[at + text].astype(np.uint64) << np.uint64(32) | (start - w.first[text]).astype(np.uint64)
                head = later.copy()
                head[1:] &= ~later[:-1] | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
                run = np.bincount(np.cumsum(head)[later] - 1, minlength=head.sum()) if head.any() else np.zeros(0, np.int64)
                rows = np.concatenate([np.flatnonzero(~later), np.flatnonzero(head)])
                k1[later], k2[later] = 0, 0
                n = np.concatenate([np.zeros(len(rows) - len(run), np.int64), run]).astype(np.int32)
                cols = [pa.array(k1[rows].view(np.int64)), pa.array(k2[rows].view(np.int64)), ids.take(pa.array(at + text[rows])), pa.array(place[rows].view(np.int64)), pa.array(n)]
                yield pa.RecordBatch.from_arrays(cols, ["k1", "k2", "doc_id", "place", "run"])

    return docs.select("doc_id", "text_key", "text", *(["halves"] if own else [])).mapInArrow(find, "k1 long, k2 long, doc_id long, place long, run int")


def later_windows(docs: DataFrame, window: int, first: int, most: int) -> DataFrame:
    """(doc_id, text_key, starts): runs, first word << 32 | length, of the windows of each text whose words also start earlier.

    docs: doc_id, text_key, text, none of them null. The repeated halves of a level are sent to all executors while they
    take `most` bytes at most. Beyond, the last level's are joined to the documents that have them, and each text brings
    its own; those of levels before it are not used, which leaves more windows to the next count and no result different.
    """
    sc = docs.sparkSession.sparkContext
    lengths = doubled_lengths(window, first)
    known: list[np.ndarray | None] = []
    for i in range(len(lengths) - 1):
        halves = count_halves(docs, lengths, sc.broadcast(list(known)))
        repeated = checkpoint(halves.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
        if 8 * repeated.count() <= most:
            known.append(np.sort(repeated.toArrow()["h"].to_numpy().view(np.uint64)))
            if not len(known[-1]):
                return docs.where("false").select("doc_id", "text_key", F.array().cast("array<bigint>").alias("starts"))
        elif i < len(lengths) - 2:
            known.append(None)
        else:
            per = halves.join(repeated, "h").groupBy("doc_id", "text_key").agg(F.collect_set("h").alias("halves"))
            docs = docs.join(broadcast_below(checkpoint(per), most), ["doc_id", "text_key"])
    found = checkpoint(find_windows(docs, lengths, sc.broadcast(known)))
    new = found.where("run = 0")
    earliest = checkpoint(new.groupBy("k1", "k2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k1", "k2", "lo"))
    after = new.join(earliest, ["k1", "k2"]).where("doc_id > lo").select("doc_id", "place", F.lit(1).alias("run"))
    gone = after.union(found.where("run > 0").select("doc_id", "place", "run"))
    span = F.shiftleft(F.col("place").bitwiseAND(F.lit(LOW32)), 32).bitwiseOR(F.col("run").cast("bigint"))
    out = checkpoint(gone.groupBy("doc_id", F.shiftrightunsigned("place", 32).alias("text_key")).agg(F.collect_list(span).alias("starts")))
    discard(found, earliest)
    return out


def copies_of_earlier(docs: DataFrame, most: int) -> DataFrame:
    """(doc_id, text_key) of documents whose whole text a smaller doc_id has too."""
    hashed = docs.select("doc_id", "text_key", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"))
    groups = checkpoint(hashed.groupBy("t1", "t2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("t1", "t2", "lo"))
    return checkpoint(hashed.join(broadcast_below(groups, most), ["t1", "t2"]).where("doc_id > lo").select("doc_id", "text_key").distinct())


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST, most: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row.

    A word goes if a window of `window` words that covers it also starts earlier, in a smaller doc_id or before it in
    the same text; what is left plays no part. Null and empty texts have no words. Rows without doc_id have no place in
    that order: they stay whole and take nothing from others. Rows of one doc_id take nothing from each other, so
    repeated rows get equal rows. An empty table gives an empty result; other columns play no part.

    Every window of a copy of an earlier document starts earlier, so copies need no search: they lose all words, if they
    have a window at all, and only one document of each text is searched.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").bitwiseAND(F.lit(LOW32)).alias("text_key"), "text")
    full = keyed.where("doc_id is not null and text is not null")
    copies = copies_of_earlier(full, most)
    starts = later_windows(full.join(broadcast_below(copies, most), ["doc_id", "text_key"], "left_anti"), window, first, most)
    # What is removed grows with the corpus, so windows and texts are joined by shuffles at every size.
    starts = checkpoint(starts.union(copies.select("doc_id", "text_key", F.array(F.lit(-1).cast("bigint")))))
    joined = keyed.join(starts, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                ws = (text.as_py() or "").encode().split()
                total.append(len(ws))
                if starts.is_valid:
                    v = starts.values.to_numpy()
                    if v[0] < 0:
                        v = np.array([max(0, len(ws) - window + 1)])  # all its windows, from word 0 on
                    at, run = v >> 32, v & LOW32
                    edge = np.zeros(len(ws) + window + 1, np.int32)
                    np.add.at(edge, at[run > 0], 1)
                    np.add.at(edge, (at + run - 1 + window)[run > 0], -1)
                    keep = np.cumsum(edge[: len(ws)]) == 0
                    ws = [ws[i] for i in np.flatnonzero(keep)]
                gone.append(total[-1] - len(ws))
                kept.append(b" ".join(ws))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """remove_repeats() of all documents, the text that is left as its digest."""
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
