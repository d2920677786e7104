"""Stages of a corpus pipeline: (spark, docs, sf_dir) -> documents, or pieces at the end.

Each works on all rows of docs and returns their columns. It shows the operators `doc_id` and `text` alone, and carries
the row as one column of its own, so no name of another column can clash with theirs. Decisions travel as (doc_id, hash
of the text), broadcast below a measured number of bytes, so a text is shuffled only where they take more.

In all stages: null doc_ids are no document of their own to be lost, rows that share a doc_id are told apart by their
texts, repeated rows share one fate (but in the near-duplicate stage, where one of them stays), and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_below, checkpoint, discard, read_table
from lodestone.llm.decontaminate import windows_found
from lodestone.llm.lines import dedup_lines
from lodestone.llm.packing import pack_documents
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.toxicity import toxicity

ROW = "_row"


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs out of the rows."""
    return rows.select(*(F.col(ROW)[c].alias(c) for c in docs.columns))


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text_hash) is not in a materialised table."""
    keyed = carried(docs).select(ROW, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    gone = broadcast_below(lost.select(F.col("doc_id").alias("_lost_id"), F.col("text_hash").alias("_lost_hash")))
    return keyed.join(gone, F.col("_id").eqNullSafe(F.col("_lost_id")) & (F.col("_hash") == F.col("_lost_hash")), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic. Null and empty texts are judged by the prior, which keeps them."""
    scored = toxicity(carried(docs), read_table(spark, sf_dir, "labels"), keep=("doc_id", ROW))
    return unpacked(scored.where("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand earlier; n_chars follows the text. Null texts become empty."""
    out = dedup_lines(carried(docs), keep=(ROW,))
    now = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return out.select(*(now.get(c, F.col(ROW)[c]).alias(c) for c in docs.columns))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that of the smallest doc_id, then hash of the text; one without doc_id only if the
    component has no other. Rows of one doc_id whose texts are in different components all stay. Of a row that is
    repeated, one stays, that of the smallest hash of all its columns."""
    members = checkpoint(near_duplicates(carried(docs)))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    heads = members.groupBy("component").agg(F.min(place).alias("head")).select(F.col("head.doc_id").alias("_head_id"), F.col("head.text_hash").alias("_head_hash"))
    # Met by document and not by component, so that no component's members come together in one task.
    is_head = F.col("doc_id").eqNullSafe(F.col("_head_id")) & (F.col("text_hash") == F.col("_head_hash"))
    headed = checkpoint(members.join(heads, is_head, "left").select("doc_id", "text_hash", "times", F.col("_head_hash").isNotNull().alias("stays")))
    lost = checkpoint(headed.where(~F.col("stays")).select("doc_id", "text_hash"))
    many = checkpoint(headed.where(F.col("stays") & (F.col("times") > 1)).select(F.col("doc_id").alias("_many_id"), F.col("text_hash").alias("_many_hash")))
    kept = without(docs, lost)
    some = broadcast_below(many)
    again = F.col("_id").eqNullSafe(F.col("_many_id")) & (F.col("_hash") == F.col("_many_hash"))
    single = kept.join(some, again, "left_anti").select(ROW)
    whole = F.xxhash64(*(F.col(ROW)[c] for c in docs.columns))
    rest = kept.join(some, again, "left_semi").groupBy("_id", "_hash").agg(F.min_by(ROW, whole).alias(ROW)).select(ROW)
    discard(members, headed)
    return unpacked(single.unionByName(rest), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item. Null and empty texts hold none."""
    found = windows_found(docs, read_table(spark, sf_dir, "benchmark"))
    return unpacked(without(docs, checkpoint(found.select("doc_id", "text_hash").distinct())), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows; null texts are packed as their end token alone."""
    return pack_documents(docs)
