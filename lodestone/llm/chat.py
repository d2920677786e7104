"""Chat formatting from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read_table

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Control strings, of this template and of common others, that a text may hold only in escaped form.
CONTROL = [START, SEP, END, "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    r"""Double each backslash, then put one after the first character of each control string. `\x` stands for x."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) messages from an event log of conv_id, seq, message_id, kind, role, text.

    kind: "delta" appends its text, "edit" and "regenerate" start the message over with theirs; null counts as delta.
    Events of a message are taken in the order of seq, kind and text. A message stands where its first event stands.
    Null texts are empty. Repeated events count as often as they occur.
    """
    events = log.select("conv_id", "message_id", F.struct(F.col("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role")).alias("e"))
    folded = events.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    resets = F.transform("es", lambda e, i: F.when(e["kind"].isin("edit", "regenerate"), i + 1).otherwise(1))
    live = F.slice("es", F.array_max(resets), F.size("es"))
    return folded.select("conv_id", F.col("es")[0]["seq"].alias("turn"), F.col("es")[0]["role"].alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def as_events(rows: DataFrame) -> DataFrame:
    """A table of whole messages as an event log: each row is the only event of a message of its own."""
    nth = F.expr("row_number() over (partition by conv_id, turn order by role, text)")
    return rows.select("conv_id", F.col("turn").alias("seq"), F.struct("turn", nth.alias("nth")).alias("message_id"), F.lit("delta").alias("kind"), "role", "text")


def format_chats(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss) and formatted, their concatenation.

    A conversation log is an ordered list: rows go by turn, ties by role and text, repeated rows stay. Null roles and
    texts are empty; null conv_id is one conversation; no rows give no rows. Loss lies on the texts of learn_role.
    """
    turns = messages.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    logs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(F.transform("ms", lambda m: F.array(segment(F.concat(F.lit(START), escape(m["role"]), F.lit(SEP)), F.lit(False)), segment(escape(m["text"]), m["role"] == learn_role), segment(F.lit(END), F.lit(False)))))
    return logs.select("conv_id", segments.alias("segments")).select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): roles and texts read back from `formatted`, and the text under the loss mask."""
    import re

    raw = F.split("formatted", re.escape(END), -1)
    parts = F.transform(F.slice(raw, F.lit(1), F.size(raw) - 1), lambda p: F.substring(p, len(START) + 1, 1 << 30))
    turns = F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substring_index(p, SEP, -1)).alias("text")))
    loss = unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digest_chats(chats: DataFrame) -> DataFrame:
    back = parse_chats(chats)
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the one numbered -1, folded from events, formatted, read back and digested."""
    log = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest_chats(format_chats(fold_events(as_events(log.unionByName(probe)))))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


OP9_SQL = f"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({len(START + SEP + END)} + length({_sql_escape('role')}) + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars
FROM log GROUP BY conv_id
"""
