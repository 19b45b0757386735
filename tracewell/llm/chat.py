"""Chat formatting by multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, all others as named
users and system turns as they are; a mask marks the characters to learn from. The result has a row for each turn and
perspective with its place in the rendered dialogue, so that a conversation of any length is never one value: the
dialogue is its pieces in the order of start. Places are running sums in two levels (blocks of turns, then turns)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Marks of the template; the names of the other speakers follow "user name=".
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Role of instructions; it never is a participant.
SYSTEM = "system"
#: Turn numbers of a block.
BLOCK = 32


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """conv_id, perspective, turn, start, length, mask_start, mask_length and piece, for each turn and perspective.

    start and mask_start count characters from the start of the rendered dialogue; mask_length is 0 for turns that are
    not the perspective's own; the mask takes the text and the end mark, not the header. Null texts are empty, null
    speakers are the speaker "unknown" and rows without a conversation form one. A conversation with system turns only
    has no participant and no rows. Turns with equal numbers keep the order of speaker and text; equal rows are turns of
    their own. Null turns come first.

    There are as many rows as turns times participants, which the method asks for: a conversation of very many speakers has the
    square of them. Turns of one number (or none) are placed in one task, however many they are. Texts stay as they are: one that
    holds the marks may look like a turn, but start and length tell the real ones."""
    name = F.coalesce(F.col(speaker).cast("string"), F.lit("unknown"))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), name.alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    people = rows.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    who = F.when(F.col("speaker") == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    head = F.concat(F.lit(OPEN), who, F.lit(CLOSE))
    seen = seen.withColumn("head", F.length(head).cast("long")).withColumn("piece", F.concat(head, F.col("text"), F.lit(END)))
    seen = seen.withColumn("length", F.length("piece").cast("long")).withColumn("own", own).withColumn("block", F.floor(F.col("turn") / BLOCK))
    sums = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("length").alias("_sum"))
    ahead = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("block").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.asc_nulls_first("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    seen = seen.withColumn("_within", F.coalesce(F.sum("length").over(within), F.lit(0)))
    placed = seen.join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("perspective") == F.col("_p")) & F.col("block").eqNullSafe(F.col("_b")))
    start = F.col("_ahead") + F.col("_within")
    return placed.select(
        "conv_id", "perspective", "turn", start.alias("start"), "length", (start + F.col("head")).alias("mask_start"),
        F.when(F.col("own"), F.col("length") - F.col("head")).otherwise(0).cast("long").alias("mask_length"), "piece",
    )


def op7_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the side of each of its participants."""
    return rotate(common.table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, t.body, t.speaker = p.perspective AS own,
    '<|' || CASE WHEN t.speaker = 'system' THEN 'system' WHEN t.speaker = p.perspective THEN 'assistant' ELSE 'user name=' || t.speaker END || '|>' || chr(10) AS head
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
s AS (
  SELECT *, head || body || '<|end|>' || chr(10) AS piece, length(head || body || '<|end|>' || chr(10)) AS len FROM r),
w AS (
  SELECT *, coalesce(sum(len) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT conv_id, perspective, turn, CAST(start AS BIGINT) AS start, CAST(len AS BIGINT) AS length, CAST(start + length(head) AS BIGINT) AS mask_start,
  CAST(CASE WHEN own THEN len - length(head) ELSE 0 END AS BIGINT) AS mask_length, piece
FROM w
"""
