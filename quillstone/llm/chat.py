"""Preference formatting of paired conversations.

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered once,
as the prompt; what follows in each is its completion, rendered turn by turn with a mask that is 1
where the loss counts (assistant turns) and 0 elsewhere.

Turns compare by number, role and text. Rows of one conversation with the same turn number are one
slot, and slots agree if they hold the same rows equally often; the prefix ends before the first slot
that differs or that one side lacks.

Scale. All of it is DataFrame operations: slots are compared by counts and sums of hashes with partial
aggregation, and results stay one row per turn, so that a conversation with a third of all rows never
meets in one task or one string. `assemble` joins turns into strings for conversations of bounded size.

Defined cases: a null role is rendered as "user", a null text as empty, and they compare as such; a null
turn sorts first and a null conv_id belongs to no pair; a pair that lacks a side has an empty prompt
and the other side's turns as completion; repeated rows are each rendered; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
_NONE = -(1 << 62)  # the turn number of a null turn


def segments(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per rendered turn: pair_id, part (prompt, chosen, rejected), turn, role, rendered, loss_mask, n_chars.

    turns: conv_id, turn, role, text. pairs: pair_id, chosen_id, rejected_id.
    """
    rows = turns.select(F.col("conv_id").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(_NONE)).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = pairs.select("pair_id", F.explode(F.create_map(F.lit("chosen"), "chosen_id", F.lit("rejected"), "rejected_id")).alias("side", "conv"))
    # The comparison moves hashes of turns only; texts move once, when it is known where prefixes end.
    code = lambda seed: F.xxhash64(F.lit(seed), "role", "text")
    marks = sides.join(rows.select("conv", "turn", code(1).alias("a"), code(2).alias("b")), "conv")
    chosen = F.col("side") == "chosen"
    values = (("n", F.lit(1)), ("a", F.col("a").cast("decimal(20,0)")), ("b", F.col("b").cast("decimal(20,0)")))
    slot = marks.groupBy("pair_id", "turn").agg(*(F.sum(F.when(s, v)).alias(f"{k}_{name}") for k, s in (("c", chosen), ("r", ~chosen)) for name, v in values))
    differs = ~(F.col("c_n").eqNullSafe(F.col("r_n")) & F.col("c_a").eqNullSafe(F.col("r_a")) & F.col("c_b").eqNullSafe(F.col("r_b")))
    ends = slot.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("ends"))
    out = sides.join(ends, "pair_id").join(rows, "conv").withColumn("shared", F.col("ends").isNull() | (F.col("turn") < F.col("ends")))
    out = out.where(~F.col("shared") | (F.col("side") == "chosen"))
    rendered = F.concat(F.lit(OPEN), "role", F.lit(CLOSE + "\n"), "text", F.lit("\n"))
    mask = (~F.col("shared") & (F.col("role") == "assistant")).cast("int")
    turn = F.when(F.col("turn") != _NONE, F.col("turn"))
    part = F.when(F.col("shared"), "prompt").otherwise(F.col("side"))
    return out.select("pair_id", part.alias("part"), turn.alias("turn"), "role", rendered.alias("rendered"), mask.alias("loss_mask"), F.length(rendered).cast("long").alias("n_chars"))


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected), where the table names no pairs of its own."""
    ids = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    return ids.select(pair.alias("pair_id")).distinct().select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))


def assemble(parts: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected) strings of `segments`, for conversations that fit a task."""
    text = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct("turn", "role", "rendered")))), lambda x: x["rendered"]), "").alias(p)
    return parts.groupBy("pair_id").agg(text("prompt"), text("chosen"), text("rejected"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text, conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side
           FROM conversations WHERE conv_id IS NOT NULL),
slot AS (SELECT pair_id, turn, list(role || chr(0) || text ORDER BY role, text) FILTER (side = 'chosen') AS c, list(role || chr(0) || text ORDER BY role, text) FILTER (side = 'rejected') AS r FROM t GROUP BY ALL),
ends AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS ends FROM slot GROUP BY ALL),
own AS (SELECT t.*, ends.ends IS NULL OR t.turn < ends.ends AS shared FROM t JOIN ends USING (pair_id))
SELECT pair_id, CASE WHEN shared THEN 'prompt' ELSE side END AS part, turn, role, '<|' || role || '|>' || chr(10) || text || chr(10) AS rendered,
       CAST(NOT shared AND role = 'assistant' AS INTEGER) AS loss_mask, length('<|' || role || '|>' || chr(10) || text || chr(10)) AS n_chars
FROM own WHERE NOT shared OR side = 'chosen'
"""
