"""Operator 5: chat formatting after cumulative-snapshot collapse.

A chat log often holds a conversation again and again as it grows.  Each turn is
hashed with its place; the running exclusive-or of these hashes, in two lanes of 64
bits, identifies every prefix of a conversation.  An anti join drops conversations
that are a proper prefix of a longer one, and of equal ones the smallest conv_id
stays.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text; turns in order of turn, role, text, where a
    null turn comes first and a null role or text is empty."""
    cleaned = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return cleaned.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations equal to it) of the maximal ones.

    Turns that repeat exactly stay turns of their own.  A null conv_id is one
    conversation and the smallest id.  Prefix hashes are made distinct before they are
    shuffled, so a first turn that a third of all conversations share does no harm.
    """
    running = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("conv_id").orderBy("pos")
    hashed = ordered_turns(turns).select("conv_id", "pos", F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64("text", "role", "pos", F.lit("lane")).alias("b"))
    prefixes = hashed.select("conv_id", "pos", F.bit_xor("a").over(running).alias("h1"), F.bit_xor("b").over(running).alias("h2"), F.lead("pos").over(after).isNull().alias("last"))
    whole = prefixes.where("last").groupBy("pos", "h1", "h2").agg(F.min_by("conv_id", F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.where("not last").select("pos", "h1", "h2").distinct()
    return whole.join(proper, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, text: each maximal conversation in a chat template of
    marked turns.  Further columns are dropped; an empty table gives no rows."""
    marked = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    kept = maximal_conversations(turns).withColumn("_id", F.coalesce("conv_id", F.lit(-(2**63)))).withColumn("_null", F.col("conv_id").isNull())
    lines = ordered_turns(turns).select(F.coalesce("conv_id", F.lit(-(2**63))).alias("_id"), F.col("conv_id").isNull().alias("_null"), "pos", marked.alias("line"))
    rendered = lines.join(kept.select("_id", "_null"), ["_id", "_null"], "left_semi").groupBy("_id", "_null").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("text"))
    return kept.join(rendered, ["_id", "_null"]).select("conv_id", "n_turns", "n_copies", "text")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, list(struct_pack(r := role, x := text) ORDER BY pos) AS l,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
  FROM t GROUP BY conv_id
), same AS (
  SELECT l, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l
)
SELECT c.conv_id, c.n::INT AS n_turns, s.n_copies, c.text
FROM c JOIN same s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.n > c.n AND d.l[1:c.n] = c.l)
"""
