"""Chat formatting: logged snapshots of a growing conversation collapse into the longest, which is rendered.

Rolling hash. Every turn has two 64-bit hashes of its place, role and text; the hash of a prefix is their
running exclusive-or in order of turns (place is part of the hash, so order matters). A prefix is known
by its length and both hashes, 128 bits together.

1. Equal conversations keep the smallest id (grouped minimum, combined before the shuffle).
2. A conversation is dropped if its whole hash equals a proper prefix of another one: an anti-join with
   the distinct prefixes. A first turn that a third of all conversations share is one distinct prefix.
3. The turns of the conversations left are rendered.

Conversations are windows over their own turns; nothing else is gathered by a key.

Defined cases: a null role or text counts as empty and is rendered empty; turns are ordered by turn (null first), then role, then text, so
ties are settled by content; a repeated row is a repeated turn; rows with a null conversation id belong
to no conversation and are left out; an empty table gives an empty result; long conversations are whole;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A rendered turn; {role} and {text} are put in.
TURN = ("<|", "|>\n", "\n")
_COUNTED = "bit_xor(xxhash64({seed}, nth, role, text)) OVER (PARTITION BY conv ORDER BY nth ROWS UNBOUNDED PRECEDING)"


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, nth, role, text, a, b): turns from 1 in order, with both prefix hashes."""
    clean = turns.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).filter("conv IS NOT NULL")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return clean.withColumn("nth", F.row_number().over(order)).select(
        "conv", "nth", "role", "text", F.expr(_COUNTED.format(seed=1)).alias("a"), F.expr(_COUNTED.format(seed=2)).alias("b"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies) of the conversations that no other one continues, from the rows of numbered()."""
    slim = prefixes.select("conv", "nth", "a", "b")
    whole = slim.groupBy("conv").agg(F.max(F.struct("nth", "a", "b")).alias("w")).select("conv", "w.*")
    unique = whole.groupBy("nth", "a", "b").agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    ends = whole.select("conv", F.col("nth").alias("n_turns"))
    proper = slim.join(ends, "conv").filter("nth < n_turns").select("nth", "a", "b").distinct()
    return unique.join(proper, ["nth", "a", "b"], "left_anti").select("conv", F.col("nth").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, n_turns, n_copies (equal conversations, itself included) and chat (rendered) of every maximal conversation."""
    rows = numbered(turns, conv, turn, role, text)
    left = maximal(rows)
    line = F.struct("nth", F.concat(F.lit(TURN[0]), "role", F.lit(TURN[1]), "text", F.lit(TURN[2])).alias("line"))
    lines = rows.join(left, "conv", "left_semi").groupBy("conv").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return lines.join(left, "conv").select(
        F.col("conv").alias(conv), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.array_join("lines.line", "").alias("chat"))


RENDER_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY nth) AS said,
         string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY nth) AS chat
  FROM t GROUP BY conv_id),
u AS (SELECT said, any_value(n_turns) AS n_turns, any_value(chat) AS chat, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY said)
SELECT conv_id, n_turns::BIGINT AS n_turns, n_copies::BIGINT AS n_copies, chat FROM u
WHERE NOT EXISTS (
  SELECT 1 FROM u AS v WHERE v.n_turns > u.n_turns AND list_slice(v.said, 1, u.n_turns) = u.said)
"""
