"""Chat formatting after a collapse of cumulative snapshots.

A client that logs a conversation after every turn leaves snapshots that are prefixes of one another. Each prefix of a conversation gets a
rolling hash: the exclusive or, over its turns, of hashes of (place, role, text), in two words of 64 bits. A conversation whose whole hash is
the hash of an inner prefix of another is a prefix of it and goes, by an anti-join; of equal conversations the least id stays. What is left is
rendered.

Scale: the rolling hash is a running window, so a conversation may have any number of turns. The texts are shuffled once, by conversation;
the anti-join moves three numbers a turn, after a distinct with map-side combining, as a shared system prompt is the first prefix of many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, role, text, z1, z2): the turns, and the hash of what precedes and includes each."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("k"))
    return turns.select("conv_id", "k", "role", "text", *[F.bit_xor(F.xxhash64(F.lit(seed), "k", "role", "text")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(name) for seed, name in ((1, "z1"), (2, "z2"))])


def render(role, text):
    """A turn as text. Marks inside the text or the role lose their meaning by a blank, as do line ends inside the role."""
    safe = lambda c: F.replace(c, F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(OPEN), F.replace(safe(role), F.lit("\n"), F.lit(" ")), F.lit("\n"), safe(text), F.lit(CLOSE + "\n"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): each conversation that is no prefix of another, rendered.

    Turns are ordered by turn, nulls first, ties by role and text; a null role or text counts as empty; rows without a conv_id are passed over.
    Repeated rows are turns of their own. Of equal conversations the least conv_id stays. Empty gives empty. Other columns are not read.
    """
    turns = prefixes(conversations)
    each = turns.groupBy("conv_id").agg(F.max(F.struct("k", "z1", "z2")).alias("end"), F.array_sort(F.collect_list(F.struct("k", render(F.col("role"), F.col("text")).alias("t")))).alias("turns"))
    whole = each.groupBy("end.k", "end.z1", "end.z2").agg(F.min("conv_id").alias("conv_id"))
    inner = turns.join(each.select("conv_id", F.col("end.k").alias("n")), "conv_id").where("k < n").select("k", "z1", "z2").distinct()
    stay = whole.join(inner, ["k", "z1", "z2"], "left_anti").select("conv_id")
    return each.join(stay, "conv_id").select("conv_id", F.col("end.k").alias("n_turns"), F.concat_ws("", F.col("turns.t")).alias("text"))


def oracle() -> str:
    """DuckDB SQL for op10_chat: lists of turns are compared instead of hashes."""
    return f"""
WITH conv AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns, count(*) AS n
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns,
       array_to_string(list_transform(turns, lambda x: '{OPEN}' || replace(replace(x.r, '<|im_', '<| im_'), chr(10), ' ') || chr(10) || replace(x.t, '<|im_', '<| im_') || '{CLOSE}' || chr(10)), '') AS text
FROM conv a
WHERE NOT EXISTS (SELECT 1 FROM conv b WHERE b.turns[1].r = a.turns[1].r AND b.turns[1].t = a.turns[1].t AND b.n > a.n AND b.turns[1:a.n] = a.turns)
  AND NOT EXISTS (SELECT 1 FROM conv b WHERE b.turns = a.turns AND b.conv_id < a.conv_id)
"""
