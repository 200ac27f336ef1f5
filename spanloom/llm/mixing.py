"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of each source are shuffled by a hash and laid end to end; every `block_tokens` tokens of that stream are a block, and a
document belongs to the block in which it starts. Slot i of the schedule takes the golden-ratio point i * 2654435769 mod 2 ** 32 through the
cumulative target weights to a source, so that every prefix of the schedule is close to the target. Slots are ranked within their source, by counts of
ranges of slots and inside each range, and
the r-th slot of a source takes its block r modulo its number of blocks. The schedule ends where every block of every source has been placed
once: nothing is lost, and sources that the target favours come round again.

By default the target moves `even` of the weight from natural shares to equal shares of all sources.

Scale: a source can hold most of the corpus, so streams are summed in two levels: 4096 hash buckets a source, whose sums give offsets, and a
window inside each bucket. Sums of sources, one row each, go to the driver, and their bounds, 8 bytes each, to the tasks that place slots. The
schedule has a row a block and is broadcast only below `broadcast_slots`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, back, map_arrow, named

BLOCK_TOKENS, EVEN_PARTS, SEED, BROADCAST_SLOTS = 65_536, 4, "mix-1", 500_000
_GOLDEN, _CELLS, _SLACK, _RANGE = 2_654_435_769, 1 << 32, 40, 1 << 16


def count_tokens(text: Column) -> Column:
    """Words between blanks, tabs and line ends; 0 for null."""
    flat = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    return F.size(F.array_remove(F.split(flat, " "), "")).cast("long")


def bounds(totals: list[tuple[str | None, int]], block_tokens: int, weights: dict[str | None, int] | None = None) -> list[tuple[str | None, int, int]]:
    """(source, blocks, upper bound of its cells of 2 ** 32) in the order of source, nulls first.

    weights: any positive integers by source; without them EVEN_PARTS - 1 parts natural and one part equal. Sources without a weight get no cells;
    one without a token has one block.
    """
    totals = sorted(((s, n) for s, n in totals if weights is None or weights.get(s, 0) > 0), key=lambda x: (x[0] is not None, x[0] or ""))
    if not totals:
        return []
    mean = max(1, sum(n for _, n in totals) // len(totals))
    own = [weights[s] if weights is not None else (EVEN_PARTS - 1) * n + mean for s, n in totals]
    out, run, total = [], 0, sum(own)
    for (s, n), w in zip(totals, own):
        run += w
        out.append((s, max(1, -(-n // block_tokens)), run * _CELLS // total))
    return out


def schedule(spark, plan: list[tuple[str | None, int, int]]) -> tuple[DataFrame, int]:
    """((slot, source, epoch, block), number of slots)."""
    uppers = [u for _, _, u in plan]
    widths = [u - b for u, b in zip(uppers, [0, *uppers])]
    if any(w <= 0 for w in widths):
        raise ValueError("a source's target weight is below 2 ** -32")
    most = max(-(-(n + _SLACK) * _CELLS // w) for (_, n, _), w in zip(plan, widths))
    shared = spark.sparkContext.broadcast(np.array(uppers, np.int64))

    def place(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(_GOLDEN) % np.uint64(_CELLS)
            nth = np.searchsorted(shared.value, points.astype(np.int64), "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nth.astype(np.int32))], ["slot", "nth"])

    slots = map_arrow(spark.range(most).select(F.col("id").alias("slot")), place, "slot bigint, nth int").withColumn("range", F.call_function("div", "slot", F.lit(_RANGE).cast("long")))
    ahead = Window.partitionBy("nth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("nth", "range").count().select("nth", "range", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("nth", "range").orderBy("slot")
    ranked = slots.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["nth", "range"]).withColumn("rank", F.col("rank") + F.col("before"))
    sources = spark.createDataFrame([(k, s, n) for k, (s, n, _) in enumerate(plan)], "nth int, source string, n_blocks bigint")
    ranked = ranked.join(sources, "nth")
    last = ranked.where("rank = n_blocks - 1").agg(F.max("slot"), F.count("*")).first()
    if last[1] != len(plan):
        raise ValueError("the schedule is too short for a source")
    out = ranked.where(F.col("slot") <= last[0])
    return out.select("slot", "source", F.call_function("div", F.col("rank"), F.col("n_blocks")).alias("epoch"), (F.col("rank") % F.col("n_blocks")).alias("block")), last[0] + 1


def mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, weights: dict[str | None, int] | None = None, seed: str = SEED, broadcast_slots: int = BROADCAST_SLOTS) -> DataFrame:
    """aside(docs) with __n_tokens, __slot, __epoch, __block, once for every slot of the block.

    A null source is a source of its own. A document without tokens adds nothing to its stream and comes with the block in which it stands, which is
    the only one where a source has none but such documents. Sources to which `weights` gives nothing drop out; a weight below 2 ** -32 of the whole
    raises. Rows that repeat an id are placed side by side, ties in order of tokens. An empty table gives no rows.
    """
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(named(docs, "doc_id")).cast("string"), F.lit(""))))
    own = [f"__c{k}" for k in range(len(docs.columns))]
    rows = aside(docs).select(*own, F.col(named(docs, "doc_id")).alias("doc_id"), F.col(named(docs, "source")).alias("source"), count_tokens(F.col(named(docs, "text"))).alias("__n_tokens"), h.alias("__h"))
    rows = rows.withColumn("__bucket", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    sums = rows.groupBy("source", "__bucket").agg(F.sum("__n_tokens").alias("__sum"))
    plan = bounds([(r[0], r[1]) for r in sums.groupBy("source").agg(F.sum("__sum")).collect()], block_tokens, weights)
    if not plan:
        return rows.where(F.lit(False)).select(*own, "__n_tokens", *[F.lit(0).cast("long").alias(c) for c in ("__slot", "__epoch", "__block")])
    spark = docs.sparkSession
    slots, n = schedule(spark, plan)
    ahead = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("__src"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"), F.sum("__sum").over(Window.partitionBy("source")).alias("__total"))
    placed = rows.join(offsets, F.col("source").eqNullSafe(F.col("__src")) & (F.col("__bucket") == F.col("__b")))
    inside = Window.partitionBy("source", "__bucket").orderBy("__h", "doc_id", "__n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__offset") + F.coalesce(F.sum("__n_tokens").over(inside), F.lit(0))
    start = F.least(start, F.greatest(F.col("__total") - 1, F.lit(0)))  # those without tokens at the very end
    placed = placed.withColumn("__at", F.call_function("div", start, F.lit(block_tokens).cast("long")))
    slots = slots.select(F.col("slot").alias("__slot"), F.col("source").alias("__source"), F.col("epoch").alias("__epoch"), F.col("block").alias("__block"))
    side = F.broadcast(slots) if n <= broadcast_slots else slots
    out = placed.join(side, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__at") == F.col("__block")))
    return out.select(*own, "__n_tokens", "__slot", "__epoch", "__block")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs, with its columns only, each row once for every slot of its block."""
    return back(mix(docs, **how), docs)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """(slot, source, epoch, block, doc_id, n_tokens): the whole schedule with the documents of each slot."""
    out = mix(docs.select("doc_id", "text", "source"), **how)
    return out.select(F.col("__slot").alias("slot"), F.col("__c2").alias("source"), F.col("__epoch").alias("epoch"), F.col("__block").alias("block"), F.col("__c0").alias("doc_id"), F.col("__n_tokens").alias("n_tokens"))


def oracle(block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> str:
    """DuckDB SQL for op7_mixing."""
    return f"""
WITH rows_ AS (
  SELECT doc_id, source, len(list_filter(string_split(replace(replace(coalesce(text, ''), chr(10), ' '), chr(9), ' '), ' '), lambda w: w <> '')) AS n_tokens,
         md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
starts AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         sum(n_tokens) OVER (PARTITION BY source) AS total FROM rows_),
placed AS (SELECT *, CAST(least(start, greatest(total - 1, 0)) AS BIGINT) // {block_tokens} AS block FROM starts),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM rows_ GROUP BY source),
weighed AS (SELECT source, n, greatest(1, (n + {block_tokens - 1}) // {block_tokens}) AS blocks, {EVEN_PARTS - 1} * n + greatest(1, (SELECT CAST(sum(n) AS BIGINT) // count(*) FROM totals)) AS w FROM totals),
cells AS (
  SELECT *, CAST((CAST(upto AS HUGEINT) * {_CELLS}) // total AS BIGINT) AS upper FROM (
    SELECT *, CAST(sum(w) OVER (ORDER BY source NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(w) OVER () AS BIGINT) AS total FROM weighed)),
ranges AS (SELECT *, coalesce(lag(upper) OVER (ORDER BY source NULLS FIRST), 0) AS lower FROM cells),
most AS (SELECT max(((blocks + {_SLACK}) * {_CELLS} + upper - lower - 1) // (upper - lower)) AS n FROM ranges),
slots AS (SELECT i AS slot, (i * {_GOLDEN}) % {_CELLS} AS cell FROM generate_series(0, (SELECT CAST(n AS BIGINT) - 1 FROM most)) AS g(i)),
ranked AS (
  SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM slots JOIN ranges ON cell >= lower AND cell < upper),
ended AS (SELECT * FROM ranked WHERE slot <= (SELECT max(slot) FROM ranked WHERE rank = blocks - 1))
SELECT slot, placed.source AS source, rank // blocks AS epoch, placed.block AS block, doc_id, n_tokens
FROM ended JOIN placed ON placed.source IS NOT DISTINCT FROM ended.source AND placed.block = rank % blocks
"""
