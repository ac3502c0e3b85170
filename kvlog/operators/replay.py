"""Replay of a command log: what each command finds, and what it does to memory.

A command's prior mutation is the last SET or DEL of its key before it. Keys are cut into blocks
of `seq`: within a block a window finds it, across blocks the last mutation of each block, a
partial aggregate, is carried forward. So a key that holds most of a log is still many tasks'
work, and no row meets another in a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sequence numbers of one block, and bytes that an entry costs beside its key and value.
BLOCK = 1 << 17
ENTRY = 64

REPLAY_SQL = """
SELECT l.*, coalesce(p.op = 'SET', false) AS present,
  coalesce(p.op = 'SET' AND (p.expires_us IS NULL OR l.ts_us < p.expires_us), false) AS live,
  p.value AS found, p.expires_us AS found_expires_us,
  CASE WHEN l.op = 'SET' THEN octet_length(encode(l.key)) + l.value_len + 64 ELSE 0 END AS new_cost,
  CASE WHEN p.op = 'SET' THEN octet_length(encode(l.key)) + p.value_len + 64 ELSE 0 END AS old_cost
FROM (SELECT *, max(CASE WHEN op IN ('SET', 'DEL') THEN seq END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM log) l
LEFT JOIN (SELECT *, CASE WHEN ttl_us > 0 THEN ts_us + ttl_us END AS expires_us FROM log) p ON p.seq = l.prior
"""


def with_prior(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """`log` with `prior`: op, value, value_len and expires_us of the key's last mutation before."""
    expires = F.when(F.col("ttl_us") > 0, F.col("ts_us") + F.col("ttl_us"))
    mutation = F.when(F.col("op").isin("SET", "DEL"), F.struct("op", "value", "value_len", expires.alias("expires_us")))
    log = log.withColumns({"_mutation": mutation, "_block": F.floor(F.col("seq") / block)})
    tails = log.filter("_mutation is not null").groupBy("key", "_block").agg(F.max_by("_mutation", "seq").alias("_tail"))
    blocks = log.select("key", "_block").distinct().join(tails, ["key", "_block"], "left")
    before = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("key", "_block", F.last("_tail", ignorenulls=True).over(before).alias("_carried")).filter("_carried is not null")
    within = Window.partitionBy("key", "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("_own", F.last("_mutation", ignorenulls=True).over(within))
    return log.join(carried, ["key", "_block"], "left").withColumn("prior", F.coalesce("_own", "_carried")).drop("_mutation", "_block", "_own", "_carried")


def cost(key: Column, value_len: Column) -> Column:
    return (F.octet_length(key) + value_len + ENTRY).cast("long")


def replay(log: DataFrame, block: int = BLOCK) -> DataFrame:
    """`log` with present (an entry is there, expired or not), live, found, found_expires_us,
    new_cost and old_cost. An entry is expired from the very instant that it expires at; reads
    remove nothing, so an expired entry costs memory until it is overwritten or deleted."""
    prior = F.col("prior")
    present = F.coalesce(prior["op"] == "SET", F.lit(False))
    rows = with_prior(log, block).withColumn("present", present)
    live = F.col("present") & F.coalesce(F.col("ts_us") < prior["expires_us"], F.lit(True))
    return rows.withColumns({
        "live": live,
        "found": prior["value"],
        "found_expires_us": prior["expires_us"],
        "new_cost": F.when(F.col("op") == "SET", cost(F.col("key"), F.col("value_len"))).otherwise(0).cast("long"),
        "old_cost": F.when(F.col("present"), cost(F.col("key"), prior["value_len"])).otherwise(0).cast("long"),
    }).drop("prior")


def usage_curve(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq, usage) after each row of `changes` (seq, delta): the sum of each block, the sums
    before it, and the sum within it, so that no window spans the log."""
    changes = changes.withColumn("_block", F.floor(F.col("seq") / block))
    sums = changes.groupBy("_block").agg(F.sum("delta").alias("_sum"))
    offsets = sums.select("_block", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return changes.join(offsets, "_block").select("seq", (F.col("_before") + F.sum("delta").over(within)).cast("long").alias("usage"))
