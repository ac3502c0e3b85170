"""The command log: one key-value command for each row of `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SQL = """
SELECT event_id AS seq, epoch_us(ts) AS ts_us, 'user:' || user_id AS key, op,
  CASE WHEN op = 'SET' THEN props END AS value,
  CASE WHEN op = 'SET' THEN CAST(octet_length(encode(props)) AS BIGINT) END AS value_len,
  CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 1000000) AS BIGINT) * 60 END AS ttl_us,
  event_type, user_id
FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'SET' WHEN 'purchase' THEN 'SET' WHEN 'error' THEN 'DEL'
  WHEN 'click' THEN 'EXISTS' WHEN 'view' THEN 'GET' END AS op FROM events)
"""


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts_us, key, op, value, value_len, ttl_us, event_type, user_id. Time is that of the
    log alone; a time to live of null or of zero and less means that the value stays."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.col("event_type")
    op = F.when(kind.isin("signup", "purchase"), "SET").when(kind == "error", "DEL").when(kind == "click", "EXISTS").when(kind == "view", "GET")
    sets = kind.isin("signup", "purchase")
    return events.select(
        F.col("event_id").alias("seq"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts_us"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"),
        op.alias("op"),
        F.when(sets, F.col("props")).alias("value"),
        F.when(sets, F.octet_length("props").cast("long")).alias("value_len"),
        F.when(kind == "purchase", F.floor(F.col("value") * 1000000).cast("long") * 60).alias("ttl_us"),
        "event_type",
        "user_id",
    )
