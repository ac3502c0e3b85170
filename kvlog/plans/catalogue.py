"""The queries over the command log and over benchmark results, and their SQL equivalents."""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.functions import commands, resp
from kvlog.operators import benchstats, policies, replay, sketch
from kvlog.plans.dialect import for_duckdb, for_spark
from kvlog.sources.log import LOG_SQL, command_log
from kvlog.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AT_US = 1705276800000000  # a fixed instant of the log: 15 January 2024
H60 = "CAST(('0x' || substr(md5(key), 1, 15)) AS BIGINT)"
BASES = {"log": LOG_SQL, "replay": replay.REPLAY_SQL, "placed": f"SELECT DISTINCT key, {H60} AS h FROM log"}


def pick(expr: str, values: list) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


RIG = f"""
SELECT event_id AS run_id, 'E' || CAST(1 + event_id % 3 AS STRING) AS experiment, event_type AS subject,
  {pick("(event_id ~/ 3) % 8", [1, 2, 4, 8, 16, 32, 48, 96])} AS cores, {pick("user_id % 2", [64, 4096])} AS data_size,
  {pick("user_id % 4", [0, 50000, 100000, 200000])} AS rate,
  100000 + (event_id % 1000) * CASE WHEN {pick("(event_id ~/ 3) % 8", [1, 2, 4, 8, 16, 32, 48, 96])} <= 8 THEN 10 ELSE 100 END AS ops,
  CAST(floor(value * 10) AS BIGINT) AS p999_us, (event_id * 7) % 101 AS srv_cpu, (event_id * 13) % 101 AS cli_cpu,
  (event_id * 17) % 101 AS srv_nic, (event_id * 19) % 101 AS cli_nic, (event_id * 23) % 26000 AS srv_mbps, (event_id * 29) % 26000 AS cli_mbps,
  event_id % 53 = 0 AS failed, event_id % 97 AS hits, event_id % 89 AS misses
FROM events"""
CONFIGURATION = "experiment, subject, cores, data_size, rate"
#: The gate in SQL of its own: every repeat beside its configuration's lists, not an aggregate joined back.
GATED_SQL = f"""
SELECT * EXCLUDE (place, broken), CASE WHEN broken THEN 'memtier-failed' WHEN NOT cli_cpu < 85 THEN 'rig-limited:client-cpu'
    WHEN greatest(srv_nic, cli_nic) >= 80 OR greatest(srv_mbps, cli_mbps) * 5 >= 25000 * 4 THEN 'rig-limited:nic'
    WHEN rate = 0 AND srv_cpu < 65 THEN 'under-generated:srv-cpu<65' WHEN cov > 0.05 THEN 'noisy:cov>5%' ELSE 'valid' END AS valid
FROM (SELECT *, row_number() OVER (PARTITION BY {CONFIGURATION} ORDER BY apart, run_id) AS place FROM (
  SELECT *, abs(ops - quantile_cont(ops, 0.5) OVER w) AS apart, coalesce(stddev_pop(ops) OVER w / nullif(avg(ops) OVER w, 0), 0) AS cov, bool_or(failed OR ops = 0) OVER w AS broken
  FROM rig WINDOW w AS (PARTITION BY {CONFIGURATION})))
WHERE place = 1"""


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _literal(rows: list[tuple], columns: str) -> str:
    """A literal table for either engine."""
    spelled = ", ".join("(" + ", ".join(_quoted(x) if x is None or isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {spelled}) AS t({columns})"


def _frames(spark: SparkSession, sf_dir: str, sql: str) -> dict[str, DataFrame]:
    log = command_log(spark, sf_dir)
    make = {
        "log": lambda: log,
        "replay": lambda: replay.replay(log),
        "placed": lambda: log.select("key").distinct().withColumn("h", F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 15), 16, 10).cast("long")),
        "events": lambda: spark.read.parquet(f"{sf_dir}/events.parquet"),
        "rig": lambda: _rig(spark, sf_dir),
        "gated": lambda: benchstats.gated(_rig(spark, sf_dir)),
    }
    return {k: f() for k, f in make.items() if "{" + k + "}" in sql}


def _spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    text = for_spark(sql)
    return spark.sql(text, **_frames(spark, sf_dir, text))


def shared(name: str, sql: str, oracle: str | None = None) -> None:
    """A query in the shared SQL; `{log}` and the like are frames of ours in the one engine and
    their own SQL in the other. With `oracle` that SQL is what the result is held against."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spark_sql(spark, sf_dir, sql)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = oracle if oracle is not None else _oracle(sql)


def _oracle(sql: str) -> str:
    text = for_duckdb(sql).replace("{rig}", "rig").replace("{gated}", "gated").replace("{events}", "events")
    used = "WITH " + ", ".join(f"{k} AS ({for_duckdb(v)})" for k, v in {**BASES, "rig": RIG, "gated": GATED_SQL}.items())
    for k in BASES:
        text = text.replace("{" + k + "}", k)
    return f"{used} {text}"


def query(name: str, oracle: str | None = None):
    """Registers a DataFrame query under its name, with the SQL of its equivalent, if there is one."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = _oracle(oracle)
        return f

    return add


# Replay.

shared("kv_command_log", "SELECT seq, ts_us, key, op, value_len, ttl_us FROM {log}")
DELTA = "CASE op WHEN 'SET' THEN new_cost - old_cost WHEN 'DEL' THEN -old_cost ELSE 0 END"
shared("kv_replay", f"SELECT seq, key, op, present, live, CASE WHEN op IN ('GET', 'EXISTS') THEN CASE WHEN live THEN 1 ELSE 0 END END AS hit, CAST({DELTA} AS BIGINT) AS delta FROM {{replay}}")
shared("kv_get_result", "SELECT seq, key, live AS ok, CASE WHEN live THEN found END AS value FROM {replay} WHERE op = 'GET'")
shared("kv_set_delta", "SELECT seq, key, CAST(new_cost AS BIGINT) AS cost, CAST(new_cost - old_cost AS BIGINT) AS delta FROM {replay} WHERE op = 'SET'")
shared("kv_del_reply", "SELECT seq, key, CASE WHEN live THEN 1 ELSE 0 END AS reply, CAST(old_cost AS BIGINT) AS freed FROM {replay} WHERE op = 'DEL'")
shared("kv_exists_reply", "SELECT seq, key, CASE WHEN live THEN 1 ELSE 0 END AS reply FROM {replay} WHERE op = 'EXISTS'")
REMAINING = "((found_expires_us - ts_us) ~/ 1000)"
shared("kv_ttl_seconds", f"SELECT seq, key, CAST(CASE WHEN NOT live THEN -2 WHEN found_expires_us IS NULL THEN -1 ELSE ({REMAINING} + 500) ~/ 1000 END AS BIGINT) AS reply FROM {{replay}} WHERE op IN ('GET', 'EXISTS')")
shared("kv_pttl_millis", f"SELECT seq, key, CAST(CASE WHEN NOT live THEN -2 WHEN found_expires_us IS NULL THEN -1 ELSE {REMAINING} END AS BIGINT) AS reply FROM {{replay}} WHERE op IN ('GET', 'EXISTS')")
shared("kv_ttl_rounding", "SELECT px, CAST((px + 500) ~/ 1000 AS BIGINT) AS reply FROM (VALUES (1500), (1499), (500), (499), (1), (60000)) AS t(px)",
       "SELECT * FROM (VALUES (1500, 2), (1499, 1), (500, 1), (499, 0), (1, 0), (60000, 60)) AS t(px, reply)")

# Snapshots.

LAST = f"""SELECT key, max_by(op, seq) AS op, max_by(coalesce(value_len, -1), seq) AS value_len, max_by(coalesce(ttl_us, 0), seq) AS ttl_us, max_by(ts_us, seq) AS ts_us
  FROM {{log}} WHERE op IN ('SET', 'DEL') AND ts_us <= {AT_US} GROUP BY key"""
shared("kv_keyspace_at", f"SELECT key, value_len, CASE WHEN ttl_us > 0 THEN ts_us + ttl_us END AS expires_us, ttl_us <= 0 OR ts_us + ttl_us > {AT_US} AS live FROM ({LAST}) WHERE op = 'SET'")
shared("kv_len_live", f"SELECT count(*) AS n FROM ({LAST}) WHERE op = 'SET' AND (ttl_us <= 0 OR ts_us + ttl_us > {AT_US})")
shared("kv_len_physical", f"SELECT count(*) AS n FROM ({LAST}) WHERE op = 'SET'")
shared("kv_usage_bytes", f"SELECT CAST(sum({DELTA}) AS BIGINT) AS bytes FROM {{replay}}")
shared("kv_cache_stats", f"""SELECT count(*) FILTER (WHERE op IN ('GET', 'EXISTS') AND live) AS hits, count(*) FILTER (WHERE op IN ('GET', 'EXISTS') AND NOT live) AS misses,
  CAST(sum({DELTA}) AS BIGINT) AS usage, count(*) FILTER (WHERE op = 'SET') AS sets, count(*) FILTER (WHERE op = 'DEL' AND live) AS deleted FROM {{replay}}""")
RATIO = "count(*) FILTER (WHERE live) AS hits, count(*) AS reads, CAST(count(*) FILTER (WHERE live) AS DOUBLE) / count(*) AS ratio FROM {replay} WHERE op IN ('GET', 'EXISTS')"
shared("kv_hit_ratio_by_day", f"SELECT ts_us ~/ 86400000000 AS day, {RATIO} GROUP BY ts_us ~/ 86400000000")
shared("kv_hit_ratio_by_user", f"SELECT key, {RATIO} GROUP BY key")
shared("kv_ttl_histogram", "SELECT ttl_us ~/ 3600000000 AS hours, count(*) AS n FROM {log} WHERE ttl_us > 0 GROUP BY ttl_us ~/ 3600000000")


@query("kv_usage_curve", f"SELECT seq, CAST(sum({DELTA}) OVER (ORDER BY seq) AS BIGINT) AS usage FROM {{replay}}")
def kv_usage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replay.replay(command_log(spark, sf_dir))
    delta = F.when(F.col("op") == "SET", F.col("new_cost") - F.col("old_cost")).when(F.col("op") == "DEL", -F.col("old_cost")).otherwise(0)
    return replay.usage_curve(rows.select("seq", delta.alias("delta")))


BATCH_SQL = """SELECT batch, CAST({what} AS BIGINT) AS reply FROM (
  SELECT r.batch, r.key, coalesce(p.op = 'SET' AND (p.ttl_us IS NULL OR p.ttl_us <= 0 OR r.began < p.ts_us + p.ttl_us), false) AS live
  FROM (SELECT *, seq // 8 AS batch, min(ts_us) OVER (PARTITION BY seq // 8) AS began,
    max(CASE WHEN op IN ('SET', 'DEL') THEN seq END) OVER (PARTITION BY key ORDER BY seq // 8 RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM log) r
  LEFT JOIN log p ON p.seq = r.prior) GROUP BY batch"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of eight keys each, all against the state before the first of them: a key's last
    mutation in a batch is one row of a log whose sequence numbers are the batches."""
    log = command_log(spark, sf_dir).withColumn("batch", F.floor(F.col("seq") / 8))
    mutation = F.when(F.col("op").isin("SET", "DEL"), F.struct("op", "value", "value_len", "ts_us", "ttl_us"))
    asked = log.groupBy("key", "batch").agg(F.count("*").alias("times"), F.max_by(mutation, F.when(mutation.isNotNull(), F.col("seq"))).alias("last"))
    found = replay.with_prior(asked.select(F.col("batch").alias("seq"), "key", "times", "last.*")).withColumnRenamed("seq", "batch")
    began = log.groupBy("batch").agg(F.min("ts_us").alias("began"))
    live = F.coalesce((F.col("prior.op") == "SET") & F.coalesce(F.col("began") < F.col("prior.expires_us"), F.lit(True)), F.lit(False))
    return found.drop("ts_us").join(began, "batch").withColumn("live", live)


@query("kv_del_multi", BATCH_SQL.replace("{what}", "count(DISTINCT key) FILTER (WHERE live)"))
def kv_del_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).groupBy("batch").agg(F.count_if("live").alias("reply"))


@query("kv_exists_multi", BATCH_SQL.replace("{what}", "count(*) FILTER (WHERE live)"))
def kv_exists_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(spark, sf_dir).groupBy("batch").agg(F.sum(F.when(F.col("live"), F.col("times")).otherwise(0)).alias("reply"))


# Placement. Portable 60-bit hashes, so that both engines place alike.

shared("kv_shard_of", "SELECT key, h, h ~/ 72057594037927936 AS shard FROM {placed}")
shared("kv_shard_load", "SELECT h ~/ 72057594037927936 AS shard, count(*) AS keys FROM {placed} GROUP BY h ~/ 72057594037927936")
shared("kv_shard_skew", "SELECT max(keys) AS most, min(keys) AS least, CAST(max(keys) * 16 AS DOUBLE) / sum(keys) AS skew FROM (SELECT h ~/ 72057594037927936 AS shard, count(*) AS keys FROM {placed} GROUP BY h ~/ 72057594037927936) t")
shared("kv_bucket_home", "SELECT key, h % 1024 AS bucket FROM {placed}")
shared("kv_hash_spread", "SELECT count(DISTINCT h ~/ 17592186044416) AS high, count(DISTINCT h % 65536) AS low, count(*) AS keys FROM {placed}")
shared("kv_key_sample", "SELECT key FROM (SELECT key, row_number() OVER (ORDER BY md5('7:' || key), key) AS n FROM {placed}) t WHERE n <= 5")
SHARDS = [(-3, 32), (0, 32), (1, 1), (2, 2), (3, 4), (16, 16), (17, 32), (1000, 1024)]
shared("kv_shard_count", f"SELECT n, CAST(CASE WHEN n = 1 THEN 1 ELSE shiftleft(1L, length(bin(CASE WHEN n <= 0 THEN 4 * 8 ELSE n END - 1))) END AS BIGINT) AS shards FROM (VALUES {', '.join(f'({n})' for n, _ in SHARDS)}) AS t(n)", f"SELECT n, CAST(s AS BIGINT) AS shards FROM (VALUES {', '.join(map(str, SHARDS))}) AS t(n, s)")
shared("kv_sketch_sizing", "SELECT ceiling, CAST(CASE WHEN ceiling <= 0 THEN 1024 ELSE greatest(1024, least(4194304, ceiling ~/ 256)) END AS BIGINT) AS counters FROM (VALUES (0), (-5), (1), (262144), (262400), (1048576), (2000000000)) AS t(ceiling)",
       "SELECT ceiling, CAST(n AS BIGINT) AS counters FROM (VALUES (0, 1024), (-5, 1024), (1, 1024), (262144, 1024), (262400, 1025), (1048576, 4096), (2000000000, 4194304)) AS t(ceiling, n)")
POLICY = "CASE WHEN {x} IN ('noeviction', 'allkeys-random', 'allkeys-lfu') THEN {x} END"
#: Settings of caches in the order they were given: cache, place, name, value.
SETTINGS = [(1, 1, "shards", "3"), (1, 2, "policy", "noeviction"), (1, 3, "shards", "9"), (1, 4, "policy", None), (2, 1, "maxmemory", "-5"), (2, 2, "seed", "7"), (2, 3, "clock", None), (3, 1, "clock", "log"), (3, 2, "maxmemory", "4096"), (3, 3, "maxmemory", "8192")]


@query("kv_options", _literal([(1, "noeviction", 0, 16, 1, "log"), (2, "allkeys-lfu", 0, 32, 7, "log"), (3, "allkeys-lfu", 8192, 32, 1, "log")], "cache, policy, maxmemory, shards, seed, clock"))
def kv_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.built(spark.createDataFrame(SETTINGS, "cache int, n int, name string, value string"))


POLICIES_ASKED = [("noeviction", "noeviction", "noeviction"), ("allkeys-random", "allkeys-random", "allkeys-random"), ("allkeys-lfu", "allkeys-lfu", "allkeys-lfu"), ("AllKeys-LFU", None, "allkeys-lfu"), ("lru", None, None), ("", None, None)]
shared("kv_policy_parse", f"SELECT name, {POLICY.replace('{x}', 'name')} AS strict, {POLICY.replace('{x}', 'lower(name)')} AS folded, coalesce({POLICY.replace('{x}', 'name')}, 'unknown') AS spelled FROM (VALUES {', '.join(f'({n!r})' for n, *_ in POLICIES_ASKED)}) AS t(name)",
       _literal([(n, s, f, s or "unknown") for n, s, f in POLICIES_ASKED], "name, strict, folded, spelled"))
CONFIG = "(VALUES (1, 'set', 'maxmemory', '1000'), (2, 'get', 'maxmemory', NULL), (3, 'set', 'maxmemory', '-1'), (4, 'set', 'maxmemory', 'x'), (5, 'get', 'maxmemory', NULL), (6, 'set', 'maxmemory-policy', 'NoEviction'), (7, 'get', 'maxmemory-policy', NULL), (8, 'set', 'maxmemory-policy', 'lru'), (9, 'get', 'maxmemory-policy', NULL), (10, 'set', 'save', ''), (11, 'get', 'save', NULL)) AS t(n, verb, name, value)"
GOOD = "CASE WHEN name = 'maxmemory' AND regexp_replace(value, '^(0|[1-9][0-9]*)$', '') = '' AND length(value) BETWEEN 1 AND 18 THEN value WHEN name = 'maxmemory-policy' AND lower(value) IN ('noeviction', 'allkeys-random', 'allkeys-lfu') THEN lower(value) END"
shared("kv_config_state", f"""SELECT n, verb, name, CASE WHEN verb = 'get' THEN CASE WHEN name IN ('maxmemory', 'maxmemory-policy') THEN coalesce(state, CASE WHEN name = 'maxmemory' THEN '0' ELSE 'allkeys-lfu' END) ELSE '(empty)' END
    WHEN name NOT IN ('maxmemory', 'maxmemory-policy') OR good IS NOT NULL THEN 'OK' ELSE 'invalid' END AS reply
  FROM (SELECT *, last_value(good) IGNORE NULLS OVER (PARTITION BY name ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM (SELECT *, {GOOD} AS good FROM {CONFIG}) g) s""",
       "SELECT * FROM (VALUES (1, 'set', 'maxmemory', 'OK'), (2, 'get', 'maxmemory', '1000'), (3, 'set', 'maxmemory', 'invalid'), (4, 'set', 'maxmemory', 'invalid'), (5, 'get', 'maxmemory', '1000'), (6, 'set', 'maxmemory-policy', 'OK'), (7, 'get', 'maxmemory-policy', 'noeviction'), (8, 'set', 'maxmemory-policy', 'invalid'), (9, 'get', 'maxmemory-policy', 'noeviction'), (10, 'set', 'save', 'OK'), (11, 'get', 'save', '(empty)')) AS t(n, verb, name, reply)")

# Protocol.

E = "chr(13) || chr(10)"


def _hex(c):
    return F.lower(F.hex(c.cast("binary")))


@query("resp_encode_request", f"""SELECT seq, lower(hex(encode('*' || n || {E} || body))) AS frame FROM (SELECT seq, 2 + (value IS NOT NULL)::INT + 2 * (coalesce(ttl_us, 0) > 0)::INT AS n,
  '$' || length(op) || {E} || op || {E} || '$' || octet_length(encode(key)) || {E} || key || {E} || coalesce('$' || octet_length(encode(value)) || {E} || value || {E}, '')
  || CASE WHEN ttl_us > 0 THEN '$2' || {E} || 'PX' || {E} || '$' || length(CAST(ttl_us // 1000 AS VARCHAR)) || {E} || (ttl_us // 1000) || {E} ELSE '' END AS body FROM log)""")
def resp_encode_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("seq", _hex(F.col("frame")).alias("frame"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = F.col("ttl_us") > 0
    px = F.when(timed, F.lit("PX")), F.when(timed, F.expr("ttl_us div 1000").cast("string"))
    return command_log(spark, sf_dir).select("seq", "op", "key", "value", "ttl_us", resp.request(F.col("op"), F.col("key"), F.col("value"), *px).alias("frame"))


def _replies(version: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v, rows = F.lit(version), replay.replay(command_log(spark, sf_dir))
        count = resp.integer(F.col("live").cast("int"))
        reply = F.when(F.col("op") == "SET", resp.simple(F.lit("OK"))).when(F.col("op") == "GET", F.when(F.col("live"), resp.bulk(F.col("found"))).otherwise(resp.null(v))).otherwise(count)
        return rows.select("seq", _hex(reply).alias("frame"), _hex(resp.boolean(F.col("live"), v)).alias("as_boolean"), _hex(resp.big_number(F.col("seq").cast("string"), v)).alias("as_number"))

    return run


for _v, _null, _bool, _big in ((2, "'$-1'", "':' || live::INT", "'$' || length(seq::VARCHAR) || chr(13) || chr(10) || seq"), (3, "'_'", "CASE WHEN live THEN '#t' ELSE '#f' END", "'(' || seq")):
    query(f"resp_encode_reply{_v}", f"""SELECT seq, lower(hex(encode(CASE op WHEN 'SET' THEN '+OK' WHEN 'GET' THEN CASE WHEN live THEN '$' || octet_length(encode(found)) || {E} || found ELSE {_null} END
      ELSE ':' || live::INT END || {E}))) AS frame, lower(hex(encode({_bool} || {E}))) AS as_boolean, lower(hex(encode({_big} || {E}))) AS as_number FROM {{replay}}""")(_replies(_v))  # fmt: skip


@query("resp_map_downgrade", "SELECT n, v, CASE WHEN v >= 3 THEN '%' || n ELSE '*' || (2 * n) END AS header, '*' || n AS plain FROM (VALUES (0), (1), (7)) a(n), (VALUES (1), (2), (3), (4)) b(v)")
def resp_map_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM (VALUES (0), (1), (7)) a(n), (VALUES (1), (2), (3), (4)) b(v)")
    line = lambda frame: F.rtrim(F.regexp_replace(frame, "[\\r\\n]", ""))
    return rows.select("n", "v", line(resp.map_header(F.col("n"), F.col("v"))).alias("header"), line(resp.array_header(F.col("n"))).alias("plain"))


DOUBLES = [
    ("3.0", "3"), ("0.1", "0.1"), ("-2.5", "-2.5"), ("1e21", "1e+21"), ("1.5e-7", "1.5e-07"), ("123456789.0", "1.23456789e+08"), ("0.001", "0.001"), ("0", "0"), ("100000", "100000"), ("123456.75", "123456.75"), ("1e6", "1e+06"), ("-1234567.5", "-1.2345675e+06"),
    ("0.0001", "0.0001"), ("0.00012", "0.00012"), ("0.00001", "1e-05"), ("12e-120", "1.2e-119"), ("1.7976931348623157e308", "1.7976931348623157e+308"), ("99999.5", "99999.5"), ("120", "120"),
]


@query("resp_double_text", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, (_, t) in enumerate([*DOUBLES, (0, "inf"), (0, "-inf"), (0, "nan")])) + ") t(i, spelled)")
def resp_double_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = [x for x, _ in DOUBLES] + ["Infinity", "-Infinity", "NaN"]
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, CAST('{x}' AS DOUBLE))" for i, x in enumerate(texts)) + " t(i, x)")
    return rows.select("i", resp.double_text(F.col("x")).alias("spelled"))


@query("resp_decode_roundtrip", "SELECT seq, op, key, value, 'ok' AS outcome FROM log")
def resp_decode_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resp.decoded(_requests(spark, sf_dir).select(F.col("seq").alias("id"), "frame"))
    arg = lambda i: F.get("args", i).cast("string")
    return rows.select(F.col("id").alias("seq"), arg(0).alias("op"), arg(1).alias("key"), arg(2).alias("value"), "outcome")


ARRAY, BULK, LENGTH, CRLF = "expected '*' array header", "expected '$' bulk-string header", "invalid length", "expected CRLF terminator"
FRAMES = [
    (b"*1\r\n$4\r\nPING\r\n", "ok"), (b"*0\r\n", "ok"), (b"*2\r\n$3\r\nGET\r\n$0\r\n\r\n", "ok"), (b"*1\r\n$4\r\nPI", "truncated"), (b"*1\r\n$4\r\nPING", "truncated"), (b"*2\r\n$1\r\na\r\n", "truncated"),
    (b"*", "truncated"), (b"PING\r\n", ARRAY), (b"*1\r\n+OK\r\n", BULK), (b"*-1\r\n", LENGTH), (b"*01\r\n", LENGTH), (b"*+1\r\n", LENGTH),
    (b"*1\r\n$-1\r\n", LENGTH), (b"*1\r\n$x\r\n", LENGTH), (b"*1048577\r\n", "multibulk count exceeds configured limit"), (b"*1\r\n$536870913\r\n", "bulk length exceeds configured limit"), (b"*1\r\n$1\r\nabc\r\n", CRLF),
    (b"*1\n", CRLF), (b"*" + b"1" * 70 + b"\r\n", "header line exceeds limit"), (b"", "end"),
]


def _closing(outcome: str) -> tuple[str, str | None]:
    if outcome in ("ok", "truncated", "end"):
        return ("dispatch" if outcome == "ok" else "close"), None
    return "error then close", f"-ERR Protocol error: {outcome}"


@query("resp_decode_errors", _literal([(i, o, *_closing(o)) for i, (_, o) in enumerate(FRAMES)], "id, outcome, disposition, reply"))
def resp_decode_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT id, unhex(h) AS frame FROM VALUES " + ", ".join(f"({i}, '{f.hex()}')" for i, (f, _) in enumerate(FRAMES)) + " t(id, h)")
    found = rows.select("id").join(resp.decoded(rows).select("id", "outcome"), "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("end")))
    return found.select("id", "outcome", resp.disposition(F.col("outcome")).alias("disposition"), F.rtrim(F.regexp_replace(resp.protocol_error(F.col("outcome")), "[\\r\\n]", "")).alias("reply"))


DIMENSION = "(VALUES " + ", ".join(f"('{v}', {a}, {b or 'NULL'})" for v, a, b in commands.COMMANDS) + ") AS c(verb, least, most)"
shared("cmd_dispatch_counts", f"SELECT c.verb, count(l.seq) AS n FROM {DIMENSION} LEFT JOIN {{log}} l ON lower(l.op) = c.verb GROUP BY c.verb")
WRONG = "ERR wrong number of arguments for '{}'"
ARITY = [("PING", 1, "ok"), ("ping", 3, WRONG.format("ping")), ("Get", 1, WRONG.format("get")), ("GET", 2, "ok"), ("set", 2, WRONG.format("set")), ("DEL", 9, "ok"), ("EXISTS", 1, WRONG.format("exists")), ("FLUSH", 1, "ERR unknown command 'FLUSH', with args beginning with: "), ("HELLO", 6, "ok"), ("select", 2, "ok"), ("CONFIG", 1, WRONG.format("config")), ("a\tb\r\n-OK", 1, "ERR unknown command 'a?b??-OK', with args beginning with: ")]


@query("cmd_arity", _literal([(i, o) for i, (_, _, o) in enumerate(ARITY)], "n, outcome"))
def cmd_arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, v, n) for i, (v, n, _) in enumerate(ARITY)], "n int, verb string, argc int")
    known = commands.arity(F.col("verb"))
    wrong = (F.col("argc") < known["least"]) | (F.col("argc") > known["most"])
    return rows.select("n", F.when(known.isNull(), commands.unknown_command(F.col("verb"))).when(wrong, commands.wrong_arity(F.col("verb"))).otherwise("ok").alias("outcome"))


def _hello(conn: int, proto: int) -> str:
    """The server's map, spelled out."""
    head = "%7" if proto == 3 else "*14"
    return "|".join([head, "$6|server|$5|kvlog|$7|version|$3|1.0|$5|proto", f":{proto}", f"$2|id|:{conn}|$4|mode|$10|standalone|$4|role|$6|master|$7|modules|*0|"])


#: Connection, arguments, dialect after them, reply with bars for line ends, whether it closes.
TALK = [
    (1, ["PING"], 2, "+PONG|", 0), (1, ["ping", "hé"], 2, "$3|hé|", 0), (1, ["HELLO"], 2, _hello(1, 2), 0), (1, ["HELLO", "3"], 3, _hello(1, 3), 0), (1, ["hello"], 3, _hello(1, 3), 0), (1, ["HELLO", "4"], 3, "-NOPROTO unsupported protocol version|", 0),
    (1, ["HELLO", "abc"], 3, "-NOPROTO unsupported protocol version|", 0), (1, ["HELLO", "2", "AUTH", "u", "p"], 3, "-ERR Client sent AUTH, but no password is set|", 0), (1, ["HELLO", "2", "SETNAME"], 3, "-ERR syntax error|", 0),
    (1, ["HELLO", "2", "setname", "x"], 2, _hello(1, 2), 0), (1, ["HELLO", "3", "SETNAME", "x", "WHAT"], 2, "-ERR syntax error|", 0), (2, ["COMMAND"], 2, "*0|", 0), (2, ["COMMAND", "docs"], 2, "*0|", 0), (2, ["COMMAND", "COUNT"], 2, ":12|", 0),
    (2, ["COMMAND", "LIST"], 2, "-ERR Unknown COMMAND subcommand or wrong number of arguments|", 0), (2, ["SELECT", "0"], 2, "+OK|", 0), (2, ["SELECT", "7"], 2, "-ERR DB index is out of range|", 0), (2, ["SELECT", "x"], 2, "-ERR value is not an integer or out of range|", 0),
    (2, ["CONFIG", "GET"], 2, "-ERR Unknown CONFIG subcommand or wrong number of arguments|", 0), (2, ["CONFIG"], 2, "-ERR wrong number of arguments for 'config'|", 0), (2, ["NOPE", "x"], 2, "-ERR unknown command 'NOPE', with args beginning with: |", 0),
    (2, ["QUIT", "now"], 2, "-ERR wrong number of arguments for 'quit'|", 0), (2, [], 2, None, 0), (2, ["GET", "k"], 2, None, 0), (2, ["QUIT"], 2, "+OK|", 1),
]


@query("cmd_replies", _literal([(i, p, r, c) for i, (_, _, p, r, c) in enumerate(TALK)], "n, proto, reply, closes"))
def cmd_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c, i, a) for i, (c, a, *_) in enumerate(TALK)], "conn int, n int, args array<string>")
    return commands.replies(rows, "kvlog", "1.0").select("n", "proto", F.replace("reply", F.lit(resp.CRLF), F.lit("|")).alias("reply"), F.col("closes").cast("int").alias("closes"))


@query("cmd_error_texts", _literal([(0, "-OOM command not allowed when used memory > 'maxmemory'|"), (1, "-ERR disk?gone|")], "n, reply"))
def cmd_error_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(0, None), (1, "disk\tgone")], "n int, fault string")
    text = F.when(F.col("fault").isNull(), F.lit(commands.OUT_OF_MEMORY)).otherwise(commands.engine_error(F.col("fault")))
    return rows.select("n", F.replace(resp.error(text), F.lit(resp.CRLF), F.lit("|")).alias("reply"))


NOW_S = 1700000000
OPTIONS = [
    ("", "persist"), ("EX 10", "10000"), ("px 10", "10"), (f"EXAT {NOW_S + 5}", "5000"), (f"PXAT {NOW_S * 1000 + 7}", "7"), ("EX", "syntax"), ("EX 10 20", "syntax"), ("KEEP 10", "syntax"), ("EX +5", "not an integer"), ("EX 007", "not an integer"),
    ("EX abc", "not an integer"), ("EX 0", "invalid expire"), ("EX -1", "invalid expire"), ("EX -0", "invalid expire"), ("EX 9223372037", "invalid expire"), ("PX 9223372036855", "invalid expire"), ("EX 9223372036854775808", "not an integer"),
    ("EX -9223372036854775808", "not an integer"), (f"EXAT {NOW_S}", "invalid expire"), ("PX 9223372036854", "9223372036854"), ("EX 1.5", "not an integer"),
]


def spark_quoted(text: str) -> str:
    return "'" + text.replace("'", "\\'") + "'"


def set_expiry(words: str, now_ms: str) -> str:
    """Spark SQL of a SET's options: the milliseconds to live, persist, or the first error."""
    unit, n = f"upper(get({words}, 0))", f"get({words}, 1)"
    value = f"CASE WHEN {n} RLIKE '^-?(0|[1-9][0-9]*)$' AND {n} <> '-9223372036854775808' THEN try_cast({n} AS BIGINT) END"
    bound = f"CASE WHEN {unit} IN ('EX', 'EXAT') THEN 9223372036 ELSE 9223372036854 END"
    ms = f"(({value}) * CASE WHEN {unit} IN ('EX', 'EXAT') THEN 1000 ELSE 1 END - CASE WHEN {unit} IN ('EXAT', 'PXAT') THEN {now_ms} ELSE 0 END)"
    return f"""CASE WHEN size({words}) = 0 THEN 'persist' WHEN size({words}) <> 2 OR {unit} NOT IN ('EX', 'PX', 'EXAT', 'PXAT') THEN {spark_quoted(commands.SYNTAX)} WHEN ({value}) IS NULL THEN {spark_quoted(commands.NOT_INTEGER)}
      WHEN ({value}) > {bound} OR ({value}) < -{bound} OR {ms} <= 0 THEN {spark_quoted(commands.BAD_EXPIRE)} ELSE CAST({ms} AS STRING) END"""


#: The errors' texts, by the short names above.
SPELLED = {"syntax": "ERR syntax error", "not an integer": "ERR value is not an integer or out of range", "invalid expire": "ERR invalid expire time in 'set' command"}


@query("cmd_set_options", _literal([(i, SPELLED.get(o, o)) for i, (_, o) in enumerate(OPTIONS)], "n, outcome"))
def cmd_set_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(f"({i}, '{x}')" for i, (x, _) in enumerate(OPTIONS))
    return spark.sql(f"SELECT n, {set_expiry('words', str(NOW_S * 1000))} AS outcome FROM (SELECT n, filter(split(x, ' '), w -> w <> '') AS words FROM VALUES {rows} t(n, x))")


HELLO = [(1, 1, "3", 3), (2, 1, None, 3), (3, 2, None, 2), (4, 1, "4", 3), (5, 1, "2", 2), (6, 2, "abc", 2), (7, 2, "3", 3), (8, 1, None, 2)]
shared("cmd_hello_dialect", f"""SELECT n, conn, coalesce(last_value(CASE WHEN version IN ('2', '3') THEN CAST(version AS INTEGER) END) IGNORE NULLS
  OVER (PARTITION BY conn ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS proto, CASE WHEN version IS NULL OR version IN ('2', '3') THEN 'map' ELSE 'NOPROTO' END AS reply
  FROM (VALUES {", ".join(f"({n}, {c}, {repr(v) if v else 'NULL'})" for n, c, v, _ in HELLO)}) AS t(n, conn, version)""",
       "SELECT * FROM (VALUES " + ", ".join(f"({n}, {c}, {p}, '{'NOPROTO' if v in ('4', 'abc') else 'map'}')" for n, c, v, p in HELLO) + ") t(n, conn, proto, reply)")
shared("cmd_select", "SELECT x, CASE WHEN x = '0' THEN 'OK' WHEN length(x) < 19 AND length(x) > 0 AND regexp_replace(x, '^-?[0-9]+$', '') = '' THEN 'out of range' ELSE 'not an integer' END AS reply FROM (VALUES ('0'), ('1'), ('-3'), ('x'), ('')) AS t(x)",
       "SELECT * FROM (VALUES ('0', 'OK'), ('1', 'out of range'), ('-3', 'out of range'), ('x', 'not an integer'), ('', 'not an integer')) t(x, reply)")


@query("cmd_sanitize", """SELECT seq, array_to_string(list_transform(range(0, least(128, length(h) // 2)), lambda i: CASE WHEN substr(h, CAST(i * 2 + 1 AS INTEGER), 2) < '20' OR substr(h, CAST(i * 2 + 1 AS INTEGER), 2) = '7F' THEN '3F' ELSE substr(h, CAST(i * 2 + 1 AS INTEGER), 2) END), '') AS clean
  FROM (SELECT seq, hex(encode(op || chr(9) || key || chr(10) || repeat('é漢' || chr(127), CAST(15 + seq % 11 AS INTEGER)))) AS h FROM log)""")
def cmd_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of two- and three-byte letters, cut at all places of a letter."""
    text = F.concat("op", F.lit("\t"), "key", F.lit("\n"), F.repeat(F.lit("é漢\x7f"), (15 + F.col("seq") % 11).cast("int")))
    return command_log(spark, sf_dir).select("seq", F.hex(commands.as_bytes(commands.sanitized(text))).alias("clean"))


# Policies and sketches.

CAPACITIES = (10, 50, 100)
LRU_SQL = """SELECT a.seq, a.key, CASE WHEN a.prev IS NOT NULL THEN count(b.seq) END AS distance FROM (SELECT seq, key, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS prev FROM log) a
  LEFT JOIN (SELECT seq, coalesce(lag(seq) OVER (PARTITION BY key ORDER BY seq), -1) AS prev FROM log) b ON b.seq > a.prev AND b.seq < a.seq AND b.prev <= a.prev GROUP BY a.seq, a.key, a.prev"""


@query("sim_lru_hits", LRU_SQL)
def sim_lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.reuse_distances(command_log(spark, sf_dir))


@query("sim_lru_hit_ratio", f"SELECT c AS capacity, count(*) FILTER (WHERE distance < c) AS hits, CAST(count(*) FILTER (WHERE distance < c) AS DOUBLE) / count(*) AS ratio FROM ({LRU_SQL}) t, (VALUES {', '.join(f'({c})' for c in CAPACITIES)}) k(c) GROUP BY c")
def sim_lru_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = policies.reuse_distances(command_log(spark, sf_dir)).select("distance", F.explode(F.array(*map(F.lit, CAPACITIES))).alias("capacity"))
    hits = F.count_if(F.col("distance") < F.col("capacity"))
    return rows.groupBy("capacity").agg(hits.alias("hits"), (hits.cast("double") / F.count("*")).alias("ratio"))


def _simulated(name: str, configurations: list[tuple[str, int]], **options) -> None:
    QUERIES[name] = lambda spark, sf_dir: policies.replay_policies(command_log(spark, sf_dir), configurations, **options)


_simulated("sim_noeviction", [("noeviction", 8192)])
_simulated("sim_random", [("allkeys-random", 8192)])
_simulated("sim_lfu", [("allkeys-lfu", 8192)])
_simulated("sim_lower_ceiling", [("allkeys-lfu", 16384)], lower_to=4096)
_simulated("sim_policy_switch", [("noeviction", 8192), ("allkeys-random", 8192)], switch_to="allkeys-lfu")
_simulated("sim_policy_compare", [(p, c) for p in policies.POLICIES for c in (4096, 8192, 0)], fill=64)


def zipf(spark: SparkSession, n: int = 300000, keys: int = 10000, s: float = 1.3) -> DataFrame:
    """(seq, key): ranks by the inverse of the distribution function at a hash of seq."""
    weights = [(k + 1) ** -s for k in range(keys)]
    total, edges, run = sum(weights), [], 0.0
    for w in weights:
        run += w / total
        edges.append((len(edges), run))
    bounds = F.broadcast(spark.createDataFrame([(k, edges[k - 1][1] if k else 0.0, e) for k, e in edges], "rank long, low double, high double").withColumn("slot", F.explode(F.sequence(F.floor(F.col("low") * 64), F.floor(F.col("high") * 64)))))
    u = spark.range(n).select(F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)).alias("u")).withColumn("slot", F.floor(F.col("u") * 64))
    return u.join(bounds, (u["slot"] == bounds["slot"]) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("seq", F.lpad(F.col("rank").cast("string"), 5, "0").alias("key"))


QUERIES["zipf_trace"] = lambda spark, sf_dir: zipf(spark)


# Workloads of a load generator, from hashes of the row's number that both engines have.

_U = "CAST(('0x' || substr(md5(concat('{salt}', CAST(event_id AS STRING))), {at}, {n})) AS BIGINT)"


def _part(salt: str, at: int = 1, n: int = 12) -> str:
    return _U.format(salt=salt, at=at, n=n)


def _hexed(sql: str) -> str:
    """The same for Spark, which reads hexadecimal digits otherwise."""
    return re.sub(r"CAST\(\('0x' \|\| (substr\(md5\(.*?\)\), \d+, \d+\))\) AS BIGINT\)", r"CAST(conv(\1, 16, 10) AS BIGINT)", sql)


#: Shares of reads, and keys, of the mixes; all keys exist, so a write is an overwrite.
MIXES = "(VALUES ('read90', 90), ('write50', 50)) AS m(mix, reads), (VALUES (65536), (4096)) AS k(keys)"
MIX = f"SELECT event_id AS seq, mix, keys, CASE WHEN {_part('op')} % 100 < reads THEN 'GET' ELSE 'SET' END AS op, {_part('key')} % keys AS key FROM {{events}}, {MIXES}"
#: One write, uniform over the keys, to two reads, normal around the middle key: twelve uniform numbers, added.
TWELVE = " + ".join(_part(salt, at, 4) for salt in ("x", "y") for at in (1, 5, 9, 13, 17, 21))
GAUSS = f"SELECT event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'SET' ELSE 'GET' END AS op, CASE WHEN event_id % 3 = 0 THEN {_part('key')} % 50000 ELSE greatest(0, least(49999, (({TWELVE}) * 6000) ~/ 65536 - 36000 + 25000)) END AS key, 4096 AS value_len FROM {{events}}"
for _name, _sql in {"load_mix": MIX, "load_gauss": GAUSS}.items():
    shared(_name, _hexed(_sql), _oracle(_sql))
shared("load_gauss_moments", f"SELECT op, CAST(round(avg(key)) AS BIGINT) ~/ 500 AS middle, CAST(round(stddev_pop(key)) AS BIGINT) ~/ 500 AS spread FROM ({_hexed(GAUSS)}) t GROUP BY op", _oracle(f"SELECT op, CAST(round(avg(key)) AS BIGINT) // 500 AS middle, CAST(round(stddev_pop(key)) AS BIGINT) // 500 AS spread FROM ({GAUSS}) t GROUP BY op"))


#: Accesses of the trace before the measured ones, and the entries that a cache holds.
ZIPF_WARM, ZIPF_CAPACITY = 50000, 100
#: Bytes of an entry: a key of 5, a value of 32, and what each entry costs.
ZIPF_ENTRY = 5 + 32 + replay.ENTRY


def _zipf_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    trace = zipf(spark).select("seq", F.lit("GET").alias("op"), "key", F.lit(0).cast("long").alias("ts_us"), F.lit(32).cast("long").alias("value_len"), F.lit(None).cast("long").alias("ttl_us"))
    engine = policies.replay_policies(trace, [(p, ZIPF_CAPACITY * ZIPF_ENTRY) for p in policies.POLICIES[1:]], fill=32, warm=ZIPF_WARM)
    return engine.unionByName(policies.replay_lru(trace, ZIPF_CAPACITY, ZIPF_ENTRY, warm=ZIPF_WARM))


QUERIES["zipf_policy_compare"] = _zipf_compare
shared("sketch_exact_frequency", "SELECT key, count(*) AS n FROM {log} WHERE op IN ('GET', 'EXISTS') GROUP BY key")
shared("door_second_sighting_exact", "SELECT l.seq, l.key, l.seq > f.first AS seen FROM {log} l JOIN (SELECT key, min(seq) AS first FROM {log} WHERE op IN ('GET', 'EXISTS') GROUP BY key) f ON f.key = l.key WHERE l.op IN ('GET', 'EXISTS')",
       _oracle("SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) > 1 AS seen FROM {log} WHERE op IN ('GET', 'EXISTS')"))


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, n, estimate): how often each key was read, and what the sketch holds at the end."""
    reads = command_log(spark, sf_dir).filter("op in ('GET', 'EXISTS')").select("seq", "key")
    end = policies.in_parts(reads, [policies.Recording(1024, 1)], "frequencies binary").first()

    def run(batches):
        f = pickle.loads(end[0]) if end else None
        for b in batches:
            found = [f.estimate(policies.fingerprint(k, 1)) for k in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], ["key", "n", "estimate"])

    return reads.groupBy("key").agg(F.count("*").alias("n")).mapInArrow(run, "key string, n long, estimate long")


QUERIES["sketch_estimate"] = _estimates
QUERIES["sketch_error"] = lambda spark, sf_dir: _estimates(spark, sf_dir).select(F.least("n", F.lit(sketch.MOST)).alias("n"), "estimate").groupBy("n").agg(F.count("*").alias("keys"), F.min("estimate").alias("least"), F.max("estimate").alias("most"))


@query("sketch_halve", "SELECT before, before // 2 AS after FROM (VALUES (0), (1), (2), (7), (14), (15)) t(before)")
def sketch_halve(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            after = []
            for n in batch.column(0).to_pylist():
                s = sketch.Sketch(64)
                for _ in range(n):
                    s.increment(99)
                s.halve()
                after.append(s.estimate(99))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(after, pa.int32())], ["before", "after"])

    return spark.createDataFrame([(n,) for n in (0, 1, 2, 7, 14, 15)], "before int").mapInArrow(run, "before int, after int")


@query("door_fpr", "SELECT true AS within_bound, 4000 AS inserted")
def door_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    door = sketch.Doorkeeper(4000)
    for i in range(4000):
        door.put_or_has(sketch.mix(i))
    false = sum(all(door.set[((sketch.mix(i) + k * (sketch.mix(sketch.mix(i)) | 1)) & (1 << 64) - 1) & (door.bits - 1)] for k in range(sketch.PROBES)) for i in range(10**6, 10**6 + 4000))
    return spark.createDataFrame([(false / 4000 <= 0.15, 4000)], "within_bound boolean, inserted int")


# Benchmark analytics.

CSV = ["test,rps,avg_latency_ms,min_latency_ms,p50_latency_ms,p95_latency_ms,p99_latency_ms,max_latency_ms", '"SET",61000.5,0.2,0.1,0.191,0.4,0.719,2', '"GET",64000,0.2,0.1,0.18,0.4,0.7,2']
CSVS = {"good": CSV, "bare": ["SET,100", "GET,200.5"], "empty": [""], "header": CSV[:1], "negative": ["SET,-1"], "text": ["SET,1", "GET,x"], "short": ["SET"]}


@query("bench_parse_csv", "SELECT * FROM (VALUES ('good', 'SET', 61000.5::DOUBLE, 0.191::DOUBLE, 0.719::DOUBLE, NULL), ('good', 'GET', 64000, 0.18, 0.7, NULL), ('bare', 'SET', 100, 0, 0, NULL), ('bare', 'GET', 200.5, 0, 0, NULL), ('empty', NULL, NULL, NULL, NULL, 'no results'), ('header', NULL, NULL, NULL, NULL, 'no results'), ('negative', NULL, NULL, NULL, NULL, 'bad rate'), ('text', NULL, NULL, NULL, NULL, 'bad rate'), ('short', NULL, NULL, NULL, NULL, 'too few columns')) t(file, command, rps, p50, p99, error)")
def bench_parse_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.parse_throughput(spark.createDataFrame([(f, i, x) for f, lines in CSVS.items() for i, x in enumerate(lines)], "file string, n int, line string"))


_LATE = '"Percentile Latencies": {"p50.00": 0.1, "p99.00": 0.5, "p99.90": 1.5, "p99.99": 2.5}'
JSONS = {
    "good": '{"ALL STATS": {"Totals": {"Ops/sec": 1000, "Hits/sec": 900, "Misses/sec": 100, %s}}}' % _LATE, "none": '{"ALL STATS": {"Totals": {"Hits/sec": 0, "Misses/sec": 0}}}', "bad": "{",
    "negative": '{"ALL STATS": {"Totals": {"Hits/sec": -1, "Misses/sec": 5}}}', "missing": '{"ALL STATS": {}}',
}


@query("bench_parse_json", "SELECT * FROM (VALUES ('good', 0.9::DOUBLE, 1000::DOUBLE, 0.1::DOUBLE, 0.5::DOUBLE, 1.5::DOUBLE, NULL), ('none', NULL, NULL, NULL, NULL, NULL, 'no reads'), ('bad', NULL, NULL, NULL, NULL, NULL, 'malformed'), ('negative', NULL, NULL, NULL, NULL, NULL, 'no reads'), ('missing', NULL, NULL, NULL, NULL, NULL, 'malformed')) t(file, hit_ratio, ops, p50, p99, p999, error)")
def bench_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.parse_hit_ratio(spark.createDataFrame(list(JSONS.items()), "file string, content string"))


#: Results of the rig's load generator: the totals have the hits, or the reads alone have them, or none; some cannot be read.
LOADS = {
    "totals": '{"ALL STATS": {"Totals": {"Ops/sec": 1000.6, "Hits/sec": 2, "Misses/sec": 1, %s}}}' % _LATE, "gets": '{"ALL STATS": {"Totals": {"Ops/sec": 10, %s}, "Gets": {"Hits/sec": 1, "Misses/sec": 3}}}' % _LATE,
    "writes": '{"ALL STATS": {"Totals": {"Ops/sec": 10, %s}}}' % _LATE, "old": '{"ALL STATS": {"Totals": {"Ops/sec": 10, "Percentile Latencies": {"p50.00": 1}}}}', "bad": "no json",
}


@query("rig_parse_load", "SELECT * FROM (VALUES ('totals', 1001::BIGINT, 0.1::DOUBLE, 0.5::DOUBLE, 1.5::DOUBLE, 2.5::DOUBLE, 0.6667::DOUBLE, NULL), ('gets', 10, 0.1, 0.5, 1.5, 2.5, 0.25, NULL), ('writes', 10, 0.1, 0.5, 1.5, 2.5, NULL, NULL), ('old', 0, NULL, NULL, NULL, NULL, NULL, 'no p99.90'), ('bad', 0, NULL, NULL, NULL, NULL, NULL, 'malformed')) t(file, ops, p50, p99, p999, p9999, hit_ratio, error)")
def rig_parse_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.parse_load(spark.createDataFrame(list(LOADS.items()), "file string, content string"))


REPEATS = "SELECT event_type AS command, user_id % 3 AS run, max(value) AS rps, min(value) AS p50, max(value) - min(value) AS p99 FROM {events} GROUP BY event_type, user_id % 3"
shared("bench_median_throughput", f"SELECT command, median(rps) AS rps, median(p50) AS p50, median(p99) AS p99 FROM ({REPEATS}) t GROUP BY command",
       _oracle(f"SELECT command, list_sort(list(rps))[(count(*) + 1) // 2] AS rps, list_sort(list(p50))[(count(*) + 1) // 2] AS p50, list_sort(list(p99))[(count(*) + 1) // 2] AS p99 FROM ({REPEATS}) t GROUP BY command"))
RATED = "SELECT experiment, run_id, CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE) / (hits + misses) ELSE 0 END AS ratio FROM rig"


@query("bench_median_hit_ratio_run", f"""SELECT experiment, run_id FROM (SELECT r.experiment, r.run_id, row_number() OVER (PARTITION BY r.experiment ORDER BY abs(r.ratio - m.mid), r.run_id) AS place
  FROM ({RATED}) r JOIN (SELECT experiment, median(ratio) AS mid FROM ({RATED}) t GROUP BY experiment) m ON m.experiment = r.experiment) t WHERE place = 1""")
def bench_median_hit_ratio_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.median_hit_run(_rig(spark, sf_dir))


def _rig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(for_spark(RIG).replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


#: The order of subjects in a table; others follow by name.
ORDER = ["view", "click", "purchase"]
#: What a suite has measured, for each subject: rates of two commands, a hit ratio and latencies, some of them missing.
SUITE = """SELECT event_type AS subject, max(CASE WHEN user_id % 2 = 0 AND event_type <> 'error' THEN value * 1000 END) AS get_rps, max(CASE WHEN user_id % 2 = 1 THEN value * 1000 END) AS set_rps,
  CASE WHEN event_type <> 'signup' THEN CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS DOUBLE) / count(*) END AS hit_ratio, min(value) AS p50, CASE WHEN event_type = 'view' THEN 0.0 ELSE max(value) / 7 END AS p99,
  CASE WHEN event_type <> 'signup' THEN max(value) / 3 END AS p999 FROM {events} GROUP BY event_type"""
SKIPPED = ["zeta", "eta"]
_CELL = "CASE WHEN {x} IS NULL OR {x} <= 0 THEN '—' ELSE printf('{f}', {x}) END"


@query("bench_render_table", f"""SELECT '| Server | GET rps | SET rps | Hit ratio | GET p50 ms | GET p99 ms | p99.9 ms |' || chr(10) || '| --- | ---: | ---: | ---: | ---: | ---: | ---: |' || chr(10)
  || string_agg('| ' || concat_ws(' | ', subject, coalesce(printf('%.0f', get_rps), '—'), coalesce(printf('%.0f', set_rps), '—'), coalesce(printf('%.4f', hit_ratio), '—'), {", ".join(_CELL.replace("{x}", x).replace("{f}", "%.3f") for x in ("p50", "p99", "p999"))}) || ' |' || chr(10), ''
    ORDER BY coalesce(list_position({ORDER}, subject), 99), subject) || chr(10) || '_Skipped (tooling unavailable): eta, zeta._' || chr(10) AS rendered FROM ({SUITE.replace("{events}", "events")}) t""")
def bench_render_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    skipped = spark.createDataFrame([(x,) for x in SKIPPED], "subject string")
    return benchstats.render_table(_spark_sql(spark, sf_dir, SUITE), skipped, ORDER)


SUBJECTS = ["alpha", "beta", "gamma", "delta", "epsilon"]
_MATRICES = {"rig_matrix_e1": ({"subject": SUBJECTS, "data_size": [64, 4096], "rate": [0, 50000, 100000, 200000]}, 40), "rig_matrix_e2": ({"subject": [*SUBJECTS, "zeta"], "cores": [1, 2, 4, 8, 16, 32, 48, 96]}, 48), "rig_matrix_e3": ({"subject": SUBJECTS}, 5)}
for _name, (_axes, _) in _MATRICES.items():
    _from = " CROSS JOIN ".join(f"(VALUES {', '.join(f'({v!r})' for v in vs)}) AS t{i}({a})" for i, (a, vs) in enumerate(_axes.items()))
    _more = ", cores * 4 AS threads, '0-' || CAST(cores - 1 AS STRING) AS pinned" if "cores" in _axes else ""
    shared(_name, f"SELECT {', '.join(_axes)}{_more} FROM {_from}" + (" WHERE cores <= 48" if "cores" in _axes else ""))
shared("rig_cov", f"SELECT {CONFIGURATION}, CAST(count(*) AS BIGINT) AS repeats, round(coalesce(stddev_pop(ops) / nullif(avg(ops), 0), 0), 3) AS cov FROM {{rig}} GROUP BY {CONFIGURATION}",
       _oracle(f"SELECT {CONFIGURATION}, count(*) AS repeats, CASE WHEN sum(ops) = 0 THEN 0 ELSE round(sqrt(greatest(0, sum(CAST(ops AS DOUBLE) * ops) / count(*) - (sum(ops) / count(*)) ** 2)) / (sum(ops) / count(*)), 3) END AS cov FROM {{rig}} GROUP BY {CONFIGURATION}"))
shared("rig_validity", f"SELECT {CONFIGURATION}, valid FROM {{gated}}")
shared("rig_representative", f"SELECT {CONFIGURATION}, run_id, ops FROM {{gated}}")
shared("rig_report_e1", "SELECT data_size, rate, row_number() OVER (PARTITION BY data_size, rate ORDER BY CASE WHEN p999_us > 0 THEN p999_us ELSE 9000000000 END, subject, cores) AS place, subject, cores, ops, p999_us FROM {gated} WHERE valid = 'valid' AND experiment = 'E1'")


@query("rig_report_e2_pivot", "SELECT subject, " + ", ".join(f"coalesce(CAST(min_by(ops, run_id) FILTER (WHERE cores = {c}) AS VARCHAR), '-') AS c{c}" for c in (1, 2, 4, 8, 16, 32, 48, 96)) + " FROM gated WHERE valid = 'valid' AND experiment = 'E2' GROUP BY subject")
def rig_report_e2_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    ladder = (1, 2, 4, 8, 16, 32, 48, 96)
    rows = _spark_sql(spark, sf_dir, "SELECT * FROM {gated}").filter("valid = 'valid' and experiment = 'E2'")
    wide = rows.groupBy("subject").pivot("cores", list(ladder)).agg(F.min_by("ops", "run_id"))
    return wide.select("subject", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")).alias(f"c{c}") for c in ladder])


shared("rig_report_e3", "SELECT row_number() OVER (ORDER BY CASE WHEN hits + misses > 0 THEN CAST(hits AS DOUBLE) / (hits + misses) ELSE 0 END DESC, run_id) AS place, run_id, subject, valid FROM {gated} WHERE experiment = 'E3'")
shared("rig_report_excluded", f"SELECT {CONFIGURATION}, valid AS reason FROM {{gated}} WHERE valid <> 'valid'")

MPSTAT = ["Linux 6.1", "10:00:01 CPU %usr %sys %idle", "10:00:02 all 10.00 5.00 85.00", "Average: CPU %usr %sys %idle", "Average: all 20.00 5.00 75.00", "Average: 0 30.00 10.00 60.00", "Average: 1 10.50 0.25 89.25"]
SAR = ["Average: IFACE rxpck/s txpck/s rxkB/s txkB/s %ifutil", "Average: lo 9 9 99999.00 99999.00 0.00", "Average: eth0 10 10 125.50 250.00 1.50", "Average: eth1 1 1 1.00 2.00 0.01"]
IRQ = (["          CPU0 CPU1", "NET_TX: 5 6", "NET_RX: 100 200", "SCHED: 9 9"], ["          CPU0 CPU1", "NET_TX: 7 6", "NET_RX: 150 260", "SCHED: 99 99"])
SECTIONS = ["noise", "@@MPSTAT@@", *MPSTAT, "@@SAR@@", *SAR, "@@SI1@@", *IRQ[0], "@@SI2@@", *IRQ[1]]


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([("host", i, x) for i, x in enumerate(lines)], "file string, n int, line string")


@query("rig_sections", _literal([(i, next((x.strip("@") for x in reversed(SECTIONS[:i]) if x.startswith("@@"))), x) for i, x in enumerate(SECTIONS) if i and not x.startswith("@@")], "n, section, line"))
def rig_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.sections(_lines(spark, SECTIONS)).select("n", "section", "line")


@query("rig_host_stats", "SELECT 25.0::DOUBLE AS cpu_avg, 40.0::DOUBLE AS cpu_max, 10.8::DOUBLE AS cpu_pinned, 1.0::DOUBLE AS nic_rx_mbps, 2.0::DOUBLE AS nic_tx_mbps, 1.5::DOUBLE AS nic_util, 112 AS softirq_net")
def rig_host_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.host_stats(_lines(spark, SECTIONS), "1,7").drop("file")


@query("rig_mpstat", "SELECT * FROM (VALUES (0, 4000), (1, 1075)) t(core, busy)")
def rig_mpstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.mpstat(_lines(spark, MPSTAT)).filter("core >= 0").select("core", F.round(F.col("busy") * 100).cast("long").alias("busy"))


@query("rig_sar", "SELECT * FROM (VALUES ('eth0', 1.004::DOUBLE, 2.0::DOUBLE, 1.5::DOUBLE)) t(iface, rx_mbps, tx_mbps, util)")
def rig_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.sar(_lines(spark, SAR)).select("iface", "rx_mbps", "tx_mbps", "util")


@query("rig_softirq", "SELECT 112 AS delta")
def rig_softirq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.softirq(_lines(spark, IRQ[0]), _lines(spark, IRQ[1])).select("delta")


@query("rig_cpu_list", "SELECT * FROM (VALUES ('0,2,4-7', 0), ('0,2,4-7', 2), ('0,2,4-7', 4), ('0,2,4-7', 5), ('0,2,4-7', 6), ('0,2,4-7', 7), ('3,3,2-3', 2), ('3,3,2-3', 3)) t(spec, core)")
def rig_cpu_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("0,2,4-7",), ("3,3,2-3",)], "spec string")
    return rows.select("spec", F.explode(benchstats.cpu_list(F.col("spec"))).alias("core"))


@query("rig_human_bytes", "SELECT * FROM (VALUES (1073741824, '1gb'), (67108864, '64m'), (1610612736, '1536m'), (4294967296, '4gb'), (1048577, '1m'), (0, '0gb')) t(n, spelled)")
def rig_human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(n,) for n in (1 << 30, 64 << 20, 1536 << 20, 4 << 30, (1 << 20) + 1, 0)], "n long")
    return rows.select("n", benchstats.human_bytes(F.col("n")).alias("spelled"))


@query("rig_report_e2_detail", """SELECT '| server | cores | ops/s | p99.9 | srvCPU% | NIC% |' || chr(10) || '|---|---|---|---|---|---|' || coalesce(string_agg(chr(10) || '| ' || concat_ws(' | ', subject, cores, ops, CASE WHEN p999_us > 0 THEN printf('%.3f', p999_us / 1000) ELSE '-' END, srv_cpu, srv_nic) || ' |', '' ORDER BY subject, cores, run_id), '') AS rendered
  FROM gated WHERE valid = 'valid' AND experiment = 'E2'""")
def rig_report_e2_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchstats.gated(_rig(spark, sf_dir)).filter("valid = 'valid' and experiment = 'E2'")
    late = F.when(F.col("p999_us") > 0, (F.col("p999_us") / 1000).cast("string")).otherwise("none")
    titles = [("subject", "server"), ("cores", "cores"), ("ops", "ops/s"), ("p999", "p99.9"), ("srv_cpu", "srvCPU%"), ("srv_nic", "NIC%")]
    return benchstats.markdown(rows.withColumn("p999", benchstats.fixed(late, 3)), titles, [F.col("subject"), F.col("cores"), F.col("run_id")])


#: A server of so many cores takes no more of what a configuration asks for.
SERVER_CORES = 8


@query("rig_clamped", f"SELECT run_id, least(cores, {SERVER_CORES}) AS cores, '0-' || (least(cores, {SERVER_CORES}) - 1) AS pinned, least(cores * 2, {SERVER_CORES}) AS threads FROM rig")
def rig_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchstats.clamped(_rig(spark, sf_dir).select("run_id", "cores", (F.col("cores") * 2).alias("threads")), SERVER_CORES, ["threads"])


@query("rig_result_row", f"""SELECT {CONFIGURATION}, ops, p999_us, round(cov, 3) AS cov, CASE WHEN hits + misses > 0 THEN round(CAST(hits AS DOUBLE) / (hits + misses), 4) END AS hit_ratio, srv_cpu, cli_cpu, greatest(srv_nic, cli_nic) AS nic, valid FROM gated""")
def rig_result_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each configuration that is written to the results, read from such a file."""
    reads = F.col("hits") + F.col("misses")
    rows = benchstats.gated(_rig(spark, sf_dir)).select(*benchstats.CONFIGURATION, "ops", "p999_us", F.round("cov", 3).alias("cov"), F.when(reads > 0, F.round(F.col("hits").cast("double") / reads, 4)).alias("hit_ratio"), "srv_cpu", "cli_cpu", F.greatest("srv_nic", "cli_nic").alias("nic"), "valid")
    folder = shared_dir(spark, "results")
    benchstats.write_results(rows, folder, rows.columns)
    return benchstats.read_results(spark, folder).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields])


@query("bench_parse_files", """SELECT command, CAST(run AS VARCHAR) AS file, round(rps, 2) AS rps, round(p50, 2) AS p50 FROM (""" + REPEATS.replace("{events}", "events") + ") t")
def bench_parse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeats written as the load generator's files, one a run, and read from them."""
    rows, folder = _spark_sql(spark, sf_dir, REPEATS), shared_dir(spark, "loads")
    number = lambda c: F.col(c).cast("decimal(20,2)").cast("string")
    line = F.concat(F.lit('"'), "command", F.lit('",'), number("rps"), F.lit(","), number("p50"))
    lines = rows.groupBy("run").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body")).select("run", F.concat(F.lit("test,rps,p50_latency_ms\n"), "body").alias("text"))
    lines.write.partitionBy("run").text(folder)
    # read by place, so that a file's lines keep their order; partition folders name the runs
    read = spark.read.option("wholetext", True).text(folder)
    files = read.select(F.col("run").cast("string").alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return benchstats.parse_throughput(files).select("file", "command", "rps", "p50")
