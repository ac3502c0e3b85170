"""Streaming queries, drained over what the log holds now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.plans.catalogue import _oracle
from kvlog.sources.log import command_log
from kvlog.sources.shared import shared_dir
from kvlog.streaming.replay import stream_replay


#: Bytes of files that one micro-batch reads: a key's commands in it are folded together.
BATCH = str(256 << 20)


def _drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the events there are as a stream into files of the shared folder, where its checkpoint is
    too, and gives the rows of these files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    class Source:
        """The command log over a streaming read."""

        class read:
            @staticmethod
            def parquet(path: str) -> DataFrame:
                return spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH).parquet(path if _is_folder(spark, path) else path.replace("events.parquet", "event[s].parquet"))

    folder, log = shared_dir(spark, "stream"), stream_replay(command_log(Source, sf_dir))
    query = log.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{folder}/rows")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir).select("seq", "key", "op", "present", "live")


def hit_ratio_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir).filter("op in ('GET', 'EXISTS')").groupBy("key").agg(F.count_if("live").alias("hits"), F.count("*").alias("reads"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"stream_replay": replayed, "stream_hit_ratio": hit_ratio_by_key}
SQL = {
    "stream_replay": _oracle("SELECT seq, key, op, present, live FROM {replay}"),
    "stream_hit_ratio": _oracle("SELECT key, count(*) FILTER (WHERE live) AS hits, count(*) AS reads FROM {replay} WHERE op IN ('GET', 'EXISTS') GROUP BY key"),
}
