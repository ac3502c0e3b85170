"""Pieces shared by the corpus operators: table access, folds, lineage cuts, samples."""

from __future__ import annotations

import math
import pickle
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch: a few very long texts at most are in a Python worker at once.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the memory of Python workers by the size of a batch, not of a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a folder of this machine serves a local
    session; on a cluster that is an error, as no other machine would see it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="kvlog-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises a frame in the shared folder, so that lost executors lose none of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True in the held-out part. Rows without an id are never learned from."""
    return F.coalesce(fold(doc_id, parts) == F.lit(part), F.lit(True))


def sample_by(df: DataFrame, strata: str, per_stratum: int) -> DataFrame:
    """The `per_stratum` rows of each stratum with the least hash of `doc_id`, of a smaller stratum
    all: the same rows in each run and after each loss of an executor. No stratum is left out,
    however many there are. The hash bound, from the counts, lets few more rows reach the ranking
    (four standard deviations, so that one in thirty thousand samples is a row or so short), and
    a stratum that holds most of the corpus is no task's work."""
    df = df.filter(F.col(strata).isNotNull() & F.col("doc_id").isNotNull())
    span, h = 1 << 30, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rates = df.groupBy(strata).count().select(strata, F.expr(f"least({span}, ({span} * {per_stratum + 4 * math.isqrt(per_stratum) + 8}L + count - 1) div count)").alias("_bound"))
    rows = df.join(F.broadcast(rates), strata).filter(h < F.col("_bound"))
    order = Window.partitionBy(strata).orderBy(h, *[F.col(c) for c in df.columns])
    return rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= per_stratum).select(*df.columns)


def labelled(labels: DataFrame, label: str, folds: int, part: int) -> DataFrame:
    """(doc_id, _label) of the labels outside the held-out part. Labels other than 0 and 1 are none."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    return known.filter(F.col("_label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, part))


def labelled_sample(docs: DataFrame, known: DataFrame, per_class: int, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(_label, *columns) of the sample of `known` (doc_id, _label), `per_class` rows of each label:
    narrow rows of a bounded number, which are sent to all. Of documents that share an id, the
    one with the least hash of its columns is taken, so that copies do not widen the sample."""
    sample = sample_by(known, "_label", per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).join(F.broadcast(sample), "doc_id")
    order = Window.partitionBy("doc_id", "_label").orderBy(F.xxhash64(*columns))
    return rows.withColumn("_place", F.row_number().over(order)).filter("_place = 1").select("_label", *columns)


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], object]):
    """What `fit` makes of the rows of a bounded sample, in an order that does not depend on their
    place: in one task, so that the driver holds the result alone."""

    def run(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_pydict({"made": pa.array([pickle.dumps(fit(sorted(rows, key=repr)))], pa.binary())})

    made = sample.repartition(1).mapInArrow(run, "made binary").collect()
    return pickle.loads(made[0][0]) if made else fit([])


def best_threshold(scores, labels, false_weight: float = 1, counts=None) -> float:
    """The score midway between two neighbours that parts the labels best: by the share of true
    rows above it less `false_weight` times that of the others; of equals the middle one. 0
    where there is one label only. A score stands for as many rows as `counts` says, else for one."""
    scores, labels = np.asarray(scores, np.float64), np.asarray(labels, bool)
    if labels.all() or not labels.any():
        return 0.0
    counts = np.ones(len(scores)) if counts is None else np.asarray(counts, np.float64)
    order = np.argsort(scores, kind="stable")
    s, y, n = scores[order], labels[order], counts[order]
    gain = (n * np.where(y, -1 / n[y].sum(), false_weight / n[~y].sum())).cumsum()[:-1]
    gain[s[1:] == s[:-1]] = -np.inf
    if not np.isfinite(gain).any():
        return float(s[0])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = best[len(best) // 2]
    return float((s[k] + s[k + 1]) / 2)


def unused(columns: list[str], name: str) -> str:
    """`name`, or the first longer one that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: a lineage cut for wide rows."""
    folder = fresh_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def keep_where(docs: DataFrame, decide) -> DataFrame:
    """The rows of `docs`, whole and in place, whose text `decide` keeps. `decide()` is called
    in each task and gives a function from a list of texts, null ones too, to a list of booleans."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def keep(batches):
        chosen = decide()
        for batch in batches:
            yield batch.filter(pa.array(chosen(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
