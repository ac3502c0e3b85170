"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

A task reads its candidates once, in blocks, and holds the k best of each query so far. A block
keeps, for each dimension, its rows in the order of that component. A query reads the lists
from the end that its own component favours, down to the depth where the bound on rows not yet
met, the sum over the dimensions of query times list value there, cannot beat its k-th score
so far; rows met are scored whole. An equal bound does not stop it, as a row not yet met may
have the smaller id. Queries are sent to the candidates in passes of bounded size, so that no
candidate is copied or shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

K = 10
SCALE = 1024
#: Rows of a block of candidates, and of a task's first one, which has no k-th score to stop at yet.
BLOCK, FIRST = 8192, 1024
#: Numbers in the queries of one pass: what the driver holds and sends to all tasks, 32 MB.
PASS = 4 << 20
#: Scores that are held at once.
SCORES = 1 << 21
#: Sums of whole numbers below this are exact in doubles, which are multiplied much faster.
EXACT = 1 << 53
#: No score, and the ends of what a score can be.
NONE, LEAST, MOST = -(1 << 63), 1 - (1 << 63), (1 << 63) - 1


def quantised(embedding: Column) -> Column:
    """floor(SCALE * x) of each component; null where the vector takes no part."""
    x = embedding.cast("array<double>")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(ok, F.transform(x, lambda v: F.floor(v * SCALE).cast("long")))


class Searcher:
    """The k best candidates of each query, as blocks of candidates come. `scored` counts the pairs
    that have been scored, of `offered` ones."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.ids = np.zeros((len(queries), k), np.int64)
        self.scores = np.full((len(queries), k), NONE)
        self.largest = self._largest(queries)
        self.scored = self.offered = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """A block, of vectors as long as the queries."""
        if not len(ids) or not len(self.queries):
            return
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        self.offered += len(ids) * len(self.queries)
        if self.largest * self._largest(vectors) * vectors.shape[1] >= EXACT:
            self.scored += len(ids) * len(self.queries)
            for k in range(len(self.queries)):
                exact = np.clip(vectors.astype(object) @ self.queries[k].astype(object), LEAST, MOST)
                self._merge(np.array([k]), ids, exact.astype(np.int64)[:, None])
            return
        x, q, n = vectors.astype(np.float64), self.queries.astype(np.float64), len(ids)
        lists, depths = np.argsort(x, axis=0, kind="stable"), self._depths(n)
        values = np.take_along_axis(x, lists, axis=0)
        bounds = np.maximum(q, 0) @ values[n - depths].T + np.minimum(q, 0) @ values[depths - 1].T
        stop = (bounds >= self.scores[:, -1:]).sum(axis=1)  # bounds fall with the depth: so many do not stop the query
        depth = np.append(depths, n)[stop]
        early = (stop < len(depths)) & ((q != 0).sum(axis=1) * depth < n)
        for k in np.flatnonzero(early):
            met = np.unique(np.concatenate([lists[n - depth[k] :, q[k] > 0].ravel(), lists[: depth[k], q[k] < 0].ravel()]))
            self.scored += len(met)
            self._merge(np.array([k]), ids[met], (x[met] @ q[k])[:, None].astype(np.int64))
        whole = np.flatnonzero(~early)  # the lists are to be read so deep that all rows may be met
        self.scored += len(whole) * n
        for at in range(0, len(whole), max(1, SCORES // n)):
            own = whole[at : at + max(1, SCORES // n)]
            self._merge(own, ids, (x @ q[own].T).astype(np.int64))

    @staticmethod
    def _largest(x: np.ndarray) -> int:
        return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))

    @staticmethod
    def _depths(n: int) -> np.ndarray:
        """Depths of the lists at which a query may stop, each about a tenth deeper."""
        return np.unique(np.minimum(n, np.ceil(1.1 ** np.arange(int(np.log(n) / np.log(1.1)) + 2)).astype(np.int64)))

    def _merge(self, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes the scores (candidate, query) of queries `own` into their k best."""
        if not len(ids):
            return
        scores, kth = np.where(ids[:, None] == self.query_ids[own], NONE, scores).T, self.scores[own, -1]
        if len(ids) > self.k:
            kth = np.maximum(kth, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        q, c = np.nonzero((scores >= kth[:, None]) & (scores > NONE))
        s = np.concatenate([self.scores[own].ravel(), scores[q, c]])
        i, q = np.concatenate([self.ids[own].ravel(), ids[c]]), np.concatenate([np.repeat(np.arange(len(own)), self.k), q])
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, and never overflows
        keep = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < self.k]
        self.scores[own], self.ids[own] = s[keep].reshape(len(own), self.k), i[keep].reshape(len(own), self.k)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, candidate id, score) of all that is held."""
        q, c = np.nonzero(self.scores > NONE)
        return self.query_ids[q], self.ids[q, c], self.scores[q, c]


def _by_length(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each length of the lists."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        own = pa.array(lengths == n)
        yield ids.filter(own).to_numpy(), lists.filter(own).flatten().to_numpy().reshape(-1 if n else int((lengths == 0).sum()), n)


def _passes(queries: DataFrame, numbers: int) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The queries, dealt into passes of about so many numbers. Only one pass is here at once."""
    n = max(1, -(-(queries.agg(F.sum(F.size("x") + 1)).first()[0] or 0) // numbers))
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(n))
    for p in range(n):
        found = queries.filter(deal == p).toArrow().combine_chunks()
        yield [part for batch in found.to_batches() for part in _by_length(batch.column(0), batch.column(1))]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, first: int = FIRST, numbers: int = PASS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of `vectors` for each row of `queries`, both
    (vec_id, x array<long>), by integer inner product, the query's own id excluded.

    Each task returns k rows a query, and those of all tasks are ranked, ties to smaller ids.
    Vectors without an id, null ones, those that hold a null and those of other lengths than
    the query's take no part. A repeated id of the candidates is each of its rows; of a repeated
    query id the least row asks. Scores beyond a long are its end. Fewer candidates than k are
    all returned; no rows give none.
    """
    spark, whole = vectors.sparkSession, "vec_id is not null and x is not null and not exists(x, v -> v is null)"
    vectors = vectors.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    queries = queries.filter(whole).select(F.col("vec_id").cast("long").alias("vec_id"), "x").groupBy("vec_id").agg(F.min("x").alias("x"))
    order, found = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), []
    for asked in _passes(queries, numbers):
        shared = spark.sparkContext.broadcast(asked)

        def search(batches, shared=shared):
            to = {x.shape[1]: Searcher(ids, x, k) for ids, x in shared.value}
            held, size = {n: [] for n in to}, dict.fromkeys(to, 0)

            def meet(n):
                ids, x = (np.concatenate(c) for c in zip(*held[n], strict=True))
                step = block if to[n].offered else first
                for at in range(0, len(ids), step):
                    to[n].add(ids[at : at + step], x[at : at + step])
                held[n], size[n] = [], 0

            for batch in batches:
                for ids, x in _by_length(batch.column(0), batch.column(1)):
                    n = x.shape[1]
                    if n in to:
                        held[n].append((ids, x))
                        size[n] += len(ids)
                        if size[n] >= (block if to[n].offered else first):
                            meet(n)
            for n in to:
                if size[n]:
                    meet(n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in to[n].best()], ["query_id", "vec_id", "score"])

        near = vectors.mapInArrow(search, "query_id long, vec_id long, score long")
        found.append(near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    if len(found) > 1:  # each pass is a scan of its own
        found = [cut(f) for f in found]
    return functools.reduce(DataFrame.unionByName, found)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("x"))
    return top_k(rows, rows.filter("vec_id % 100 = 0"))


OP5_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
