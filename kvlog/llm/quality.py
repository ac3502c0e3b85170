"""Quality scores by a factorisation machine.

The inputs are hashed words, statistics of the text's structure in bins, and the metadata column
n_chars in bins. A score is linear in them plus all pairwise products at low rank, in linear
time by half the difference between the square of the sum and the sum of the squares.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import best_threshold, fitted, held_out, labelled, labelled_sample, small_batches, table

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Buckets of hashed words, bins of a statistic, rank of the products, training rows a label.
WORDS, BINS, RANK, SAMPLE = 1 << 14, 16, 8, 2500

_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _LOWER[97:123] = True, True
_PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """Shares in [0, 1] and counts of the structure, and the metadata."""
    n, size = len(words), max(1, len(text))
    bytes_ = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    letters = max(1, bytes_[_UPPER].sum() + bytes_[_LOWER].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    shared = lambda x: math.log1p(x) / 14
    top = counts.most_common(1)[0][1] if counts else 0
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        shared(n),
        len(counts) / max(1, n),
        top / max(1, n),
        repeats / max(1, n - 1),
        min(1.0, sum(map(len, words)) / max(1, n) / 24),
        bytes_[_UPPER].sum() / letters,
        bytes_[_PUNCTUATION].sum() / size,
        bytes_[48:58].sum() / size,
        bytes_[128:].sum() / size,
        (bytes_[9:14].sum() + bytes_[32]) / size,
        shared(len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, max(map(len, lines), default=0) / 4096),
        bytes_[124] / max(1, n),
        sum(bytes_[[33, 35, 36, 37, 38, 42]]) / max(1, n),
        (bytes_[46] + bytes_[63]) / max(1, n),
        0.0 if n_chars is None else shared(max(0, n_chars)),
        1.0 if n_chars is None else 0.0,
    ]


STATISTICS = len(statistics("", [], Counter(), 0))
WIDTH = WORDS + STATISTICS * (BINS + 1)


def features(text: str, n_chars: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): words by the log of their count at unit length, statistics by bin."""
    words = text.split()
    counts = Counter(words)
    at = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS for w in counts), np.int64, len(counts))
    x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    x /= max(1e-9, np.sqrt((x * x).sum()))
    stats = np.array(statistics(text, words, counts, n_chars))
    bins = WORDS + np.arange(STATISTICS) * (BINS + 1) + np.ceil(np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64)
    return np.concatenate([at, bins]), np.concatenate([x, np.full(STATISTICS, 1 / np.sqrt(STATISTICS))])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        return float(self.bias + self.linear[at] @ x + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum()))

    def score(self, text: str | None, n_chars: int | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.raw(*features(text or "", n_chars))))))


def fit(rows: list[tuple[int, str | None, int | None]], epochs: int = 12, seed: int = 3) -> Machine:
    """Adagrad over balanced rows (label, text, n_chars). The bias is then moved so that on rows
    set aside the best parting of the labels lies at THRESHOLD."""
    data, y = [features(t or "", n) for _, t, n in rows], np.array([r[0] for r in rows], np.float64)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(WIDTH), rng.normal(0, 0.05, (WIDTH, RANK)))
    aside = rng.random(len(rows)) < 0.2
    train = np.flatnonzero(~aside)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        for k in rng.permutation(train):
            at, x = data[k]
            total = (m.factors[at] * x[:, None]).sum(axis=0)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, m.raw(at, x)))))
            g = (p - y[k]) * weight[k]
            if abs(g) < 1e-3:
                continue
            gw = g * x + 1e-5 * m.linear[at]
            gv = g * x[:, None] * (total - m.factors[at] * x[:, None]) + 1e-5 * m.factors[at]
            seen_b += g * g
            np.add.at(seen_w, at, gw * gw)
            np.add.at(seen_v, at, gv * gv)
            m.bias -= 0.1 * g / math.sqrt(seen_b)
            np.add.at(m.linear, at, -0.1 * gw / np.sqrt(seen_w[at]))
            np.add.at(m.factors, at, -0.05 * gv / np.sqrt(seen_v[at]))
    check = np.flatnonzero(aside) if y[aside].min(initial=1) < y[aside].max(initial=0) else train
    m.bias += math.log(THRESHOLD / (1 - THRESHOLD)) - best_threshold([m.raw(*data[k]) for k in check], y[check])
    return m


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Machine | None:
    """A machine from `per_label` rows of each label at most. None without labelled documents."""
    rows = labelled_sample(docs.withColumns({"text": F.col("text").cast("string"), "n_chars": F.col("n_chars").cast("long")}), labelled(labels, "quality", FOLDS, HELD_OUT), per_label, ("text", "n_chars"))
    return fitted(rows, lambda found: fit(found) if found else None)


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text, n_chars).

    A null text is scored as the empty one, a null n_chars as missing; without a machine all
    scores are 0.5. Rows without an id are held out; repeated rows are scored each; no rows
    give none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches):
        m = shared.value
        for batch in batches:
            s = [m.score(t, n) if m else 0.5 for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
