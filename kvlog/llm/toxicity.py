"""Toxicity scores by a convolutional text classifier trained in numpy.

Hashed embeddings of words and of their beginnings, filters over one, two and three words, the
maximum of each filter over the whole text, and a logistic layer, all trained from random
values, with half of the words hidden in each step. A fifth of the labelled rows is never
trained on, and on all of it, however many rows that is, each language's threshold is found,
which is then moved to one half. The language is that which the text itself is identified as.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import language
from .common import best_threshold, cut, fitted, held_out, labelled, labelled_sample, small_batches, table, unused, written

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Buckets of hashed words, numbers in an embedding, words under a filter, filters of each width.
WORDS, EMBEDDING, WIDTHS, FILTERS = 1 << 14, 12, (1, 2, 3), 12
#: Training rows of each label, and the fewest of either label that a language's threshold needs.
SAMPLE, LEAST = 2000, 15
#: One labelled row in so many is for the thresholds alone.
ASIDE = 5
#: Parts of a unit that raw scores are counted in for the thresholds, and the largest counted as itself.
PARTS, LARGEST = 4, 16
#: Rows that training goes through, over and over, but in so many passes at least and at most.
STEPS, PASSES, MOST_PASSES = 8000, 4, 40
#: The share of words that a training step does not see.
HIDDEN = 0.5
#: A share of the clean texts that is called toxic weighs as much as this many of the toxic ones missed.
CLEAN = 4
#: Words that are convolved at once, so that memory is that of a part of a very long text.
CHUNK = 1 << 15

_WORD = re.compile(r"\w+")
#: Letters of a word's beginning, for words longer than that; buckets of these follow the words'.
START = 4
_PAD = 2 * WORDS
#: Windows that begin in the padding behind a text are none.
_TAIL = WIDTHS[-1] - 1


class _Buckets(dict):
    def __missing__(self, word):
        if len(self) > 200_000:
            self.clear()
        at = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass")) % WORDS
        self[word] = buckets = at(word) * (_PAD + 1) + (WORDS + at(word[:START] + "-") if len(word) > START else _PAD)
        return buckets


_buckets = _Buckets()


def word_ids(text: str | None) -> np.ndarray:
    """Two rows: the buckets of a text's words and of their beginnings; padding at the end, so
    that every word begins a window."""
    words = _WORD.findall((text or "").lower())
    ids = np.full((2, max(1, len(words)) + _TAIL), _PAD, np.int32)
    ids[:, : len(words)] = np.divmod(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), _PAD + 1)
    return ids


def together(filters: list[np.ndarray]) -> np.ndarray:
    """The filters of all widths and places side by side, for one product."""
    return np.concatenate([place for own in filters for place in own], axis=1)


def convolve(embedding: np.ndarray, side: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """What the filters of each width give at each window, the last of ids[:, -_TAIL:] being none."""
    n, parts = ids.shape[1] - _TAIL, (embedding[ids[0]] + embedding[ids[1]]) @ side
    places = iter(range(0, side.shape[1], FILTERS))
    return [sum(parts[j : j + n, at : at + FILTERS] for j, at in zip(range(w), places, strict=False)) for w in WIDTHS]


@dataclass
class Network:
    embedding: np.ndarray
    filters: list[np.ndarray]
    filter_bias: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def pooled(self, held: list[np.ndarray]) -> np.ndarray:
        """The maximum of each filter over all windows of each text, CHUNK windows at once."""
        ids, width, side = np.concatenate(held, axis=1), np.array([h.shape[1] for h in held]), together(self.filters)
        ends = np.cumsum(width)
        edges = np.stack([ends - width, ends - _TAIL], axis=1).ravel()  # of each text and of its padding
        most = np.full((len(held), len(WIDTHS), FILTERS), -np.inf, np.float32)
        for at in range(0, int(edges[-1]), CHUNK):
            n = min(CHUNK, int(edges[-1]) - at)
            part = np.arange(np.searchsorted(edges, at, "right") - 1, np.searchsorted(edges, at + n))
            own, begins = part % 2 == 0, np.maximum(edges[part] - at, 0)
            for k, out in enumerate(convolve(self.embedding, side, ids[:, at : at + n + _TAIL])):
                top = np.maximum.reduceat(out, begins, axis=0)[own]
                most[part[own] // 2, k] = np.maximum(most[part[own] // 2, k], top)
        return np.maximum(0, most + np.stack(self.filter_bias)).reshape(len(held), -1)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Scores before any threshold; texts are put together up to CHUNK words, or one longer text."""
        out, held, size, first = np.empty(len(texts)), [], 0, 0
        for i, text in enumerate(texts, 1):
            held.append(word_ids(text))
            size += held[-1].shape[1]
            if size >= CHUNK or i == len(texts):
                out[first:i] = self.pooled(held) @ self.weights + self.bias
                held, size, first = [], 0, i
        return out


def gradients(net: Network, batch: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The weighted logistic loss of a batch, and its gradient by embedding, filters, their biases,
    weights and bias. Through a maximum it goes to the first window that has it."""
    ids = np.concatenate(batch, axis=1)
    ends = np.cumsum([b.shape[1] for b in batch])
    spans = [(int(e) - b.shape[1], int(e) - _TAIL) for e, b in zip(ends, batch, strict=True)]
    places, tops = [], []
    for out in convolve(net.embedding, together(net.filters), ids):
        at = np.stack([a + out[a:b].argmax(axis=0) for a, b in spans])
        places.append(at)
        tops.append(out[at, np.arange(FILTERS)])
    h = np.maximum(0, np.concatenate([t + b for t, b in zip(tops, net.filter_bias, strict=True)], axis=1))
    z = h @ net.weights + net.bias
    g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(h.dtype)
    back = np.where(h > 0, g[:, None] * net.weights, 0).reshape(len(y), len(WIDTHS), FILTERS)
    by_embedding, by_filter = np.zeros_like(net.embedding), [np.zeros_like(w) for w in net.filters]
    for k, w in enumerate(WIDTHS):
        for j in range(w):
            for row in ids:
                hit = row[places[k] + j]
                by_filter[k][j] += np.einsum("dfe,df->ef", net.embedding[hit], back[:, k])
                np.add.at(by_embedding, hit.ravel(), (back[:, k, :, None] * net.filters[k][j].T).reshape(-1, EMBEDDING))
    by_embedding[-1] = 0
    loss = float((np.logaddexp(0, np.where(y > 0, -z, z)) * weight).mean())
    return loss, [by_embedding, *by_filter, *back.sum(axis=0), h.T @ g, np.array([g.sum()])]


def fit(rows: list[tuple[int, str | None]], seed: int = 11) -> Network | None:
    """Adam over batches of (label, text) whose labels weigh alike, from random values. Buckets that
    no row holds are zero, as is the padding. None without rows."""
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    data, y = [word_ids(t) for _, t in rows], np.array([r[0] for r in rows], np.float64)
    used = np.unique(np.concatenate([*(np.unique(d) for d in data), [_PAD]]))
    data = [np.searchsorted(used, d).astype(np.int32) for d in data]
    start = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    net = Network(
        start(len(used), EMBEDDING),
        [start(w, EMBEDDING, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        start(len(WIDTHS) * FILTERS),
        np.zeros(1, np.float32),
    )
    net.embedding[-1] = 0
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    params = [net.embedding, *net.filters, *net.filter_bias, net.weights, net.bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(max(PASSES, min(MOST_PASSES, STEPS // len(rows)))):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), 32):
            own = order[low : low + 32]
            batch = [np.where(rng.random(data[k].shape[1]) < HIDDEN, len(used) - 1, data[k]) for k in own]
            t += 1
            rate = 0.01 * math.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, (p, g) in enumerate(zip(params, gradients(net, batch, y[own], weight[own])[1], strict=True)):
                first[k] *= 0.9
                first[k] += 0.1 * g
                second[k] *= 0.999
                second[k] += 0.001 * g * g
                p -= rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    whole = np.zeros((_PAD + 1, EMBEDDING), np.float32)
    whole[used] = net.embedding
    net.embedding = whole
    return net


@dataclass
class Classifier:
    network: Network
    languages: language.Model | None

    def language_of(self, texts: list[str]) -> list[str]:
        found = [language.UNKNOWN] * len(texts)
        at = [i for i, t in enumerate(texts) if t] if self.languages else []
        if at:
            best = self.languages.scores([texts[i] for i in at]).argmax(axis=1)
            for i, k in zip(at, best.tolist(), strict=True):
                found[i] = self.languages.languages[k]
        return found


def known(labels: DataFrame, aside: bool) -> DataFrame:
    """(doc_id, _label) outside the held-out part: those for the thresholds, or those to train on."""
    own = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(ASIDE)) == 0
    return labelled(labels, "toxic", FOLDS, HELD_OUT).filter(own if aside else ~own)


def train(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> Classifier | None:
    """A classifier without thresholds from `per_label` rows of each label at most, and from the
    languages of documents outside the held-out part. None without labelled rows."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    network = fitted(labelled_sample(docs, known(labels, aside=False), per_label), fit)
    return network and Classifier(network, language.train(docs.filter(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))))


def with_raw(docs: DataFrame, classifier: Classifier | None, raw: str, lang: str) -> DataFrame:
    """`docs` (text and any other columns) with the score before any threshold and the language that
    the text is identified as. Without a classifier the score is far below any threshold."""
    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(classifier), docs.columns.index("text")

    def score(batches):
        c = shared.value
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).to_pylist()
            raws = c.network.raw(texts) if c else np.full(len(texts), -1e3)
            langs = c.language_of([t or "" for t in texts]) if c else [language.UNKNOWN] * len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raws, pa.float64()), pa.array(langs, pa.string())], [*batch.schema.names, raw, lang])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(raw, T.DoubleType()), T.StructField(lang, T.StringType())]))


def thresholds(raws: DataFrame, labels: DataFrame) -> tuple[float, dict[str, float]]:
    """The threshold over all rows, and that of each language with rows enough. The rows are all of
    `raws` (doc_id, raw, lang) that have a label set aside for this; they are counted by score,
    so no language's rows meet in one place and the driver sees a threshold a language. Each is
    the middle between two counted scores; without both labels it is 0."""
    at = F.round(F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col("raw"))) * PARTS).cast("int").alias("bin")
    counts = raws.join(known(labels, aside=True), "doc_id").groupBy("lang", at, F.col("_label").alias("label")).agg(F.count("*").alias("n"))
    whole = counts.groupBy("bin", "label").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "label", "n")

    def best(key, own: pd.DataFrame) -> pd.DataFrame:
        n, y, every = own["n"].to_numpy(), own["label"].to_numpy(), pd.isna(key[0])
        enough = every or min(n[y == 1].sum(), n[y == 0].sum()) >= LEAST
        cuts = [(None if every else key[0], best_threshold(own["bin"].to_numpy() / PARTS, y, CLEAN, n))] if enough else []
        return pd.DataFrame(cuts, columns=["of", "cut"])

    cuts = dict(map(tuple, counts.unionByName(whole).groupBy("lang").applyInPandas(best, "of string, cut double").collect()))
    return cuts.pop(None, 0.0), cuts


def score(raw: Column, lang: Column, cuts: tuple[float, dict[str, float]]) -> Column:
    """The score in [0, 1]: THRESHOLD where `raw` is at the threshold of its language."""
    own = [F.lit(x) for pair in cuts[1].items() for x in pair]
    cut_ = F.coalesce(F.create_map(*own)[lang], F.lit(cuts[0])) if own else F.lit(cuts[0])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), raw - cut_))))


def scored(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of `docs` (doc_id, text, lang), learned from
    its rows that `labels` (doc_id, toxic) marks outside the held-out part.

    A null or wordless text is scored as padding alone; without labelled rows all scores are 0.
    Rows without an id are held out; repeated rows are scored each; no rows give none.
    """
    made = train(docs, labels, per_label)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raws = with_raw(rows, made, "raw", "lang").drop("text")
    raws = cut(raws) if made else raws  # scored once, both for the thresholds and for the result
    s = score(F.col("raw"), F.col("lang"), thresholds(raws, labels) if made else (0.0, {}))
    return raws.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), s.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang and any other columns) that are not predicted to be
    toxic, as `scored` has it. Without labelled rows all stay."""
    made = train(docs, labels, per_label)
    if made is None:
        return docs
    raw, lang = unused(docs.columns, "raw"), unused(docs.columns, "found_lang")
    rows = written(with_raw(docs, made, raw, lang), "scored")  # scored once, as above
    cuts = thresholds(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(raw).alias("raw"), F.col(lang).alias("lang")), labels)
    return rows.filter(score(F.col(raw), F.col(lang), cuts) < THRESHOLD).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
