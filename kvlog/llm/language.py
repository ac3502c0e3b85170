"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier of hashed byte n-grams predicts each bit. A
text gets the language whose codeword has the least loss, each bit's loss weighted by how well
its classifier did on training rows set aside; a small lead over the second flags ambiguity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fitted, held_out, sample_by, small_batches, table

FOLDS, HELD_OUT = 5, 0
#: Buckets of hashed n-grams of each order, the orders in bytes, and training rows a language.
BUCKETS, ORDERS, SAMPLE = 2048, (1, 2, 3, 4), 400
#: Bytes that are hashed at once, so that a very long text needs no more memory than others.
CHUNK = 1 << 20
UNKNOWN = "und"
AMBIGUOUS = 0.6

_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams, of each order by itself, at unit length.
    Case, digits and runs of white space make no difference."""
    data = np.frombuffer(b" %b " % " ".join(text.lower().split()).encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BUCKETS * len(ORDERS), np.float64)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + ORDERS[-1] - 1].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for k, n in enumerate(ORDERS):
            m = min(len(part), len(data) - at) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + part[n - 1 : n - 1 + m] + np.uint32(1)
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            bucket = (mixed >> np.uint32(21)).astype(np.int64)
            out[k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(bucket[:CHUNK], minlength=BUCKETS)
    for k in range(len(ORDERS)):
        own = out[k * BUCKETS : (k + 1) * BUCKETS]
        own /= max(1.0, own.sum())
    return (np.sqrt(out) / np.sqrt(len(ORDERS))).astype(np.float32)


def codewords(classes: int) -> np.ndarray:
    """A row of signs for each class. Up to 5 classes: all two-sided splits; beyond: splits
    drawn from a fixed seed, of many draws those whose codewords lie farthest apart."""
    if classes <= 5:
        splits = range(1, max(2, 1 << (classes - 1)))
        return np.array([[1 if s >> c & 1 else -1 for s in splits] for c in range(classes)], np.float32)
    rng, best = np.random.default_rng(7), (-1, None)
    bits = 10 * int(np.ceil(np.log2(classes)))
    for _ in range(200):
        code = rng.permuted(np.where(np.arange(classes)[:, None] % 2 == 0, 1.0, -1.0).repeat(bits, axis=1), axis=0)
        apart = ((bits - code @ code.T) / 2 + np.eye(classes) * bits).min()
        best = max(best, (apart, code), key=lambda x: x[0])
    return best[1].astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row of probabilities for each text, over the languages."""
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, self.weights.shape[0]), np.float32)
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[str], langs: list[str], epochs: int = 30, seed: int = 5) -> Model:
    """Logistic regressions by Adam; a fifth of the rows is set aside to weigh the bits. Features are
    held sparse, since the rows grow with the number of languages."""
    names = sorted(set(langs))
    y, code = np.array([names.index(v) for v in langs]), codewords(len(names))
    sparse = [(k, f[k]) for f in map(features, texts) for k in [np.flatnonzero(f).astype(np.uint16)]]

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS * len(ORDERS)), np.float32)
        for own, r in zip(x, rows.tolist(), strict=True):
            own[sparse[r][0]] = sparse[r][1]
        return x

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    aside, train = order[: len(texts) // 5], order[len(texts) // 5 :]
    w, b = np.zeros((BUCKETS * len(ORDERS), code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb, t = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b), 0
    share = np.bincount(y, minlength=len(names))
    balance = (len(y) / len(names) / np.maximum(1, share))[y].astype(np.float32)[:, None]
    for _ in range(epochs):
        for at in range(0, len(train), 64):
            k = train[at : at + 64]
            signs, x = code[y[k]], dense(k)
            g = -signs / (1 + np.exp(signs * (x @ w + b))) * balance[k] / len(k)
            gw, gb, t = x.T @ g + 1e-5 * w, g.sum(axis=0), t + 1
            m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            rate = 0.1 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w, b = w - rate * m / (np.sqrt(v) + 1e-8), b - rate * mb / (np.sqrt(vb) + 1e-8)
    check = aside if len(aside) else train
    parts = [check[at : at + 1024] for at in range(0, len(check), 1024)]
    right = sum(((dense(k) @ w + b) * code[y[k]] > 0).sum(axis=0) for k in parts) / len(check) if len(check) else np.ones(len(b))
    trust = np.maximum(0.05, 2 * right - 1)
    return Model(names, code, w, b, (trust / trust.sum() * min(4.0, len(trust))).astype(np.float32))


def train(docs: DataFrame, per_language: int = SAMPLE) -> Model | None:
    """A model of `docs` (doc_id, text, lang), from a bounded sample: `per_language` rows of each
    language at most, chosen by the hash of the id. None where no row has a text, an id and a
    language."""
    rows = docs.filter("text is not null and length(text) > 0").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def learn(sample: list[tuple[str, str]]) -> Model | None:
        sample = sorted(r for r in sample if _LETTER.search(r[1]))
        return fit([t for _, t in sample], [v for v, _ in sample]) if sample else None

    return fitted(sample_by(rows, "lang", per_language).select("lang", "text"), learn)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for each row of `docs` (doc_id, text).

    A text that is null, empty or without a letter is `und` with score 0, and so are all texts
    without a model. Ties go to the language that sorts first. Rows without an id are held out;
    repeated rows are scored each; no rows give none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            at = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            lang, p, odd = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            if at:
                scores = model.scores([texts[i] for i in at])
                for i, k, s in zip(at, scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True):
                    lang[i], p[i], odd[i] = model.languages[k], s, s < AMBIGUOUS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(p, pa.float64()), pa.array(odd)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.filter(~held_out(F.col("doc_id"), FOLDS, HELD_OUT))))
