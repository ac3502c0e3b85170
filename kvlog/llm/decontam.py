"""Benchmark decontamination by SimHash over item-sized windows.

Texts are words, lower-cased; a shingle is five words. A window holds as many words as an item.
A window can only be similar to an item if it shares enough shingles with it, so only windows
with that many shingles of items of their size are fingerprinted. Eight byte blocks index the items: of two fingerprints
at most RADIUS bits apart, one block differs in at most two bits, so looking each block up with
up to two bits flipped finds all items within the radius. Candidates are verified by the exact
similarity of weighted shingles, each weighted by how often it occurs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_where, small_batches, table

SHINGLE = 5
SIMILARITY = 0.8
#: 8 blocks with 3 differing bits each would be 24 bits, so within 23 some block has at most 2.
RADIUS = 23
#: Characters of items that are looked for in one pass over the documents; what the driver holds
#: and sends out is bounded by this, and a larger benchmark takes more passes.
PASS_CHARS = 16 << 20
#: Windows of a text that are fingerprinted at once.
RUN = 1 << 14

_WORD = re.compile(r"\w+")
_NEAR = [np.array([v for v in range(256) if (v ^ x).bit_count() <= 2]) for x in range(256)]


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, given those of the words."""
    n = len(hashes) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(width if n > 0 else 0):
        with np.errstate(over="ignore"):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def _signs(shingles: np.ndarray) -> np.ndarray:
    """A row of 64 signs for each shingle."""
    return np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _isin(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted `known`."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _runs(starts: np.ndarray, apart: int) -> list[np.ndarray]:
    """The starts in runs without a gap of over `apart`, and of RUN starts at most, so that what a run
    needs does not grow with the text."""
    found = np.split(starts, np.flatnonzero(np.diff(starts) > apart) + 1) if len(starts) else []
    return [r[at : at + RUN] for r in found for at in range(0, len(r), RUN)]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity: least over greatest weights."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


class Items:
    """The items of one pass, indexed. An item of fewer words than a shingle is one shingle of
    all its words; one of none is never found."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.sizes: dict[tuple[int, int], list[tuple[int, np.uint64, Counter]]] = {}
        known: dict[int, list[np.ndarray]] = {}
        for item_id, text in sorted(set(rows)):
            words = words_of(text)
            if not words:
                continue
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
            width = min(SHINGLE, len(words))
            s = _shingles(_word_hashes(words), width)
            known.setdefault(width, []).append(s)
            self.sizes.setdefault((width, len(s)), []).append((item_id, _packed(_signs(s).sum(axis=0)[None])[0], Counter(s.tolist())))
        self.known = {w: np.unique(np.concatenate(k)) for w, k in known.items()}
        self.own = {(w, n): np.unique(np.array([s for i in items for s in i[2]], np.uint64)) for (w, n), items in self.sizes.items()}
        self.hash = np.concatenate([np.zeros(1, np.uint64), _word_hashes(list(self.vocabulary))])
        self.index = {}
        for size, items in self.sizes.items():
            blocks = np.array([i[1] for i in items], np.uint64).view(np.uint8).reshape(-1, 8)
            lists = [[[] for _ in range(256)] for _ in range(8)]
            for k, row in enumerate(blocks):
                for b in range(8):
                    for v in _NEAR[row[b]]:
                        lists[b][v].append(k)
            self.index[size] = [[np.array(x, np.int64) for x in one] for one in lists]

    def candidates(self, size, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) of each pair of fingerprints at most RADIUS bits apart."""
        own, found = np.array([i[1] for i in self.sizes[size]], np.uint64), set()
        blocks = prints.view(np.uint8).reshape(-1, 8)
        for b in range(8):
            near = [self.index[size][b][v] for v in blocks[:, b]]
            at = np.repeat(np.arange(len(prints)), [len(x) for x in near])
            if len(at):
                item = np.concatenate(near)
                close = np.bitwise_count(prints[at] ^ own[item]) <= RADIUS
                found.update(zip(at[close].tolist(), item[close].tolist(), strict=True))
        return sorted(found)

    def search(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of each item that a window of the text is
        similar to: the most similar window, the first of equals."""
        words = words_of(text)
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        inside = np.concatenate([[0], np.cumsum(codes > 0)])
        hits = {}
        for width, known in self.known.items():
            if len(words) >= width:
                runs = np.flatnonzero(inside[width:] - inside[:-width] == width)
                s = np.zeros(len(runs), np.uint64)
                for i in range(width if len(runs) else 0):
                    with np.errstate(over="ignore"):
                        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + self.hash[codes[runs + i]])
                held = _isin(s, known)
                hits[width] = runs[held], s[held]
        best: dict[int, tuple[float, int, int]] = {}
        for (width, size), items in self.sizes.items():
            n = len(words) - width + 1
            m = min(size, n)  # a text shorter than the item is one window
            least = math.ceil((m + size) * SIMILARITY / (1 + SIMILARITY) - 1e-9)
            if n < 1 or len(hits[width][0]) < least:
                continue
            held = np.zeros(n + 1, np.int64)
            held[1 + hits[width][0][_isin(hits[width][1], self.own[width, size])]] = 1
            held = np.cumsum(held)
            starts = np.flatnonzero(held[m:] - held[: n - m + 1] >= least)
            for group in _runs(starts, 4 * m + 64):
                low, high = int(group[0]), int(group[-1]) + m
                shingles = _shingles(_word_hashes(words[low : high + width - 1]), width)
                sums = np.cumsum(np.concatenate([np.zeros((1, 64), np.int32), _signs(shingles)]), axis=0)
                prints = _packed(sums[group - low + m] - sums[group - low])
                for w, k in self.candidates((width, size), prints):
                    start = int(group[w])
                    item_id, _, weights = items[k]
                    sim = similarity(Counter(shingles[start - low : start - low + m].tolist()), weights)
                    if sim >= SIMILARITY and (item_id not in best or (-sim, start) < (-best[item_id][0], best[item_id][1])):
                        best[item_id] = sim, start, m + width - 1
        return [(i, *found) for i, found in sorted(best.items())]


def _passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, dealt into passes of about PASS_CHARS characters. Only one pass is here at once."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // PASS_CHARS)
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    for p in range(n):
        yield [(r[0], r[1]) for r in rows.filter(deal == p).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item of `benchmark` (item_id,
    text) to which a window of a document of `docs` (doc_id, text) has a similarity of
    SIMILARITY or more, with the most similar window, the first of equals.

    Null and wordless texts and items match nothing; items without an id take no part. A
    document shorter than an item is one window. A null doc_id stays null; repeated rows are
    searched each; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]
    out = spark.createDataFrame([], schema)
    for rows in _passes(benchmark):
        shared = spark.sparkContext.broadcast(rows)

        def search(batches, shared=shared):
            items = Items(shared.value)
            for batch in batches:
                found = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in items.search(t)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in enumerate(kinds)], names)

        out = out.unionByName(docs.mapInArrow(search, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` (text and any other columns) in which no item of `benchmark` is found."""
    for rows in _passes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def decide(shared=shared):
            items = Items(shared.value)
            return lambda texts: [not items.search(t) for t in texts]

        docs = keep_where(docs, decide)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
