"""SimHash near-duplicates: a positional byte index with count filtering, then verification.

A fingerprint is eight positional bytes. Two fingerprints at most 3 bits apart share at least
5 of them (`MIN_SHARED`). A postings list of one positional byte would hold 1/256 of the
corpus, so the index is keyed by three positional bytes: of any 5 of 8 positions at least 3
lie in the same half, so the 4 + 4 triples within the halves meet every such pair. The shared
positional bytes of each pair that meets are tallied, pairs below the guaranteed 5 go, and the
rest is verified by exact Hamming distance.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches, table, unused
from .components import components

SHINGLE = 3
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Fingerprints of one key that meet in one cell of a join; larger keys are dealt in blocks.
BLOCK = 2048
#: The most fingerprints that are looked up in a table sent to all tasks.
COMMON = 100_000

_hash = functools.partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text, unsigned; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        return _hash(joined)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: n - SHINGLE + 1].tolist()
    m = n - SHINGLE + 1
    spans = map(slice, starts, ends[SHINGLE - 1 :].tolist())
    hashes = np.fromiter(map(_hash, map(joined.__getitem__, spans)), np.uint64, m)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little")
    whole = m // 255 * 255  # sums of 255 bits stay within a byte, which numpy adds fastest
    ones = np.add.reduce(bits[whole:], axis=0, dtype=np.uint8).astype(np.int64)
    if whole:
        ones += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > m, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        fp = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, **more: Column) -> DataFrame:
    """(doc_id, fp, more): the fingerprint of each row as a signed long, and further columns that
    are longs. A null text is empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[c.alias(n) for n, c in more.items()])
    return rows.mapInArrow(_fingerprints, ", ".join(f"{n} long" for n in ("doc_id", "fp", *more)))


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _alike(x: Column, triple: tuple[int, ...]) -> Column:
    """Whether the difference of two fingerprints has no bit in the bytes of a triple."""
    mask = sum(255 << 8 * p for p in triple)
    return x.bitwiseAND(F.lit(mask - (mask >> 63 << 64)).cast("long")) == 0


def tallied(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b, shared), a < b: each pair of the distinct fingerprints in column `fp` that meets in a
    postings list and shares MIN_SHARED positional bytes or more, once.

    The list of a triple holds the fingerprints whole, so a pair's shared positional bytes are
    counted where it first meets: in the list of the first triple that it shares, the others
    passing it over. No pair is shuffled to be counted or to lose its repetitions. A list of
    over `block` fingerprints is dealt over the cells of a block triangle, so that no cell joins
    more than `block` with `block` of them."""
    keys = F.array(*[
        functools.reduce(lambda k, p: k * 256 + _byte(F.col("fp"), p), triple, F.lit(slot).cast("long"))
        for slot, triple in enumerate(TRIPLES)
    ])
    postings = distinct.select("fp", F.explode(keys).alias("key"))
    large = postings.groupBy("key").count().filter(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = postings.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = dealt.select("fp", "own", "key", F.explode(cell).alias("cell")).select("fp", "own", "key", "cell.i", "cell.j")
    a, b = (dealt.select("key", "i", "j", F.col("fp").alias(n), F.col("own").alias(f"of_{n}")) for n in ("a", "b"))
    x = a["a"].bitwiseXOR(b["b"])
    first = functools.reduce(lambda later, k: F.when(_alike(x, TRIPLES[k]), F.lit(k)).otherwise(later), reversed(range(len(TRIPLES))), F.lit(len(TRIPLES)))
    # two fingerprints of one block have all cells of that block in common; its own cell counts
    once = (F.shiftright(a["key"], 24) == first) & (a["a"] < b["b"]) & ((a["of_a"] != b["of_b"]) | (a["i"] == a["j"]))
    shared = functools.reduce(lambda s, p: s + (_byte(x, p) == 0).cast("int"), range(8), F.lit(0))
    met = a.join(b, (a["key"] == b["key"]) & (a["i"] == b["i"]) & (a["j"] == b["j"]) & once & (shared >= MIN_SHARED))
    return met.select("a", "b", shared.alias("shared"))


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in column `fp` that are at most MAX_BITS
    apart: the tallied pairs, verified."""
    return tallied(distinct, block).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")


def roots(classes: DataFrame) -> DataFrame:
    """(fp, root) of each of the distinct fingerprints in column `fp` that has a link."""
    return components(links(classes.select("fp")), "a", "b").select(F.col("node").alias("fp"), "root")


def by_fingerprint(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` (fp and more) with the columns of `found` (fp, n and more), a row a fingerprint, n of
    the rows having it. A fingerprint of over 1/COMMON of the rows, or of BLOCK where that is
    more, is looked up in a table of at most COMMON rows that all tasks have, so its rows stay
    where they are; the others meet by fingerprint."""
    total = found.agg(F.sum("n")).first()[0] or 0
    common = found.filter(F.col("n") > max(BLOCK, total // COMMON)).drop("n")
    here = rows.join(F.broadcast(common), "fp")
    rest = rows.join(F.broadcast(common.select("fp")), "fp", "left_anti").join(found.drop("n"), "fp")
    return here.unionByName(rest)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs` (doc_id, text).

    Fingerprints MAX_BITS apart or nearer are linked; component_id is the smallest doc_id that
    links reach, the row's own included. Null and wordless texts have fingerprint zero and are
    linked like any other. A row with a null doc_id gets the component_id of its group, null if
    no row of the group has an id. Repeated rows stay repeated; no rows give no rows. Copies
    meet as one fingerprint before any comparison.
    """
    prints = cut(fingerprints(docs))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = cut(roots(classes).join(classes, "fp"))
    whole = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(whole, "root").select("fp", "component")
    ids = cut(classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component_id")))
    return by_fingerprint(prints, ids).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, one without an id
    only where no row of the group has one; of rows with that same id, or with none, the least
    hash of all columns decides. A row is told by that hash of 128 bits, not by its doc_id, so
    neither null nor repeated ids make a difference; rows that are alike in all columns are one.
    A null text is empty; no rows give no rows."""
    row = {"h": F.xxhash64(*docs.columns), "g": F.xxhash64(F.lit(1), *docs.columns)}
    distinct = fingerprints(docs, **row).groupBy("fp", "doc_id", "h", "g").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "g", "n")
    classes = cut(distinct.groupBy("fp").agg(F.min(first).alias("first")))
    groups = classes.join(roots(classes), "fp", "left").groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("first").alias("first"))
    h, g = unused(docs.columns, "h"), unused(docs.columns, "g")
    keep = cut(groups.select(F.col("first.h").alias(h), F.col("first.g").alias(g), F.col("first.n").alias("repeats_")))
    kept = docs.withColumns({h: row["h"], g: row["g"]}).join(keep.select(h, g), [h, g], "left_semi")
    if not keep.filter("repeats_ > 1").isEmpty():
        kept = kept.dropDuplicates([h, g])
    return kept.select(*docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
