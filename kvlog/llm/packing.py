"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Items wait in a bounded pool of one task. The open sequence takes the item that fits and has
the largest dot product of its own vector with what is left of the limits, each dimension in
units of its limit. Where no whole item fits and cutting is allowed, it takes the beginning of
the item with the largest dot product, and the rest goes back to the pool. No shuffle is
needed: each input partition fills its own sequences, all but its last to the brim. All tokens
of a plain document bear loss; of instruction data only those of the answers do, so that the
three limits differ.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .tokens import VOCABULARY, Vocabulary, model_at

#: The id that ends a document.
END = 0
#: Items that wait in a task; a sequence is filled when there are as many.
POOL = 2048


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


class Piece(NamedTuple):
    """Tokens [start, start + length) of an item, at an offset of a sequence."""

    item: int
    start: int
    length: int
    sequence: int
    offset: int


class VectorPacker:
    """Packs items as they come. `add` and `finish` return the pieces of the sequences that
    they complete. An item's loss-bearing tokens count from its end, as answers follow
    prompts; an item of no tokens takes no place."""

    def __init__(self, limits: Limits = Limits(), cut: bool = True, pool: int = POOL):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.unit = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        size = 2 * pool + 8
        self.vector = np.zeros((size, 3), np.int64)
        self.item, self.start = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.n = self.sequence = 0

    def add(self, item: int, tokens: int, loss_tokens: int | None = None) -> list[Piece]:
        loss = tokens if loss_tokens is None else min(loss_tokens, tokens)
        lim, out, start = self.limits, [], 0
        while self.cut and tokens - start >= lim.tokens and min(loss, tokens - start) == 0 or self.cut and tokens - start >= lim.tokens <= lim.loss_tokens:
            out.append(Piece(item, start, lim.tokens, self.sequence, 0))
            self.sequence += 1
            start += lim.tokens
        if tokens > start:
            if not self.cut and (tokens > lim.tokens or loss > lim.loss_tokens):
                raise ValueError(f"item {item} of {tokens} tokens, {loss} of them loss-bearing, fits no sequence")
            self._wait(item, start, tokens - start, min(loss, tokens - start))
        while self.n >= self.pool:
            out += self._fill()
        return out

    def finish(self) -> list[Piece]:
        out = []
        while self.n:
            out += self._fill()
        return out

    def _wait(self, item, start, tokens, loss):
        self.item[self.n], self.start[self.n], self.vector[self.n] = item, start, (tokens, 1, loss)
        self.n += 1

    def _take(self, k, tokens, loss, left, out, offset):
        """Places the first `tokens` of waiting item k."""
        out.append(Piece(int(self.item[k]), int(self.start[k]), tokens, self.sequence, offset))
        left -= (tokens, 1, loss)
        if tokens < self.vector[k, 0]:
            self.start[k] += tokens
            self.vector[k] -= (tokens, 0, loss)
        else:
            self.n -= 1
            for a in (self.item, self.start, self.vector):
                a[k] = a[self.n]
        return offset + tokens

    def _fill(self) -> list[Piece]:
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], np.int64)
        out, offset = [], 0
        while self.n and left[0] and left[1]:
            v = self.vector[: self.n]
            score = v @ (left / (self.unit * self.unit))
            fits = (v <= left).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, score, -1)))
                offset = self._take(k, int(v[k, 0]), int(v[k, 2]), left, out, offset)
                continue
            if not self.cut:
                break
            prompt = v[:, 0] - v[:, 2]
            head = np.minimum(np.minimum(v[:, 0], left[0]), prompt + left[2])
            if not head.any():
                break
            score = np.stack([head, np.ones_like(head), np.maximum(0, head - prompt)], axis=1) @ (left / (self.unit * self.unit))
            k = int(np.argmax(np.where(head > 0, score, -1)))
            tokens = int(head[k])
            offset = self._take(k, tokens, max(0, tokens - int(prompt[k])), left, out, offset)
        self.sequence += 1
        return out


_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _packed(texts: DataFrame, path: str, limits: Limits, cut: bool, end: int, loss: bool) -> DataFrame:
    """The pieces of `texts` (doc_id, text, text): what bears no loss, and what does. With `loss` also
    the loss-bearing tokens of each piece."""
    small_batches(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast(model_at(path))
    names = [*_PIECES, "loss_tokens"] if loss else _PIECES

    def pack(batches):
        vocabulary, packer = Vocabulary(shared.value), VectorPacker(limits, cut)
        base, last = TaskContext.get().partitionId() << 33, end.to_bytes(4, "little")
        waiting: dict[int, list] = {}  # item: its doc_id, ids, tokens of the prompt, and tokens not yet placed

        def rows(pieces):
            cols = [[] for _ in names]
            for p in pieces:
                doc_id, ids, prompt, _ = doc = waiting[p.item]
                crc = zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])
                row = doc_id, p.start, p.length, crc, len(ids) // 4, base + p.sequence, p.offset, p.start + p.length - max(p.start, min(prompt, p.start + p.length))
                for c, x in zip(cols, row, strict=False):
                    c.append(x)
                doc[3] -= p.length
                if not doc[3]:
                    del waiting[p.item]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

        item = 0
        for batch in batches:
            done = []
            for doc_id, free, bearing in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                prompt = vocabulary.encode(free) if free else b""
                ids = prompt + vocabulary.encode(bearing or "") + last
                waiting[item] = [doc_id, ids, len(prompt) // 4, len(ids) // 4]
                done += packer.add(item, len(ids) // 4, (len(ids) - len(prompt)) // 4)
                item += 1
            if done:
                yield rows(done)
        yield rows(packer.finish())

    return texts.mapInArrow(pack, ", ".join(f"{n} long" for n in names))


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of `docs`
    (doc_id, text), tokenised with the vocabulary file at `path`, each document ended by `end`.

    All tokens of a document bear loss. Every id lies in one piece; a null or empty text is the
    end alone. A null doc_id stays null; repeated rows are packed each; no rows give none.
    sequence_id joins the number of the input partition and that of the sequence within it: a
    task that runs again gives the same sequences if it reads its rows in the same order, as
    from files.
    """
    text = F.col("text").cast("string")
    return _packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("free"), text.alias("bearing")), path, limits, True, end, False)


def pack_examples(examples: DataFrame, path: str, limits: Limits = Limits(loss_tokens=512, segments=64), cut: bool = True, end: int = END) -> DataFrame:
    """The pieces of `examples` (doc_id, prompt, answer) as pack_documents gives them, and loss_tokens,
    those of each piece that bear loss: the answer's and the end. No sequence exceeds any of the
    limits. Without `cut` no example is cut, and one that fits no sequence is an error."""
    return _packed(examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("prompt").cast("string").alias("prompt"), F.col("answer").cast("string").alias("answer")), path, limits, cut, end, True)


def conversation_examples(conversations: DataFrame) -> DataFrame:
    """(doc_id, prompt, answer) of each row of `conversations` (conv_id, turn, role, text) that an
    assistant has said: doc_id is that of the conversation, the prompt is what any others said in
    the turn before, nothing if none did. The two meet by conversation and turn, so one long
    conversation is many tasks' work. Null texts are empty; rows without a conversation or turn
    take no part; a repeated turn answers or is answered each."""
    rows = conversations.filter("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), (F.col("role") == "assistant").alias("own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    asked = rows.filter(~F.coalesce("own", F.lit(False))).select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    said = rows.filter("own").join(asked, ["conv_id", "turn"], "left")
    return said.select(F.col("conv_id").cast("long").alias("doc_id"), F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("text").alias("answer"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
