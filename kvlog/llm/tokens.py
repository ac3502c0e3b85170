"""Token counts by a whole-token shortcut over a byte-level BPE vocabulary.

Offline, each vocabulary string is proved to encode alone as one token. In a text, pre-tokens
found in that table count one; only the rest goes through the merges, each distinct one once.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, table

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens that a worker remembers beside the whole-token table; then it starts anew.
REMEMBERED = 300_000
#: Strings that are proved at once: what the library gives for one is about a kilobyte.
PROVED = 1024
LONGEST_REMEMBERED = 64

#: The alternatives of the public pattern, likeliest first: no two of them, but for the last two, begin alike.
_UNICODE = regex.compile(r""" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?[^\p{White_Space}\p{L}\p{N}]+| ?\p{N}+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+""")
_ASCII = re.compile(r""" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9]+| ?[0-9]+|\s+(?!\S)|\s+""", re.ASCII)


def pre_tokens(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _UNICODE).findall(text)


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


def whole_tokens(model: str) -> dict[str, int]:
    """The strings of the vocabulary that are one pre-token and encode alone as that one token."""
    tok, byte_of, found = Tokenizer.from_str(model), _byte_chars(), {}
    special = {t["content"] for t in json.loads(model)["added_tokens"]}
    for token, number in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(map(byte_of.__getitem__, token)).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in special and pre_tokens(text) == [text]:
            found[text] = number
    texts, out = list(found), {}
    for at in range(0, len(texts), PROVED):
        part = texts[at : at + PROVED]
        out |= {t: found[t] for t, e in zip(part, tok.encode_batch(part, add_special_tokens=False), strict=True) if e.ids == [found[t]]}
    return out


class _Counts(dict):
    """Tokens of pre-tokens: one of each whole token; the rest is merged when first met."""

    def __init__(self, whole, merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge = whole, merge

    def __missing__(self, piece):
        n = len(self.merge(piece))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) > len(self.whole) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = n
        return n


class Vocabulary:
    """Counts, by the whole tokens given, and encodes texts as the library does by default: strings of special tokens within
    a text are those tokens; nothing is added, truncated or padded. Where the merges of the
    vocabulary are in the order of its ids, as in rank files, they are applied by rank."""

    def __init__(self, model: str, whole: dict[str, int] | None = None):
        spec = json.loads(model)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab, byte_of = spec["model"]["vocab"], _byte_chars()
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made == sorted(made) and len(vocab) == len(made) + 256:
            ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}
            by_rank = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode_plain, merge = lambda text: by_rank.encode_to_numpy(text, disallowed_special=()), by_rank._encode_single_piece
        else:
            tok = Tokenizer.from_str(model)
            self.encode_plain = merge = lambda text: tok.encode(text, add_special_tokens=False).ids
        self.counts = _Counts(whole or {}, merge)

    def parts(self, text: str) -> list[str]:
        """Plain and special parts by turns, beginning with a plain one."""
        return self.split.split(text) if any(s in text for s in self.special) else [text]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return len(parts) // 2 + sum(sum(map(self.counts.__getitem__, pre_tokens(p))) for p in parts[::2])

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        parts = self.parts(text)
        return b"".join(np.asarray(self.encode_plain(p), "<u4").tobytes() if k % 2 == 0 else self.special[p].to_bytes(4, "little") for k, p in enumerate(parts))


def model_at(path: str) -> str:
    """The model of a vocabulary file, all that encoding needs, a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(path: str) -> tuple[str, dict[str, int]]:
    """What counting needs of a vocabulary: its model and its proved whole tokens."""
    model = model_at(path)
    return model, whole_tokens(model)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of `docs` (doc_id, text).

    Counts are those of the library for the vocabulary file at `path`. A null text is empty and
    has no tokens; a null doc_id stays null; repeated rows are counted each; no rows give none.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def count(batches):
        vocabulary = Vocabulary(*shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.fromiter(map(vocabulary.count, texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
