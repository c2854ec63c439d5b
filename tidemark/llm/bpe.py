"""Byte-level BPE: texts to token ids and back, as a tree of joins.

A text is cut into halves down to leaves; leaves are encoded alone; two neighbours are joined by encoding again
a window around their border.  The window grows until both of its ends lie where a non-blank character meets a
blank.  No alternative of the split pattern matches a non-blank followed by a blank, and its lookahead reads one
blank run only, so every such place is a border of matches in the whole text as well as in either part:
tokens outside the window cannot change.  Joining is associative, with the empty text as its unit.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import portions, row_portions

#: The split of the public 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 16_384
BLANK = frozenset(" \n\r\t")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Ranks of one vocabulary, with a leaf encoder and the join."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, leaf: int = LEAF, window: int = 32):
        import tiktoken

        self.leaf, self.window = max(1, leaf), max(1, window)
        self.leaf_ids = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.leaf_ids(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Tokens of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        a, b = self.stable_before(text, lo, mid), self.stable_after(text, mid, hi)
        if a == mid or b == mid:
            return left + right
        keep = len(left) - self.covering(reversed(left), text[a:mid])
        skip = self.covering(right, text[mid:b])
        return left[:keep] + self.leaf_ids(text[a:b]) + right[skip:]

    def stable_before(self, text: str, lo: int, mid: int) -> int:
        """Nearest sure border at or before mid, else lo."""
        size = self.window
        while True:
            start = max(lo + 1, mid - size)
            for i in range(mid, start - 1, -1):
                if i < len(text) and text[i] in BLANK and not text[i - 1].isspace():
                    return i
            if start <= lo + 1:
                return lo
            mid, size = start - 1, size * 2

    def stable_after(self, text: str, mid: int, hi: int) -> int:
        """Nearest sure border at or after mid, else hi."""
        size = self.window
        while True:
            end = min(hi, mid + size)
            for i in range(mid, end):
                if text[i] in BLANK and not text[i - 1].isspace():
                    return i
            if end == hi:
                return hi
            mid, size = end, size * 2

    def covering(self, ids, part: str) -> int:
        """How many of the ids, in the given order, spell the part."""
        need, n = len(part.encode()), 0
        for i in ids:
            if need <= 0:
                break
            need -= len(self.bytes_of[i])
            n += 1
        return n

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids: leaves of the same size joined pairwise up the tree."""
        parts = [b"".join(map(self.bytes_of.__getitem__, ids[at:at + self.leaf])) for at in range(0, len(ids), self.leaf)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[at:at + 2]) for at in range(0, len(parts), 2)]
        return parts[0]


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str, leaf: int) -> Codec:
    return Codec(read_ranks(path), pattern, leaf)


def ship(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file of the driver (a few MB) to the executors once; its name there."""
    context, name = spark.sparkContext, path.rpartition("/")[2]
    sent = context.__dict__.setdefault("vocabularies_sent", {})
    if name not in sent:
        context.addFile(path)
        sent[name] = path
    if sent[name] != path:
        raise ValueError(f"another file named {name} was sent before: {sent[name]}")
    return name


def encode_texts(docs: DataFrame, ranks_path: str, text: str = "text", ids: str = "ids", pattern: str = PATTERN, leaf: int = LEAF) -> DataFrame:
    """Adds an array of token ids; the text column and all others stay.  NULL and empty texts give no tokens.

    One text is one row and is encoded where it lies: no shuffle.  A former column named like `ids` is replaced.
    """
    name, docs = ship(docs.sparkSession, ranks_path), docs.drop(ids)
    schema = docs.withColumn(ids, F.array().cast("array<int>")).schema

    def run(batches):
        own = codec(SparkFiles.get(name), pattern, leaf)
        for batch in portions(batches, text):
            made = [np.array(own.encode(t.as_py() or ""), np.int32) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])
    return docs.mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded", pattern: str = PATTERN, leaf: int = LEAF) -> DataFrame:
    """Adds the bytes that the ids spell; NULL ids give none.  A former column named like `decoded` is replaced."""
    name, tokens = ship(tokens.sparkSession, ranks_path), tokens.drop(decoded)
    schema = tokens.withColumn(decoded, F.lit(None).cast("binary")).schema

    def run(batches):
        own = codec(SparkFiles.get(name), pattern, leaf)
        for batch in row_portions(batches, 256):
            made = [own.decode(i.values.to_pylist() if i.is_valid else []) for i in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, decoded])
    return tokens.mapInArrow(run, schema)
