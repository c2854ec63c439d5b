"""N-gram Jaccard join by MinHash banding.

Texts become sets of hashed word n-grams; equal sets are one class member from then on.  Band and row counts are
chosen for a target recall at the threshold.  Sets that share a band hash are tied to the bucket's smallest set, a
number of rows linear in the bucket, and the connected parts of those ties hold every candidate pair.  The full
n-gram sets of one part then meet in one task and all pairs are counted there as a product of incidence matrices;
a part too large for a task is cut into blocks, and each pair of blocks is a task of its own.  No pair is ever a row.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import portions, staged
from tidemark.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 256
#: A task verifies parts of at most so many sets and n-grams; larger parts are cut into blocks.
BLOCK_SETS = 1024
BLOCK_GRAMS = 400_000
CHUNK = 1 << 20
SEED = 20_240_611


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band, thus fewest false candidates, so that a pair at the threshold shares a
    band with probability `recall` at least, within max_hashes hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold ** rows))) if threshold < 1 else 1
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("max_hashes is too small for this recall")
    return best


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class NGrams:
    """Sorted distinct 64-bit hashes of each text's word n-grams; a text of fewer words is one n-gram of all of them."""

    def __init__(self, words: int = WORDS):
        self.words = words
        rng = np.random.default_rng(SEED)
        self.of_byte = rng.integers(1, 1 << 63, 256, np.uint64)
        self.blank = np.zeros(256, bool)
        self.blank[[9, 10, 11, 12, 13, 32]] = True
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        self.step = np.uint64(0xD6E8FEB86659FD93)
        self.power, self.unpower = self.powers(2 * CHUNK)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for b in (self.base, self.inverse):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        return out[0], out[1]

    def word_hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every word of the bytes."""
        codes = np.frombuffer(data, np.uint8)
        inside = ~self.blank[codes]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
        if not len(edge):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        power, unpower = (self.power, self.unpower) if len(codes) <= len(self.power) else self.powers(len(codes))
        spread = np.append(self.of_byte[codes] * power[:len(codes)], np.uint64(0))
        sums = np.add.reduceat(spread, edge)[::2]
        return edge[::2], mixed(sums * unpower[edge[::2]])

    def of(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The n-gram set of each text, in order."""
        held: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > CHUNK:
                yield from self.of_chunk(held)
                held, size = [], 0
                yield self.grams(self.long_words(text))
                continue
            held.append(text)
            size += len(text) + 1
            if size > CHUNK:
                yield from self.of_chunk(held)
                held, size = [], 0
        yield from self.of_chunk(held)

    def long_words(self, text: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + CHUNK)
            while end < len(text) and not self.blank[text[end]]:
                end += 1
            parts.append(self.word_hashes(text[at:end])[1])
            at = end
        return np.concatenate(parts)

    def of_chunk(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if not texts:
            return
        start, hashes = self.word_hashes(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        bound = np.searchsorted(start, ends)
        first = 0
        for last in bound:
            yield self.grams(hashes[first:last])
            first = last

    def grams(self, words: np.ndarray) -> np.ndarray:
        n = min(self.words, len(words))
        if n == 0:
            return words
        value = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            value = mixed(value * self.step + words[i:len(words) - n + 1 + i])
        return np.unique(value)


class MinHash:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(SEED + 1)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.salt = rng.integers(1, 1 << 63, bands, np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """Band hashes of a set that is not empty."""
        least = np.full(len(self.times), np.uint64((1 << 64) - 1))
        for at in range(0, len(grams), 512):
            values = np.multiply.outer(grams[at:at + 512], self.times)
            values += self.plus
            np.minimum(least, values.min(axis=0), out=least)
        value = self.salt.copy()
        for column in least.reshape(self.bands, self.rows).T:
            value = mixed(value * np.uint64(31) + column)
        return value.view(np.int64)


@functools.lru_cache(maxsize=4)
def ngrams(words: int) -> NGrams:
    return NGrams(words)


def key_of(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set_key (NULL without a word), grams (their number), bands of every row."""
    def run(batches):
        own, minhash = ngrams(words), MinHash(bands, rows)
        for batch in portions(batches, "text", 4 << 20):
            keys, sizes, hashes = [], [], []
            for g in own.of([t or b"" for t in batch.column(1).to_pylist()]):
                keys.append(key_of(g))
                sizes.append(len(g))
                hashes.append(minhash(g) if len(g) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                                             names=["doc_id", "set_key", "grams", "bands"])
    return docs.select("doc_id", F.lower("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set_key binary, grams int, bands array<bigint>")


def gram_sets(docs: DataFrame, words: int, carried: list[str]) -> DataFrame:
    """set_key, n-grams as bytes, and carried columns of rows (set_key, text, carried); rows of another set than set_key go."""
    schema = docs.select("set_key", F.col("text").cast("binary").alias("grams"), *carried).schema

    def run(batches):
        own = ngrams(words)
        for batch in portions(batches, "text", 4 << 20):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            made = [g.tobytes() if key_of(g) == want else None for g, want in zip(own.of(texts), batch.column("set_key").to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column("set_key"), pa.array(made, pa.binary()), *(batch.column(c) for c in carried)],
                                             names=["set_key", "grams", *carried])
            yield out.filter(out.column("grams").is_valid())
    return docs.mapInArrow(run, schema)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity reaches the threshold (the diagonal is false)."""
    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column)[column] > 1
    row, column = row[shared], column[shared]
    common = np.zeros((n, n), np.float32)
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = max(1, 4_000_000 // n)
        for lo in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, (lo, lo + width))
            part = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            common += part @ part.T
    either = sizes[:, None] + sizes[None, :] - common
    out = common >= threshold * either - 1e-6
    np.fill_diagonal(out, False)
    return out


def local_roots(near: np.ndarray) -> np.ndarray:
    """Smallest index that each index is connected to."""
    root = np.arange(len(near))
    while True:
        least = np.minimum(root, np.where(near, root[None, :], len(near)).min(axis=1, initial=len(near)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """set_key, links (documents of linked sets), root (a linked set, or NULL) from rows of sorted (part, i, j).

    Within a task (part, i, i) all pairs count; in (part, i, j) those between block i and block j.
    """
    kind = "set_key binary, links bigint, root binary"

    def solve(rows: list[tuple]):
        seen = {r["set_key"]: r for r in rows}  # repeated rows of a document give one set
        rows = [seen[k] for k in sorted(seen)]
        near = linked([np.frombuffer(r["grams"], np.uint64) for r in rows], threshold)
        if rows[0]["i"] != rows[0]["j"]:
            side = np.array([r["block"] for r in rows])
            near &= side[:, None] != side[None, :]
        weight = np.array([r["members"] for r in rows])
        root = local_roots(near)
        for k, r in enumerate(rows):
            if near[k].any():
                yield r["set_key"], int(weight[near[k]].sum()), rows[root[k]]["set_key"] if root[k] != k else None

    def run(batches):
        held, at = [], None
        for batch in portions(batches, "grams", 8 << 20):
            out = []
            for r in batch.to_pylist():
                if (key := (r["part"], r["i"], r["j"])) != at:
                    if held:
                        out += solve(held)
                    held, at = [], key
                held.append(r)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["set_key", "links", "root"])
        if held:
            out = list(solve(held))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 3, (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["set_key", "links", "root"])
    return blocks.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(run, kind)


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL,
                 max_hashes: int = MAX_HASHES, block_sets: int = BLOCK_SETS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """doc_id, set_id, class_id, n_links of every row.

    Words are runs of characters other than space and ASCII 9 to 13, of the text in lower case.
    set_id: smallest doc_id with the same n-gram set.  class_id: smallest doc_id of all that are connected by links, a
    link being a Jaccard similarity of the threshold or more.  n_links: rows that the row links to, same set included.
    NULL, empty and blank texts are each a class of their own without links.  Repeated rows count as copies of each other.
    NULL doc_ids count as members but name a class only if it has no other.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    signed = staged(signatures(docs, words, bands, rows), "signatures")
    sets = staged(signed.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("set_id"), F.count("*").alias("members"), F.first("grams").alias("grams"), F.first("bands").alias("bands")), "sets")
    parts = components(bucket_ties(sets), "set_key", "part")
    info = sets.drop("bands").join(parts, "set_key")
    cut = info.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / F.lit(block_sets)), F.ceil(F.sum("grams") / F.lit(block_grams))).cast("int").alias("k"))
    k = F.col("k")
    candidates = info.drop("grams").join(cut, "part").withColumn("block", F.pmod(F.xxhash64("set_key"), k).cast("int"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.lower("text").alias("text"))
    met = texts.join(candidates.hint("shuffle_hash"), F.col("_doc").eqNullSafe(F.col("set_id")))
    grams = gram_sets(met.drop("_doc", "set_id").withColumn("text", F.col("text").cast("binary")), words, ["part", "members", "block", "k"])
    others = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    blocks = grams.withColumn("pair", F.explode(others)).select("set_key", "grams", "members", "block", "part", "pair.i", "pair.j")
    found = staged(verify(blocks, threshold), "links")
    classes = components(found.where("root IS NOT NULL").select(F.col("set_key").alias("a"), F.col("root").alias("b")), "set_key", "class")
    links = found.groupBy("set_key").agg(F.sum("links").alias("links"))
    per_set = sets.select("set_key", "set_id", "members").join(links, "set_key", "left").join(classes, "set_key", "left")
    named = per_set.withColumn("class", F.coalesce("class", "set_key"))
    named = named.join(named.groupBy("class").agg(F.min("set_id").alias("class_id")), "class")
    out = signed.select("doc_id", "set_key").join(named, "set_key", "left")
    alone = F.col("set_key").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("set_id")).alias("set_id"),
                      F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, 0).otherwise(F.col("members") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))


def bucket_ties(sets: DataFrame) -> DataFrame:
    """(a, b): each set of a band bucket tied to the bucket's smallest set."""
    dealt = sets.select("set_key", F.explode("bands").alias("band"))
    hubs = dealt.groupBy("band").agg(F.min("set_key").alias("hub"), F.max("set_key").alias("last")).where("hub < last")
    return dealt.join(hubs.drop("last"), "band").where("set_key <> hub").select(F.col("set_key").alias("a"), F.col("hub").alias("b")).distinct()


def first_of_class(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class: the rows whose doc_id names it, and of equal rows only one."""
    names = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    turn = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy("_text"))
    kept = docs.join(names.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_kept"))).drop("_kept")
    return kept.withColumn("_text", F.xxhash64("text")).withColumn("_turn", turn).where("_turn = 1").drop("_text", "_turn")


