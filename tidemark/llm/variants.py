"""Groups of spelling variants: words one inserted, deleted or replaced letter apart, led by the frequent ones.

Letters are hashed to a few symbols.  Each word gives its reduced form and the reduced forms one edit away, as hashes;
these meet the reduced forms of the vocabulary in one equi-join, and the pairs are verified on the words themselves.
An edit leads from one word of a pair to the other: deletions are generated from the longer word and replacements from
the word with the smaller symbol, so insertions and the other replacements are the same pairs seen from the other side
and every pair is found exactly once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import portions, staged

#: Letters fall on so many symbols, by code point.  Fewer symbols make smaller neighbourhoods and more pairs to verify.
SYMBOLS = 6
MIN_LENGTH = 5
MIN_COUNT = 3
#: One in so many distinct words of a document loses a letter (a planted slip).
SLIP = 97
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000
#: Letters of a word that goes with each row of its neighbourhood, and of the words that are reduced at a time.
CARRIED, PORTION = 64, 64 << 10
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}

_RNG = np.random.default_rng(11)
BASE = np.uint64(_RNG.integers(1 << 62, 1 << 63) | 1)
VALUES = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def slipped(doc_id: int | None, word: str, slip: int) -> str:
    """The word, without one letter where its hash within the document says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def count_words(batches: Iterable[pa.RecordBatch], slip: int = SLIP) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def passed_on() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return batch

    for batch in portions(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for word, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
                seen[slipped(doc_id, word, slip)] += n
            if len(seen) >= COUNTED:
                yield passed_on()
    if seen:
        yield passed_on()


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): distinct words of all texts, with their occurrences."""
    counted = docs.select("doc_id", "text").mapInArrow(count_words, "word string, n long").where(F.length("word") >= min_length)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Reduced:
    """Reduced forms of a batch of words as polynomial hashes, and those one edit away, each in constant time."""

    def __init__(self, words: list[str]):
        data = [w.encode("latin-1") for w in words]
        size = np.array([len(d) for d in data], dtype=np.int64)
        self.symbol = np.frombuffer(b"".join(data), np.uint8) % SYMBOLS
        self.word = np.repeat(np.arange(len(words)), size)
        start = np.cumsum(size) - size
        self.at = np.arange(len(self.symbol)) - start[self.word]
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=0)), BASE)]), dtype=np.uint64)
            terms = VALUES[self.symbol] * self.power[self.at]
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            self.start = start
            self.whole = self.sums[start + size] - self.sums[start]

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """Once for each run of a symbol: deleting any of its letters gives the same."""
        i = np.flatnonzero((self.at == 0) | (self.symbol != np.roll(self.symbol, 1)))
        before = self.sums[i] - self.sums[self.start[self.word[i]]]
        after = self.whole[self.word[i]] - (self.sums[i + 1] - self.sums[self.start[self.word[i]]])
        return self.word[i], before + after * INVERSE

    def replacements(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for step in range(1, SYMBOLS):
            i = np.flatnonzero(self.symbol + step < SYMBOLS)
            s = self.symbol[i]
            yield self.word[i], self.whole[self.word[i]] + (VALUES[s + step] - VALUES[s]) * self.power[self.at[i]]


def reduced_words(batches: Iterable[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "word", PORTION):
        key = Reduced(batch.column("word").to_pylist()).whole
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.select(carry).columns], ["key", *carry])


def neighbourhoods(batches: Iterable[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    """(key, same, carried columns): the word under its own reduced form and those one edit away."""
    for batch in portions(batches, "word", PORTION):
        words, kept = Reduced(batch.column("word").to_pylist()), batch.select(carry)
        parts = [(np.arange(batch.num_rows), words.whole), words.deletions(), *words.replacements()]
        for kind, (word, key) in enumerate(parts):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(word), kind == 0)), *kept.take(pa.array(word)).columns],
                                             ["key", "same", *carry])


def one_edit_apart(pairs: DataFrame) -> DataFrame:
    """Pairs (same, a, b) that are near, each once: equal reduced forms find a pair of equal lengths from both sides, and
    a deletion leads to the shorter word."""
    longer = F.length("a") - F.length("b")
    once = F.when(F.col("same"), (longer == 0) & (F.col("a") < F.col("b"))).otherwise(longer.isin(0, 1))
    return pairs.where(once).where(F.levenshtein("a", "b", 1) == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words exactly one edit apart, each pair once.

    Neighbourhoods carry their word, but for words of over CARRIED letters, which stand in for themselves by an id."""
    def met(longer: DataFrame, other: DataFrame, carry: list[str], kinds: str) -> DataFrame:
        left = longer.mapInArrow(partial(neighbourhoods, carry=carry), f"key long, same boolean, {kinds}")
        right = other.mapInArrow(partial(reduced_words, carry=carry), f"key long, {kinds}")
        return left.toDF("key", "same", *[f"{c}_a" for c in carry]).join(right.toDF("key", *[f"{c}_b" for c in carry]), "key")

    size, sides = F.length("word"), words.select("word", "n")
    short = sides.where(size <= CARRIED)
    near = one_edit_apart(met(short, short, ["word", "n"], "word string, n long").withColumnsRenamed({"word_a": "a", "word_b": "b"}))
    named = sides.withColumn("id", F.xxhash64("word"))
    long = met(named.where(size > CARRIED), named.where(size >= CARRIED), ["id"], "id long")
    for side in "ab":
        long = long.join(named.where(size >= CARRIED).select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"), F.col("id").alias(f"id_{side}")), f"id_{side}")
    out = ["a", "n_a", "b", "n_b"]
    return near.select(out).unionByName(one_edit_apart(long).select(out))


def roots(steps: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each word's chain.  Every form at least doubles the count, so chains
    are short, and each round doubles the distance that a row has covered."""
    found = staged(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = staged(found.join(onward, "root", "left"), "roots")
        found = ahead.select("word", F.coalesce("further", "root").alias("root"))
        if ahead.where(F.col("further").isNotNull()).isEmpty():
            return found


def group_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n, n_near, form, form_n, root): every frequent word, the much more frequent word one edit away, and the
    word that following such forms leads to.

    NULL and empty texts have no words; a NULL doc_id counts as an empty one in the slip rule; repeated rows count
    each time; other columns are not read; a table without words gives no rows.
    """
    words = staged(vocabulary(docs, min_length, min_count), "words")
    pairs = staged(near_pairs(words), "near")
    ways = pairs.select(F.inline(F.array(*[
        F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"n_{b}").alias("n")) for a, b in ("ab", "ba")])))
    best = ways.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    led = words.join(best, "word", "left")
    enough = -F.col("best.less") >= 2 * F.col("n")
    led = staged(led.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                            F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(led.where(F.col("form").isNotNull()))
    return led.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
