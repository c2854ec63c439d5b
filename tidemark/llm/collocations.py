"""Phrases whose words occur together far more often than apart, per language.

Every word position is counted once, by the window of words that it leads: up to five words, padded with NULL where
the piece of text ends.  Spark's ROLLUP over the window columns sums the counts of successively shorter prefixes, and
a phrase's count is the sum of the windows that begin with it, so no n-gram length is exploded on its own.

A phrase of enough occurrences holds only words and shorter phrases of enough occurrences.  They are therefore counted
first, length by length and by hashes, and a window is padded from the first rare phrase on.  The frequent hashes go to
the tasks as a bit set of fixed size: the fuller it is the fewer windows are cut short, and the counts are exact at any fill.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import portions, staged
from tidemark.llm.hashcounts import is_live, live_bits, mixed, range_bits

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: A shorter phrase goes if a longer candidate around it has this percentage of its count.
COVERED = 100
UNKNOWN = "und"
#: Bytes of text at a time, and windows that a task merges before it passes them on.
PORTION, MERGED = 4 << 20, 600_000
STEP = np.uint64(0xD6E8FEB86659FD93)
SEPARATORS = r"[.,;:!?\x0A-\x0D]"
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]


def coded(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Word codes of the texts in order, -1 between pieces, and the words by code."""
    text = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    text = pc.replace_substring_regex(pc.replace_substring(text, "\t", " "), SEPARATORS, " \n ")
    tokens = pc.split_pattern(pc.binary_join_element_wise(text, *(pa.scalar(x, pa.large_string()) for x in ("\n", " "))), " ").flatten()
    tokens = tokens.filter(pc.not_equal(tokens, ""))
    names = tokens.dictionary_encode()
    code, words = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary
    end = words.index("\n").as_py()
    return np.where(code == end, -1, code), words


def live_phrases(code: np.ndarray, words: pa.Array, lang: str, live: np.ndarray | None, longest: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By length: hash of the phrase that begins at each position, and whether it may be frequent, which its words and
    both phrases one word shorter must be.  Without a bit set all words and pairs may be."""
    seed = xxhash.xxh64_intdigest(lang)
    names = np.array([xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()], dtype=np.uint64)
    name = np.where(code >= 0, names[code], np.uint64(0))
    hashes, chosen = [mixed(name)], [code >= 0]
    for k in range(1, longest):
        found, ok = np.zeros(len(code), np.uint64), np.zeros(len(code), bool)
        found[:-k] = mixed(hashes[-1][:-k] * STEP + name[k:])
        if live is not None:
            chosen[-1][chosen[-1]] = is_live(live, hashes[-1][chosen[-1]])
        ok[:-1] = chosen[-1][:-1] & chosen[-1][1:]
        hashes.append(found)
        chosen.append(ok)
    return hashes, chosen


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    for batch in portions(batches, "text", PORTION):
        langs = batch.column("lang")
        for lang in langs.unique().to_pylist():
            yield lang, *coded(batch.column("text").filter(pc.equal(langs, lang)))


def phrase_hashes(batches: Iterable[pa.RecordBatch], live: Broadcast | None, length: int) -> Iterator[np.ndarray]:
    """Hashes of the phrases of a length that may be frequent as far as the bit set tells; pairs come with their words."""
    for lang, code, words in by_language(batches):
        hashes, chosen = live_phrases(code, words, lang, live and live.value, length)
        yield np.concatenate([hashes[k][chosen[k]] for k in range(0 if length == 2 else length - 1, length)])


def grouped(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row number for each distinct row of the columns, and how often the row is there."""
    key, longer = columns[0], np.arange(len(columns[0]))
    for column in columns[1:]:  # only rows with another word are told apart further
        longer = longer[column[longer] >= 0]
        some = key[longer] * (column.max(initial=0) + 2) + column[longer] + 1
        key = key.copy()
        key[longer] = np.unique(some, return_inverse=True)[1] + key.max(initial=0) + 1
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return first, n


def windows(batches: Iterable[pa.RecordBatch], live: Broadcast, longest: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Counted windows: words from the leading one on as long as the phrase is frequent, then NULL.  All windows that a
    rare word leads are one, of NULLs only.  A row holds a task's windows of a range of their hashes, as lists."""
    names = ["lang", *WORDS[:longest]]
    held, rows = [], 0

    def merged() -> pa.Table:
        return summed_windows(pa.Table.from_batches(held), ["range", *names])

    for lang, code, words in by_language(batches):
        hashes, chosen = live_phrases(code, words, lang, live.value, longest)
        chosen[-1][chosen[-1]] = is_live(live.value, hashes[-1][chosen[-1]])
        start = np.flatnonzero(code >= 0)
        columns = [np.where(chosen[k][start], code[np.minimum(start + k, len(code) - 1)], -1) for k in range(longest)]
        first, n = grouped(columns)
        part = np.zeros(len(first), np.uint64)
        for k, column in enumerate(columns):
            part = np.where(column[first] >= 0, hashes[k][start[first]], part)
        arrays = [words.take(pa.array(c[first], mask=c[first] < 0)).cast(pa.string()) for c in columns]
        held.append(pa.RecordBatch.from_arrays([pa.array((part >> np.uint64(64 - bits)).astype(np.int32)), pa.array([lang] * len(first), pa.string()), *arrays, pa.array(n)],
                                               ["range", *names, "n"]))
        rows += len(first)
        if rows > MERGED:
            table = merged()
            held, rows = table.combine_chunks().to_batches(), len(table)
            if rows > MERGED // 2:
                yield listed(table)
                held, rows = [], 0
    if held:
        yield listed(merged())


def summed_windows(rows: pa.Table, names: list[str]) -> pa.Table:
    return rows.group_by(names, use_threads=False).aggregate([("n", "sum")]).select([*names, "n_sum"]).rename_columns([*names, "n"])


def listed(table: pa.Table) -> pa.RecordBatch:
    """One row for each range, the other columns as lists."""
    rows = table.sort_by("range").combine_chunks()
    part = rows.column("range").to_numpy()
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[:len(part)])
    offsets = pa.array(np.append(edges, len(part)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, rows.column(c).combine_chunks()) for c in rows.column_names[1:]]
    return pa.RecordBatch.from_arrays([pa.array(part[edges]), *lists], rows.column_names)


def window_counts(rows: DataFrame, live: Broadcast, longest: int, bits: int) -> DataFrame:
    """(lang, w1 and on, n): every window of all tasks once."""
    names = ["lang", *WORDS[:longest]]
    lists = rows.mapInArrow(partial(windows, live=live, longest=longest, bits=bits),
                            "range int, " + ", ".join(f"{c} array<string>" for c in names) + ", n array<long>")

    def together(part: pa.Table) -> pa.Table:
        return summed_windows(pa.table({c: pa.chunked_array([x.flatten() for x in part.column(c).chunks]) for c in [*names, "n"]}), names)

    return lists.groupBy("range").applyInArrow(together, ", ".join(f"{c} string" for c in names) + ", n long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, words, f): count of every phrase of one to `longest` words that has `min_count` occurrences, and, with no
    words, the number of word occurrences of the language."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.col("text").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    context, live, bits = rows.sparkSession.sparkContext, None, 0
    for length in range(2, longest + 1):  # each length is counted where the shorter ones are frequent
        bits = bits | live_bits(rows, partial(phrase_hashes, live=live, length=length), min_count, size)
        live = context.broadcast(bits)
    names = WORDS[:longest]
    counted = window_counts(rows, live, longest, max(1, range_bits(size) - 3))
    summed = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    # a prefix of k words is rolled up from word k + 1 on, and is whole if its last word isn't padding
    rolled = lambda k: F.col("rolled") == (1 << (longest - k)) - 1
    whole = rolled(0)
    for k, name in enumerate(names, 1):
        whole = whole | (rolled(k) & F.col(name).isNotNull())
    phrase = F.coalesce(*[F.when(rolled(k), F.array(*names[:k])) for k in range(longest + 1)])
    found = summed.where(whole).where(rolled(0) | (F.col("f") >= min_count))
    return found.select("lang", phrase.alias("words"), "f")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, covered: int = COVERED, longest: int = LONGEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to `longest` words of each language.

    A phrase with count a is cut in two where floor(1000 * a * n / (l * r)) is least, l and r being the counts of its
    parts and n the language's words; a tie goes to the shortest first part.  Phrases inside a longer candidate with
    `covered` percent of their count go.  NULL or empty texts have no words, a NULL language is `und`, repeated rows
    count each time, other columns are not read; a table without phrases gives no rows.
    """
    counts = staged(phrase_counts(docs, min_count, longest).withColumn("phrase", F.concat_ws(" ", "words")), "phrases")
    total = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    known = counts.where(F.size("words") > 0).select("lang", "phrase", "f")
    candidates = counts.where(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    return ranked(uncovered(scored(candidates, known, total), candidates, covered), top)


def scored(candidates: DataFrame, known: DataFrame, total: DataFrame) -> DataFrame:
    """Candidates with the counts and score of their weakest cut."""
    size = F.size("words")
    cut = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "words")
    cut = cut.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("head"),
                     F.concat_ws(" ", F.slice("words", F.col("k") + 1, size)).alias("tail"))
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    both = cut.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(total, "lang")
    exact = F.expr("cast(1000 * cast(a as decimal(38, 0)) * cast(n as decimal(38, 0)) as decimal(38, 0))"
                   " div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    weakest = F.min(F.struct(exact.alias("score"), "k", "l", "r", "n")).alias("cut")
    return both.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def inner_phrases(words: Column) -> Column:
    """All shorter runs of two words or more."""
    def runs(k: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.concat_ws(" ", F.slice(words, i, k)))
    return F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), runs))


def uncovered(found: DataFrame, candidates: DataFrame, covered: int) -> DataFrame:
    """Rows whose phrase no longer candidate with enough of its count holds."""
    longer = candidates.where(F.size("words") > 2)
    inside = longer.select("lang", F.explode(inner_phrases(F.col("words"))).alias("phrase"), F.col("a").alias("around"))
    most = inside.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = found.join(most, ["lang", "phrase"], "left")
    return kept.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * covered)).drop("around")


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
