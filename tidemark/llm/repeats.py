"""Repeated byte strings, found in a sparse enhanced suffix array.

Every string of `length` bytes chooses one anchor within itself: the rightmost smallest hash of its k-byte grams.
The choice depends on the string alone, so equal strings have equal anchors at equal offsets, and only anchors
whose gram occurs more than once can belong to repeats.  Suffixes that start at those anchors are sorted by Spark,
by gram and following bytes: the suffix array.  A scan with a stack over the common prefix lengths of neighbours
yields the intervals of the common-prefix tree.  Within an interval the bytes before the anchors are compared: where
they part, the left extension is diverse and a repeat cannot grow; members that agree on enough of them form a
maximal repeat group with all its occurrences.

Whole copies are found first, by digest, and only one copy of each text takes part in the search.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import portions, staged, utf8
from tidemark.llm.jaccard import mixed

LENGTH = 200
GRAM = 32
PIECE = 1 << 18
#: An anchor gram with more suffixes than this is counted by whole strings instead of in one task.
HOT = 20_000
#: Suffixes that a scan takes at a time, and all of their last gram.
SCANNED = 5_000


class Runs(NamedTuple):
    """Starts lo..hi of strings that chose the anchor at `at`; `owner` numbers the texts, positions are within the text."""
    owner: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    gram: np.ndarray
    context: np.ndarray  # hash of the bytes from lo to the end of the last string, with the anchor's place


class Anchors:
    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        if not 0 < gram <= length:
            raise ValueError("the gram must not be longer than the string")
        self.length, self.gram, self.window = length, gram, length - gram + 1
        rng = np.random.default_rng(7)
        self.of_byte = rng.integers(1, 1 << 63, 256, np.uint64)
        base = 0x9E3779B97F4A7C15
        n = 2 * PIECE + 2 * length
        powers = np.full((2, n), [[base], [pow(base, -1, 1 << 64)]], np.uint64)
        powers[:, 0] = 1
        self.power, self.unpower = np.multiply.accumulate(powers, axis=1)

    def runs(self, texts: list[bytes]) -> Iterator[Runs]:
        held, size = [], 0
        for k, text in enumerate(texts):
            if len(text) < self.length:
                continue
            for at in range(0, len(text) - self.length + 1, PIECE):
                piece = text[at:at + PIECE + self.length - 1]
                held.append((k, at, piece))
                size += len(piece)
                if size >= PIECE:
                    yield self.found(held)
                    held, size = [], 0
        if held:
            yield self.found(held)

    def found(self, pieces: list[tuple[int, int, bytes]]) -> Runs:
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        sizes = np.array([len(p) for _, _, p in pieces])
        begin = np.cumsum(sizes) - sizes
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.power[:len(data)], out=total[1:])
        grams = mixed((total[self.gram:] - total[:-self.gram]) * self.unpower[:len(data) - self.gram + 1])
        place = np.uint64(0xFFFFF)
        value = (grams & ~place) | (place - np.arange(len(grams), dtype=np.uint64))
        chosen = place - (sliding_min(value, self.window) & place)
        starts = np.concatenate([np.arange(b, b + n - self.length + 1) for b, n in zip(begin, sizes, strict=True)])
        piece = np.repeat(np.arange(len(pieces)), sizes - self.length + 1)
        at = chosen[starts].astype(np.int64)
        change = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]))))
        lo, hi, at, piece = starts[change], starts[np.append(change[1:], len(starts)) - 1], at[change], piece[change]
        context = mixed((total[hi + self.length] - total[lo]) * self.unpower[lo] + ((at - lo) * 65_537 + (hi - lo)).astype(np.uint64))
        shift = np.array([a for _, a, _ in pieces])[piece] - begin[piece]
        owner = np.array([k for k, _, _ in pieces])[piece]
        return Runs(owner, at + shift, lo + shift, hi + shift, grams[at].view(np.int64), context)


def sliding_min(value: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbouring values, in two passes over blocks of that width."""
    n = len(value)
    if width == 1:
        return value
    blocks = np.full(-(-n // width) * width, np.iinfo(value.dtype).max, value.dtype)
    blocks[:n] = value
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


@functools.lru_cache(maxsize=2)
def anchors(length: int, gram: int) -> Anchors:
    return Anchors(length, gram)


def joined_runs(found: Iterator[Runs]) -> Runs | None:
    parts = list(found)
    return Runs(*map(np.concatenate, zip(*parts, strict=True))) if parts else None


def gram_lists(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Adds to rows (key, text as bytes) the anchor grams of the text, one for each distinct context and a second one
    for a context that occurs again in the same text; the text column goes."""
    schema = docs.drop("text").withColumn("grams", F.array().cast("array<bigint>")).schema

    def run(batches):
        own = anchors(length, gram)
        for batch in portions(batches, "text"):
            r = joined_runs(own.runs(batch.column("text").to_pylist()))
            ends, flat = np.zeros(batch.num_rows, np.int64), np.zeros(0, np.int64)
            if r is not None:
                order = np.lexsort((r.context, r.gram, r.owner))
                owner, flat, context = r.owner[order], r.gram[order], r.context[order]
                same = np.concatenate(([False], (owner[1:] == owner[:-1]) & (flat[1:] == flat[:-1]) & (context[1:] == context[:-1])))
                keep = ~(same & np.concatenate(([False], same[:-1])))  # the first two of equal ones
                flat, ends = flat[keep], np.bincount(owner[keep], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(ends))), pa.int32()), pa.array(flat, pa.int64()))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], names=[*kept, "grams"])
    return docs.mapInArrow(run, schema)


SUFFIXES = "key binary, gram bigint, at int, first int, last int, ahead binary, behind binary"
SPANS = "key binary, start int, stop int"


def suffixes(docs: DataFrame, length: int, gram: int, turned: bool = True) -> DataFrame:
    """Suffixes at the listed anchors of rows (key, text, grams), with the bytes ahead and behind, these turned around.

    Bytes are raised by one, so that zero can mark the end.  A context that occurs again in its own text is sent
    once; the strings that start there are known to be repeated and come as rows without bytes (first to last).
    """
    shifted, step = bytes((b + 1) % 256 for b in range(256)), -1 if turned else 1

    def run(batches):
        own = anchors(length, gram)
        for batch in portions(batches, "text", 1 << 20):
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
            r = joined_runs(own.runs(texts))
            rows = []
            if r is not None:
                wanted = batch.column("grams")
                listed = np.concatenate([np.isin(r.gram[r.owner == k], wanted[k].values.to_numpy()) for k in range(len(texts))]) if len(texts) > 1 else np.isin(r.gram, wanted[0].values.to_numpy())
                r = Runs(*(c[listed] for c in r))
            if r is not None and len(r.at):
                order = np.lexsort((r.context, r.gram, r.owner))
                o, g, c = r.owner[order], r.gram[order], r.context[order]
                again = np.concatenate(([False], (o[1:] == o[:-1]) & (g[1:] == g[:-1]) & (c[1:] == c[:-1])))
                local = again | np.concatenate((again[1:], [False]))
                for k, at, lo, hi, gr in zip(*(x[order][~again].tolist() for x in (r.owner, r.at, r.lo, r.hi, r.gram)), strict=True):
                    text = texts[k]
                    rows.append((keys[k], gr, at, lo, hi, text[at:hi + length].translate(shifted), text[lo:at][::step].translate(shifted)))
                if local.any():
                    o, lo, hi = r.owner[order][local], r.lo[order][local], r.hi[order][local]
                    by = np.lexsort((lo, o))
                    o, lo, hi = o[by], lo[by], hi[by]
                    new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (lo[1:] > hi[:-1] + 1))))
                    last = np.append(new[1:], len(o)) - 1
                    rows += [(keys[k], int(mixed(np.array([a * 1_000_003 + k], np.uint64)).view(np.int64)[0]), a, a, b, None, None)
                             for k, a, b in zip(o[new].tolist(), lo[new].tolist(), hi[last].tolist(), strict=True)]
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)],
                                             names=["key", "gram", "at", "first", "last", "ahead", "behind"])
    return docs.mapInArrow(run, SUFFIXES)


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x width bytes ended by zeros, lengths)."""
    sizes = np.array([len(b) for b in column.to_pylist()], np.int64)
    rows = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in column.to_pylist()), np.uint8)
    return rows.reshape(len(sizes), width), sizes


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows; the padding of one never equals a byte of another."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def intervals(prefix: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common length, first, last) of the intervals of the common-prefix tree; prefix[i]: of suffixes i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, size in enumerate([*prefix, -1]):
        first = i
        while stack and stack[-1][0] > size:
            top, first = stack.pop()
            yield top, first, i
        if not stack or stack[-1][0] < size:
            stack.append((size, first))


def repeated_ranges(ahead: np.ndarray, behind: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, nearest, farthest) distances before the anchor at which repeated strings start.

    Suffixes lie in sorted order; bounds[g]..bounds[g + 1] share a gram.
    """
    n = len(ahead)
    opened = np.zeros((n, length + 2), np.int32)  # +1 where a range of distances begins, -1 after its end
    prefix = np.append(common(ahead[:-1], ahead[1:]), 0) if n > 1 else np.zeros(n, np.int64)
    sizes = np.diff(bounds)

    def mark(members: np.ndarray, near: int | np.ndarray, reach: np.ndarray) -> None:
        np.add.at(opened, (members, near), 1)
        np.add.at(opened, (members, reach + 1), -1)

    first = bounds[:-1][sizes == 2]
    if len(first):
        back = common(behind[first], behind[first + 1])
        near = length - prefix[first]
        ok = back >= near
        for side in (first, first + 1):
            mark(side[ok], near[ok], back[ok])
    for g in np.flatnonzero(sizes > 2):
        lo, hi = int(bounds[g]), int(bounds[g + 1])
        order = lo + np.argsort(np.ascontiguousarray(behind[lo:hi]).view(f"S{behind.shape[1]}").ravel(), kind="stable")
        turn = np.empty(hi - lo, np.int64)
        turn[order - lo] = np.arange(hi - lo)
        for size, a, b in intervals(prefix[lo:hi - 1].tolist()):
            members = lo + a + np.argsort(turn[a:b + 1], kind="stable")
            back = common(behind[members[:-1]], behind[members[1:]])
            reach = np.maximum(np.append(back, -1), np.append(-1, back))
            ok = reach >= length - size  # not so: the left extension is diverse before the string is long enough
            if ok.any():
                mark(members[ok], length - size, reach[ok])
    inside = np.cumsum(opened, axis=1) > 0
    edges = np.diff(inside.astype(np.int8), axis=1, prepend=0)
    row, near = np.nonzero(edges == 1)
    _, after = np.nonzero(edges == -1)
    return row, near, after - 1


def scan(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans (key, start, stop) of repeated strings from suffixes; those of a gram meet in one task, in sorted order."""
    def solve(table: pa.Table):
        known = table.filter(table.column("ahead").is_null())
        table = table.filter(table.column("ahead").is_valid()).combine_chunks()
        keys, start, stop = [known.column("key")], [known.column("first").to_numpy()], [known.column("last").to_numpy() + length]
        if table.num_rows > 1:
            grams = table.column("gram").to_numpy()
            bounds = np.concatenate(([0], np.flatnonzero(grams[1:] != grams[:-1]) + 1, [len(grams)]))
            row, near, far = repeated_ranges(padded(table.column("ahead"), length)[0], padded(table.column("behind"), length - gram)[0], bounds, length)
            at = table.column("at").to_numpy()[row]
            keys.append(table.column("key").take(pa.array(row)))
            start.append(at - far)
            stop.append(at - near + length)
        flat = [c for k in keys for c in (k.chunks if isinstance(k, pa.ChunkedArray) else [k])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(flat).cast(pa.binary()) if flat else pa.array([], pa.binary()),
                                           pa.array(np.concatenate(start), pa.int32()), pa.array(np.concatenate(stop), pa.int32())], names=["key", "start", "stop"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, SCANNED):
                part = batch.slice(lo, SCANNED)
                held.append(part)
                count += part.num_rows
                if count >= SCANNED:
                    table = pa.Table.from_batches(held)
                    grams = table.column("gram").to_numpy()
                    cut = int(np.searchsorted(grams, grams[-1]))  # the last gram may go on
                    if cut:
                        yield solve(table.slice(0, cut))
                        table = table.slice(cut).combine_chunks()
                    held, count = table.to_batches(), table.num_rows
        if held:
            yield solve(pa.Table.from_batches(held))
    return rows.repartition("gram").sortWithinPartitions("gram", "ahead").mapInArrow(run, SPANS)


def counted(rows: DataFrame, length: int) -> DataFrame:
    """Spans from suffixes of hot grams (bytes behind not turned): their strings are counted by digest, combined per task
    before the shuffle, so that no group of suffixes has to meet."""
    strings = rows.where("ahead IS NOT NULL").select(
        "key", F.explode(F.sequence(F.col("first"), F.col("last"))).alias("start"), F.concat("behind", "ahead").alias("bytes"), "first")
    strings = strings.select("key", "start", F.unhex(F.md5(F.substring(F.col("bytes"), F.col("start") - F.col("first") + 1, F.lit(length)))).alias("digest"))
    often = strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return strings.join(often, "digest", "left_semi").select("key", "start", (F.col("start") + length).alias("stop"))


def text_key(text: str | Column) -> Column:
    """Identity of a text: half of its SHA-256."""
    return F.substring(F.unhex(F.sha2(utf8(text), 256)), 1, 16)


def with_key(docs: DataFrame, text: str = "text", key: str = "key") -> DataFrame:
    """Text as bytes, and its identity; NULL counts as empty."""
    return docs.withColumns({key: text_key(text), text: utf8(text)}).where(F.col(key).isNotNull())


def repeated_spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """key, copies, spans (array of start, stop in bytes, unmerged) of every distinct text that holds repeated strings or
    occurs more than once, from rows (doc_id, key, text) of `with_key`.

    A text with copies is repeated from end to end if it has `length` bytes; its spans may then be NULL or partial.
    """
    lists = gram_lists(keyed.select("doc_id", "key", "text"), length, gram)
    texts = staged(lists.groupBy("key").agg(F.first("grams").alias("grams"), F.min("doc_id").alias("one"), F.count("*").alias("copies")), "texts")
    listed = texts.select("key", "one", F.explode("grams").alias("gram"))
    often = listed.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    sought = staged(listed.join(often, "gram").groupBy("key", "one").agg(
        F.collect_set("gram").alias("grams"), F.collect_set(F.when(F.col("n") > hot, F.col("gram"))).alias("hot")), "sought")
    # one row of each text; written so that the rows still meet by key alone and share that exchange with later steps
    same = F.coalesce(F.col("doc_id") == F.col("one"), F.col("doc_id").isNull() & F.col("one").isNull())
    met = keyed.select("doc_id", "key", "text").join(sought.hint("shuffle_hash"), "key").where(same)
    cold = met.withColumn("grams", F.array_except("grams", "hot"))
    spans = scan(suffixes(cold.select("key", "text", "grams"), length, gram), length, gram)
    if sought.where(F.size("hot") > 0).limit(1).count():
        few = met.where(F.size("hot") > 0).select("key", "text", F.col("hot").alias("grams"))
        hot_rows = suffixes(few, length, gram, turned=False)
        known = hot_rows.where("ahead IS NULL").select("key", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
        spans = spans.unionByName(counted(hot_rows, length)).unionByName(known)
    grouped = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.where("copies > 1").select("key", "copies").join(grouped, "key", "full").select(
        "key", F.coalesce("copies", F.lit(1)).alias("copies"), "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [tuple(x) for x in out]


def whole_characters(data: bytes, start: int, stop: int) -> tuple[int, int]:
    """The part of a span that holds whole UTF-8 characters."""
    while start < stop and data[start] & 0xC0 == 0x80:
        start += 1
    while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop -= 1
    return start, stop


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, characters: bool = False) -> DataFrame:
    """Adds `kept` (the bytes outside repeated strings) and `removed` (maximal removed runs as start, stop) to every row.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else in the table, in the same text
    or another; strings never cross texts and are judged on the input.  characters: a removed run leaves the
    characters that it would cut.  NULL and texts shorter than `length` stay as they are.  All copies go, repeated
    rows among them.  Columns named key, kept, removed, copies and spans are replaced, all others are carried along.
    """
    keyed = with_key(docs.drop("key", "kept", "removed", "copies", "spans"), text)
    plain = keyed if text == "text" else keyed.withColumnRenamed(text, "text")
    spans = repeated_spans(plain, length, gram, hot)
    met = keyed.join(spans.hint("shuffle_hash"), "key", "left").drop("key")
    pair = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    schema = met.drop("copies", "spans").withColumns({"kept": F.col(text), "removed": F.expr("CAST(NULL AS array<struct<start:int,stop:int>>)")}).schema
    names = [n for n in met.columns if n not in ("copies", "spans")]

    def run(batches):
        for batch in portions(batches, text, 1 << 20):
            kept, removed = [], []
            for data, copies, own in zip(*(batch.column(c).to_pylist() for c in (text, "copies", "spans")), strict=True):
                if (copies or 1) > 1 and len(data) >= length:
                    gone = [(0, len(data))]
                else:
                    gone = merged([(s["start"], s["stop"]) for s in own or ()])
                if characters:
                    gone = [g for g in (whole_characters(data, *g) for g in gone) if g[0] < g[1]]
                edges = [0, *(x for g in gone for x in g), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                removed.append([{"start": a, "stop": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(kept, pa.binary()), pa.array(removed, pair)],
                                             names=[*names, "kept", "removed"])
    return met.mapInArrow(run, schema)
