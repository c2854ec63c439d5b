"""Language-model scoring with a probabilistic suffix tree over all words.

A symbol is a word or the end of a text.  A context is the one or two symbols before a token; it is a node if the next
symbols that occur often enough after it are distributed otherwise than after the context one symbol shorter, by more
than chance (count times divergence).  A node's distribution takes a discount off each next symbol's count and gives
what is left to the shorter context's distribution, down to the root: discounted word counts, whose rest is the
probability of a word that training has not seen.  So each node, like the unigram base, has a distribution over the
known words, the end and one unknown word, and a token is scored from the longest suffix of what comes before it that
is a node.

The tree is a set of Spark tables keyed by hashes of symbol sequences, and grows with the corpus: every sequence that
occurs again is weighed, whatever the size of the corpus.  Sequences that occur once are sorted out beforehand by the bit
sets of `hashcounts`.  A sequence is counted where its shorter one is, so it crosses the shuffle as its first symbol and a
count, and finds its parent's probability there.  Texts meet what they need of the tree block by block: a block's distinct
sequences are looked up once, those after a node and nodes themselves, as a bit set of the nodes tells.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import portions, shuffles_dropped, staged, unstaged, utf8
from tidemark.llm.hashcounts import is_live, live_bits, mixed, planes, range_bits, values_of

#: Symbols of the longest context.
DEPTH = 2
#: Occurrences that an edge of the tree needs: a sequence that does not occur again says nothing of what follows.
MIN_COUNT = 2
#: Least gain of a node over its shorter context, in nats for each of its edges and two more.
MIN_GAIN = 2.0
DISCOUNT = 0.75
#: Text that a block of lookups holds.
BLOCK_BYTES = 64 << 20
PORTION = 2 << 20
#: Place of a row without an id.
NO_ID = -(1 << 63)

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_RNG = np.random.default_rng(8)
BASE = int(_RNG.integers(1 << 62, 1 << 63)) | 1
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(int(_RNG.integers(1 << 62, 1 << 63)) | 1)
END = np.uint64(_RNG.integers(1 << 63))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", BASE), ("down", INVERSE)):
            _POWERS[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, PORTION + 65_536), base, np.uint64)]), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the symbols of all texts, after one END at the start of all; and the text of each symbol but that."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    word = ~BLANK[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)])
    found = mixed((sums[stop] - sums[start]) * down[start])
    at = np.concatenate([start, ends])
    order = np.argsort(at, kind="stable")
    hashes = np.concatenate([found, np.full(len(ends), END)])[order]
    return np.concatenate([[END], hashes]), np.searchsorted(ends, at[order])


class Sequences(NamedTuple):
    """By position: hash of the last k symbols, and whether they exist; an END is only the first or the last of them."""
    hashes: list[np.ndarray]
    valid: list[np.ndarray]

    @classmethod
    def of(cls, symbol: np.ndarray, depth: int = DEPTH) -> Sequences:
        hashes, valid = [mixed(symbol)], [np.ones(len(symbol), bool)]
        for k in range(1, depth + 1):
            longer, ok = np.zeros(len(symbol), np.uint64), np.zeros(len(symbol), bool)
            longer[k:] = mixed(hashes[-1][k:] * STEP + symbol[:-k])
            ok[k:] = valid[-1][k:] & ((symbol[1:len(symbol) - k + 1] != END) if k > 1 else True)
            hashes.append(longer)
            valid.append(ok)
        return cls(hashes, valid)

    def candidates(self, live: list[np.ndarray]) -> list[np.ndarray]:
        """Positions by length where the sequence is live so far: its own bit, and both shorter ones, as far as given."""
        out = [self.valid[0]]
        for k in range(1, len(self.hashes)):
            ok = self.valid[k].copy()
            if k > 1:
                ok[1:] &= out[-1][1:] & out[-1][:-1]
            if k <= len(live):
                ok[ok] = is_live(live[k - 1], self.hashes[k][ok])
            out.append(ok)
        return out


def texts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in portions(batches, "text", PORTION):
        yield batch, batch.column("text").to_pylist()


def blocks_of(batch: pa.RecordBatch, texts: list[bytes], cuts: np.ndarray) -> np.ndarray:
    """Neighbouring ids share a block, as files usually hold them together; an id at which several blocks are cut is
    dealt over them by its texts."""
    ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
    low, high = np.searchsorted(cuts, ids, "left"), np.searchsorted(cuts, ids, "right")
    out = low.astype(np.int32)
    for i in np.flatnonzero(high > low):
        out[i] += zlib.crc32(texts[i]) % (high[i] - low[i] + 1)
    return out


def sequence_hashes(batches: Iterable[pa.RecordBatch], live: list[Broadcast]) -> Iterator[np.ndarray]:
    """Hashes of the sequences one longer than the bit sets given, where all that is known of them is live."""
    bits, k = [b.value for b in live], len(live) + 1
    for _, texts in texts_of(batches):
        found = Sequences.of(symbols(texts)[0], k)
        yield found.hashes[k][found.candidates(bits)[k]]


#: Sequences that a task holds before it merges equal ones, and that it passes on if they are still as many as half of it.
HELD = 2_000_000


def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Columns seq, n and others of all parts, sorted by seq, with n summed over equal ones."""
    seq, n, *more = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(seq)
    seq = seq[order]
    first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else np.zeros(0, np.int64)
    return [seq[first], np.add.reduceat(n[order], first) if len(seq) else n, *(c[order[first]] for c in more)]


def byte_planes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def plane_values(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


CHUNKS = "range int, size byte, gaps binary, kinds binary, first binary, n binary"


def sequence_chunks(batches: Iterable[pa.RecordBatch], live: list[Broadcast], bits: int) -> Iterator[pa.RecordBatch]:
    """Training occurrences of the live sequences one longer than the bit sets before the last, by ranges of the shorter
    sequence's hash: gaps of those, how many there are of each, their first symbols and counts; with pairs come words."""
    sets, k = [b.value for b in live], len(live)
    sizes = (0, 1) if k == 1 else (k,)
    held: dict[int, list[list[np.ndarray]]] = {size: [] for size in sizes}

    def sent():
        for size, parts in held.items():
            if not sum(len(part[0]) for part in parts):
                continue
            seq, n, *rest = merged(parts)
            shorter, first = rest if size else (seq, None)
            if size:
                order = np.argsort(shorter)
                shorter, first, n = shorter[order], first[order], n[order]
            name = shorter >> np.uint64(64 - bits)
            edges = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            rows = []
            for lo, hi in zip(edges, [*edges[1:], len(name)]):
                head = np.flatnonzero(np.concatenate([[True], shorter[lo + 1:hi] != shorter[lo:hi - 1]]))
                gaps = np.diff(shorter[lo:hi][head], prepend=np.uint64(0))
                rows.append((int(name[lo]), size, byte_planes(gaps), byte_planes(np.diff(head, append=hi - lo)) if size else b"",
                             first[lo:hi].tobytes() if size else b"", byte_planes(n[lo:hi])))
            kinds = [pa.int32(), pa.int8(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["range", "size", "gaps", "kinds", "first", "n"])
            parts.clear()

    rows = 0
    for _, texts in texts_of(batches):
        symbol, _ = symbols(texts)
        found = Sequences.of(symbol, k)
        ok = found.candidates(sets)
        for size in sizes:
            at = np.flatnonzero(ok[size][1:]) + 1
            part = [found.hashes[size][at], np.ones(len(at), np.int64)]
            held[size].append(part + ([found.hashes[size - 1][at], symbol[at - size]] if size else []))
            rows += len(at)
        if rows > HELD:
            for size, parts in held.items():
                held[size] = [merged(parts)]
            rows = sum(len(parts[0][0]) for parts in held.values())
            if rows > HELD // 2:
                yield from sent()
                rows = 0
    yield from sent()


def counted_sequences(chunks: pa.Table, size: int) -> list[np.ndarray]:
    """seq, n, shorter and first of a range, sorted by seq."""
    parts = [[np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)]]
    for kind, *data in zip(*(chunks.column(c).to_pylist() for c in ("size", "gaps", "kinds", "first", "n"))):
        if kind == size:
            shorter, n = np.cumsum(plane_values(data[0]), dtype=np.uint64), plane_values(data[3]).astype(np.int64)
            if size:
                shorter, first = np.repeat(shorter, plane_values(data[1]).astype(np.int64)), np.frombuffer(data[2], "<u8").astype(np.uint64)
                parts.append([mixed(shorter * STEP + first), n, shorter, first])
            else:
                parts.append([shorter, n, shorter, shorter])
    return merged(parts)


def longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64)) for c in columns]


WORDS_AND_PAIRS = "size byte, seq long, n long, ctx long, shorter long, parent long"


def words_and_pairs(chunks: pa.Table, min_count: int) -> pa.Table:
    """Words of a range with their counts, and pairs that end with them; a pair's parent is its last word's count."""
    word, n, *_ = counted_sequences(chunks, 0)
    seq, count, shorter, first = (c for c in counted_sequences(chunks, 1))
    often = count >= min_count
    seq, count, shorter, first = seq[often], count[often], shorter[often], first[often]
    none, names = pa.nulls(len(word), pa.int64()), ["size", "seq", "n", "ctx", "shorter", "parent"]
    rows = [pa.array(np.ones(len(word), np.int8)), *longs(word, n), none, none, none]
    more = [pa.array(np.full(len(seq), 2, np.int8)), *longs(seq, count, mixed(first), shorter, n[np.searchsorted(word, shorter)])]
    return pa.concat_tables([pa.table(rows, names), pa.table(more, names)])


def triples(chunks: pa.Table, pairs: pa.Table, min_count: int) -> pa.Table:
    """(ctx, seq, n, parent) of a range's sequences of three, parent being the probability of the pair they end with."""
    seq, n, shorter, first = counted_sequences(chunks, 2)
    often = n >= min_count
    seq, n, shorter, first = seq[often], n[often], shorter[often], first[often]
    known, last, p = pairs.column("seq").to_numpy().view(np.uint64), pairs.column("ctx").to_numpy().view(np.uint64), pairs.column("p").to_numpy()
    order = np.argsort(known)
    at = order[np.searchsorted(known[order], shorter)] if len(known) else np.zeros(0, np.int64)
    return pa.table([*longs(mixed(last[at] * STEP + first), seq, n), pa.array(p[at].astype(np.float32))], ["ctx", "seq", "n", "parent"])


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted; numpy's own hashes before it sorts, which takes many times as long here."""
    out = np.sort(np.concatenate(parts))
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


#: A sequence is asked for by so many bits of its hash; what is told has the whole hash.
ASK_BITS = 40


def wanted_sequences(batches: Iterable[pa.RecordBatch], live: list[Broadcast], inner: Broadcast, cuts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """(range, block, gaps): a block's words, and the live sequences whose context is a node or that are nodes, as far as
    bits tell."""
    sets, nodes = [b.value for b in live], inner.value
    width = ASK_BITS - bits
    held: dict[int, list[np.ndarray]] = {}
    rows = 0

    def sent():
        for block, parts in held.items():
            key = distinct(parts).astype(np.int64)
            name = key >> width
            edges = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(key) else []
            data = [(int(name[lo]), block, planes(np.diff(key[lo:hi], prepend=name[lo] << width))) for lo, hi in zip(edges, [*edges[1:], len(key)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in data], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["range", "block", "gaps"])
        held.clear()

    for batch, texts in texts_of(batches):
        symbol, text = symbols(texts)
        found = Sequences.of(symbol)
        blocks = blocks_of(batch, texts, cuts)[text]
        node = [is_live(nodes, h) for h in found.hashes[:DEPTH]]
        keys, own = [], []
        for k, ok in enumerate(found.candidates(sets)):
            if k:
                told = np.concatenate([[False], node[k - 1][:-1]])
                ok = ok & (told | node[k] if k < DEPTH else told)
            at = np.flatnonzero(ok[1:]) + 1
            keys.append(found.hashes[k][at] >> np.uint64(64 - ASK_BITS))
            own.append(blocks[at - 1])
        key, own = np.concatenate(keys), np.concatenate(own)
        for block in np.flatnonzero(np.bincount(own)):
            part = distinct([key[own == block]])
            held.setdefault(int(block), []).append(part)
            rows += len(part)
        if rows > HELD:
            for block, parts in held.items():
                held[block] = [distinct(parts)]
            rows = sum(len(parts[0]) for parts in held.values())
            if rows > HELD // 2:
                yield from sent()
                rows = 0
    yield from sent()


TOLD = "block int, gaps binary, n binary, log_p binary, log_rest binary"


def told_sequences(asked: pa.Table, tree: pa.Table, bits: int) -> pa.Table:
    """What each block that asks is told of a range: its sequences of the tree, as far as the bits asked for tell."""
    seq = tree.column("seq").to_numpy().view(np.uint64)
    order = np.argsort(seq)
    first = np.concatenate([[True], seq[order][1:] != seq[order][:-1]]) if len(seq) else np.zeros(0, bool)
    known, at = seq[order][first], np.empty(len(seq), np.int64)
    at[order] = np.cumsum(first) - 1
    kind, value, values = tree.column("kind").to_numpy(), tree.column("value").to_numpy(), np.full((3, len(known)), np.nan)
    values[kind, at] = value
    by_block: dict[int, list[np.ndarray]] = {}
    for name, block, gaps in zip(*(asked.column(c).to_pylist() for c in ("range", "block", "gaps"))):
        by_block.setdefault(block, []).append(np.cumsum(values_of(gaps)) + (name << (ASK_BITS - bits)))
    key, rows = (known >> np.uint64(64 - ASK_BITS)).astype(np.int64), []
    for block, parts in by_block.items():
        wanted = np.append(distinct(parts), np.iinfo(np.int64).max)
        own = wanted[np.searchsorted(wanted[:-1], key)] == key
        if own.any():
            rows.append((block, byte_planes(np.diff(known[own], prepend=np.uint64(0))), byte_planes(np.nan_to_num(values[0, own]).astype(np.int64)),
                         *(v[own].astype("<f4").tobytes() for v in values[1:])))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), *[pa.binary()] * 4))], ["block", "gaps", "n", "log_p", "log_rest"])


def least_count(n_bytes: int) -> int:
    """Occurrences that a context with its next symbol must have: the same in a corpus of any size."""
    return MIN_COUNT


class Tree(NamedTuple):
    """By sequence: counts (seq, n) of words, edges (seq, log_p) with the log10 probability of the last symbol after the
    others, and nodes (seq, log_rest) with that of the share left to the shorter context.  tokens and words are those of
    the training texts."""
    counts: DataFrame
    edges: DataFrame
    nodes: DataFrame
    tokens: int
    words: int

    @property
    def unknown(self) -> float:
        return float(np.log10((self.words * DISCOUNT + 1) / (self.tokens + 1)))


def grow(learned: DataFrame, n_bytes: int, min_count: int, min_gain: float) -> tuple[Tree, list[Broadcast]]:
    """The tree of the texts, and the bit sets of sequences that may be in it."""
    context, live = learned.sparkSession.sparkContext, []
    bits = range_bits(n_bytes >> 2)

    def chunks() -> DataFrame:
        live.append(context.broadcast(live_bits(learned, partial(sequence_hashes, live=list(live)), min_count, n_bytes)))
        return learned.mapInArrow(partial(sequence_chunks, live=list(live), bits=bits), CHUNKS)

    def counted(part: pa.Table) -> pa.Table:
        return words_and_pairs(part, min_count)

    both = staged(chunks().groupBy("range").applyInArrow(counted, WORDS_AND_PAIRS), "pairs")
    words = both.where("size = 1").select("seq", "n")
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, of, log = F.col("n"), F.col("of"), lambda c: F.log10(c).cast("float")
    rest = ((F.col("kinds") * DISCOUNT + of - F.col("held")) / of).alias("rest")
    # count times divergence from the shorter context, but for the context's own count
    gains = (F.col("told") - F.col("held") * F.log("of") > min_gain * (F.col("kinds") + 2)).alias("gains")
    p = (n - DISCOUNT) / of + F.col("rest") * F.col("parent")
    sums = [F.count("*"), F.sum("n"), F.sum(n * F.log(n / F.col("parent")))]
    pairs = both.where("size = 2").withColumn("parent", (F.col("parent") - DISCOUNT) / (tokens + 1))
    told = pairs.groupBy("ctx").agg(*[c.alias(name) for c, name in zip(sums, ("kinds", "held", "told"))])
    first = staged(told.join(words.select(F.col("seq").alias("ctx"), n.alias("of")), "ctx").select("ctx", "of", rest, gains), "nodes")
    level = staged(pairs.join(first, "ctx").select("seq", "ctx", "shorter", "n", p.cast("float").alias("p")), "level")
    words = staged(words, "words")
    unstaged(both)

    def with_parents(part: pa.Table, known: pa.Table) -> pa.Table:
        return triples(part, known, min_count)

    known = level.select(F.shiftrightunsigned("seq", 64 - bits).cast("int").alias("range"), "seq", "ctx", "p")
    found = chunks().groupBy("range").cogroup(known.groupBy("range")).applyInArrow(with_parents, "ctx long, seq long, n long, parent float")
    own = Window.partitionBy("ctx")
    found = found.join(level.select(F.col("seq").alias("ctx"), n.alias("of"), F.col("shorter").alias("last")), "ctx")
    found = found.withColumns({name: c.over(own) for c, name in zip(sums, ("kinds", "held", "told"))}).select("*", rest, gains).where("gains")
    second = staged(found.select("seq", "ctx", "last", log(p).alias("log_p"), log("rest").alias("log_rest")), "tree-triples")
    deep = second.groupBy("ctx").agg(F.first("last").alias("last"), F.first("log_rest").alias("log_rest"))
    # a node's shorter context is a node, too
    good = staged(first.where("gains").select("ctx").unionByName(deep.select(F.col("last").alias("ctx"))).distinct(), "good")
    edges = level.join(good, "ctx", "left_semi").select("seq", log("p").alias("log_p")).unionByName(second.select("seq", "log_p"))
    nodes = first.join(good, "ctx", "left_semi").select(F.col("ctx").alias("seq"), log("rest").alias("log_rest"))
    nodes = nodes.unionByName(deep.select(F.col("ctx").alias("seq"), "log_rest"))
    return Tree(words, edges, staged(nodes, "tree-nodes"), tokens, distinct), live


def node_hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column("seq").to_numpy().view(np.uint64)


class Lookup:
    """What a block needs of the tree, by hash."""

    def __init__(self, told: pa.Table):
        whole = lambda name, read: np.concatenate([np.zeros(0), *map(read, told.column(name).to_pylist())])
        seq = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(plane_values(g), dtype=np.uint64) for g in told.column("gaps").to_pylist())])
        order = np.argsort(seq)
        self.seq = seq[order]
        # rows by the first bits of their hash, a row or less for each value of these
        bits = max(1, len(seq).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.seq >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        value = lambda name, read: np.append(whole(name, read)[order], np.nan)
        part = partial(np.frombuffer, dtype="<f4")
        self.n, self.log_p, self.log_rest = value("n", plane_values), value("log_p", part), value("log_rest", part)

    def at(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash; the last, which is empty, where there is none."""
        out, slot = np.full(len(hashes), len(self.seq)), (hashes >> self.shift).astype(np.int64)
        row, stop, left = self.start[slot], self.start[slot + 1], np.arange(len(hashes))
        while True:
            more = row < stop
            row, stop, left = row[more], stop[more], left[more]
            if not len(left):
                return out
            found = self.seq[row] == hashes[left]
            out[left[found]] = row[found]
            row, stop, left = row[~found] + 1, stop[~found], left[~found]

    def score(self, found: Sequences, tokens: int, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """Training count and log10 probability of every symbol but the first."""
        rows = [self.at(h) for h in found.hashes]
        n = np.nan_to_num(self.n[rows[0][1:]])
        out = np.where(n > 0, np.log10(np.maximum(n - DISCOUNT, DISCOUNT / 4) / (tokens + 1)), unknown)
        for k in range(1, DEPTH + 1):
            rest, p = self.log_rest[rows[k - 1][:-1]], self.log_p[rows[k][1:]]
            node = found.valid[k][1:] & ~np.isnan(rest)
            out = np.where(node, np.where(np.isnan(p), rest + out, p), out)
        return n, out


def bundled(batches: Iterable[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(block, ids, held, times, sizes, data): texts of a block, many to a row, compressed for the shuffle.  Equal rows
    go once, with their number."""
    press = zstandard.ZstdCompressor(level=1)
    for batch, texts in texts_of(batches):
        blocks = blocks_of(batch, texts, cuts)
        kinds = Counter(zip(blocks.tolist(), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts))
        for block in set(blocks.tolist()):
            own = [(*k, n) for k, n in kinds.items() if k[0] == block]
            _, ids, held, data, times = map(list, zip(*own))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([times], pa.list_(pa.int64())),
                 pa.array([list(map(len, data))], pa.list_(pa.int64())), pa.array([press.compress(b"".join(data))], pa.binary())],
                ["block", "ids", "held", "times", "sizes", "data"])


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, score double"
TEXTS = "block int, ids array<long>, held array<boolean>, times array<long>, sizes array<long>, data binary"


def solve(texts: pa.Table, told: pa.Table, tokens: int, unknown: float) -> pa.Table:
    """Scores of a block's texts from what it needs of the tree."""
    lookup, out = Lookup(told), []
    for row in zip(*(texts.column(c).to_pylist() for c in ("ids", "held", "times", "sizes", "data")), strict=True):
        out.append(scored(lookup, tokens, unknown, *row))
    kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64())]
    return pa.Table.from_batches(out, pa.schema(kinds))


def scored(lookup: Lookup, tokens: int, unknown: float, ids: list, held: list[bool], times: list[int], sizes: list[int], data: bytes) -> pa.RecordBatch:
    whole, ends = zstandard.ZstdDecompressor().decompress(data, max_output_size=sum(sizes) or 1), np.cumsum(sizes)
    parts, first = [], 0
    while first < len(ids):  # a portion at a time, or one text
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PORTION, "right")))
        symbol, text = symbols([whole[ends[i] - sizes[i]:ends[i]] for i in range(first, last)])
        n, log_p = lookup.score(Sequences.of(symbol), tokens, unknown)
        add = lambda values: np.bincount(text, values, last - first)
        parts.append((add(None), add(n > 0), add(np.log10(n + 0.5)), add(log_p)))
        first = last
    found = [np.repeat(np.concatenate(c), times) for c in zip(*parts)]
    at = pa.array(np.repeat(np.arange(len(ids)), times))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()).take(at), pa.array(held, pa.bool_()).take(at), pa.array(found[0].astype(np.int64)), pa.array(found[1].astype(np.int64)),
         pa.array(found[2]), pa.array(found[3])], ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score"])


def train(rows: DataFrame, n_bytes: int, cuts: np.ndarray, min_count: int | None = None, min_gain: float = MIN_GAIN) -> tuple[Tree, list[Broadcast]]:
    """The tree of the rows that are not held out, and the bit sets of its sequences."""
    return grow(rows.where("NOT held_out").select("text"), n_bytes, least_count(n_bytes) if min_count is None else min_count, min_gain)


def score(docs: DataFrame, held_out: Column, min_count: int | None = None, min_gain: float = MIN_GAIN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    Rows whose held_out is not true are learned from.  Tokens are the words and one end; base_score is the unigram
    log10 probability with half a count added, score that of the suffix tree.  NULL and empty texts consist of
    their end.  Repeated rows are learned from and scored each; of other columns only those that held_out names are
    read.  With nothing to learn from, train_tokens is 0 and every word is unknown; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    ids = F.coalesce("doc_id", F.lit(NO_ID))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    cuts = rows.agg(F.percentile_approx(ids, [i / blocks for i in range(1, blocks)], 100 * blocks)).first()[0] if blocks > 1 else []
    cuts = np.array(cuts or [], np.int64)
    with shuffles_dropped(docs.sparkSession):
        tree, live = train(rows, size, cuts, min_count, min_gain)
        inner = docs.sparkSession.sparkContext.broadcast(live_bits(tree.nodes.select("seq"), node_hashes, 1, size))
    bits = max(ASK_BITS - 32, range_bits(size >> 2))
    asked = rows.mapInArrow(partial(wanted_sequences, live=live, inner=inner, cuts=cuts, bits=bits), "range int, block int, gaps binary")
    of = lambda rows, kind, value: rows.select(F.shiftrightunsigned("seq", 64 - bits).cast("int").alias("range"), "seq", F.lit(kind).cast("byte").alias("kind"), F.col(value).cast("double").alias("value"))
    parts = of(tree.counts, 0, "n").unionByName(of(tree.edges, 1, "log_p")).unionByName(of(tree.nodes, 2, "log_rest"))

    def tell(own: pa.Table, parts: pa.Table) -> pa.Table:
        return told_sequences(own, parts, bits)

    with shuffles_dropped(docs.sparkSession):
        told = staged(asked.groupBy("range").cogroup(parts.groupBy("range")).applyInArrow(tell, TOLD), "told")
    unstaged(parts)
    texts = rows.mapInArrow(partial(bundled, cuts=cuts), TEXTS)
    counted, unknown = tree.tokens, tree.unknown

    def one(own: pa.Table, needed: pa.Table) -> pa.Table:
        return solve(own, needed, counted, unknown)

    found = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(one, SCORES)
    whole = float(np.log10(max(tree.tokens + (tree.words + 1) * 0.5, 0.5)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.tokens).cast("long").alias("train_tokens"),
                        (F.col("log_counts") - F.col("n_tokens") * whole).alias("base_score"), "score")
