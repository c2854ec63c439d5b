"""Nearest vectors by inner product: inverted lists scanned dimension block by dimension block.

Lists are k-means cells fitted on a bounded sample; a query probes the lists whose centres have the largest inner
products with it, as many as the sample needs for the wanted recall.  All vectors are rotated at random, which keeps
inner products and spreads every vector's mass evenly over the dimensions.  Within a probed list the distance is summed
up in column blocks; after each block a candidate is abandoned where its partial distance is larger than a candidate as
near as the worst result so far would have, but for a small error probability (the share of a random vector's mass in
some of its dimensions has a beta distribution).  The rest get their inner product from the original vectors.

Vectors lie in blocks of neighbouring lists, and a task reads a block before the queries that probe it, so it holds one
block and one portion of queries.  The query's best list is scanned first, for a bound; the other lists need to beat it.
Equal vectors are searched once, with the smallest ids of each: a vector that a third of the rows share is one candidate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import row_portions, staged

K = 20
#: Recall that the number of probed lists is chosen for, on the sample; the scan's own errors come on top.
RECALL = 0.97
#: Vectors, at about which number the sample of lists and probes is bounded, and queries among them.
SAMPLE, TRIALS = 16_384, 512
MOST_LISTS = 4096
ROWS_PER_LIST = 64
ROUNDS = 12
#: Column blocks of the scan and the chance that a test abandons a true neighbour.
BLOCKS, ERROR = 4, 1e-5
#: Rows of a block of lists: this share of all, within these bounds.
BLOCK_SHARE, LEAST_BLOCK, MOST_BLOCK = 1 / 64, 2048, 131_072
#: Query and candidate pairs at a time.
PAIRS = 1 << 20
#: A dense product goes on while this share of a list's pairs is alive; then pair by pair.
DENSE = 0.2
SEED = 7


class Lists(NamedTuple):
    centres: np.ndarray
    probes: int
    sample: np.ndarray


class Places(NamedTuple):
    """Where lists lie: first block, number of blocks, number of vectors, by list."""
    first: np.ndarray
    parts: np.ndarray
    size: np.ndarray


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))[0]


@lru_cache(maxsize=16)
def mass_bounds(dim: int) -> tuple[list[int], list[float]]:
    """Ends of the column blocks, and the share of a squared length that lies before each end but for ERROR."""
    ends = sorted({round(dim * (i + 1) / BLOCKS) for i in range(BLOCKS)} - {0})
    shares = []
    for end in ends[:-1]:
        x = (np.arange(200_000) + 0.5) / 200_000
        log = (end / 2 - 1) * np.log(x) + ((dim - end) / 2 - 1) * np.log1p(-x)
        mass = np.cumsum(np.exp(log - log.max()))
        shares.append(float(x[np.searchsorted(mass, (1 - ERROR) * mass[-1])]))
    return ends, shares + [1.0]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cells(x: np.ndarray, n: int) -> np.ndarray:
    """Centres of n k-means cells; an empty cell keeps its centre."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), n, replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        cell = nearest_cell(x, centres)
        count = np.bincount(cell, minlength=n)
        sums = np.stack([np.bincount(cell, weights=x[:, j], minlength=n) for j in range(x.shape[1])], axis=1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest_cell(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(1) / 2
    return np.concatenate([np.argmax(x[i:i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def fit(sample: np.ndarray, total: int, k: int) -> Lists:
    """Lists for `total` vectors, and the probes that find RECALL of the sample's own neighbours of its trial rows."""
    n = int(max(1, min(MOST_LISTS, total ** 0.5, len(sample) // ROWS_PER_LIST)))
    centres = cells(sample, n)
    axis = np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0]
    centres = centres[np.argsort(centres @ axis, kind="stable")]  # similar lists come to lie in the same block
    trial = np.random.default_rng(SEED).permutation(len(sample))[:TRIALS]
    near = np.argpartition(-(sample[trial] @ sample.T), min(k, len(sample) - 1), axis=1)[:, :k + 1]
    rank = np.argsort(np.argsort(-(sample[trial] @ centres.T), axis=1), axis=1)
    needed = np.sort(rank[np.arange(len(trial))[:, None], nearest_cell(sample, centres)[near]].ravel())
    return Lists(centres, int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1, sample)


def assign(batches: Iterable[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in row_portions(batches, 16_384):
        found = nearest_cell(matrix(batch.column("vector")), centres)
        yield batch.append_column("list", pa.array(found.astype(np.int32)))


def probe(batches: Iterable[pa.RecordBatch], lists: Lists, places: Places, k: int) -> Iterator[pa.RecordBatch]:
    """(query_id, vector, block, lists, first, bound): a query's probed lists by block; `first` for the best list of all.

    A query goes on beyond the usual number of probes until its lists hold k + 1 vectors.  Its bound is the k + 1-st best
    product with the sample, which its result can't be worse than."""
    most = np.sqrt((lists.sample ** 2).sum(1).max())
    for batch in row_portions(batches, 256):
        x = matrix(batch.column("vector")).astype(np.float64)
        order = np.argsort(-(x @ lists.centres.T), axis=1, kind="stable")
        bound = np.full(len(x), -np.inf)
        if len(lists.sample) > k:
            bound = np.partition(x @ lists.sample.T, -(k + 1), axis=1)[:, -(k + 1)] - 1e-9 * most * np.sqrt((x ** 2).sum(1))
        held = np.cumsum(places.size[order], axis=1)
        upto = np.maximum(lists.probes, 1 + (held < min(k + 1, held[0, -1] if len(held) else 0)).sum(1))
        filled = places.size[order] > 0
        lead = np.argmax(filled, axis=1)
        row, at = np.nonzero((np.arange(order.shape[1]) < upto[:, None]) & filled)
        chosen = order[row, at]
        copies = places.parts[chosen]
        which = np.repeat(np.arange(len(row)), copies)
        part = np.arange(len(which)) - np.repeat(np.cumsum(copies) - copies, copies)
        row, chosen, first = row[which], chosen[which], (at == lead[row])[which]
        block = places.first[chosen] + part
        turn = np.lexsort((chosen, block, ~first, row))
        row, chosen, first, block = row[turn], chosen[turn], first[turn], block[turn]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1]) | (block[1:] != block[:-1])])[:len(row)])
        ends = np.append(new, len(row)).astype(np.int32)
        rows = batch.select(["query_id", "vector"]).take(pa.array(row[new]))
        yield pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(block[new].astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(chosen.astype(np.int32))), pa.array(first[new]),
             pa.array(bound[row[new]])],
            ["query_id", "vector", "block", "lists", "first", "bound"])


class Block:
    """Candidates of a block of lists, by list."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        lists = rows.column("list").to_numpy()
        turn = np.argsort(lists, kind="stable")
        self.lists, starts = np.unique(lists[turn], return_index=True)
        self.starts = np.append(starts, len(lists))
        self.vectors = matrix(rows.column("vector").combine_chunks())[turn]
        self.ids = rows.column("ids").combine_chunks().take(pa.array(turn))
        self.least = self.ids.flatten().to_numpy()[self.ids.offsets.to_numpy()[:-1] - self.ids.offsets[0].as_py()]
        self.rotated = self.vectors @ rotation(self.vectors.shape[1])
        self.ends, self.shares = mass_bounds(self.vectors.shape[1])
        lows = [0, *self.ends[:-1]]
        self.cuts = [slice(a, b) for a, b in zip(lows, self.ends)]
        self.norms = np.stack([(self.rotated[:, c] ** 2).sum(1) for c in self.cuts])

    def slice_of(self, name: int) -> slice:
        i = int(np.searchsorted(self.lists, name))
        return slice(self.starts[i], self.starts[i + 1]) if i < len(self.lists) and self.lists[i] == name else slice(0, 0)

    def survivors(self, turned: np.ndarray, norms: np.ndarray, bound: np.ndarray, rows: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of query and candidate that may have a product of at least the query's bound, k + 1 a query at most."""
        whole = norms.sum(0)[:, None] + self.norms[:, rows].sum(0)
        with np.errstate(invalid="ignore"):
            reach = whole - 2 * bound[:, None]  # squared distance at which the product equals the bound
        slack = 1e-5 * whole + 1e-12
        x, partial_sum, alive = self.rotated[rows], np.zeros(whole.shape), None
        q = c = None
        for step, cut in enumerate(self.cuts):
            if q is None:
                partial_sum += norms[step][:, None] + self.norms[step, rows] - 2 * (turned[:, cut] @ x[:, cut].T)
                alive = partial_sum <= reach * self.shares[step] + slack
                if step + 1 < len(self.cuts) and np.count_nonzero(alive) < DENSE * alive.size:
                    q, c = np.nonzero(alive)
                    partial_sum, reach, slack = partial_sum[q, c], reach[q, c], slack[q, c]
            else:
                partial_sum += ((turned[q, cut] - x[c, cut]) ** 2).sum(1)
                keep = partial_sum <= reach * self.shares[step] + slack
                q, c, partial_sum, reach, slack = q[keep], c[keep], partial_sum[keep], reach[keep], slack[keep]
        if q is None:
            if alive.shape[1] > k + 1:  # far more than k + 1 of a query can't be among its results
                product = np.where(alive, (whole - partial_sum) / 2, -np.inf)
                alive &= product >= (np.partition(product, -(k + 1), axis=1)[:, -(k + 1)])[:, None] - slack
            q, c = np.nonzero(alive)
        return q, c + rows.start

    def scan(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """The k + 1 best candidates of each query among its lists here that reach its bound."""
        vectors = matrix(queries.column("vector"))
        turned = vectors @ rotation(vectors.shape[1])
        norms = np.stack([(turned[:, c] ** 2).sum(1) for c in self.cuts])
        bound = queries.column("bound").fill_null(-np.inf).to_numpy(zero_copy_only=False)
        names = queries.column("lists")
        row = np.repeat(np.arange(len(names)), np.diff(names.offsets.to_numpy()))
        name = names.flatten().to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for one in np.unique(name):
            rows, who = self.slice_of(one), row[name == one]
            step = max(1, PAIRS // max(1, rows.stop - rows.start))
            for lo in range(0, len(who) if rows.stop > rows.start else 0, step):
                part = who[lo:lo + step]
                q, c = self.survivors(turned[part], norms[:, part], bound[part], rows, k)
                found.append((part[q], c))
        q, c = (np.concatenate(x) for x in zip(*found))
        score = products(vectors, self.vectors, q, c)
        keep = score >= bound[q]
        q, c, score = q[keep], c[keep], score[keep]
        turn = np.lexsort((self.least[c], -score, q))
        q, c, score = q[turn], c[turn], score[turn]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        full = np.full(len(names), np.nan)
        full[q[place == k]] = score[place == k]
        keep = place <= k
        q, c, score = q[keep], c[keep], score[keep]
        return pa.RecordBatch.from_arrays(
            [queries.column("query_id").take(pa.array(q)), pa.array(score), self.ids.take(pa.array(c)), pa.array(full[q], from_pandas=True)],
            ["query_id", "score", "ids", "bound"])


def products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of the components."""
    out = np.zeros(len(i))
    for d in range(a.shape[1]):
        out += a[i, d].astype(np.float64) * b[j, d].astype(np.float64)
    return out


def search(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one or more blocks, candidates before queries: each query's best candidates of its block."""
    current, waiting, block = None, [], None
    for batch in row_portions(batches, 2048):
        blocks, asks = batch.column("block").to_numpy(), batch.column("query_id").is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            run = batch.slice(lo, hi - lo)
            if blocks[lo] != current:
                current, waiting, block = blocks[lo], [], None
            if not asks[lo]:
                waiting.append(run)
            elif waiting or block:
                block, waiting = block or Block(waiting), []
                yield block.scan(run, k)


FOUND = "query_id long, score double, ids array<long>, bound double"


def one_vector_an_id(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with an id and a usable vector; of an id's vectors the least."""
    x = F.col(vector)
    usable = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("vector")).where(F.col("id").isNotNull() & usable)
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): every vector once, with the k + 1 smallest ids that have it."""
    order = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k + 1)
    return few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def sampled(distinct: DataFrame, total: int) -> np.ndarray:
    """About SAMPLE vectors, chosen by their own hash; all if they are fewer."""
    share = min(1.0, SAMPLE / max(1, total))
    rows = distinct.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int(share * (1 << 20))).select("vector").toArrow()
    x = matrix(rows.column("vector").combine_chunks()).astype(np.float64)
    return x[np.lexsort(x.T)] if len(x) else x


def placed(sizes: np.ndarray) -> Places:
    """Runs of lists make a block; a list larger than a block has several of its own."""
    rows = int(min(MOST_BLOCK, max(LEAST_BLOCK, sizes.sum() * BLOCK_SHARE)))
    parts = np.maximum(1, -(-sizes // rows))
    first, block, room = np.zeros(len(sizes), np.int64), 0, rows
    for i, size in enumerate(sizes):
        if size > room and room < rows:
            block, room = block + 1, rows
        first[i] = block
        block, room = (block + int(parts[i]), rows) if parts[i] > 1 else (block, room - size)
    return Places(first, parts, sizes)


def meet(candidates: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """The queries' results within the blocks that they name."""
    spark = candidates.sparkSession
    rows = candidates.unionByName(queries, allowMissingColumns=True)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(blocks, least), "block").sortWithinPartitions("block", F.col("query_id").isNotNull())
    return dealt.mapInArrow(partial(search, k=k), FOUND)


def nearest(vectors: DataFrame, asks: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `asks` holds (a condition on the id), the k rows of other ids
    with the largest inner products; ties go to the smaller id.

    Rows without an id, and vectors that are NULL, empty, zero or hold a NULL or non-finite component, take no part.  An
    id given several times has the least of its vectors.  All vectors that take part must have the same length.  Other
    columns are not read; an empty table gives no rows.
    """
    rows = staged(one_vector_an_id(vectors, key, vector), "vectors")
    distinct = staged(distinct_vectors(rows, k), "distinct")
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total, least, most = distinct.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not total:
        return empty
    if least != most:
        raise ValueError(f"vectors of {least} and of {most} components have no inner product")
    lists = fit(sampled(distinct, total), total, k)
    kind = distinct.schema["vector"].dataType.simpleString()
    assigned = staged(distinct.mapInArrow(partial(assign, centres=lists.centres), f"vector {kind}, ids array<long>, list int"), "listed")
    sizes = np.zeros(len(lists.centres), np.int64)
    for name, n in assigned.groupBy("list").count().collect():  # MOST_LISTS rows at most
        sizes[name] = n
    places = placed(sizes)
    spread = F.array(*[F.struct(F.lit(int(a)).alias("first"), F.lit(int(b)).alias("parts")) for a, b in zip(places.first, places.parts)])
    at = F.get(spread, F.col("list"))
    block = (at["first"] + F.pmod(F.xxhash64("vector"), at["parts"])).cast("int")
    candidates = assigned.select("vector", "ids", "list", block.alias("block"))
    queries = rows.where(asks).select(F.col("id").alias("query_id"), "vector")
    probes = staged(queries.mapInArrow(partial(probe, lists=lists, places=places, k=k),
                                       f"query_id long, vector {kind}, block int, lists array<int>, first boolean, bound double"), "probes")
    blocks = int((places.first + places.parts).max())
    asked = lambda rows: rows.select("query_id", "vector", "block", "lists", "bound")
    near = staged(meet(candidates, asked(probes.where("first")), blocks, k), "near")
    better = near.groupBy("query_id").agg(F.max("bound").alias("better"))
    rest = probes.where("not first").join(better, "query_id", "left").withColumn("bound", F.greatest("bound", "better"))
    found = near.unionByName(meet(candidates, asked(rest), blocks, k)).select("query_id", "score", "ids")
    # of vectors that several ids have, k + 1 are enough for any k of their ids
    by_vector = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("ids")[0])
    few = found.withColumn("turn", F.row_number().over(by_vector)).where(F.col("turn") <= k + 1)
    few = few.select("query_id", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    by_id = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = few.withColumn("rank", F.row_number().over(by_id))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
