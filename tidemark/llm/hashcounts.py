"""Which hashed items occur often enough: counts of all items, back as a bit set of fixed size.

Tasks send sorted keys as gaps, in byte planes, a few bytes for each key; ranges of keys are summed apart.  An item is
live if its bit is set: every item with `least` occurrences is, others only where keys or bits coincide.  The set is
what may be broadcast whatever the input; the fuller it is, the less it sorts out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Items are counted by so many bits of their hash, and the bit set is 16 MB.
KEY_BITS, LIVE_BITS = 36, 27
#: Keys that a task holds before it passes them on.
HELD = 4_000_000


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


def range_bits(n_bytes: int) -> int:
    """Ranges hold the keys of about a megabyte of text each."""
    return int(min(20, max(6, np.ceil(np.log2(max(n_bytes, 1) / (1 << 20))))))


def planes(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def values_of(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(back, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)


def packed(batches: Iterable[pa.RecordBatch], hashes: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """(range, gaps, counts) of the hashes, once or a few times a task."""
    width = KEY_BITS - bits

    def sent(parts):
        key, n = summed(parts)
        name = key >> width
        edges = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(key) else np.zeros(0, np.int64)
        rows = [[], [], []]
        for lo, hi in zip(edges, [*edges[1:], len(key)]):
            rows[0].append(int(name[lo]))
            rows[1].append(planes(np.diff(key[lo:hi], prepend=name[lo] << width)))
            rows[2].append(planes(np.minimum(n[lo:hi], (1 << 32) - 1)))
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["range", "gaps", "counts"])

    parts, held = [], 0
    for found in hashes(batches):
        key, n = np.unique((found >> np.uint64(64 - KEY_BITS)).astype(np.int64), return_counts=True)
        parts.append((key, n))
        held += len(key)
        if held > HELD:
            parts = [summed(parts)]
            held = len(parts[0][0])
            if held > HELD // 2:
                yield sent(parts)
                parts, held = [], 0
    if parts:
        yield sent(parts)


def live_range(rows: pa.Table, bits: int, least: int) -> pa.Table:
    width = KEY_BITS - bits
    gaps, counts = rows.column("gaps").to_pylist(), rows.column("counts").to_pylist()
    key, n = summed([(np.cumsum(values_of(g)), values_of(c)) for g, c in zip(gaps, counts)])
    out = np.zeros(1 << (LIVE_BITS - bits), np.uint8)
    out[key[n >= least] >> (width - (LIVE_BITS - bits))] = 1
    return pa.table({"range": rows.column("range")[:1], "live": pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())})


def live_bits(rows: DataFrame, hashes: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], least: int, n_bytes: int) -> np.ndarray:
    """Bit set over the hashes that `hashes` finds in the rows' batches: those with `least` occurrences are in it."""
    bits = range_bits(n_bytes)
    chunks = rows.mapInArrow(partial(packed, hashes=hashes, bits=bits), "range int, gaps binary, counts binary")

    def one(part: pa.Table) -> pa.Table:
        return live_range(part, bits, least)

    found = chunks.groupBy("range").applyInArrow(one, "range int, live binary").toArrow()
    out = np.zeros((1 << bits, 1 << (LIVE_BITS - bits - 3)), np.uint8)
    for name, live in zip(found.column("range").to_pylist(), found.column("live").to_pylist()):
        out[name] = np.frombuffer(live, np.uint8)
    return out.ravel()


def is_live(live: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes >> np.uint64(64 - LIVE_BITS)
    return (live[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
