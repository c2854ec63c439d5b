"""Media columns: ISO base media files, written from payloads and described by walking their boxes.

A file is a run of nested boxes (size, four-character type, body).  The sample tables of a track say where
each sample lies, how long it lasts and which samples are keyframes, so codec, duration and keyframe byte
ranges come from the header boxes alone; sample bytes are never decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import portions, utf8

#: Boxes whose body is a run of boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex"}
SAMPLE_BYTES = 64
SAMPLES_PER_CHUNK = 1024
TIMESCALE = 8000
IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

_RANGES = "array<struct<offset:bigint,length:bigint>>"
_TRACK = f"codec:string,handler:string,timescale:bigint,duration:bigint,n_samples:bigint,n_keyframes:bigint,keyframes:{_RANGES}"
FACTS = f"struct<{_TRACK},samples:{_RANGES},tracks:array<struct<{_TRACK}>>,error:string>"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def write_container(payload: bytes) -> bytes:
    """One audio track of 8-bit PCM (`ipcm`): samples of 64 bytes, chunks of 1024 samples, each chunk's first a keyframe.

    payload: a positive multiple of 64 bytes, stored unchanged in `mdat`.
    """
    if not payload or len(payload) % SAMPLE_BYTES:
        raise ValueError(f"payload must be a positive multiple of {SAMPLE_BYTES} bytes")
    n = len(payload) // SAMPLE_BYTES
    chunks = -(-n // SAMPLES_PER_CHUNK)
    last = n - (chunks - 1) * SAMPLES_PER_CHUNK
    duration = len(payload)
    runs = [(1, SAMPLES_PER_CHUNK if chunks > 1 else last)] + ([(chunks, last)] if chunks > 1 and last < SAMPLES_PER_CHUNK else [])
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0), b"isom", b"iso2")
    entry = box(b"ipcm", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16),
                full_box(b"pcmC", struct.pack(">BB", 0, 8)))

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * (SAMPLES_PER_CHUNK * SAMPLE_BYTES)
        wide = int(offsets[-1]) >= 1 << 32
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, SAMPLE_BYTES)),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, per, 1) for at, per in runs)),
            full_box(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
            full_box(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks) * SAMPLES_PER_CHUNK).astype(">u4").tobytes()),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()))
        minf = box(b"minf", full_box(b"smhd", bytes(4)),
                   box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)),
                   full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration), bytes(8),
                        struct.pack(">hhhh", 0, 0, 0x100, 0), IDENTITY, bytes(8), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10),
                        IDENTITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = ftyp + moov(len(ftyp) + len(moov(0)) + 8)
    return b"".join((head, struct.pack(">I", len(payload) + 8), b"mdat", payload))


def walk(data: memoryview, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of types, body start, body end) of every box, outer before inner.  Raises ValueError on a broken size."""
    while start < end:
        if end - start < 8:
            raise ValueError("cut box header")
        size, kind, head = int.from_bytes(data[start:start + 4], "big"), bytes(data[start + 4:start + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8:start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind.decode('latin-1')} reaches past its parent")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def _table(data: memoryview, lo: int, hi: int, kind: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    """The counted table of a full box."""
    n = int.from_bytes(data[lo + skip:lo + skip + 4], "big")
    need = n * columns * int(kind[-1])
    if lo + skip + 4 + need > hi:
        raise ValueError("cut table")
    return np.frombuffer(data, kind, n * columns, lo + skip + 4).astype(np.int64).reshape(n, columns)


def _track(data: memoryview, track: dict[bytes, tuple[int, int]]) -> dict:
    """Facts of a track from the places of its boxes."""
    out: dict = {"handler": None}
    lo, _ = track[b"mdhd"]
    out["timescale"], out["duration"] = struct.unpack_from(">IQ" if data[lo] == 1 else ">II", data, lo + (20 if data[lo] == 1 else 12))
    if b"hdlr" in track:
        out["handler"] = bytes(data[track[b"hdlr"][0] + 8:track[b"hdlr"][0] + 12]).decode("latin-1")
    out["codec"] = bytes(data[track[b"stsd"][0] + 12:track[b"stsd"][0] + 16]).decode("latin-1")
    lo, hi = track[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, lo + 4)
    sizes = np.full(n, fixed, np.int64) if fixed else _table(data, lo, hi, ">u4", skip=8)[:, 0]
    wide = b"co64" in track
    chunk_at = _table(data, *track[b"co64" if wide else b"stco"], ">u8" if wide else ">u4")[:, 0]
    runs = _table(data, *track[b"stsc"], ">u4", 3)
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk_at) + 1)))
    if per_chunk.sum() != n:
        raise ValueError("sample tables disagree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offsets = before + np.repeat(chunk_at - before[first], per_chunk) if n else before
    if n and (offsets[-1] + sizes[-1] > len(data)):
        raise ValueError("samples reach past the file")
    keys = _table(data, *track[b"stss"], ">u4")[:, 0] - 1 if b"stss" in track else np.arange(n)
    joined = np.flatnonzero(np.append(True, offsets[1:] != offsets[:-1] + sizes[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(joined[1:], n) - 1 if n else joined
    return out | {"n_samples": int(n), "n_keyframes": len(keys),
                  "keyframes": [{"offset": int(offsets[k]), "length": int(sizes[k])} for k in keys],
                  "samples": [{"offset": int(offsets[a]), "length": int(offsets[b] + sizes[b] - offsets[a])} for a, b in zip(joined, ends, strict=True)]}


TRACK = ("codec", "handler", "timescale", "duration", "n_samples", "n_keyframes", "keyframes", "samples")


def describe(media: bytes) -> dict:
    """Facts of the first track with samples, and in `tracks` those of all such tracks but their sample runs; `error` says
    why a file can't be read (the rest is then NULL).  Files in fragments, whose samples are not in the tables, are such."""
    out: dict = dict.fromkeys((*TRACK, "tracks", "error"))
    try:
        data, tracks = memoryview(media), []
        for path, lo, hi in walk(data, 0, len(data)):
            if path[-1] == b"moof":
                raise ValueError("fragments (moof) are not read")
            if path[-1] == b"trak":
                tracks.append({})
            elif tracks and b"trak" in path:
                tracks[-1].setdefault(path[-1], (lo, hi))
        found = [_track(data, t) for t in tracks if {b"mdhd", b"stsd", b"stts", b"stsc"} <= t.keys()]
        if not found:
            raise ValueError("no track with sample tables")
        return out | found[0] | {"tracks": [{k: v for k, v in t.items() if k != "samples"} for t in found]}
    except (ValueError, KeyError, IndexError, struct.error) as fault:
        return out | {"error": str(fault) or type(fault).__name__}


def payload_of(text: str | Column, unit: int = SAMPLE_BYTES) -> Column:
    """UTF-8 bytes of a text with zero bytes up to a positive multiple of unit; NULL counts as empty."""
    data = utf8(text)
    size = F.octet_length(data)
    padded = F.greatest(F.ceil(size / F.lit(unit)), F.lit(1)) * F.lit(unit)
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), (padded - size).cast("int"))))


def store(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Adds a column with the file that holds each payload (NULL for a NULL payload), in place of one of that name."""
    df = df.drop(media)
    schema = df.withColumn(media, F.lit(None).cast("binary")).schema

    def run(batches):
        for batch in portions(batches, payload):
            made = [None if p is None else write_container(p) for p in batch.column(payload).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, media])
    return df.mapInArrow(run, schema)


def media_columns(df: DataFrame, media: str = "media", column: str = "facts") -> DataFrame:
    """Adds a struct column of what the boxes say: codec, handler, timescale, duration, counts, keyframe byte ranges,
    and the byte runs that samples fill, of the first track with samples; `tracks` lists all.

    A NULL, empty, cut or foreign file gives a struct whose `error` is set and whose other fields are NULL.
    Other columns, whatever their names, are carried along; a former column of that name is replaced.
    """
    df = df.drop(column)
    schema = df.select("*", F.lit(None).cast(FACTS).alias(column)).schema
    span = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    facts = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()),
                       ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", span), ("samples", span)])
    facts = pa.struct([*facts, ("tracks", pa.list_(pa.struct([f for f in facts if f.name != "samples"]))), ("error", pa.string())])

    def run(batches):
        for batch in portions(batches, media):
            found = [describe(m or b"") for m in batch.column(media).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, facts)], names=[*batch.schema.names, column])
    return df.mapInArrow(run, schema)


def sample_bytes(media: str | Column, facts: str | Column) -> Column:
    """The sample bytes of a described file, in order, read back from their byte runs."""
    media, facts = (F.col(c) if isinstance(c, str) else c for c in (media, facts))
    runs = F.transform(facts["samples"], lambda r: F.hex(F.substring(media, (r["offset"] + 1).cast("int"), r["length"].cast("int"))))
    return F.when(F.size(facts["samples"]) == 1, F.substring(media, (facts["samples"][0]["offset"] + 1).cast("int"),
                                                             facts["samples"][0]["length"].cast("int"))).otherwise(F.unhex(F.array_join(runs, "")))
