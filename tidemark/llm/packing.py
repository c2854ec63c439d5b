"""Best-fit packing: token pieces of documents into fixed-length training sequences.

The packer works on the histogram of piece lengths, which has at most `capacity` entries however large the
corpus is.  It fills one bin greedily from the longest length that still fits, then replaces the bin's smallest
piece with two unpacked pieces that fill the widened gap more tightly, as often as that helps.  The finished
bin is repeated as long as all its lengths last, so a few thousand bin patterns describe all sequences.
Pieces find their place by their rank within their length.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import ship
from tidemark.llm.common import portions, staged

CAPACITY = 4096
END_ID = 1
#: Parts kept with their ids in a worker; the memo starts anew beyond it (speed only).
MEMO_PARTS = 600_000
#: Bytes of text that are split at a time, and the most of one slice of a text.
AT_ONCE, SLICE = 4 << 20, 4 << 20
ROWS_PER_CHUNK = 20_000

BLANK, LETTER, DIGIT, OTHER, WHOLE = range(5)
_CODES = np.arange(256)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each character below 256 by the tokenizer's split, and its lower case; characters that are blanks or
    control characters to the tokenizer, but for space and line feed, make their word one that is not split."""
    kind = np.full(256, OTHER, np.uint8)
    lower = _CODES.copy()
    for c in _CODES:
        ch = chr(c)
        if ch.isalpha():
            kind[c], lower[c] = LETTER, ord(ch.lower())
        elif ch.isnumeric():
            kind[c] = DIGIT
    kind[(_CODES < 33) | ((_CODES > 126) & (_CODES < 161))] = WHOLE
    kind[[10, 32]] = BLANK
    return kind, lower.astype(np.uint8)


KIND, LOWER = _classes()


def split_parts(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Parts of all texts in order, lower-cased, and how many each text has.

    A part is a contraction's ending, a run of letters, one digit or a run of other characters; a word with characters
    beyond Latin-1, control characters or unusual blanks is one part as it stands.
    """
    data = np.frombuffer(b" ".join(texts) + b"  ", np.uint8).copy()
    ends = np.cumsum([len(t) + 1 for t in texts])
    lead = (data == 0xC2) | (data == 0xC3)
    tail = np.concatenate([[False], lead[:-1]])
    code = np.where(tail, (data & 0x3F) + np.where(np.roll(data, 1) == 0xC3, 192, 128), data).astype(np.uint8)
    kind = KIND[code]
    first = np.flatnonzero(lead)
    kind[first] = kind[first + 1]
    kind[~lead & ~tail & (data >= 0x80)] = WHOLE
    blank = kind == BLANK
    odd = np.flatnonzero(kind == WHOLE)
    if len(odd):
        word = np.cumsum(blank)
        kind[np.isin(word, np.unique(word[odd])) & ~blank] = WHOLE
    split = ~blank & (kind != WHOLE)
    low = np.where(split & ~lead, LOWER[code], code)
    data = np.where(split & tail, 0x80 | (low & 0x3F), np.where(split & ~lead, low, data)).astype(np.uint8)
    new = ~blank & ((kind != np.concatenate([[BLANK], kind[:-1]])) | ((kind == DIGIT) & ~tail))
    mark = np.flatnonzero(new & split & (data == 39))
    one, two = data[mark + 1], data[np.minimum(mark + 2, len(data) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    # an ending belongs to its apostrophe, and what follows it is a part of its own
    joined = short | long
    new[mark[joined] + 1] = False
    after = mark[joined] + np.where(short, 2, 3)[joined]
    new[after] = ~blank[after]
    start = np.flatnonzero(new)
    keep = data[~blank]
    offset = np.append(np.cumsum(~blank)[start] - 1, len(keep)).astype(np.int32)
    parts = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offset), pa.py_buffer(keep)])
    return parts, np.diff(np.searchsorted(start, ends), prepend=0)


class WordIds:
    """Ids of a tokenizer whose words end at blanks: each distinct part is encoded once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}

    def learn(self, parts: list[bytes]) -> None:
        """Ids of parts, many to a text; each ends with its first id that ends a word.  A part that the tokenizer may
        split or change is a text of its own."""
        plain = [p for p in parts if not ODD(p)]
        for lo in range(0, len(plain), 6400):
            some = plain[lo:lo + 6400]
            lines = [some[k:k + 64] for k in range(0, len(some), 64)]
            for line, e in zip(lines, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False), strict=True):
                ids = np.asarray(e.ids, "<u4")
                stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
                data, at = ids.tobytes(), 0
                for part, stop in zip(line, stops, strict=True):
                    self.memo[part] = data[at:stop]
                    at = stop
        odd = [p for p in parts if ODD(p)]
        for lo in range(0, len(odd), 1000):
            some = odd[lo:lo + 1000]
            for part, e in zip(some, self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False), strict=True):
                self.memo[part] = np.asarray(e.ids, "<u4").tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        parts, n = split_parts(texts)
        names = parts.dictionary_encode()
        words = names.dictionary.to_pylist()
        fresh = [w for w in words if w not in self.memo]
        if len(self.memo) + len(fresh) > MEMO_PARTS:
            self.memo.clear()
            fresh = words
        self.learn(fresh)
        found = [self.memo[w] for w in words]
        flat, size = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        code = names.indices.to_numpy()
        many = size[code]
        to = np.concatenate([[0], np.cumsum(many)])
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - to[:-1], many) + np.arange(to[-1])]
        edges = to[np.concatenate([[0], np.cumsum(n)])]
        return [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[list[bytes]] = [[] for _ in texts]
        pending: list[tuple[int, bytes]] = []
        held = 0

        def flush():
            for (k, _), ids in zip(pending, self.encode([t for _, t in pending]), strict=True):
                out[k].append(ids)
            pending.clear()

        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = self.cut(text, at)
                pending.append((k, text[at:end]))
                held += end - at
                at = end
                if held >= AT_ONCE:
                    flush()
                    held = 0
        if pending:
            flush()
        return [b"".join(parts) for parts in out]

    @staticmethod
    def cut(text: bytes, at: int) -> int:
        """End of the next slice: at a blank, so that no word is cut."""
        if len(text) - at <= SLICE:
            return len(text)
        end = text.rfind(b" ", at + 1, at + SLICE)
        end = end if end > 0 else text.find(b" ", at + SLICE)
        return end if end > 0 else len(text)


#: Bytes that only parts hold which are not split: control characters, and leads of characters up to U+00A0 or beyond U+00FF.
ODD = re.compile(rb"[\x00-\x20\x7F]|\xC2[\x80-\xA0]|[\xC4-\xFF]").search


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordIds(path)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids array<int>"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Ids of every document (text, then end_id), cut every `capacity` ids: doc_id, piece, start, length, ids_crc32[, ids].

    NULL text counts as empty and gives one piece with end_id alone.  Repeated rows give repeated pieces.  Only
    doc_id and text are read, so other columns may have any names.  The tokenizer must end words at blanks.
    """
    name = ship(docs.sparkSession, tokenizer_path)
    schema = PIECES if with_ids else PIECES.rpartition(", ids ")[0]
    closing = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        own = word_ids(SparkFiles.get(name))
        for batch in portions(batches, "text", 8 << 20):
            rows = []
            for doc_id, made in zip(batch.column(0).to_pylist(), own([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]), strict=True):
                made += closing
                for k, at in enumerate(range(0, len(made), 4 * capacity)):
                    part = made[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            columns = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Pattern(NamedTuple):
    lengths: list[int]  # of one bin, longest first
    bins: int


def best_two_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Bin patterns that use up counts[length] pieces of each length 1 to capacity."""
    left = np.asarray(counts, np.int64).copy()
    out: list[Pattern] = []
    while left.any():
        free, chosen, gap = left.copy(), [], capacity
        while gap > 0 and (fits := np.flatnonzero(free[1:gap + 1])).size:
            longest = int(fits[-1]) + 1
            times = min(int(free[longest]), gap // longest)
            chosen += [longest] * times
            free[longest] -= times
            gap -= longest * times
        while gap and chosen:
            wide = gap + chosen[-1]
            pair = _best_pair(free, wide)
            if pair is None or sum(pair) <= chosen[-1]:
                break
            gap = wide - sum(pair)
            free[chosen.pop()] += 1
            for x in pair:
                free[x] -= 1
            chosen = sorted([*chosen, *pair], reverse=True)
        used = np.bincount(chosen, minlength=len(left))
        bins = int((left[used > 0] // used[used > 0]).min())
        left -= bins * used
        out.append(Pattern(chosen, bins))
    return out


def _best_pair(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two free lengths with the largest sum within room; of equal sums the one with the longest piece."""
    if room < 2:
        return None
    at = np.arange(room + 1)
    below = np.maximum.accumulate(np.where(free[:room + 1] > 0, at, 0))
    long = at[1:][free[1:room + 1] > 0]
    short = below[np.minimum(room - long, long)]
    twice = (short == long) & (free[long] < 2)
    if twice.any():
        short[twice] = below[long[twice] - 1]
    ok = short > 0
    if not ok.any():
        return None
    best = np.lexsort((long[ok], long[ok] + short[ok]))[-1]
    return int(long[ok][best]), int(short[ok][best])


def places(patterns: list[Pattern]) -> pd.DataFrame:
    """For each pattern and length: the ranks it takes, the first sequence, pieces of that length per bin, first offset."""
    rows, taken, sequence = [], {}, 0
    for lengths, bins in patterns:
        offset = 0
        for length, per_bin in sorted(pd.Series(lengths).value_counts().items(), reverse=True):
            rank = taken.get(length, 0)
            rows.append((length, rank, sequence, per_bin, offset))
            taken[length] = rank + per_bin * bins
            offset += length * per_bin
        sequence += bins
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "per_bin", "offset"]).astype("int64").sort_values(["length", "rank"])


def with_rank(df: DataFrame, group: str, order: list[str], rank: str, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rank from 0 within each group, in no fixed order: a group is dealt by hash into chunks of bounded size, each
    ranked alone after the counts of the chunks before it, so that a hot group has many tasks."""
    chunks = max(1, -(-df.count() // rows_per_chunk))
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    counts = (dealt.groupBy(group, "_chunk").agg(F.count("*").alias("_n"))
              .select(group, "_chunk", F.coalesce(before, F.lit(0)).alias("_before")))
    within = F.row_number().over(Window.partitionBy(group, "_chunk").orderBy(*order))
    return dealt.join(counts, [group, "_chunk"]).withColumn(rank, F.col("_before") + within - 1).drop("_chunk", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id (from 0, dense) and offset (gapless from 0 within a sequence) to pieces of 1 to capacity tokens.

    pieces: a stored table (it is read three times) with doc_id, piece, length.  An empty table gives an empty one;
    equal rows get different places.  Lengths out of range raise ValueError.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        if length is None or not 1 <= length <= capacity:
            raise ValueError(f"piece length {length} is not within 1 and {capacity}")
        counts[length] = n
    table = places(best_two_fit(counts, capacity))
    keys = (table["length"].to_numpy() << 48) + table["rank"].to_numpy()
    first, base, per_bin, offset = (table[c].to_numpy() for c in ("rank", "sequence", "per_bin", "offset"))
    plan = pieces.sparkSession.sparkContext.broadcast((keys, first, base, per_bin, offset))  # at most patterns x lengths rows

    def run(frames):
        keys, first, base, per_bin, offset = plan.value
        for f in frames:
            length, rank = f["length"].to_numpy(), f.pop("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            turn = rank - first[at]
            yield f.assign(sequence_id=base[at] + turn // per_bin[at], offset=offset[at] + turn % per_bin[at] * length)

    ranked = with_rank(pieces.drop("sequence_id", "offset", "_rank"), "length", ["doc_id", "piece"], "_rank")
    schema = ranked.drop("_rank").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(staged(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
