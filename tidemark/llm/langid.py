"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts per language over all labelled rows, combined per task before the shuffle, into a
matrix of languages x buckets, whose size does not depend on the corpus.  Its log probabilities are broadcast;
texts are scored in batches: n-gram buckets of a slice of texts select matrix rows, which are summed per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, portions

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SMOOTHING = 0.5
SLICE = 1 << 19
#: Allowance below a language's usual score per n-gram, in standard deviations; calibration rows that the common deviation of
#: all languages counts for beside a language's own.
DEVIATIONS = 6.0
COMMON_ROWS = 5
UNKNOWN = "und"

MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]
SPACE = np.uint32(32)


def _letters() -> np.ndarray:
    """Lower-case form of each letter of the basic plane, else a space; beyond it every character stays."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


class Grams:
    """Hashed n-gram buckets of texts, by slices of bounded size."""

    def __init__(self, orders=ORDERS, buckets: int = BUCKETS):
        self.orders, self.buckets, self.table = tuple(orders), buckets, _letters()

    def slices(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
        """(text numbers, start of each text in every order, buckets of every order); a long text comes in several slices."""
        numbers, parts, held = [], [], 0
        reach = max(self.orders) - 1
        for k, text in enumerate(texts):
            for at in range(0, len(text), SLICE):
                part = text[max(0, at - reach):at + SLICE] if at else " " + text[:SLICE]
                if at + SLICE >= len(text):
                    part += " "
                numbers.append(k)
                parts.append(part)
                held += len(part)
                if held >= SLICE:
                    yield self.hashed(numbers, parts)
                    numbers, parts, held = [], [], 0
        if parts:
            yield self.hashed(numbers, parts)

    def hashed(self, numbers: list[int], parts: list[str]):
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 0x10000, self.table[np.minimum(codes, 0xFFFF)], codes)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        begin = np.cumsum(sizes) - sizes
        starts, buckets = [], []
        for n in self.orders:
            value = np.zeros(max(0, len(codes) - n + 1), np.uint32)
            for i in range(n):
                value = (value ^ codes[i:len(codes) - n + 1 + i]) * MIX[i]
                value ^= value >> np.uint32(15)
            fits = np.maximum(sizes - n + 1, 0)
            if (sizes >= n).all() and n == 1:
                inside = None
            else:
                inside = np.ones(len(value), bool)
                for back in range(1, n):
                    cut = begin[1:] - back
                    inside[cut[(cut >= 0) & (cut < len(value))]] = False
            value = (value + np.uint32(n)) % np.uint32(self.buckets)
            buckets.append(value if inside is None else value[inside])
            starts.append(np.cumsum(fits) - fits)
        return np.asarray(numbers), starts, buckets


def train(labelled: DataFrame, text: str = "text", label: str = "lang", orders=ORDERS, buckets: int = BUCKETS, smoothing: float = SMOOTHING):
    """(languages, log prior, log probabilities as buckets x languages) from all rows whose label is not NULL.

    NULL and empty texts count for the prior only.  No labelled row gives no language.  The matrix that reaches the
    driver has languages x buckets counts at most, whatever the number of rows.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label")).where("label IS NOT NULL")
    grams = Grams(orders, buckets)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in portions(batches, "text", 1 << 20):
            texts, labels = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            for lang in set(labels):
                own = [t for t, x in zip(texts, labels, strict=True) if x == lang]
                docs[lang] = docs.get(lang, 0) + len(own)
                total = sums.setdefault(lang, np.zeros(buckets, np.int64))
                for _, _, found in grams.slices(own):
                    for f in found:
                        total += np.bincount(f, minlength=buckets)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(total[at], docs[lang]))],
                                             names=["label", "bucket", "n"])

    summed = rows.mapInArrow(count, "label string, bucket bigint, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    found = summed.toPandas()  # at most languages x (buckets + 1) rows
    languages = sorted(found["label"].unique())
    counts = np.zeros((buckets, len(languages)))
    docs = np.zeros(len(languages))
    for k, lang in enumerate(languages):
        own = found[found["label"] == lang]
        docs[k] = own.loc[own["bucket"] < 0, "n"].sum()
        own = own[own["bucket"] >= 0]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    logs = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * buckets)
    prior = np.log(docs / docs.sum()) if len(languages) else docs
    return languages, prior, logs


def predict(docs: DataFrame, model, text: str = "text", prediction: str = "lang_pred", score: str = "score",
            orders=ORDERS, fit: str | None = None) -> DataFrame:
    """Adds the most probable language and its posterior probability, from the whole text alone.

    The posterior compares the known languages only, and nears 1 with the length of any text.  `fit` names a column more, for
    the mean log probability of the text's n-grams in that language, which does not, and `fit`_n for their number.

    NULL, and texts without a letter: `und` with score 0; so is every text if the model knows no language.
    Equal posteriors go to the first language by name.  Former columns of these names are replaced.
    """
    languages, prior, logs = model
    docs = docs.drop(prediction, score, *([fit, f"{fit}_n"] if fit else []))
    more = {fit: F.lit(0.0), f"{fit}_n": F.lit(0).cast("long")} if fit else {}
    schema = docs.withColumns({prediction: F.lit("").cast("string"), score: F.lit(0.0)} | more).schema
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))  # languages x buckets
    grams = Grams(orders, logs.shape[0])

    def run(batches):
        weights = shared.value
        for batch in portions(batches, text, 1 << 20):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            total = np.tile(prior, (len(texts), 1))
            size = np.zeros(len(texts), np.int64)
            for numbers, starts, found in grams.slices(texts) if languages else ():
                for begin, buckets in zip(starts, found, strict=True):
                    each = np.diff(np.append(begin, len(buckets)))
                    some = each > 0
                    np.add.at(size, numbers, each)
                    if some.any():
                        for k in range(len(languages)):
                            np.add.at(total[:, k], numbers[some], np.add.reduceat(weights[k][buckets], begin[some]))
            known = np.fromiter((bool(languages) and any(map(str.isalpha, t)) for t in texts), bool, len(texts))
            best = total.argmax(axis=1) if languages else np.zeros(len(texts), np.int64)
            sure = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1) if languages else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                 pa.array(np.where(known, sure, 0.0)), *([pa.array(usual(total, best, size)), pa.array(size)] if fit else [])], names=names)

    def usual(total, best, size):
        if not languages:
            return np.zeros(len(size))
        return (total[np.arange(len(best)), best] - prior[best]) / np.maximum(size, 1)
    return docs.mapInArrow(run, schema)


def calibrate(labelled: DataFrame, model, text: str = "text", label: str = "lang", orders=ORDERS) -> dict[str, tuple[float, float, float]]:
    """language: (usual mean log probability of a text's n-grams, its deviation between texts, variance of one n-gram).

    From labelled rows that the model has not learned from: quartiles of the rows that it gives their own label, so that a
    few rows of noise do not widen them.  A language's deviation is drawn towards that of all languages, the more so the fewer
    rows it has; one without rows has the lowest middle of the others.  Without any row there are no bounds.  One row for each
    language reaches the driver.
    """
    languages, _, logs = model
    found = predict(labelled.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("label")), model, orders=orders, fit="fit")
    rows = found.where("lang_pred = label").groupBy("label").agg(F.count("*").alias("n"), F.percentile_approx("fit", [0.25, 0.5, 0.75], 100_000).alias("q")).collect()
    share = np.exp(logs)
    one = ((share * logs ** 2).sum(axis=0) - (share * logs).sum(axis=0) ** 2).tolist()
    if not rows:
        return {}
    spread = {r.label: (r.q[2] - r.q[0]) / 1.349 for r in rows}
    common = sum(r.n * spread[r.label] for r in rows) / sum(r.n for r in rows)
    own = {r.label: (r.q[1], (r.n * spread[r.label] + COMMON_ROWS * common) / (r.n + COMMON_ROWS)) for r in rows}
    other = min(m for m, _ in own.values()), max(common, *[d for _, d in own.values()])
    return {lang: (*own.get(lang, other), one[k]) for k, lang in enumerate(languages)}


def fits(bounds: dict[str, tuple[float, float, float]], prediction: str = "lang_pred", fit: str = "fit", orders=ORDERS, deviations: float = DEVIATIONS) -> Column:
    """Whether a text's n-grams are as probable as those of its predicted language usually are; short texts have more play."""
    out = F.lit(True)
    for lang, (middle, spread, one) in bounds.items():
        # every character is in one n-gram of each order, and these vary together
        play = deviations * F.sqrt(F.lit(spread ** 2) + F.lit(len(orders) * one) / F.greatest(F.col(f"{fit}_n"), F.lit(1)))
        out = F.when(F.col(prediction) == lang, F.col(fit) >= F.lit(middle) - play).otherwise(out)
    return out


def held_out(key: str | Column = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True for rows of the test fold by crc32 of the key's text; false for a NULL key."""
    return F.coalesce(crc_mod(key, folds) == fold, F.lit(False))
