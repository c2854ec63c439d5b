"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0).  Expectation-maximisation over the counts of vote patterns
estimates how each rule votes on good and on bad documents; the posterior probability of being good takes
the place of passing every rule.  Patterns number 3 ** rules at most, whatever the number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS

#: Name, signal, bound of a good vote (None: the rule never votes good), bound of a bad vote.
RULES = [
    ("length", "n_words", 80, 50),
    ("stops", "stop_share", 0.1, 0.04),
    ("variety", "variety", 0.6, 0.4),
    ("symbols", "symbol_share", None, 0.03),
    ("repeats", "repeat_share", None, 0.25),
    ("lines", "dup_line_share", None, 0.3),
    ("shouting", "upper_share", None, 0.4),
    ("marks", "mark_share", None, 0.3),
    ("word_length", "mean_length", None, 11.0),
]
#: Signals of which more is better.
RISING = {"n_words", "stop_share", "variety"}
ROUNDS = 12
START = 0.8
#: So many rows of each class are assumed beforehand, half of their votes abstaining and the rest right with START.
PRIOR_ROWS = 1
THRESHOLD = 0.5
#: Frequent short words of English, German, French and Spanish.
STOPS = ["the", "of", "and", "to", "in", "is", "that", "it", "a", "for", "with",
         "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "den", "von", "zu", "mit",
         "le", "la", "les", "des", "et", "est", "un", "une", "dans", "que", "pour",
         "el", "los", "las", "de", "y", "en", "del", "por", "con", "no", "una", "se"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds word, symbol, line and repetition counts of every whole text.

    Words are runs of characters that are not space or ASCII 9 to 13; NULL counts as empty.  A repeated word is one
    within a three-word window that occurs twice or more in its text, the first occurrence included.
    """
    words, windows = F.col("_words"), F.col("_windows")
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({
        "_words": F.filter(F.split(whole, f"[{BLANKS}]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANKS}]")),
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_marks": F.length(F.regexp_replace(whole, r"[^!?;:=~^_+/\\{}\[\]@]+", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(whole, r"\P{Lu}+", "")).cast("long"),
    })
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_distinct": F.size(F.array_distinct("_words")).cast("long"),
        "n_stops": F.size(F.filter("_words", lambda w: w.isin(STOPS))).cast("long"),
        "_windows": F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - 2, F.lit(1))), lambda i: F.xxhash64(
            F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))),
    }).drop("_lines")
    repeats = F.when(F.size("_words") < 4, 0).when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_repeated())
    return out.withColumn("n_repeat_words", repeats.cast("long")).drop("_words", "_windows")


def _repeated() -> Column:
    """Words covered by repeated windows: windows sorted as text with their places, those equal to a neighbour kept,
    then each adds its reach beyond the one before."""
    return F.expr("""
        aggregate(
            array_sort(transform(array(array_sort(transform(sequence(1, size(_words) - 2), i -> struct(
                concat_ws(' ', get(_words, i - 1), get(_words, i), get(_words, i + 1)) AS w, i AS p)))),
                s -> transform(filter(s, (x, k) -> x.w = get(s, k - 1).w OR x.w = get(s, k + 1).w), x -> x.p))[0]),
            struct(0 AS n, 0 AS reach),
            (acc, p) -> struct(acc.n + p + 3 - greatest(p, acc.reach) AS n, p + 3 AS reach),
            acc -> acc.n)""")


def signals(counted: DataFrame) -> DataFrame:
    """Shares that the rules judge; NULL where a text has no words."""
    def share(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
    return counted.withColumns({
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "upper_share": share("n_upper", "word_chars"),
        "variety": F.when(F.col("n_words") > 0, F.col("n_distinct") / F.sqrt("n_words") / 10),
        "mean_length": share("word_chars", "n_words"),
        "mark_share": share("n_marks", "n_words"), "stop_share": share("n_stops", "n_words")})


def vote(signal: str, good: float | None, bad: float) -> Column:
    """1 on the good side, -1 beyond the bad bound, else 0; abstains where the signal is NULL."""
    x = F.col(signal)
    poor = x < bad if signal in RISING else x > bad
    fine = F.lit(False) if good is None else x >= good if signal in RISING else x <= good
    return F.when(poor, -1).when(fine, 1).otherwise(0)


def with_votes(measured_rows: DataFrame, rules=RULES) -> DataFrame:
    return measured_rows.withColumns({f"vote_{name}": vote(signal, good, bad) for name, signal, good, bad in rules})


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS, start: float = START, prior: float = PRIOR_ROWS):
    """(log odds of good, per rule {vote: log likelihood ratio}) from vote patterns and their row counts.

    Two classes with votes independent within each; a rule starts as right with probability `start`, so that class
    `good` is the one that most rules vote for.  No rows give even odds and no rules.
    """
    k = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    assumed = {1: (start / 2, (1 - start) / 2), 0: (0.5, 0.5), -1: ((1 - start) / 2, start / 2)}
    odds = 0.0
    ratio = [{v: math.log(g / b) for v, (g, b) in assumed.items()} for _ in range(k)]
    for _ in range(rounds if total else 0):
        good = [1 / (1 + math.exp(-(odds + sum(ratio[j][v] for j, v in enumerate(votes))))) for votes, _ in patterns]
        n_good = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        n_bad = total - n_good
        odds = math.log((n_good + prior) / (n_bad + prior))
        for j in range(k):
            for v, (in_good, in_bad) in assumed.items():
                g = prior * in_good + sum(p * n for p, (votes, n) in zip(good, patterns, strict=True) if votes[j] == v)
                b = prior * in_bad + sum((1 - p) * n for p, (votes, n) in zip(good, patterns, strict=True) if votes[j] == v)
                ratio[j][v] = math.log(g / (n_good + prior)) - math.log(b / (n_bad + prior))
    return odds, ratio


def posterior(odds: float, ratio: list[dict[int, float]], rules=RULES) -> Column:
    logit = F.lit(odds)
    for (name, *_), r in zip(rules, ratio, strict=True):
        v = F.col(f"vote_{name}")
        logit = logit + F.when(v == 1, F.lit(r[1])).when(v == -1, F.lit(r[-1])).otherwise(F.lit(r[0]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def judge(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, rules=RULES, store=None) -> DataFrame:
    """The counts of `measured`, votes, base_failed, quality (posterior of being good) and kept, for every row.

    base_failed: under 50 words, or over half of the words repeated.  kept: not base_failed and quality at least
    the threshold.  A NULL or empty text fails the base.  Equal texts get equal results.
    store: called with the measured rows, which are read twice (pattern counts, result); should return a stored copy.
    """
    base = measured(docs, text)
    votes = with_votes(signals(store(base) if store else base), rules)
    names = [f"vote_{r[0]}" for r in rules]
    patterns = [(tuple(row[:-1]), row[-1]) for row in votes.groupBy(*names).count().orderBy(*names).collect()]  # 3 ** rules at most
    odds, ratio = estimate(patterns)
    if not patterns:
        ratio = [{1: 0.0, 0: 0.0, -1: 0.0} for _ in rules]
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = votes.withColumns({"base_failed": failed, "quality": posterior(odds, ratio, rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
