"""Three-class models on bars and out-of-fold probability tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.models.splits import split_fold
from tidemark.operators.metrics import average_precision, mcc
from tidemark.operators.momentum import systematic_sample
from tidemark.operators.ranks import exact_quantiles, global_rank
from tidemark.operators.schema import MODEL_FEATURES
from tidemark.session import stage

CLASSES = ("LONG", "SHORT", "NO_TRADE")
PROBS = ("prob_long", "prob_short", "prob_no_trade")

Fit = Callable[[DataFrame, list[str]], Callable[[DataFrame], DataFrame]]


def class_index(label: str | Column) -> Column:
    """LONG 0, SHORT 1, NO_TRADE 2."""
    c = F.col(label) if isinstance(label, str) else label
    return reduce(lambda acc, i: acc.when(c == CLASSES[i], float(i)), range(1, 3), F.when(c == CLASSES[0], 0.0))


def training_rows(bars: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Labelled rows with all features, class index and balanced weights n / (classes x n_class)."""
    rows = bars.dropna(subset=[label, *features]).withColumn("y", class_index(label))
    counts = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"))  # three rows
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    weights = counts.crossJoin(total).select("y", (F.col("total") / (F.col("k") * F.col("n"))).alias("w"))
    return rows.join(F.broadcast(weights), "y")


def _filled(df: DataFrame, features: list[str]) -> DataFrame:
    present = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) if f in df.columns else F.lit(0.0).alias(f)
               for f in features]
    others = [c for c in df.columns if c not in features]
    return df.select(*others, *present)


def _score_pipeline(model: PipelineModel, features: list[str]) -> Callable[[DataFrame], DataFrame]:
    def score(df: DataFrame) -> DataFrame:
        p = vector_to_array("probability")
        # a class absent from the training rows has no slot and scores 0
        slot = lambda i: F.coalesce(F.get(p, F.lit(i)), F.lit(0.0))
        out = model.transform(_filled(df, features))
        return out.withColumns({n: slot(i) for i, n in enumerate(PROBS)}).drop(
            "raw", "features", "rawPrediction", "probability", "prediction")
    return score


def classes_of(train: DataFrame) -> list[float]:
    """The class indices that training rows hold, three at most."""
    return sorted(row["y"] for row in train.select("y").distinct().toLocalIterator())


def known_class(classes: list[float], features: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Scores where there is nothing to tell apart: 1 for the only class; with no training rows, the same for each class."""
    share = lambda i: 1.0 / len(CLASSES) if not classes else float(float(i) in classes)

    def score(df: DataFrame) -> DataFrame:
        return _filled(df, features).withColumns({n: F.lit(share(i)) for i, n in enumerate(PROBS)})
    score.rounds = dict.fromkeys(CLASSES, 0)
    return score


def _fit(classifier, scale: bool) -> Fit:
    def fit(train: DataFrame, features: list[str]):
        if len(classes := classes_of(train)) < 2:
            return known_class(classes, features)
        stages = [VectorAssembler(inputCols=features, outputCol="raw" if scale else "features", handleInvalid="skip")]
        if scale:
            stages.append(RobustScaler(inputCol="raw", outputCol="features", withCentering=True))
        model = Pipeline(stages=[*stages, classifier.copy()]).fit(train)
        return _score_pipeline(model, features)
    return fit


def logistic(l1: bool = False, max_iter: int = 100, reg: float = 1e-4) -> Fit:
    return _fit(LogisticRegression(labelCol="y", weightCol="w", family="multinomial", maxIter=max_iter,
                                   regParam=reg, elasticNetParam=1.0 if l1 else 0.0), scale=True)


def forest(trees: int = 100, depth: int = 10, min_leaf: int = 20, every: int = 5, seed: int = 42) -> Fit:
    """Random forest on every ``every``-th bar of each symbol-day."""
    base = _fit(RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth,
                                       minInstancesPerNode=min_leaf, seed=seed), scale=False)

    def fit(train: DataFrame, features: list[str]):
        return base(systematic_sample(train, every) if every > 1 else train, features)
    return fit


def _held_back(train: DataFrame, share: float, seed: int) -> Column:
    """A seeded share of the symbol-days, for deciding when to stop."""
    return F.pmod(F.xxhash64(F.lit(seed), "symbol", F.col("trade_date").cast("string")), F.lit(1000)) < int(share * 1000)


def boosted(rounds: int = 100, depth: int = 6, step: float = 0.05, seed: int = 42, hold_back: float = 0.0,
            tolerance: float = 0.001) -> Fit:
    """One boosted tree model per class against the rest; scores are rescaled to sum to 1.

    With ``hold_back``, that share of the training symbol-days decides when a class stops: at the first round that
    does not lower their error by ``tolerance`` of it.  The scoring function names the rounds of each class (``rounds``);
    a class that the training rows lack takes none and scores 0.  Where no symbol-day falls to one of the two sides,
    nothing is held back and all rounds are run.
    """
    def fit(train: DataFrame, features: list[str]):
        if len(classes := classes_of(train)) < 2:
            return known_class(classes, features)
        assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
        kept = [c for c in ("symbol", "trade_date") if c in train.columns] if hold_back else []
        rows = assembler.transform(train).select("features", "y", "w", *kept)
        early = {}
        if hold_back:
            rows = rows.withColumn("held_back", _held_back(rows, hold_back, seed))
            early = {"validationIndicatorCol": "held_back", "validationTol": tolerance}
        rows = stage(rows)  # the assembled table that all classes are fitted on
        if hold_back and rows.select("held_back").distinct().count() < 2:
            early = {}
        models = {
            i: GBTClassifier(labelCol="is_class", weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=step,
                          seed=seed, checkpointInterval=-1, **early).fit(rows.withColumn("is_class", (F.col("y") == float(i)).cast("double")))
            for i in range(len(CLASSES)) if float(i) in classes
        }

        def score(df: DataFrame) -> DataFrame:
            out = assembler.transform(_filled(df, features))
            out = out.withColumns({name: F.lit(0.0) for i, name in enumerate(PROBS) if i not in models})
            for i, model in models.items():
                name = PROBS[i]
                out = model.transform(out).withColumn(name, vector_to_array("probability")[1]).drop(
                    "rawPrediction", "probability", "prediction")
            total = F.col(PROBS[0]) + F.col(PROBS[1]) + F.col(PROBS[2])
            return out.withColumns({n: F.col(n) / total for n in PROBS}).drop("features")

        score.rounds = {name: models[i].getNumTrees if i in models else 0 for i, name in enumerate(CLASSES)}
        return score
    return fit


def rounds_used(bars: DataFrame, folds: DataFrame, label: str, features: list[str], horizon_min: int | None = 60,
                **options) -> DataFrame:
    """fold, class, max_rounds, rounds: where boosting with held-back days stopped (``boosted`` options)."""
    most = options.setdefault("rounds", 100)

    def run(train: DataFrame, val: DataFrame) -> DataFrame:
        used = boosted(**options)(training_rows(train, label, features), features).rounds
        return bars.sparkSession.createDataFrame([(c, most, n) for c, n in used.items()], "class string, max_rounds int, rounds int")
    return per_fold(bars, folds, run, label, horizon_min)


def out_of_fold(bars: DataFrame, folds: DataFrame, fit: Fit, label: str, features: list[str] | None = None,
                horizon_min: int | None = 60) -> DataFrame:
    """Each validation day scored by a model that never saw it: bars with probabilities and fold.

    Every fold is scored, also one whose training rows hold a single class or none (``known_class``).  The loop is over folds (a handful of fits); training and scoring run on the cluster and the
    scored folds are united lazily.
    """
    features = features or MODEL_FEATURES
    bars, folds = stage(bars), stage(folds)  # every fold reads both several times
    parts = []
    for row in folds.select("fold").distinct().orderBy("fold").toLocalIterator():
        train, val = split_fold(bars, folds, row["fold"], horizon_min)
        rows = training_rows(train, label, features)
        rows = stage(rows)
        parts.append(fit(rows, features)(val).withColumn("fold", F.lit(row["fold"])))
    if not parts:  # no days
        return known_class([], features)(bars.limit(0)).withColumn("fold", F.lit(None).cast(folds.schema["fold"].dataType))
    return reduce(DataFrame.unionByName, parts)


def per_fold(bars: DataFrame, folds: DataFrame, run: Callable[[DataFrame, DataFrame], DataFrame], label: str,
             horizon_min: int | None = 60) -> DataFrame:
    """run(train, validation) of every fold with a column fold; ``bars`` should be staged."""
    parts = []
    for row in folds.select("fold").distinct().orderBy("fold").toLocalIterator():
        train, val = split_fold(bars, folds, row["fold"], horizon_min)
        parts.append(run(train, val).withColumn("fold", F.lit(row["fold"])))
    if not parts:
        raise ValueError("there are no folds")
    return reduce(DataFrame.unionByName, parts)


def fold_means(results: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The rows of every fold and, with fold NULL, their means per group."""
    means = results.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values]).withColumn("fold", F.lit(None).cast(results.schema["fold"].dataType))
    return results.select("fold", *by, *values).unionByName(means)


def keyed_out_of_fold(bars: DataFrame, fits: Fit | dict[str, Fit], label: str, features: list[str] | None = None,
                      folds: int = 5) -> DataFrame | dict[str, DataFrame]:
    """As ``out_of_fold`` for rows that carry a fold number by symbol.  Several models, by name, share each fold's rows and
    give a table each."""
    features = features or MODEL_FEATURES
    bars, several = stage(bars), isinstance(fits, dict)
    named = fits if several else {"": fits}
    parts: dict[str, list[DataFrame]] = {name: [] for name in named}
    for k in range(folds):
        mine = bars.where(F.col("fold") == k)
        if mine.isEmpty():
            continue
        rows = stage(training_rows(bars.where(F.col("fold") != k), label, features))
        for name, fit in named.items():
            parts[name].append(fit(rows, features)(mine))
    found = {name: reduce(DataFrame.unionByName, own) if own else known_class([], features)(bars) for name, own in parts.items()}
    return found if several else found[""]


def predicted_class(df: DataFrame) -> DataFrame:
    best = F.greatest(*PROBS)
    return df.withColumn("pred", F.when(F.col(PROBS[0]) == best, CLASSES[0]).when(F.col(PROBS[1]) == best, CLASSES[1])
                         .otherwise(CLASSES[2]))


def evaluate(scored: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """MCC and average precision of LONG and SHORT per group."""
    by = list(by or [])
    rows = stage(predicted_class(scored).where(F.col(label).isNotNull()))
    ap = lambda p, c, name: average_precision(rows, p, F.col(label) == c, by).select(
        *by, F.col("average_precision").alias(name))
    m = mcc(rows, label, "pred", by)
    long_ap, short_ap = ap(PROBS[0], "LONG", "ap_long"), ap(PROBS[1], "SHORT", "ap_short")
    if by:
        return m.join(long_ap, by, "left").join(short_ap, by, "left")
    return m.crossJoin(F.broadcast(long_ap)).crossJoin(F.broadcast(short_ap))


def shuffled(df: DataFrame, column: str, by: list[str], seed: int = 42, ids: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """``column`` permuted within ``by``: values in one seeded order meet rows in another.

    Both orders come from exact distributed ranks, so a group of any size is permuted whole.
    """
    def order(n: int, what: list[str]) -> DataFrame:
        h = F.xxhash64(F.lit(seed + n), *[F.col(c).cast("string") for c in ids]).cast("double")
        return global_rank(df.withColumn("_h", h), "_h", list(ids), by).drop("_h", "n").select(*what, "rn")

    df = stage(df)
    others = [c for c in df.columns if c != column]
    rows = order(0, others)
    values = order(1, [*by, column])
    return rows.join(values, [*by, "rn"]).drop("rn").select(*df.columns)


def permutation_importance(scored_by: Callable[[DataFrame], DataFrame], val: DataFrame, label: str,
                           features: list[str], seed: int = 42) -> DataFrame:
    """feature, mcc, mcc_shuffled, importance: loss of MCC when one feature is permuted."""
    val = stage(val)
    base = mcc(predicted_class(scored_by(val)), label, "pred").select(F.col("mcc"))
    parts = []
    keyed = val.withColumn("_all", F.lit(0))
    for f in features:
        moved = scored_by(shuffled(keyed, f, ["_all"], seed).drop("_all"))
        parts.append(mcc(predicted_class(moved), label, "pred").select(
            F.lit(f).alias("feature"), F.col("mcc").alias("mcc_shuffled")))
    return reduce(DataFrame.unionByName, parts).crossJoin(F.broadcast(base)).withColumn(
        "importance", F.col("mcc") - F.col("mcc_shuffled"))


def tree_importance(bars: DataFrame, label: str, features: list[str], **forest_options) -> DataFrame:
    """feature, importance from the forest's split gains (one row per feature); 0 where there are no two classes to split."""
    rows = stage(training_rows(bars, label, features))
    if len(classes_of(rows)) < 2:
        return bars.sparkSession.createDataFrame([(f, 0.0) for f in features], "feature string, importance double")
    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)
    options = {"numTrees": 20, "maxDepth": 5, "seed": 42, **forest_options}
    model = RandomForestClassifier(labelCol="y", weightCol="w", **options).fit(assembled)
    gains = [(f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return bars.sparkSession.createDataFrame(gains, "feature string, importance double")


def coefficients(bars: DataFrame, label: str, features: list[str], reg: float = 1e-4) -> DataFrame:
    """class, feature, coefficient of the scaled logistic model; 0 for a class that training rows lack, and where there are no two to tell apart."""
    rows = stage(training_rows(bars, label, features))
    if len(classes_of(rows)) < 2:
        return bars.sparkSession.createDataFrame([(c, f, 0.0) for c in CLASSES for f in features], "class string, feature string, coefficient double")
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip"),
              RobustScaler(inputCol="raw", outputCol="features", withCentering=True),
              LogisticRegression(labelCol="y", weightCol="w", family="multinomial", regParam=reg, maxIter=50)]
    matrix = Pipeline(stages=stages).fit(rows).stages[-1].coefficientMatrix.toArray()
    # a class after the last that the training rows hold has no row in the matrix
    flat = [(name, f, float(matrix[c][i]) if c < len(matrix) else 0.0) for c, name in enumerate(CLASSES) for i, f in enumerate(features)]
    return bars.sparkSession.createDataFrame(flat, "class string, feature string, coefficient double")


def robust_scale(df: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - median) / interquartile range, exact; a zero range leaves the centred value, a column without values is NULL.

    The quantiles of all columns come from one pass over (column, value) counts, and reach the rows as one broadcast row.
    """
    if fit_on is None:
        df = fit_on = stage(df)
    long = fit_on.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("r")).select("r.*")
    found = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["name"])
    limits = found.agg(*[F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"_q_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(limits))
    for c in columns:
        spread = F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
        out = out.withColumn(f"{c}_scaled", (F.col(c) - F.col(f"_q_{c}")[1]) / F.when(spread == 0, 1.0).otherwise(spread))
    return out.drop(*[f"_q_{c}" for c in columns])


def fit_and_save(bars: DataFrame, label: str, path: str, features: list[str] | None = None, trees: int = 100) -> None:
    """Final model on all labelled days, stored with Spark's own format."""
    features = features or MODEL_FEATURES
    rows = training_rows(bars, label, features)
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"),
              RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, maxDepth=10, minInstancesPerNode=20, seed=42)]
    Pipeline(stages=stages).fit(rows).write().overwrite().save(path)


def load_scorer(path: str, features: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    return _score_pipeline(PipelineModel.load(path), features or MODEL_FEATURES)
