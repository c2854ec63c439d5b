"""Audit table of predictions: what each model said at every bar, beside price, momentum, label and return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import slug
from tidemark.models.oof import Fit, keyed_out_of_fold, predicted_class
from tidemark.models.splits import mapped_folds
from tidemark.operators.momentum import roc
from tidemark.operators.schema import KEYS, MODEL_FEATURES
from tidemark.session import stage


def prediction_audit(bars: DataFrame, fold_map: DataFrame, fits: dict[str, Fit], label: str, ret: str,
                     features: list[str] | None = None, folds: int = 5) -> DataFrame:
    """ts, symbol, slug, fold, ltp, roc_9pct, pred_{model} of each of ``fits``, label, return.

    Bars lacking the label, a feature or a price are left out.  A symbol's fold comes from the map, else from the digest
    of its name, and each bar is predicted by models that never saw its fold.
    """
    features = features or MODEL_FEATURES
    rows = mapped_folds(bars.dropna(subset=[label, "ltp", *features]), fold_map, folds=folds)
    rows = stage(rows.withColumn("roc_9pct", roc(9, "ltp", KEYS, fill=None)))
    out = rows.select(*KEYS, "ts", slug("symbol", "trade_date").alias("slug"), "fold", "ltp", "roc_9pct", label, ret)
    for name, scored in keyed_out_of_fold(rows, fits, label, features, folds).items():
        said = predicted_class(scored).select(*KEYS, "ts", F.col("pred").alias(f"pred_{name}"))
        out = out.join(said, [*KEYS, "ts"], "left")
    return out.select("ts", "symbol", "slug", "fold", "ltp", "roc_9pct", *[f"pred_{name}" for name in fits], label, ret)
