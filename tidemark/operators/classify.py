"""Judging a direction classifier: confusion matrix, rates, ROC curve and area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import ratio
from ..session import written
from .ordered import Timeline, even_blocks, with_running


def confusion_matrix(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """``tn, fp, fn, tp`` per group, from 0/1 columns."""
    a, p = F.col(actual) == 1, F.col(predicted) == 1
    return df.groupBy(*keys).agg(
        F.count_if(~a & ~p).alias("tn"),
        F.count_if(~a & p).alias("fp"),
        F.count_if(a & ~p).alias("fn"),
        F.count_if(a & p).alias("tp"),
    )


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Accuracy, precision up and down, recall up (0 when undefined), signal shares and their imbalance."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    out = matrix.withColumns(
        {
            "accuracy": ratio(tp + tn, total),
            "precision_up": F.coalesce(ratio(tp, tp + fp), F.lit(0.0)),
            "recall_up": F.coalesce(ratio(tp, tp + fn), F.lit(0.0)),
            "precision_down": F.coalesce(ratio(tn, tn + fn), F.lit(0.0)),
            "long_ratio": ratio(fp + tp, total),
            "short_ratio": ratio(fn + tn, total),
        }
    )
    return out.withColumn("imbalance", ratio("long_ratio", "short_ratio"))


def _running_by_score(df: DataFrame, actual: str, score: str, keys: Sequence[str], blocks: int | None) -> DataFrame:
    """Per distinct score, best first: positives and negatives at it and up to it.

    Equal scores are counted before anything is ordered, and the counts written
    once. The distinct scores of a group are then walked in pieces of about equal
    size (``blocks`` of them, or as many as their number asks for).
    """
    a = F.col(actual) == 1
    counts = written(
        df.where(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("threshold"))
        .agg(F.count_if(a).alias("_pos"), F.count_if(~a).alias("_neg"))
        .withColumn("_down", -F.col("threshold")),
        "score-counts",
    )
    line = Timeline(tuple(keys), ("_down",))
    rows, line = even_blocks(counts, line, blocks)
    out = with_running(rows, line, sums={"tp": "_pos", "fp": "_neg"})
    totals = written(counts.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N")), "score-totals")
    return out.join(totals, list(keys))


def roc_points(
    df: DataFrame, actual: str, score: str, keys: Sequence[str] = ("symbol",), blocks: int | None = None
) -> DataFrame:
    """False and true positive rate at every distinct score used as threshold."""
    out = _running_by_score(df, actual, score, keys, blocks)
    return out.select(
        *keys,
        "threshold",
        ratio(F.col("fp").cast("double"), F.col("_N").cast("double")).alias("fpr"),
        ratio(F.col("tp").cast("double"), F.col("_P").cast("double")).alias("tpr"),
    )


def roc_auc(
    df: DataFrame, actual: str, score: str, keys: Sequence[str] = ("symbol",), blocks: int | None = None
) -> DataFrame:
    """Area under the ROC curve; equal scores share their credit. NULL with one class only."""
    out = _running_by_score(df, actual, score, keys, blocks)
    # Each negative beats the positives below it and ties half with its own score's.
    won = F.col("_neg") * (F.col("tp") - F.col("_pos") / 2)
    return out.groupBy(*keys, "_P", "_N").agg(F.sum(won).alias("_won")).select(
        *keys, ratio(F.col("_won").cast("double"), (F.col("_P") * F.col("_N")).cast("double")).alias("auc")
    )
