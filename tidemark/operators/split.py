"""Chronological splits and cross-validation folds. Nothing is ever shuffled in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import BARS, Timeline, with_position


def with_split(df: DataFrame, test_size: float = 0.25, line: Timeline = BARS) -> DataFrame:
    """Add ``row_no`` (from 0), ``n_rows`` and ``is_train``: the first
    ``floor(n * (1 - test_size))`` rows of each series train, the rest test."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    out = with_position(df, line)
    return out.withColumn("is_train", F.col("row_no") < F.floor(F.col("n_rows") * F.lit(1.0 - test_size)))


def chrono_split(df: DataFrame, test_size: float = 0.25, line: Timeline = BARS) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, test_size, line)
    extra = ("row_no", "n_rows", "is_train")
    return marked.where("is_train").drop(*extra), marked.where(~F.col("is_train")).drop(*extra)


def with_train_ratios(df: DataFrame, ratios: Sequence[float], line: Timeline = BARS) -> DataFrame:
    """Every row once per train ratio, with ``train_size`` and ``is_train``.

    The copies come from a literal array of the given ratios, after the row
    positions are known, so no join and no further shuffle is needed.
    """
    out = with_position(df, line)
    out = out.withColumn("train_size", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    return out.withColumn("is_train", F.col("row_no") < F.floor(F.col("n_rows") * F.col("train_size")))


def with_fold_block(df: DataFrame, size: int, line: Timeline = BARS) -> DataFrame:
    """Add ``fold_block`` = position // size. A rolling fold trains on one block and tests on the next."""
    return with_position(df, line).withColumn("fold_block", F.floor(F.col("row_no") / F.lit(size)))


def rolling_fold_rows(df: DataFrame, size: int, folds: int, line: Timeline = BARS) -> DataFrame:
    """Rows labelled ``window_no`` (from 0) and ``part``: at most two labels per row.

    Fold i trains on rows [size*i, size*(i+1)) and tests on the next ``size``
    rows; folds that would run past the end of the series do not exist.
    """
    out = with_fold_block(df, size, line)
    labels = F.array(
        F.struct(F.col("fold_block").alias("window_no"), F.lit("train").alias("part")),
        F.struct((F.col("fold_block") - 1).alias("window_no"), F.lit("test").alias("part")),
    )
    out = out.withColumn("_label", F.explode(labels)).select("*", "_label.*").drop("_label")
    complete = (F.col("window_no") + 2) * F.lit(size) <= F.col("n_rows")
    return out.where((F.col("window_no") >= 0) & (F.col("window_no") < folds) & complete)


def expanding_folds(df: DataFrame, size: int, folds: int, line: Timeline = BARS, time: str = "datetime") -> DataFrame:
    """One row per expanding fold: its train and test sizes and times.

    Fold i (from 1) trains on everything before its test block, so its numbers
    are running totals of block numbers; no row is copied into later folds.
    """
    blocks = (
        with_fold_block(df, size, line)
        .groupBy(*line.keys, "fold_block", "n_rows")
        .agg(F.count(F.lit(1)).alias("test_rows"), F.min(time).alias("test_start"), F.max(time).alias("test_end"))
    )
    w = Window.partitionBy(*line.keys).orderBy("fold_block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumns(
            {
                "train_rows": F.sum("test_rows").over(w),
                "train_start": F.min("test_start").over(w),
                "train_end": F.max("test_end").over(w),
            }
        )
        .where((F.col("fold_block") >= 1) & (F.col("fold_block") <= folds))
        .where((F.col("fold_block") + 1) * F.lit(size) <= F.col("n_rows"))
        .withColumnRenamed("fold_block", "iteration_no")
        .drop("n_rows")
    )
