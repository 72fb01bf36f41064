"""Cross-validation over time: rolling, expanding, split ratios, walk-forward.

No fold copies its training rows. For squared error block moments are summed
once, a rolling fold uses one block's row, and an expanding fold or a split
ratio uses a running total over the blocks. Robust losses weigh rows per fold:
a row answers for all the folds that it trains, in one pass a step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import direction
from ..operators.features import drop_null_rows
from ..operators.ordered import BARS, Timeline, with_position
from ..operators.split import with_fold_block
from ..session import written
from .regression import Folds, Weighting, cumulative_moments, fit_linear, moment_names, moments, score, solve


def _rows(df: DataFrame, features: Sequence[str], target: str, line: Timeline) -> DataFrame:
    columns = dict.fromkeys([*line.columns(), *features, target])
    return drop_null_rows(df.select(*columns))


def expected_return(tested: DataFrame, target: str, by: Sequence[str]) -> DataFrame:
    """``ev``: mean of ``sign(prediction) * actual`` per group."""
    return tested.groupBy(*by).agg(F.avg(direction("y_hat") * F.col(target)).alias("ev"))


def _evaluate(
    test: DataFrame, train: DataFrame | None, fold_sums: DataFrame | None, features: Sequence[str], target: str,
    by: list[str], loss: str | Weighting, folds: Folds | None = None,
) -> DataFrame:
    if loss == "mse":
        models = written(solve(fold_sums, list(features), [tuple(features)], by), "models")
    else:
        own = [k for k in by if folds is None or k != folds.name]
        models = fit_linear(train, list(features), target, own, loss=loss, folds=folds)
    return expected_return(score(test, models, features, by), target, by)


def rolling_cv(
    df: DataFrame, features: Sequence[str], target: str, size: int, folds: int,
    line: Timeline = BARS, loss: str | Weighting = "huber",
) -> DataFrame:
    """``window_no`` (from 0) and ``ev`` per series: train on one block, test on the next."""
    keys = list(line.keys)
    rows = written(with_fold_block(_rows(df, features, target, line), size, line), "fold-rows")
    whole = (F.col("window_no") + 2) * F.lit(size) <= F.col("n_rows")
    wanted = (F.col("window_no") >= 0) & (F.col("window_no") < folds) & whole
    test = rows.withColumn("window_no", F.col("fold_block") - 1).where(wanted)
    train = rows.withColumn("window_no", F.col("fold_block")).where(wanted)
    by = [*keys, "window_no"]
    sums = moments(train, features, target, by) if loss == "mse" else None
    return _evaluate(test, train, sums, features, target, by, loss)


def expanding_cv(
    df: DataFrame, features: Sequence[str], target: str, size: int, folds: int,
    line: Timeline = BARS, loss: str | Weighting = "huber",
) -> DataFrame:
    """``iteration_no`` (from 1) and ``ev`` per series: train on everything before the test block."""
    keys = list(line.keys)
    rows = written(with_fold_block(_rows(df, features, target, line), size, line), "fold-rows")
    by = [*keys, "iteration_no"]
    fits = (F.col("fold_block") + 1) * F.lit(size) <= F.col("n_rows")
    test = rows.where((F.col("fold_block") >= 1) & (F.col("fold_block") <= folds) & fits)
    test = test.withColumnRenamed("fold_block", "iteration_no")
    if loss == "mse":
        sums = moments(rows, features, target, [*keys, "fold_block"])
        sums = cumulative_moments(sums, len(features), keys, "fold_block")
        sums = sums.withColumn("iteration_no", F.col("fold_block") + 1)
        return _evaluate(test, None, sums, features, target, by, loss)
    numbers = list(range(1, folds + 1))
    train = rows.where(F.col("fold_block") < folds)
    return _evaluate(test, train, None, features, target, by, loss, Folds("iteration_no", "fold_block", numbers, numbers))


def ratio_cv(
    df: DataFrame, features: Sequence[str], target: str, ratios: Sequence[float],
    line: Timeline = BARS, loss: str | Weighting = "huber",
) -> DataFrame:
    """``train_size`` and ``ev`` per series: one chronological split per ratio (in rising order)."""
    keys, ratios = list(line.keys), sorted(float(r) for r in ratios)
    rows = written(with_position(_rows(df, features, target, line), line), "fold-rows")
    ends = [F.floor(F.col("n_rows") * F.lit(r)) for r in ratios]
    # How many of the splits already have this row behind their training end.
    passed = [(F.col("row_no") >= e).cast("int") for e in ends]
    rows = rows.withColumn("_passed", sum(passed[1:], passed[0]))
    sizes = F.array(*[F.lit(r) for r in ratios])
    by = [*keys, "train_size"]
    # Splits 0.._passed-1 test this row; the later ones train on it.
    test = rows.withColumn("train_size", F.explode(F.slice(sizes, F.lit(1), F.col("_passed"))))
    if loss == "mse":
        sums = moments(rows, features, target, [*keys, "_passed"])
        # A split whose segment is empty still owes its running total.
        every = sums.select(*keys).distinct().withColumn("_passed", F.explode(F.array(*[F.lit(i) for i in range(len(ratios))])))
        sums = every.join(sums, [*keys, "_passed"], "left").na.fill(0.0, moment_names(len(features)))
        sums = cumulative_moments(sums, len(features), keys, "_passed")
        sums = sums.withColumn("train_size", F.get(sizes, F.col("_passed")))
        return _evaluate(test, None, sums, features, target, by, loss)
    train = rows.where(F.col("_passed") < len(ratios))
    return _evaluate(test, train, None, features, target, by, loss, Folds("train_size", "_passed", ratios, [i + 1 for i in range(len(ratios))]))


def compare_methods(results: dict[str, DataFrame], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean and sample deviation of ``ev`` per method."""
    out = None
    for name, table in results.items():
        part = table.select(*keys, "ev").withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, "method").agg(F.avg("ev").alias("mean_ev"), F.stddev_samp("ev").alias("std_ev"))


def walk_forward(
    df: DataFrame, pool: Sequence[str], settings: Sequence[Sequence[str]], target: str, size: int, folds: int,
    line: Timeline = BARS, inner: float = 0.75,
) -> DataFrame:
    """Rolling folds with a setting (feature set) tuned inside each training block.

    Each block is split in two parts in time. Every setting is fitted on the
    first part and judged by its ``ev`` on the second; the best (the earlier
    setting on ties) is refitted on the whole block and tested on the next one.
    The refit adds the two parts' moments, so the rows are summed once.
    """
    keys, pool = list(line.keys), list(pool)
    by = [*keys, "window_no"]
    rows = with_fold_block(_rows(df, pool, target, line), size, line)
    cut = F.lit(int(size * inner))
    rows = rows.withColumn("_late", F.col("row_no") - F.col("fold_block") * F.lit(size) >= cut)
    rows = written(rows, "fold-rows")
    whole = (F.col("window_no") + 2) * F.lit(size) <= F.col("n_rows")
    wanted = (F.col("window_no") >= 0) & (F.col("window_no") < folds) & whole
    train = rows.withColumn("window_no", F.col("fold_block")).where(wanted)
    sums = written(moments(train, pool, target, [*by, "_late"]), "fold-sums")
    trial = written(solve(sums.where(~F.col("_late")), pool, settings, by), "models")
    judged = score(train.where("_late"), trial, pool, by).groupBy(*by, "model_id").agg(
        F.avg(direction("y_hat") * F.col(target)).alias("_ev")
    )
    rank = F.struct(F.col("_ev"), (-F.col("model_id")).alias("_first"))
    best = judged.groupBy(*by).agg(F.max_by("model_id", rank).alias("model_id"))
    both = sums.groupBy(*by).agg(*[F.sum(n).alias(n) for n in moment_names(len(pool))])
    refit = written(solve(both, pool, settings, by).join(best, [*by, "model_id"]), "models")
    test = rows.withColumn("window_no", F.col("fold_block") - 1).where(wanted)
    return score(test, refit, pool, by).groupBy(*by, "model_id", "features").agg(
        F.avg(direction("y_hat") * F.col(target)).alias("ev")
    )
