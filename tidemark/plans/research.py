"""End-to-end research plans: trades to bars, features, model, trades, figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import sharpe_annualization_factor
from ..functions.maths import dot
from ..operators.bars import ohlc
from ..operators.features import add_log_return_features, drop_null_rows, lag_names
from ..operators.metrics import leaderboard, performance, trade_results
from ..operators.ordered import BARS, Timeline
from ..operators.split import with_split
from ..session import written
from .regression import Weighting, feature_subsets, fit_linear, score

Model = Callable[[Sequence[str]], Column]


def add_model_predictions(
    df: DataFrame, model: DataFrame | Model | tuple[Sequence[float], float], features: Sequence[str],
    by: Sequence[str] = ("symbol",), name: str = "y_hat",
) -> DataFrame:
    """Predict in-row with a coefficient table, fixed ``(weights, bias)``, or any
    callable from feature names to a Column (a ``pandas_udf`` call, say)."""
    if isinstance(model, DataFrame):
        return score(df, model, features, by, name).drop("model_id", "features", "weights", "bias")
    if callable(model):
        return df.withColumn(name, model(features))
    weights, bias = model
    return df.withColumn(name, dot(features, weights, bias))


def split_rows(
    df: DataFrame, features: Sequence[str], target: str, test_size: float = 0.25, line: Timeline = BARS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Complete rows with ``is_train``; only the columns a model study needs."""
    columns = list(dict.fromkeys([*line.columns(), *features, target, *keep]))
    return with_split(drop_null_rows(df.select(*columns)), test_size, line)


def learn_model_trades(
    df: DataFrame, features: Sequence[str], target: str = "close_log_return", loss: str | Weighting = "l1",
    test_size: float = 0.25, line: Timeline = BARS,
) -> DataFrame:
    """Fit on the first part of each series and give the trades of the rest."""
    rows = written(split_rows(df, features, target, test_size, line), "study-rows")
    models = written(fit_linear(rows.where("is_train"), features, target, line.keys, loss=loss), "models")
    tested = score(rows.where(~F.col("is_train")), models, features, line.keys)
    return trade_results(tested, target, "y_hat", line).drop("row_no", "n_rows", "is_train", "model_id", "weights", "bias", "features")


def search_linear_models(
    df: DataFrame, target: str, pool: Sequence[str], factor: float = 1.0, max_features: int = 1,
    loss: str | Weighting = "l1", test_size: float = 0.25, line: Timeline = BARS,
) -> DataFrame:
    """All feature subsets up to a size, for every series, best Sharpe ratio first.

    The feature table is written once. All subsets of all series are fitted from
    one aggregation of the train rows (more passes for a loss other than mse);
    the test rows are then scored by every model and summarised per model.
    """
    keys = list(line.keys)
    subsets = feature_subsets(pool, max_features)
    rows = written(split_rows(df, pool, target, test_size, line), "study-rows")
    models = written(fit_linear(rows.where("is_train"), list(pool), target, keys, subsets, loss), "models")
    tested = score(rows.where(~F.col("is_train")), models, list(pool), keys)
    trades = trade_results(tested, target, "y_hat", line.by("model_id", "features"))
    figures = performance(
        trades.withColumnRenamed("features", "_f"), [*keys, "model_id", "_f"], factor, F.col("_f"), target
    ).drop("_f")
    found = figures.join(models.select(*keys, "model_id", "weights", "bias"), [*keys, "model_id"])
    return leaderboard(found, "sharpe", ties=[*keys, "model_id"])


def benchmark_model(
    df: DataFrame, features: Sequence[str], target: str = "close_log_return", factor: float = 1.0,
    loss: str | Weighting = "l1", test_size: float = 0.25, line: Timeline = BARS,
) -> DataFrame:
    """Figures and coefficients of one feature set, per series."""
    rows = written(split_rows(df, features, target, test_size, line), "study-rows")
    models = written(fit_linear(rows.where("is_train"), list(features), target, line.keys, loss=loss), "models")
    tested = score(rows.where(~F.col("is_train")), models, list(features), line.keys)
    trades = trade_results(tested, target, "y_hat", line)
    figures = performance(trades, line.keys, factor, ",".join(features), target)
    return figures.join(models.select(*line.keys, "weights", "bias"), list(line.keys))


def ar_study(trades: DataFrame, every: str = "12h", lags: int = 3, test_size: float = 0.25, loss: str = "mse") -> DataFrame:
    """The flagship: trades -> bars -> lags -> AR model per symbol -> trades -> figures."""
    line = Timeline.of_bars(every)
    feats = add_log_return_features(ohlc(trades, every), "close", 1, lags, line)
    names = lag_names("close_log_return", lags)
    return benchmark_model(feats, names, "close_log_return", sharpe_annualization_factor(every), loss, test_size, line)


def compare_timeframes(
    bars: dict[str, DataFrame], weights: Sequence[float], bias: float, col: str = "close"
) -> DataFrame:
    """One fixed AR model at several bar lengths: figures per symbol and interval."""
    names = lag_names(f"{col}_log_return", len(weights))
    out = None
    for every, table in bars.items():
        line = Timeline.of_bars(every)
        feats = drop_null_rows(add_log_return_features(table, col, 1, len(weights), line))
        feats = add_model_predictions(feats, (weights, bias), names)
        trades = trade_results(feats, f"{col}_log_return", "y_hat", line)
        part = performance(trades, ("symbol",), sharpe_annualization_factor(every), ",".join(names), f"{col}_log_return")
        part = part.withColumn("interval", F.lit(every))
        out = part if out is None else out.unionByName(part)
    return out
