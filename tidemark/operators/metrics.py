"""Trade results and performance figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import as_col, direction, ratio, sharpe
from .ordered import BARS, Timeline, with_running


def trade_results(
    df: DataFrame, y_true: str | Column = "close_log_return", y_pred: str | Column = "y_hat", line: Timeline = BARS
) -> DataFrame:
    """Trade by trade: win flag, position, log return, equity curve and drawdown.

    Adds ``y_pred, y_true, is_won, position, trade_log_return, equity_curve,
    drawdown_log_return``. A win is equal signs (so flat on flat wins); a zero
    prediction takes no position. The curves live in log space and start with
    the first trade.
    """
    out = df.withColumns({"y_pred": as_col(y_pred), "y_true": as_col(y_true)})
    out = out.withColumns(
        {
            "is_won": direction("y_pred") == direction("y_true"),
            "position": direction("y_pred"),
            "trade_log_return": direction("y_pred") * F.col("y_true"),
        }
    )
    out = with_running(out, line, sums={"equity_curve": "trade_log_return"}, peaks={"_peak": "equity_curve"})
    return out.withColumn("drawdown_log_return", F.col("equity_curve") - F.col("_peak")).drop("_peak")


def performance(
    trades: DataFrame,
    keys: Sequence[str] = ("symbol",),
    factor: float | Column = 1.0,
    features: str | Column | None = None,
    target: str = "close_log_return",
) -> DataFrame:
    """The sixteen figures of a set of trades, one row per group, in one aggregation.

    ``trades`` is the output of :func:`trade_results`. Averages over no rows are
    NULL, and count as zero in the expected value.
    """
    r, won = F.col("trade_log_return"), F.col("is_won")
    sums = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("no_trades"),
        F.avg(won.cast("double")).alias("win_rate"),
        F.avg(F.when(won, r)).alias("avg_win"),
        F.avg(F.when(~won, r)).alias("avg_loss"),
        F.max(r).alias("best_trade"),
        F.min(r).alias("worst_trade"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("std"),
        F.sum(r).alias("total_log_return"),
        F.min("drawdown_log_return").alias("max_drawdown"),
        F.min("equity_curve").alias("equity_trough"),
        F.max("equity_curve").alias("equity_peak"),
    )
    win, loss = F.coalesce("avg_win", F.lit(0.0)), F.coalesce("avg_loss", F.lit(0.0))
    label = features if isinstance(features, Column) else F.lit(features)
    return sums.withColumns(
        {
            "features": label,
            "target": F.lit(target),
            "ev": F.col("win_rate") * win + (1 - F.col("win_rate")) * loss,
            "compound_return": F.exp("total_log_return"),
            "sharpe": sharpe(F.col("_mean"), F.col("std"), factor),
        }
    ).select(
        *keys, "features", "target", "no_trades", "win_rate", "avg_win", "avg_loss", "best_trade", "worst_trade",
        "ev", "std", "total_log_return", "compound_return", "max_drawdown", "equity_trough", "equity_peak", "sharpe",
    )


def profitable_rate(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Win rate by the other definition: the share of trades with a positive return."""
    return trades.groupBy(*keys).agg(F.avg((F.col("trade_log_return") > 0).cast("double")).alias("profitable_rate"))


def drawdown_percent(log_drawdown: str | Column) -> Column:
    return F.exp(as_col(log_drawdown)) - 1


def final_value(log_return: str | Column, capital: float) -> Column:
    return F.exp(as_col(log_return)) * F.lit(float(capital))


def sharpe_with_risk_free(
    df: DataFrame, returns: str, risk_free: float = 0.0, factor: float | Column = 1.0, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Sharpe ratio over a risk-free rate, with the population deviation."""
    stats = df.groupBy(*keys).agg(F.avg(returns).alias("mean"), F.stddev_pop(returns).alias("std"))
    return stats.withColumn("sharpe", sharpe(F.col("mean") - F.lit(risk_free), F.col("std"), factor))


def compare_portfolios(df: DataFrame, pnl: str, key: str = "portfolio") -> DataFrame:
    """Total, mean, population deviation and Sharpe ratio per portfolio."""
    stats = df.groupBy(key).agg(
        F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("mean_pnl"), F.stddev_pop(pnl).alias("std_pnl")
    )
    return stats.withColumn("sharpe", ratio("mean_pnl", "std_pnl"))


def leaderboard(df: DataFrame, metric: str = "sharpe", k: int | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """Best first. With ``k`` Spark keeps only the top k per task and never sorts the rest."""
    ranked = df.orderBy(F.col(metric).desc_nulls_last(), *ties)
    return ranked.limit(k) if k else ranked


def last_value(df: DataFrame, value: str, keys: Sequence[str] = ("symbol",), time: str = "datetime") -> DataFrame:
    """The value of each series' last row (final equity), as one aggregation."""
    return df.groupBy(*keys).agg(F.max_by(value, time).alias(value))
