"""From signals to money: sizing, fees, compounding, leverage, liquidation, stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import as_col, as_value, direction, ratio
from .ordered import BARS, Timeline, with_lags, with_running


def add_signal(df: DataFrame, y_hat: str = "y_hat", ret: str = "close_log_return", line: Timeline = BARS) -> DataFrame:
    """``dir_signal``, ``trade_log_return`` and its running sum ``cum_trade_log_return``."""
    out = df.withColumn("dir_signal", direction(y_hat))
    out = out.withColumn("trade_log_return", F.col(ret) * F.col("dir_signal"))
    return with_running(out, line, sums={"cum_trade_log_return": "trade_log_return"})


def add_tx_fee(trades: DataFrame, fee: float | str | Column, name: str) -> DataFrame:
    """``tx_fee_{name}``: the rate charged on entry value and on exit value."""
    rate = as_value(fee)
    return trades.withColumn(f"tx_fee_{name}", F.col("exit_trade_value") * rate + F.col("entry_trade_value") * rate)


def add_tx_fees(trades: DataFrame, maker: float | str | Column, taker: float | str | Column) -> DataFrame:
    return add_tx_fee(add_tx_fee(trades, maker, "maker"), taker, "taker")


def round_trip_log_fee(fee: float | str | Column, formula: str = "round_trip") -> Column:
    """Log-space cost of one trade: ``ln(1 - 2*fee)``, or the literal ``ln(fee)``."""
    rate = as_value(fee)
    if formula == "log_fee":
        return F.ln(rate)
    if formula != "round_trip":
        raise ValueError("formula must be round_trip or log_fee")
    return F.ln(F.lit(1.0) - rate * 2)


def add_tx_fees_log(
    trades: DataFrame,
    maker: float | str | Column,
    taker: float | str | Column,
    line: Timeline = BARS,
    formula: str = "round_trip",
) -> DataFrame:
    """Net log returns and net log equity under both fee rates."""
    out = trades.withColumns(
        {
            f"trade_log_return_net_{n}": F.col("trade_log_return") + round_trip_log_fee(fee, formula)
            for n, fee in (("maker", maker), ("taker", taker))
        }
    )
    return with_running(
        out, line, sums={f"equity_curve_net_{n}": f"trade_log_return_net_{n}" for n in ("maker", "taker")}
    )


def add_taker_cost(trades: DataFrame, fee: float | str | Column, line: Timeline = BARS) -> DataFrame:
    """Plain subtraction of a round trip: ``trade_net_return = return - 2*fee``, and its curve."""
    out = trades.withColumn("trade_net_return", F.col("trade_log_return") - as_value(fee) * 2)
    return with_running(out, line, sums={"cum_trade_net_return": "trade_net_return"})


def add_equity_curves(
    trades: DataFrame, capital: float | str | Column, curves: dict[str, str], line: Timeline = BARS
) -> DataFrame:
    """``equity_curve_{suffix} = capital + running sum`` for each ``{suffix: pnl column}``."""
    out = with_running(trades, line, sums={f"_sum_{s}": pnl for s, pnl in curves.items()})
    out = out.withColumns({f"equity_curve_{s}": as_value(capital) + F.col(f"_sum_{s}") for s in curves})
    return out.drop(*(f"_sum_{s}" for s in curves))


def add_equity_curve(
    trades: DataFrame, capital: float | str | Column, pnl: str, suffix: str, line: Timeline = BARS
) -> DataFrame:
    return add_equity_curves(trades, capital, {suffix: pnl}, line)


def add_trade_log_returns(
    trades: DataFrame,
    pre_trade_value: float | str | Column,
    fee: float | str | Column,
    capital: float | str | Column,
    line: Timeline = BARS,
) -> DataFrame:
    """A given capital per trade (number or column): quantities, PnL, fees and two equity curves."""
    out = add_signal(trades, line=line)
    out = out.withColumn("pre_trade_value", as_value(pre_trade_value))
    out = out.withColumns(
        {
            "post_trade_value": F.col("pre_trade_value") * F.exp("trade_log_return"),
            "trade_qty": ratio("pre_trade_value", "open"),
        }
    )
    rate = as_value(fee)
    out = out.withColumns(
        {
            "signed_trade_qty": F.col("trade_qty") * F.col("dir_signal"),
            "trade_gross_pnl": F.col("post_trade_value") - F.col("pre_trade_value"),
            "tx_fees": F.col("pre_trade_value") * rate + F.col("post_trade_value") * rate,
        }
    )
    out = out.withColumn("trade_net_pnl", F.col("trade_gross_pnl") - F.col("tx_fees"))
    return add_equity_curves(out, capital, {"gross": "trade_gross_pnl", "net": "trade_net_pnl"}, line)


def _net_and_curves(out: DataFrame, capital: Column, line: Timeline) -> DataFrame:
    out = out.withColumns(
        {
            "trade_net_taker_pnl": F.col("trade_gross_pnl") - F.col("tx_fee_taker"),
            "trade_net_maker_pnl": F.col("trade_gross_pnl") - F.col("tx_fee_maker"),
        }
    )
    curves = {"gross": "trade_gross_pnl", "taker": "trade_net_taker_pnl", "maker": "trade_net_maker_pnl"}
    return add_equity_curves(out, capital, curves, line)


def add_compounding_trades(
    trades: DataFrame,
    capital: float | str | Column,
    leverage: float | str | Column,
    maker: float | str | Column,
    taker: float | str | Column,
    line: Timeline = BARS,
) -> DataFrame:
    """Profits reinvested, with leverage and both fee schedules.

    The notional starts at ``capital * leverage`` and follows the compounded
    return; the equity curves start from ``capital``. The notional before a
    trade is ``exp(cumulative - own return)``, so no further pass over the
    series is needed.
    """
    notional = as_value(capital) * as_value(leverage)
    before = F.col("cum_trade_log_return") - F.col("trade_log_return")
    out = trades.withColumns(
        {
            "entry_trade_value": F.exp(before) * notional,
            "exit_trade_value": F.exp("cum_trade_log_return") * notional,
        }
    )
    out = out.withColumns(
        {
            "signed_trade_qty": ratio("entry_trade_value", "open") * F.col("dir_signal"),
            "trade_gross_pnl": F.col("exit_trade_value") - F.col("entry_trade_value"),
        }
    )
    return _net_and_curves(add_tx_fees(out, maker, taker), as_value(capital), line)


def add_constant_trades(
    trades: DataFrame,
    capital: float | str | Column,
    share: float | str | Column,
    maker: float | str | Column,
    taker: float | str | Column,
    line: Timeline = BARS,
) -> DataFrame:
    """The same share of the starting capital in every trade, with fees and three curves."""
    value = as_value(capital) * as_value(share)
    out = trades.withColumns(
        {
            "entry_trade_value": value,
            "exit_trade_value": value * F.exp("trade_log_return"),
            "trade_qty": F.try_divide(value, F.col("open")),
        }
    )
    out = out.withColumns(
        {
            "signed_trade_qty": F.col("trade_qty") * F.col("dir_signal"),
            "trade_gross_pnl": F.col("exit_trade_value") - F.col("entry_trade_value"),
        }
    )
    out = _net_and_curves(add_tx_fees(out, maker, taker), as_value(capital), line)
    return out.withColumn("net_return", F.try_divide(F.col("equity_curve_taker"), as_value(capital)) - 1)


def add_static_sizing(trades: DataFrame, capital: float, line: Timeline = BARS) -> DataFrame:
    """A fixed position for every trade, no fee: ``*_static`` value, PnL and curve."""
    out = trades.withColumns(
        {
            "pre_trade_value_static": F.lit(float(capital)),
            "post_trade_value_static": F.exp("trade_log_return") * F.lit(float(capital)),
        }
    )
    out = out.withColumn("trade_gross_pnl_static", F.col("post_trade_value_static") - F.lit(float(capital)))
    return add_equity_curve(out, capital, "trade_gross_pnl_static", "static", line)


def add_dynamic_sizing(
    trades: DataFrame, capital: float, leverage: float = 1.0, suffix: str = "compound", line: Timeline = BARS
) -> DataFrame:
    """The position grows with the result so far (times leverage), no fee: ``*_{suffix}`` values and PnL."""
    notional = float(capital) * float(leverage)
    out = trades.withColumn(f"post_trade_value_{suffix}", F.exp("cum_trade_log_return") * F.lit(notional))
    pre = f"pre_trade_value_{suffix}"
    out = with_lags(out, line, {pre: (f"post_trade_value_{suffix}", 1)})
    out = out.withColumn(pre, F.coalesce(pre, F.lit(notional)))
    return out.withColumn(f"trade_gross_pnl_{suffix}", F.col(f"post_trade_value_{suffix}") - F.col(pre))


def sizing_summary(trades: DataFrame, pnl: str, capital: float, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean and total PnL, final equity and total return of one sizing rule."""
    sums = trades.groupBy(*keys).agg(F.avg(pnl).alias("mean_pnl"), F.sum(pnl).alias("total_pnl"))
    final = F.lit(float(capital)) + F.col("total_pnl")
    return sums.withColumns({"final_equity": final, "total_return": final / F.lit(float(capital))})


def with_parameters(df: DataFrame, **values: Sequence[float]) -> DataFrame:
    """Every row once per value of each named parameter list (a sweep).

    The lists are literals of the query, so the copies come from ``explode`` and
    nothing is joined.
    """
    for name, items in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in items])))
    return df


def leverage_sweep(
    trades: DataFrame,
    capital: float,
    leverages: Sequence[float],
    maker: float,
    taker: float,
    line: Timeline = BARS,
    time: str = "datetime",
) -> DataFrame:
    """Net taker return at each leverage, per series.

    The equity after the last trade is the capital plus the sum of all net PnL,
    so each leverage costs one aggregation and no running total.
    """
    swept = with_parameters(trades, leverage=leverages)
    notional = F.lit(float(capital)) * F.col("leverage")
    entry = F.exp(F.col("cum_trade_log_return") - F.col("trade_log_return")) * notional
    leave = F.exp("cum_trade_log_return") * notional
    net = leave - entry - (entry + leave) * F.lit(float(taker))
    net_maker = leave - entry - (entry + leave) * F.lit(float(maker))
    sums = swept.groupBy(*line.keys, "leverage").agg(F.sum(net).alias("_taker"), F.sum(net_maker).alias("_maker"))
    return sums.select(
        *line.keys,
        "leverage",
        (F.col("_taker") / capital).alias("net_taker_return"),
        (F.col("_maker") / capital).alias("net_maker_return"),
    )


def long_liquidation_price(entry: str | Column, leverage: float | str | Column, mmr: float = 0.005) -> Column:
    lev = as_value(leverage)
    return F.try_divide(as_col(entry) * lev, lev + 1 - lev * F.lit(mmr))


def short_liquidation_price(entry: str | Column, leverage: float | str | Column, mmr: float = 0.005) -> Column:
    lev = as_value(leverage)
    return F.try_divide(as_col(entry) * lev, lev - 1 + lev * F.lit(mmr))


def add_liquidation(trades: DataFrame, leverage: float | str | Column, mmr: float = 0.005) -> DataFrame:
    """``liquidation_price``, the bar's ``worst_price`` for the position, and ``liquidated``."""
    is_long, is_short = F.col("dir_signal") == 1, F.col("dir_signal") == -1
    out = trades.withColumn(
        "liquidation_price",
        F.when(is_long, long_liquidation_price("open", leverage, mmr)).when(
            is_short, short_liquidation_price("open", leverage, mmr)
        ),
    )
    hit = (is_long & (F.col("low") <= F.col("liquidation_price"))) | (
        is_short & (F.col("high") >= F.col("liquidation_price"))
    )
    return out.withColumns(
        {
            "worst_price": F.when(is_long, F.col("low")).otherwise(F.col("high")),
            "liquidated": F.coalesce(hit, F.lit(False)),
        }
    )


def liquidated_trades(trades: DataFrame) -> DataFrame:
    return trades.where("liquidated")


def confident(probability: str | Column, low: float = 0.45, high: float = 0.55) -> Column:
    """Trade only when the model is sure enough, either way."""
    p = as_col(probability)
    return (p >= F.lit(high)) | (p <= F.lit(low))


def compare_strategies(
    trades: DataFrame, probability: str, low: float = 0.45, high: float = 0.55, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Trading every bar against trading only confident bars, side by side."""
    sure, r = confident(probability, low, high), F.col("trade_log_return")
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("all_trades"),
        F.count_if(sure).alias("confident_trades"),
        F.count_if(~sure).alias("skipped_trades"),
        F.sum(r).alias("all_return"),
        F.coalesce(F.sum(F.when(sure, r)), F.lit(0.0)).alias("confident_return"),
    )


def add_percent_drawdown(trades: DataFrame, equity: str, line: Timeline = BARS) -> DataFrame:
    """``drawdown_pct`` of a money equity curve: (equity - highest so far) / highest so far."""
    out = with_running(trades, line, maxima={"_top": equity})
    return out.withColumn("drawdown_pct", ratio(F.col(equity) - F.col("_top"), "_top")).drop("_top")


def add_drawdown_stop(trades: DataFrame, equity: str, limit: float = 0.2, line: Timeline = BARS) -> DataFrame:
    """``stopped``: true for every trade after the one whose drawdown first passed ``limit``."""
    out = add_percent_drawdown(trades, equity, line)
    out = out.withColumn("_breach", (F.col("drawdown_pct") < F.lit(-limit)).cast("int"))
    out = with_running(out, line, sums={"_breaches": "_breach"})
    return out.withColumn("stopped", F.col("_breaches") - F.col("_breach") > 0).drop("_breach", "_breaches")
