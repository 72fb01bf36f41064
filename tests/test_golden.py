"""Hand-checkable values."""

from __future__ import annotations

import math

import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemark.functions.intervals import (
    annualization_column, exchange_interval, interval_micros, parse_interval, sharpe_annualization_factor,
)
from tidemark.functions.maths import dot
from tidemark.operators import backtest, features, ledger, metrics, ordered
from tidemark.streaming.ticks import lag_vector


def approx(values, digits=1e-6):
    return [None if v is None else pytest.approx(v, abs=digits) for v in values]


def test_log_returns_of_three_prices(series):
    out = features.add_log_return(series(a=[100, 120, 100]))
    got = column(out, "close_log_return")
    assert got == approx([None, 0.182322, -0.182322])
    assert sum(v for v in got if v) == pytest.approx(0)


def test_difference_and_simple_return(series):
    out = features.add_difference(series(a=[100, 120, 100]), "close")
    assert column(out, "close_diff") == approx([None, 20, -20])
    assert column(out, "close_return") == approx([None, 0.2, -0.166667])


def test_lag_of_log_return(series):
    prices = [10, 8, 11, 7, 9, 12, 8, 9, 7, 10]
    out = features.add_log_return_features(series(a=prices), "close", 1, 1)
    logs = [None] + [math.log(b / a) for a, b in zip(prices, prices[1:])]
    assert column(out, "close_log_return") == approx(logs)
    assert column(out, "close_log_return_lag_1") == approx([None] + logs[:-1])


def test_lags_follow_the_column_asked_for(series):
    out = features.add_log_return_features(series("open", a=[1, 2, 4, 8]), "open", 1, 1)
    assert column(out, "open_log_return_lag_1") == approx([None, None, math.log(2), math.log(2)])


def test_horizon_spaces_returns_and_lags(series):
    out = features.add_log_return_features(series(a=[1, 2, 4, 8, 16, 32]), "close", 2, 1)
    assert column(out, "close_log_return") == approx([None, None] + [math.log(4)] * 4)
    assert column(out, "close_log_return_lag_1") == approx([None] * 4 + [math.log(4)] * 2)


def test_cumulative_log_returns_and_value(series):
    prices = [100, 120, 100, 80, 155]
    out = features.portfolio_path(series(a=prices))
    assert column(out, "cum_log_return") == approx([math.log(p / 100) for p in prices])
    assert column(out, "portfolio_value") == approx(prices)


def test_lag_vector_after_each_tick(series):
    out = lag_vector(series("price", a=[90, 100, 150, 110, 160]), 3, line=ordered.BARS)
    names = features.lag_names("log_return", 3)
    rows = [[r[n] for n in names] for r in out.orderBy("datetime").collect()]
    assert rows[4] == approx([math.log(160 / 110), math.log(110 / 150), math.log(150 / 100)])
    assert [all(v is not None for v in r) for r in rows] == [False, False, False, True, True]


def test_window_of_three(series):
    out = ordered.with_last_values(series("price", a=[1, 2, 3, 4]), ordered.BARS, "price", 3)
    assert column(out, "dropped") == [None, None, None, 1.0]
    assert column(out, "window") == [[1.0], [1.0, 2.0], [1.0, 2.0, 3.0], [2.0, 3.0, 4.0]]
    assert column(out, "is_full") == [False, False, True, True]
    with pytest.raises(ValueError):
        ordered.with_last_values(out, ordered.BARS, "price", 0)


def test_open_and_close_a_position(spark):
    rows = [("me", "BTC", 1, 0, 5, 10), ("me", "BTC", 2, 0, -5, 15)]
    orders = spark.createDataFrame(rows, "account string, symbol string, t int, seq int, q int, p int").select(
        "account", "symbol", F.timestamp_seconds("t").alias("datetime"), "seq",
        F.col("q").cast("decimal(18,8)").alias("signed_qty"), F.col("p").cast("decimal(18,8)").alias("price"),
    )
    out = ledger.fills(orders, 50.0).orderBy("datetime").collect()
    assert [float(r.pnl) for r in out] == [0, 25]
    assert [float(r.balance) for r in out] == [50, 75]
    assert [float(r.position) for r in out] == [5, 0]
    assert ledger.open_positions(ledger.fills(orders)).count() == 0


def test_partial_closes_book_at_average_cost(spark):
    rows = [(1, 4, 10), (2, 2, 11), (3, -3, 12), (4, -3, 13), (5, -1, 20), (6, 1, 18)]
    orders = spark.createDataFrame(rows, "t int, q int, p int").select(
        F.lit("me").alias("account"), F.lit("X").alias("symbol"), F.timestamp_seconds("t").alias("datetime"),
        F.lit(0).alias("seq"), F.col("q").cast("decimal(18,8)").alias("signed_qty"), F.col("p").cast("decimal(18,8)").alias("price"),
    )
    out = ledger.fills(orders, 0.0).orderBy("datetime").collect()
    assert [float(r.pnl) for r in out] == [0, 0, 5, 8, 0, 2]
    assert float(ledger.account_summary(ledger.fills(orders), 1.0).first().balance) == 16


def test_a_position_sold_in_parts(spark):
    orders = spark.createDataFrame([(1, 10, 10), (2, -4, 15), (3, -6, 12)], "t int, q int, p int").select(
        F.lit("me").alias("account"), F.lit("X").alias("symbol"), F.timestamp_seconds("t").alias("datetime"),
        F.lit(0).alias("seq"), F.col("q").cast("decimal(18,8)").alias("signed_qty"), F.col("p").cast("decimal(18,8)").alias("price"),
    )
    out = ledger.fills(orders, 100.0).orderBy("datetime").collect()
    assert [float(r.balance) for r in out] == [100, 120, 132]


def test_a_turned_position_books_its_first_half(spark):
    rows = [(1, 5, 10), (2, -10, 15), (3, 5, 12), (4, -2, 20), (5, 6, 10), (6, -4, 11)]
    orders = spark.createDataFrame(rows, "t int, q int, p int").select(
        F.lit("me").alias("account"), F.lit("X").alias("symbol"), F.timestamp_seconds("t").alias("datetime"),
        F.lit(0).alias("seq"), F.col("q").cast("decimal(18,8)").alias("signed_qty"), F.col("p").cast("decimal(18,8)").alias("price"),
    )
    out = ledger.fills(orders, 100.0).orderBy("datetime").collect()
    assert [float(r.balance) for r in out] == [100, 125, 140, 140, 160, 164]
    assert [float(r.pnl) for r in out] == [0, 25, 15, 0, 20, 4]


def test_liquidation_prices(spark):
    one = spark.range(1).select(
        F.round(backtest.long_liquidation_price(F.lit(200.0), 2), 4).alias("long"),
        F.round(backtest.short_liquidation_price(F.lit(200.0), 2), 4).alias("short"),
    ).first()
    assert (one.long, one.short) == (133.7793, 396.0396)


def test_linear_model_rows(spark):
    rows = spark.createDataFrame([(-0.1, -0.2), (-0.2, -0.4), (-0.4, -0.8)], "a double, b double")
    got = [r.y for r in rows.select(dot(["a", "b"], [-0.5, -0.1], 0.0001).alias("y")).collect()]
    assert sorted(got) == approx([0.0701, 0.1401, 0.2801])


@pytest.mark.parametrize(
    "every,factor", [("1h", math.sqrt(8760)), ("1d", math.sqrt(365)), ("1m", math.sqrt(525600)), ("1w", math.sqrt(365 / 7))]
)
def test_annualisation(spark, every, factor):
    assert sharpe_annualization_factor(every) == pytest.approx(factor)
    one = spark.range(1).withColumn("e", F.lit(every)).select(annualization_column("e").alias("f")).first()
    assert one.f == pytest.approx(factor)


def test_intervals_are_matched_in_full():
    assert parse_interval("15m") == (15, "m") and interval_micros("1mo") is None
    for bad in ("1day", "d", "0h", "", "1.5h"):
        with pytest.raises(ValueError):
            parse_interval(bad)
    assert exchange_interval("OKX", "12h") == "12H" and exchange_interval("kraken", "1w") == 10080
    with pytest.raises(ValueError):
        exchange_interval("coinbase", "12h")


def test_compounding_is_additive_in_logs(series):
    returns = [0.005439, 0.008597, 0.001385]
    rows = series("trade_log_return", a=returns).withColumns({"open": F.lit(10.0), "dir_signal": F.lit(1.0)})
    rows = ordered.with_running(rows, ordered.BARS, sums={"cum_trade_log_return": "trade_log_return"})
    out = backtest.add_compounding_trades(rows, 100, 1, 0.0, 0.0)
    assert column(out, "exit_trade_value")[-1] == pytest.approx(101.5541, abs=1e-4)
    assert column(out, "equity_curve_gross")[-1] == pytest.approx(101.5541, abs=1e-4)


def test_portfolios_a_and_b(spark):
    a = [1.0, 1.0, -1.0, 1.0, 1.0, 1.0, -1.0, 1.0, 1.0, 1.0]
    b = [-10.0, 10.0, -10.0, 15.0, -10.0, 16.0, -18.0, 13.0, -10.0, 10.0]
    rows = spark.createDataFrame([("A", v) for v in a] + [("B", v) for v in b], "portfolio string, pnl double")
    out = {r.portfolio: r for r in metrics.compare_portfolios(rows, "pnl").collect()}
    assert out["A"].total_pnl == 6 and out["A"].std_pnl == pytest.approx(0.8) and out["A"].sharpe == pytest.approx(0.75)
    assert out["B"].total_pnl == 6 and out["B"].sharpe == pytest.approx(0.6 / 12.507, abs=1e-3)
