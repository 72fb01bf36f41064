from __future__ import annotations

import math

import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemark.operators import backtest, ledger
from tidemark.operators.ordered import Timeline


@pytest.fixture()
def trades(series):
    rows = series("close_log_return", a=[0.1, -0.2, 0.3, -0.05], b=[0.2, 0.2])
    return rows.withColumns(
        {"y_hat": F.when(F.col("symbol") == "b", -1.0).otherwise(F.lit(1.0)), "open": F.lit(20.0), "low": F.lit(15.0), "high": F.lit(26.0)}
    )


def a(df, name):
    return column(df.where("symbol = 'a'"), name)


RETURNS = [0.1, -0.2, 0.3, -0.05]


def test_given_capital_per_trade_returns_a_table(trades):
    out = backtest.add_trade_log_returns(trades, 50.0, 0.001, 100.0)
    post = [50 * math.exp(r) for r in RETURNS]
    assert a(out, "trade_gross_pnl") == pytest.approx([p - 50 for p in post])
    assert a(out, "tx_fees") == pytest.approx([(50 + p) * 0.001 for p in post])
    gross, net, fees = a(out, "equity_curve_gross"), a(out, "equity_curve_net"), a(out, "tx_fees")
    assert [g - n for g, n in zip(gross, net)] == pytest.approx([sum(fees[: i + 1]) for i in range(4)])
    by_column = backtest.add_trade_log_returns(trades.withColumn("cap", F.lit(50.0)), "cap", 0.001, 100.0)
    assert a(by_column, "equity_curve_net") == pytest.approx(net)
    assert column(out.where("symbol = 'b'"), "signed_trade_qty") == [-2.5, -2.5]


@pytest.mark.parametrize("line", [Timeline(), Timeline(block="2h")])
def test_compounding(trades, line):
    out = backtest.add_compounding_trades(backtest.add_signal(trades, line=line), 100, 3, 0.0002, 0.0005, line)
    value, entries, exits = 300.0, [], []
    for r in RETURNS:
        entries.append(value)
        value *= math.exp(r)
        exits.append(value)
    assert a(out, "entry_trade_value") == pytest.approx(entries) and a(out, "exit_trade_value") == pytest.approx(exits)
    assert a(out, "tx_fee_taker") == pytest.approx([(x + y) * 0.0005 for x, y in zip(entries, exits)])
    assert a(out, "equity_curve_gross")[-1] == pytest.approx(100 + exits[-1] - 300)
    assert a(out, "signed_trade_qty") == pytest.approx([e / 20 for e in entries])


def test_sweep_matches_single_runs(trades):
    signals = backtest.add_signal(trades)
    swept = {(r.symbol, r.leverage): r.net_taker_return for r in backtest.leverage_sweep(signals, 100, [1, 4, 8], 0.0002, 0.0005).collect()}
    for lev in (1, 4, 8):
        last = a(backtest.add_compounding_trades(signals, 100, lev, 0.0002, 0.0005), "equity_curve_taker")[-1]
        assert swept["a", lev] == pytest.approx(last / 100 - 1)


def test_log_fees(trades):
    out = backtest.add_tx_fees_log(backtest.add_signal(trades), 0.0002, 0.0005)
    assert a(out, "equity_curve_net_taker") == pytest.approx([sum(RETURNS[: i + 1]) + (i + 1) * math.log(1 - 0.001) for i in range(4)])
    literal = backtest.add_tx_fees_log(backtest.add_signal(trades), 0.0002, 0.0005, formula="log_fee")
    assert a(literal, "trade_log_return_net_taker")[0] == pytest.approx(0.1 + math.log(0.0005))
    with pytest.raises(ValueError):
        backtest.round_trip_log_fee(0.1, "other")


def test_sizing_rules(trades):
    rows = backtest.add_signal(trades)
    static = backtest.add_static_sizing(rows, 50.0)
    total = sum(50 * math.exp(r) - 50 for r in RETURNS)
    assert a(static, "equity_curve_static")[-1] == pytest.approx(50 + total)
    s = {r.symbol: r for r in backtest.sizing_summary(static, "trade_gross_pnl_static", 50.0).collect()}
    assert s["a"].final_equity == pytest.approx(50 + total) and s["a"].total_return == pytest.approx((50 + total) / 50)
    dynamic = backtest.add_dynamic_sizing(rows, 50.0, 2.0)
    assert a(dynamic, "pre_trade_value_compound")[0] == 100
    assert a(dynamic, "post_trade_value_compound")[-1] == pytest.approx(100 * math.exp(sum(RETURNS)))


def test_liquidation(trades):
    out = backtest.add_liquidation(backtest.add_signal(trades), 4.0)
    assert a(out, "liquidation_price")[0] == pytest.approx(20 * 4 / (5 - 0.02))
    assert set(a(out, "liquidated")) == {True} and set(a(out, "worst_price")) == {15.0}
    assert backtest.liquidated_trades(backtest.add_liquidation(backtest.add_signal(trades), 1.0)).where("symbol = 'a'").count() == 0
    flat = backtest.add_liquidation(backtest.add_signal(trades.withColumn("y_hat", F.lit(0.0))), 4.0)
    assert set(a(flat, "liquidated")) == {False} and set(a(flat, "liquidation_price")) == {None}


def test_drawdown_stop(series):
    rows = series("equity", a=[100, 110, 87, 90, 200])
    out = backtest.add_drawdown_stop(rows, "equity", 0.2)
    assert column(out, "drawdown_pct") == pytest.approx([0, 0, -23 / 110, -20 / 110, 0])
    assert column(out, "stopped") == [False, False, False, True, True]


def test_orders_close_before_they_open(trades):
    rows = backtest.add_signal(trades).withColumns({"account": F.lit("m"), "qty": F.lit(5.0) * F.col("dir_signal")})
    orders = ledger.order_pairs(rows.where("symbol = 'b'"), "qty", "open")
    got = [(r.seq, float(r.signed_qty)) for r in orders.orderBy("datetime", "seq").collect()]
    assert got == [(1, -5), (0, 5), (1, -5)]


@pytest.mark.parametrize("block", [None, "1h"])
def test_ledger_balance_is_the_sum_of_pnl(trades, block):
    rows = backtest.add_signal(trades).withColumns({"account": F.lit("m"), "qty": F.col("close_log_return") * 100, "open": 20 + F.col("close_log_return")})
    orders = ledger.order_pairs(rows, "qty", "open")
    line = Timeline(("account", "symbol"), ("datetime", "seq"), block)
    out = ledger.fills(orders, 7.0, line)
    qty = [round(r * 100, 8) for r in RETURNS]
    price = [20 + r for r in RETURNS]
    want = 7 + sum(q * (price[i + 1] - price[i]) for i, q in enumerate(qty[:-1]))
    last = out.where("symbol = 'a'").orderBy(F.desc("datetime"), F.desc("seq")).first()
    assert float(last.balance) == pytest.approx(want)
    assert sum(float(v) for v in a(out, "pnl")) == pytest.approx(want - 7)


def average_cost(orders, balance):
    """Balances after each (quantity, price), one order at a time."""
    held = cost = 0.0
    out = []
    for q, p in orders:
        new = round(held + q, 8)
        if held and held * q < 0:
            closed = -q if abs(q) <= abs(held) else held
            balance += closed * (p - cost / held)
            cost = 0.0 if not new else new * p if new * held < 0 else cost * new / held
        else:
            cost += q * p
        held = new
        out.append(balance)
    return out


@pytest.mark.parametrize("block", [None, "1m", "10m", "2h"])
def test_partial_closes_under_blocks(spark, block):
    import random

    rng = random.Random(11)
    rows, want = [], {}
    for symbol, n in (("HOT", 400), ("b", 30), ("one", 1)):
        orders, held = [], 0
        for i in range(n):
            q = rng.choice([-held, rng.randint(-9, 9), 1, -1]) or 2
            orders.append((float(q), float(rng.randint(5, 30))))
            held += q
        want[symbol] = average_cost(orders, 50.0)
        rows += [("m", symbol, i * 20 + rng.randint(0, 19), i, *o) for i, o in enumerate(orders)]
    table = spark.createDataFrame(rows, "account string, symbol string, t int, seq int, q double, price double").repartition(4)
    table = table.select("account", "symbol", F.timestamp_seconds("t").alias("datetime"), "seq", F.col("q").cast(ledger.QTY).alias("signed_qty"), F.col("price").cast(ledger.QTY).alias("price"))
    out = ledger.fills(table, 50.0, Timeline(("account", "symbol"), ("datetime", "seq"), block))
    for symbol, balances in want.items():
        got = [float(r.balance) for r in out.where(F.col("symbol") == symbol).orderBy("datetime", "seq").collect()]
        assert got == pytest.approx(balances, abs=1e-6)
