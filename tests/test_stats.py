from __future__ import annotations

import math

import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemark.functions import maths, text
from tidemark.operators import classify, features, metrics, stats


def test_correlation_of_four_points(spark):
    for x, y in (([1, 2, 3, 4], [1, 3, 2, 5]), ([1, 2, 3, 4], [2, 3, 4, 5]), ([1, 2, 3, 4], [-1, -3, -2, -6])):
        df = spark.createDataFrame([("a", float(i), float(j)) for i, j in zip(x, y)], "symbol string, x double, y double")
        cells = {(r.row, r.column): r.corr for r in stats.correlation_matrix(df, ["x", "y"]).collect()}
        assert cells["x", "y"] == pytest.approx(np.corrcoef(x, y)[0, 1]) == cells["y", "x"]
        assert cells["x", "x"] == pytest.approx(1)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([("a", 1.0, float(i), None if i % 2 else 1.0) for i in range(4)], "symbol string, c double, x double, n double")
    r = df.select(maths.safe_corr("c", "x").alias("v"), maths.safe_corr("n", "x").alias("w")).first()
    assert r.v is None and r.w is None
    assert all(r.corr is None for r in stats.correlation_matrix(df, ["c", "x"]).where("row != column").collect())


def test_pairs_use_common_bars_only(series):
    df = series(a=[1, 2, 4, 3], b=[2, 4, 8, 6, 100], c=[4, 3, 1, 2])
    out = {(r.symbol_x, r.symbol_y): r for r in stats.pair_correlations(df, [("a", "b"), ("c", "a"), ("b", "zz")]).collect()}
    assert out["a", "b"].corr == pytest.approx(1) and out["a", "b"].bars == 4
    assert out["c", "a"].corr == pytest.approx(np.corrcoef([4, 3, 1, 2], [1, 2, 4, 3])[0, 1])
    assert ("b", "zz") not in out


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [0, 1, 2, 9.999, 10]] + [("flat", 5.0)] * 3, "symbol string, v double")
    out = {(r.symbol, r.bin): r.n for r in stats.histogram(df, "v", 10).collect()}
    assert out == {("a", 0): 1, ("a", 1): 1, ("a", 2): 1, ("a", 9): 2, ("flat", 0): 3}


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", float(v)) for v in rng.standard_normal(2000)], "symbol string, v double")
    out = stats.kernel_density(df, "v", 40).orderBy("point_no").collect()
    x, y = [r.x for r in out], [r.density for r in out]
    assert np.trapezoid(y, x) == pytest.approx(1, abs=0.02)
    h = stats.kde_bandwidth(df, "v").first().bandwidth
    assert h == pytest.approx(1.06 * 2000**-0.2, rel=0.1)
    values = np.array([r.v for r in df.collect()])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert h == pytest.approx(1.06 * min(values.std(ddof=1), (q3 - q1) / 1.34) * 2000**-0.2)


@pytest.mark.parametrize("n", [1, 2, 7, 50])
def test_exact_quantiles(spark, n):
    values = [float((i * 7) % 11) for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), ("b", 5.0)], "symbol string, v double")
    shares = {"q0": 0.0, "q1": 0.25, "q5": 0.5, "q9": 0.9, "top": 1.0}
    got = {r.symbol: r for r in stats.exact_quantiles(df, "v", shares).collect()}
    assert [got["a"][k] for k in shares] == pytest.approx(list(np.quantile(values, list(shares.values()))))
    assert got["b"].q5 == 5.0 and stats.describe(df, "v").where("symbol = 'a'").first().median == pytest.approx(np.median(values))


def test_counts_and_shares(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [("a", -1)] + [("b", 1)], "symbol string, s int")
    per = {(r.symbol, r.s): r.share for r in stats.value_counts(df, "s", ["symbol"]).collect()}
    assert per == {("a", 1): 0.75, ("a", -1): 0.25, ("b", 1): 1.0}
    assert {r.s: (r.n, r.share) for r in stats.value_counts(df, "s").collect()} == {1: (4, 0.8), -1: (1, 0.2)}


def test_class_metrics_and_their_guards(spark):
    rows = [("a", 0, 0)] * 4 + [("a", 0, 1)] * 1 + [("a", 1, 0)] * 2 + [("a", 1, 1)] * 3 + [("z", 0, 0)]
    m = {r.symbol: r for r in classify.class_metrics(classify.confusion_matrix(spark.createDataFrame(rows, "symbol string, y int, p int"), "y", "p")).collect()}
    assert (m["a"].accuracy, m["a"].precision_up, m["a"].recall_up) == (0.7, 0.75, 0.6)
    assert m["a"].precision_down == pytest.approx(4 / 6) and m["a"].imbalance == pytest.approx(4 / 6)
    assert (m["z"].precision_up, m["z"].recall_up, m["z"].imbalance) == (0, 0, 0)


def test_trade_results_and_figures(series):
    df = series("r", a=[0.1, -0.2, 0.0, 0.3], up=[0.1, 0.2]).withColumn("p", F.when(F.col("r") == -0.2, 1.0).when(F.col("r") == 0, 0.0).otherwise(F.col("r")))
    out = metrics.trade_results(df, "r", "p")
    assert column(out.where("symbol='a'"), "is_won") == [True, False, True, True]
    assert column(out.where("symbol='a'"), "equity_curve") == pytest.approx([0.1, -0.1, -0.1, 0.2])
    assert column(out.where("symbol='a'"), "drawdown_log_return") == pytest.approx([0, -0.2, -0.2, 0])
    f = {r.symbol: r for r in metrics.performance(out, factor=2.0, features="x", target="r").collect()}
    a, up = f["a"], f["up"]
    assert (a.no_trades, a.win_rate, a.avg_loss) == (4, 0.75, -0.2) and a.max_drawdown == pytest.approx(-0.2)
    assert a.sharpe == pytest.approx(2 * np.mean([0.1, -0.2, 0, 0.3]) / np.std([0.1, -0.2, 0, 0.3], ddof=1))
    assert up.avg_loss is None and up.ev == pytest.approx(0.15) and up.compound_return == pytest.approx(math.exp(0.3))
    one = metrics.performance(metrics.trade_results(series("r", a=[0.1]), "r", "r")).first()
    assert one.sharpe == 0 and one.std is None


def test_leaderboard_is_a_top_k_plan(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("sharpe"))
    top = metrics.leaderboard(df, "sharpe", 3, ["id"])
    assert [r.id for r in top.collect()] == [6, 13, 20]
    assert "TakeOrderedAndProject" in top._jdf.queryExecution().executedPlan().toString()


def test_zero_and_missing_prices_give_null(series):
    out = features.add_log_return(series(a=[1, 0, 2, None, 3, -1, 4]))
    assert column(out, "close_log_return") == [None] * 7


def test_log_returns_add_up(series):
    prices = [3, 1, 4, 1, 5, 9, 2, 6]
    out = features.add_log_return(series(a=prices)).agg(F.sum("close_log_return").alias("s")).first()
    assert out.s == pytest.approx(math.log(6 / 3))


def test_ticker_text(spark):
    df = spark.createDataFrame([("AAPL", 262.82, 1500000, 0.0523)], "s string, p double, v long, c double")
    symbol, price = text.parse_quote(F.lit("AAPL:262.82"))
    r = df.select(
        symbol, price, text.price_column_name("s").alias("n"), text.before(F.lit("AAPL-price"), "-").alias("b"),
        text.after(F.lit("AAPL-price"), "-").alias("a"), text.price_label("s", "p").alias("l"),
        text.volume_label("s", "v").alias("vol"), text.change_label("s", "c").alias("ch"),
        text.position_value(F.lit(150), F.lit(195.75)).alias("pv"), text.unrealized_pnl(F.lit(150), F.lit(180.5), F.lit(195.75)).alias("pnl"),
        text.after("s", "-").alias("none"), text.parse_quote(F.lit("X:abc"))[1].alias("bad"),
    ).first()
    assert (r.symbol, r.price, r.n, r.b, r.a) == ("AAPL", 262.82, "AAPL_price", "AAPL", "price")
    assert (r.l, r.vol, r.ch) == ("AAPL price is $262.82", "AAPL volume: 1,500,000", "AAPL change: 5.23%")
    assert (r.pv, r.pnl, r.none, r.bad) == (29362.5, 2287.5, None, None)
