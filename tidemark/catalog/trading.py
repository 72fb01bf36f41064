"""Catalogue: trade results, performance, sizing, fees, leverage, risk and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import sharpe_annualization_factor
from ..functions.maths import sigmoid
from ..operators import backtest, bars, classify, features, ledger, metrics, ordered
from ..operators.ordered import Timeline
from ..plans import nets, research
from ..sources.sample_tables import LINE_ORDER, event_trades, line_trades, table
from .base import (
    CAPITAL, FIGURES, LAGS, LINES, MAKER, R, RESULTS, RS, SAFE_LOG, SIGNALS, TAKER, TRADES, WEIGHTS, BIAS,
    figures, figures_sql, query, r6, rounded, rows_sql, study_bars, study_features, study_results, study_rows, study_trades,
)

TICK_FIGURES = [n for n in FIGURES if n != "log_compound_return"]  # the multiple itself overflows over many ticks
RUN = "OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING)"


@query(
    "trade_results",
    f"""WITH {RESULTS} SELECT symbol, datetime, is_won, position,
    {RS('y_pred', 'y_true', 'trade_log_return', 'equity_curve', 'drawdown_log_return')} FROM results""",
)
def trade_results(spark, sf):
    return rounded(
        study_results(spark, sf), "symbol", "datetime", "is_won", "position", "y_pred", "y_true", "trade_log_return",
        "equity_curve", "drawdown_log_return",
    )


@query(
    "performance_summary",
    f"""WITH {RESULTS}, f AS ({figures_sql('results', 'symbol', 'sqrt(730)')})
    SELECT symbol, '{','.join(LAGS)}' AS features, 'close_log_return' AS target, no_trades, {RS(*FIGURES)} FROM f""",
)
def performance_summary(spark, sf):
    out = metrics.performance(study_results(spark, sf), ("symbol",), sharpe_annualization_factor("12h"), ",".join(LAGS))
    return figures(out, "symbol", "features", "target")


@query("running_equity", f"WITH {RESULTS} SELECT symbol, datetime, {R('equity_curve')} FROM results")
def running_equity(spark, sf):
    rows = study_rows(spark, sf).withColumn("r", F.signum("y_hat") * F.col("close_log_return"))
    out = ordered.with_running(rows, ordered.BARS, sums={"equity_curve": "r"})
    return rounded(out, "symbol", "datetime", "equity_curve")


@query(
    "win_rates",
    f"""WITH {RESULTS} SELECT symbol, {R('avg(CAST(trade_log_return > 0 AS DOUBLE))', 'profitable_rate')},
    {R('avg(CAST(is_won AS DOUBLE))', 'win_rate')}, {R('exp(min(drawdown_log_return)) - 1', 'max_drawdown_pct')},
    {R('ln(exp(sum(trade_log_return)) * 1000)', 'log_final_value')} FROM results GROUP BY symbol""",
)
def win_rates(spark, sf):
    trades = study_results(spark, sf)
    rate = metrics.profitable_rate(trades)
    rest = trades.groupBy("symbol").agg(
        F.avg(F.col("is_won").cast("double")).alias("win_rate"),
        metrics.drawdown_percent(F.min("drawdown_log_return")).alias("max_drawdown_pct"),
        F.ln(metrics.final_value(F.sum("trade_log_return"), 1000)).alias("log_final_value"),
    )
    return rounded(rate.join(rest, "symbol"), "symbol", "profitable_rate", "win_rate", "max_drawdown_pct", "log_final_value")


def _compound(capital: float, leverage: str, carry: str = "") -> str:
    """SQL for compounding: entry, exit, gross and both fees, then curves."""
    return f"""entries AS (SELECT *{carry}, {capital}e0 * {leverage} * exp(cum_trade_log_return - trade_log_return) AS entry_trade_value,
      {capital}e0 * {leverage} * exp(cum_trade_log_return) AS exit_trade_value FROM signals),
    priced AS (SELECT *, entry_trade_value / open * dir_signal AS signed_trade_qty, exit_trade_value - entry_trade_value AS trade_gross_pnl,
      (entry_trade_value + exit_trade_value) * {MAKER}e0 AS tx_fee_maker, (entry_trade_value + exit_trade_value) * {TAKER}e0 AS tx_fee_taker FROM entries),
    netted AS (SELECT *, trade_gross_pnl - tx_fee_taker AS trade_net_taker_pnl, trade_gross_pnl - tx_fee_maker AS trade_net_maker_pnl FROM priced),
    curves AS (SELECT *, {capital}e0 + sum(trade_gross_pnl) {RUN} AS equity_curve_gross, {capital}e0 + sum(trade_net_taker_pnl) {RUN} AS equity_curve_taker,
      {capital}e0 + sum(trade_net_maker_pnl) {RUN} AS equity_curve_maker FROM netted)"""


MONEY = [
    "entry_trade_value", "exit_trade_value", "signed_trade_qty", "trade_gross_pnl", "tx_fee_maker", "tx_fee_taker",
    "trade_net_taker_pnl", "trade_net_maker_pnl", "equity_curve_gross", "equity_curve_taker", "equity_curve_maker",
]


def scaled(name: str) -> str:
    """Money over its own bar's notional, so that rounding is relative."""
    return f"{name} / exp(cum_trade_log_return)"


def scaled_money(df, names=MONEY):
    return df.select(
        "symbol", "datetime", *[r6(F.col(n) / F.exp("cum_trade_log_return"), 4).alias(n) for n in names]
    )


@query(
    "compounding",
    f"""WITH {SIGNALS}, {_compound(CAPITAL, '1')} SELECT symbol, datetime, {', '.join(R(scaled(n), n, 4) for n in MONEY)} FROM curves""",
)
def compounding(spark, sf):
    out = backtest.add_compounding_trades(study_trades(spark, sf), CAPITAL, 1.0, MAKER, TAKER)
    return scaled_money(out)


@query(
    "leveraged_compounding",
    f"""WITH {SIGNALS}, {_compound(CAPITAL, '4')} SELECT symbol, datetime, {', '.join(R(scaled(n), n, 4) for n in MONEY)} FROM curves""",
)
def leveraged_compounding(spark, sf):
    out = backtest.add_compounding_trades(study_trades(spark, sf), CAPITAL, 4.0, MAKER, TAKER)
    return scaled_money(out)


@query(
    "fees_maker_taker",
    f"""WITH {SIGNALS}, v AS (SELECT *, 100 * exp(trade_log_return) AS exit_trade_value, 100e0 AS entry_trade_value FROM signals)
    SELECT symbol, datetime, {R(f'exit_trade_value * {MAKER}e0 + entry_trade_value * {MAKER}e0', 'tx_fee_maker')},
      {R(f'exit_trade_value * {TAKER}e0 + entry_trade_value * {TAKER}e0', 'tx_fee_taker')} FROM v""",
)
def fees_maker_taker(spark, sf):
    rows = study_trades(spark, sf).withColumns(
        {"entry_trade_value": F.lit(100.0), "exit_trade_value": F.lit(100.0) * F.exp("trade_log_return")}
    )
    return rounded(backtest.add_tx_fees(rows, MAKER, TAKER), "symbol", "datetime", "tx_fee_maker", "tx_fee_taker")


@query(
    "fees_log",
    f"""WITH {SIGNALS}, n AS (SELECT *, trade_log_return + ln(1 - 2 * {MAKER}e0) AS trade_log_return_net_maker,
      trade_log_return + ln(1 - 2 * {TAKER}e0) AS trade_log_return_net_taker, trade_log_return + ln({TAKER}e0) AS literal_form FROM signals)
    SELECT symbol, datetime, {RS('trade_log_return_net_maker', 'trade_log_return_net_taker', 'literal_form')},
      {R(f'sum(trade_log_return_net_maker) {RUN}', 'equity_curve_net_maker')}, {R(f'sum(trade_log_return_net_taker) {RUN}', 'equity_curve_net_taker')} FROM n""",
)
def fees_log(spark, sf):
    out = backtest.add_tx_fees_log(study_trades(spark, sf), MAKER, TAKER)
    out = out.withColumn("literal_form", F.col("trade_log_return") + backtest.round_trip_log_fee(TAKER, "log_fee"))
    return rounded(
        out, "symbol", "datetime", "trade_log_return_net_maker", "trade_log_return_net_taker", "literal_form",
        "equity_curve_net_maker", "equity_curve_net_taker",
    )


@query(
    "taker_cost",
    f"""WITH {SIGNALS}, n AS (SELECT *, trade_log_return - 2 * {TAKER}e0 AS trade_net_return FROM signals)
    SELECT symbol, datetime, {R('trade_net_return')}, {R(f'sum(trade_net_return) {RUN}', 'cum_trade_net_return')} FROM n""",
)
def taker_cost(spark, sf):
    out = backtest.add_taker_cost(study_trades(spark, sf), TAKER)
    return rounded(out, "symbol", "datetime", "trade_net_return", "cum_trade_net_return")


@query(
    "constant_sizing",
    f"""WITH {SIGNALS}, v AS (SELECT *, 50e0 AS entry_trade_value, 50 * exp(trade_log_return) AS exit_trade_value FROM signals),
    p AS (SELECT *, exit_trade_value - entry_trade_value AS trade_gross_pnl, 50 / open * dir_signal AS signed_trade_qty,
      (entry_trade_value + exit_trade_value) * {MAKER}e0 AS tx_fee_maker, (entry_trade_value + exit_trade_value) * {TAKER}e0 AS tx_fee_taker FROM v),
    c AS (SELECT *, 100 + sum(trade_gross_pnl) {RUN} AS equity_curve_gross, 100 + sum(trade_gross_pnl - tx_fee_taker) {RUN} AS equity_curve_taker,
      100 + sum(trade_gross_pnl - tx_fee_maker) {RUN} AS equity_curve_maker FROM p)
    SELECT symbol, datetime, {RS('exit_trade_value', 'signed_trade_qty', 'trade_gross_pnl', 'tx_fee_taker', 'equity_curve_gross', 'equity_curve_taker', 'equity_curve_maker', digits=5)},
      {R('equity_curve_taker / 100 - 1', 'net_return', 5)} FROM c""",
)
def constant_sizing(spark, sf):
    out = backtest.add_constant_trades(study_trades(spark, sf), CAPITAL, 0.5, MAKER, TAKER)
    return rounded(
        out, "symbol", "datetime", "exit_trade_value", "signed_trade_qty", "trade_gross_pnl", "tx_fee_taker",
        "equity_curve_gross", "equity_curve_taker", "equity_curve_maker", "net_return", digits=5,
    )


@query(
    "capital_join",
    f"""WITH {SIGNALS}, capital AS (SELECT symbol, datetime, 10 + volume AS pre_trade_value FROM bars),
    v AS (SELECT *, pre_trade_value * exp(trade_log_return) AS post_trade_value FROM signals JOIN capital USING (symbol, datetime)),
    p AS (SELECT *, post_trade_value - pre_trade_value AS trade_gross_pnl, (pre_trade_value + post_trade_value) * {TAKER}e0 AS tx_fees FROM v)
    SELECT symbol, datetime, pre_trade_value, {R('post_trade_value', digits=4)}, {R('pre_trade_value / open * dir_signal', 'signed_trade_qty', 4)},
      {RS('trade_gross_pnl', 'tx_fees', digits=4)}, {R('trade_gross_pnl - tx_fees', 'trade_net_pnl', 4)},
      {R(f'100 + sum(trade_gross_pnl) {RUN}', 'equity_curve_gross', 4)}, {R(f'100 + sum(trade_gross_pnl - tx_fees) {RUN}', 'equity_curve_net', 4)} FROM p""",
)
def capital_join(spark, sf):
    """Capital per trade from another table, matched by symbol and bar."""
    capital = study_bars(spark, sf).select("symbol", "datetime", (F.lit(10) + F.col("volume")).alias("capital"))
    rows = study_rows(spark, sf).join(capital, ["symbol", "datetime"])
    out = backtest.add_trade_log_returns(rows, "capital", TAKER, CAPITAL)
    return rounded(
        out.withColumn("pre_trade_value", F.col("pre_trade_value")), "symbol", "datetime", "pre_trade_value",
        "post_trade_value", "signed_trade_qty", "trade_gross_pnl", "tx_fees", "trade_net_pnl", "equity_curve_gross",
        "equity_curve_net", digits=4,
    )


@query(
    "static_vs_dynamic",
    f"""WITH {SIGNALS}, s AS (SELECT symbol, {R('avg(50 * exp(trade_log_return) - 50)', 'static_mean', 5)},
      {R('50 + sum(50 * exp(trade_log_return) - 50)', 'static_final', 5)} FROM signals GROUP BY symbol),
    d AS (SELECT symbol, {R('ln(arg_max(50 * exp(cum_trade_log_return), datetime) / 50)', 'dynamic_log_return')},
      {R('ln(arg_max(50 * 2 * exp(cum_trade_log_return), datetime) / 50)', 'leveraged_log_return')} FROM signals GROUP BY symbol),
    p AS (SELECT symbol, {R('ln(1 + sum((exp(cum_trade_log_return) - exp(cum_trade_log_return - trade_log_return))))', 'dynamic_total')} FROM signals GROUP BY symbol)
    SELECT * FROM s JOIN d USING (symbol) JOIN p USING (symbol)""",
)
def static_vs_dynamic(spark, sf):
    rows = study_trades(spark, sf)
    rows = backtest.add_static_sizing(rows, 50.0)
    rows = backtest.add_dynamic_sizing(rows, 50.0)
    rows = backtest.add_dynamic_sizing(rows, 50.0, 2.0, "leveraged")
    last = lambda c: F.ln(F.max_by(c, "datetime") / 50)
    out = rows.groupBy("symbol").agg(
        F.avg("trade_gross_pnl_static").alias("static_mean"), F.max_by("equity_curve_static", "datetime").alias("static_final"),
        last("post_trade_value_compound").alias("dynamic_log_return"), last("post_trade_value_leveraged").alias("leveraged_log_return"),
        F.ln(1 + F.sum("trade_gross_pnl_compound") / 50).alias("dynamic_total"),
    )
    return out.select(
        "symbol", r6("static_mean", 5).alias("static_mean"), r6("static_final", 5).alias("static_final"),
        r6("dynamic_log_return").alias("dynamic_log_return"), r6("leveraged_log_return").alias("leveraged_log_return"),
        r6("dynamic_total").alias("dynamic_total"),
    )


@query(
    "leverage_sweep",
    f"""WITH {SIGNALS}, x AS (SELECT symbol, leverage, leverage * exp(cum_trade_log_return - trade_log_return) AS e, leverage * exp(cum_trade_log_return) AS o
      FROM signals CROSS JOIN (SELECT unnest([1e0, 2e0, 4e0, 8e0]) AS leverage)),
    r AS (SELECT symbol, leverage, sum(o - e - (e + o) * {TAKER}e0) AS taker, sum(o - e - (e + o) * {MAKER}e0) AS maker, max(o) AS top FROM x GROUP BY symbol, leverage)
    SELECT symbol, leverage, {R('taker / top', 'net_taker_return')}, {R('maker / top', 'net_maker_return')} FROM r""",
)
def leverage_sweep(spark, sf):
    rows = study_trades(spark, sf)
    out = backtest.leverage_sweep(rows, CAPITAL, [1, 2, 4, 8], MAKER, TAKER)
    top = rows.groupBy("symbol").agg(F.exp(F.max("cum_trade_log_return")).alias("_top"))
    out = out.join(top, "symbol")
    scale = F.col("_top") * F.col("leverage")
    return out.select(
        "symbol", "leverage", r6(F.col("net_taker_return") / scale).alias("net_taker_return"),
        r6(F.col("net_maker_return") / scale).alias("net_maker_return"),
    )


@query(
    "liquidation",
    f"""WITH {SIGNALS}, l AS (SELECT symbol, datetime, dir_signal, low, high,
      CASE WHEN dir_signal = 1 THEN open * 4e0 / (5 - 0.005e0 * 4) WHEN dir_signal = -1 THEN open * 4e0 / (3 + 0.005e0 * 4) END AS liquidation_price FROM signals)
    SELECT symbol, datetime, {R('liquidation_price', digits=5)}, CASE WHEN dir_signal = 1 THEN low ELSE high END AS worst_price,
      coalesce((dir_signal = 1 AND low <= liquidation_price) OR (dir_signal = -1 AND high >= liquidation_price), false) AS liquidated FROM l""",
)
def liquidation(spark, sf):
    out = backtest.add_liquidation(study_trades(spark, sf), 4.0)
    return out.select("symbol", "datetime", r6("liquidation_price", 5).alias("liquidation_price"), "worst_price", "liquidated")


@query(
    "liquidated_counts",
    f"""WITH {SIGNALS}, x AS (SELECT *, unnest([2e0, 4e0, 10e0, 50e0]) AS leverage FROM signals)
    SELECT symbol, leverage, count(*) AS n FROM x
    WHERE (dir_signal = 1 AND low <= open * leverage / (leverage + 1 - 0.005e0 * leverage))
       OR (dir_signal = -1 AND high >= open * leverage / (leverage - 1 + 0.005e0 * leverage)) GROUP BY symbol, leverage""",
)
def liquidated_counts(spark, sf):
    rows = backtest.with_parameters(study_trades(spark, sf), leverage=[2, 4, 10, 50])
    hit = backtest.liquidated_trades(backtest.add_liquidation(rows, "leverage"))
    return hit.groupBy("symbol", "leverage").agg(F.count(F.lit(1)).alias("n"))


SCORED = f"""{rows_sql()}, scored AS (SELECT *, 1 / (1 + exp(-4 * y_hat)) AS p FROM study),
    acted AS (SELECT *, CAST(p >= 0.5e0 AS INTEGER) AS y_pred_binary, CAST(close_log_return > 0 AS INTEGER) AS up FROM scored)"""


def scored_rows(spark, sf):
    rows = study_rows(spark, sf).withColumn("p", sigmoid(F.col("y_hat") * 4))
    return rows.withColumns({"y_pred_binary": (F.col("p") >= 0.5).cast("int"), "up": (F.col("close_log_return") > 0).cast("int")})


@query(
    "threshold_strategy",
    f"""WITH {SCORED}, t AS (SELECT symbol, p >= 0.55e0 OR p <= 0.45e0 AS sure, CASE WHEN y_pred_binary = 1 THEN 1 ELSE -1 END * close_log_return AS r FROM acted)
    SELECT symbol, count(*) AS all_trades, count(*) FILTER (WHERE sure) AS confident_trades, count(*) FILTER (WHERE NOT sure) AS skipped_trades,
      {R('sum(r)', 'all_return')}, {R('coalesce(sum(r) FILTER (WHERE sure), 0)', 'confident_return')} FROM t GROUP BY symbol""",
)
def threshold_strategy(spark, sf):
    side = F.when(F.col("y_pred_binary") == 1, 1).otherwise(-1)
    rows = scored_rows(spark, sf).withColumn("trade_log_return", side * F.col("close_log_return"))
    out = backtest.compare_strategies(rows, "p")
    return rounded(out, "symbol", "all_trades", "confident_trades", "skipped_trades", "all_return", "confident_return")


@query(
    "drawdown_path",
    f"""WITH {SIGNALS}, e AS (SELECT symbol, datetime, drawdown_log_return, exp(cum_trade_log_return) AS equity FROM signals)
    SELECT symbol, datetime, {R('drawdown_log_return')}, {R(f'(equity - max(equity) {RUN}) / max(equity) {RUN}', 'drawdown_pct')} FROM e""",
)
def drawdown_path(spark, sf):
    rows = study_results(spark, sf).withColumn("equity", F.exp("equity_curve"))
    out = backtest.add_percent_drawdown(rows, "equity")
    return rounded(out, "symbol", "datetime", "drawdown_log_return", "drawdown_pct")


@query(
    "drawdown_stop",
    f"""WITH {SIGNALS}, e AS (SELECT symbol, datetime, exp(cum_trade_log_return) AS equity FROM signals),
    d AS (SELECT *, equity / max(equity) {RUN} - 1 AS drawdown_pct FROM e)
    SELECT symbol, datetime, coalesce(max(CAST(drawdown_pct < -0.2e0 AS INTEGER)) OVER (PARTITION BY symbol ORDER BY datetime
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM d""",
)
def drawdown_stop(spark, sf):
    rows = study_trades(spark, sf).withColumn("equity", F.exp("cum_trade_log_return"))
    return backtest.add_drawdown_stop(rows, "equity", 0.2).select("symbol", "datetime", "stopped")


FRAMES = {"6h": ("6 hours", 1460), "12h": ("12 hours", 730), "1d": ("1 day", 365)}


def _frame_sql(tag: str, every: str, periods: int) -> str:
    """One timeframe's figures; its CTE names are kept apart by nesting."""
    inner = RESULTS.replace(rows_sql(), rows_sql(every))
    return f"""SELECT '{tag}' AS "interval", * FROM (WITH {inner} {figures_sql('results', 'symbol', f'sqrt({periods})')})"""


@query(
    "timeframe_compare",
    f"""SELECT symbol, "interval", no_trades, {RS(*FIGURES)} FROM ({' UNION ALL '.join(_frame_sql(t, e, p) for t, (e, p) in FRAMES.items())})""",
)
def timeframe_compare(spark, sf):
    opened, high, low, _ = bars.ohlc_aggs()
    first = (opened, high, low, F.sum("price").alias("paid"), F.count(F.lit(1)).alias("n"))
    later = (
        F.min_by("open", "datetime").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.sum("paid").alias("paid"), F.sum("n").alias("n"),
    )
    tables = bars.bar_ladder(event_trades(spark, sf), list(FRAMES), *first, coarser=later)
    tables = {every: table.withColumn("close", F.col("paid") / F.col("n")) for every, table in tables.items()}
    return figures(research.compare_timeframes(tables, WEIGHTS, BIAS), "symbol", "interval")


@query(
    "final_equity",
    f"WITH {SIGNALS} SELECT symbol, {R('arg_max(cum_trade_log_return, datetime)', 'equity')} FROM signals GROUP BY symbol",
)
def final_equity(spark, sf):
    rows = study_trades(spark, sf).withColumnRenamed("cum_trade_log_return", "equity")
    return rounded(metrics.last_value(rows, "equity"), "symbol", "equity")


@query(
    "leaderboard",
    f"""WITH {RESULTS}, f AS ({figures_sql('results', 'symbol', '1')}) SELECT symbol, {R('sharpe')} FROM f ORDER BY f.sharpe DESC, symbol LIMIT 3""",
)
def leaderboard(spark, sf):
    out = metrics.performance(study_results(spark, sf)).select("symbol", "sharpe")
    return metrics.leaderboard(out, "sharpe", 3, ["symbol"]).select("symbol", r6("sharpe").alias("sharpe"))


@query(
    "random_baseline",
    f"""WITH {RESULTS}, r AS (SELECT *, CASE WHEN ((CAST(epoch(datetime) AS BIGINT) + 99) % 2147483648 * 2654435761) % 4294967296 >= 2147483648
      THEN 1 ELSE -1 END AS coin FROM results)
    SELECT symbol, datetime, coin, {R('equity_curve')}, {R(f'equity_curve - sum(coin * close_log_return) {RUN}', 'excess')} FROM r""",
)
def random_baseline(spark, sf):
    """A coin-flip strategy and how far the model is ahead of it."""
    rows = study_results(spark, sf).withColumn("coin", features.random_signal(F.unix_seconds("datetime"), 99))
    rows = rows.withColumn("coin_return", F.col("coin") * F.col("close_log_return"))
    out = ordered.with_running(rows, ordered.BARS, sums={"coin_curve": "coin_return"})
    return out.select(
        "symbol", "datetime", "coin", r6("equity_curve").alias("equity_curve"),
        r6(F.col("equity_curve") - F.col("coin_curve")).alias("excess"),
    )


@query(
    "ordered_scan_equity",
    f"""WITH {LINES}, s AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN qty ELSE -qty END AS flow FROM lines),
    c AS (SELECT *, sum(flow) OVER w AS flow_sum, max(price) OVER w AS top_price FROM s
      WINDOW w AS (PARTITION BY symbol ORDER BY datetime, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING))
    SELECT symbol, l_orderkey, l_linenumber, l_partkey, l_suppkey, {R('flow_sum')}, {R('top_price')},
      {R('flow_sum - max(flow_sum) OVER (PARTITION BY symbol ORDER BY datetime, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)', 'below_peak')} FROM c""",
)
def ordered_scan_equity(spark, sf):
    """Running sum, running maximum and drawdown over every line, in even blocks:
    six symbols, and many lines on the same day."""
    rows = line_trades(spark, sf)
    flow = F.when(F.col("l_partkey") % 2 == 0, F.col("qty")).otherwise(-F.col("qty"))
    rows, line = ordered.even_blocks(rows, Timeline(("symbol",), LINE_ORDER))
    out = ordered.with_running(rows, line, {"flow_sum": flow}, {"peak": "flow_sum"}, {"top_price": "price"})
    return out.select(
        "symbol", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("flow_sum").alias("flow_sum"),
        r6("top_price").alias("top_price"), r6(F.col("flow_sum") - F.col("peak")).alias("below_peak"),
    )


TICK_RUN = "OVER (PARTITION BY symbol ORDER BY datetime, id ROWS UNBOUNDED PRECEDING)"


@query(
    "tick_backtest",
    f"""WITH {TRADES}, r AS (SELECT symbol, datetime, id, {SAFE_LOG} AS y FROM trades),
    l AS (SELECT *, lag(y) OVER (PARTITION BY symbol ORDER BY datetime, id) AS x FROM r),
    signed AS (SELECT symbol, datetime, id, sign(-0.5e0 * x + 0.01e0) = sign(y) AS is_won, sign(-0.5e0 * x + 0.01e0) * y AS trade_log_return
      FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
    curve AS (SELECT *, sum(trade_log_return) {TICK_RUN} AS equity_curve FROM signed),
    results AS (SELECT *, equity_curve - max(equity_curve) {TICK_RUN} AS drawdown_log_return FROM curve),
    f AS ({figures_sql('results', 'symbol', '1')})
    SELECT symbol, no_trades, {', '.join(R(n, digits=5) for n in TICK_FIGURES)} FROM f""",
)
def tick_backtest(spark, sf):
    """Features, signal, trades and figures of every tick, in even blocks throughout."""
    ticks = event_trades(spark, sf).select("symbol", "datetime", "id", "price")
    ticks, line = ordered.even_blocks(ticks, Timeline(("symbol",), ("datetime", "id")))
    rows = features.add_log_return_features(ticks, "price", 1, 1, line)
    rows = features.drop_null_rows(rows).withColumn("y_hat", F.col("price_log_return_lag_1") * -0.5 + 0.01)
    out = metrics.performance(metrics.trade_results(rows, "price_log_return", "y_hat", line))
    return rounded(out, "symbol", "no_trades", *TICK_FIGURES, digits=5)


# --- classification ---------------------------------------------------------------

CONFUSION = """SELECT symbol, count(*) FILTER (WHERE up = 0 AND y_pred_binary = 0) AS tn, count(*) FILTER (WHERE up = 0 AND y_pred_binary = 1) AS fp,
      count(*) FILTER (WHERE up = 1 AND y_pred_binary = 0) AS fn, count(*) FILTER (WHERE up = 1 AND y_pred_binary = 1) AS tp FROM acted GROUP BY symbol"""


@query("confusion", f"WITH {SCORED} {CONFUSION}")
def confusion(spark, sf):
    return classify.confusion_matrix(scored_rows(spark, sf), "up", "y_pred_binary")


@query(
    "confusion_labels",
    """SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp,
      count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp FROM labels""",
)
def confusion_labels(spark, sf):
    return classify.confusion_matrix(table(spark, sf, "labels"), "quality", "toxic", ())


@query(
    "class_metrics",
    f"""WITH {SCORED}, c AS ({CONFUSION})
    SELECT symbol, {R('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {R('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision_up')},
      {R('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall_up')}, {R('coalesce(tn / nullif(tn + fn, 0), 0)', 'precision_down')},
      {R('(fp + tp) / (tp + tn + fp + fn)', 'long_ratio')}, {R('(fn + tn) / (tp + tn + fp + fn)', 'short_ratio')},
      {R('(fp + tp) / nullif(fn + tn, 0)', 'imbalance')} FROM c""",
)
def class_metrics(spark, sf):
    out = classify.class_metrics(classify.confusion_matrix(scored_rows(spark, sf), "up", "y_pred_binary"))
    return rounded(out, "symbol", "accuracy", "precision_up", "recall_up", "precision_down", "long_ratio", "short_ratio", "imbalance")


@query(
    "class_balance",
    f"WITH {SCORED} SELECT symbol, {R('avg(up)', 'up_share')}, count(*) AS n FROM acted GROUP BY symbol",
)
def class_balance(spark, sf):
    out = scored_rows(spark, sf).groupBy("symbol").agg(F.avg("up").alias("up_share"), F.count(F.lit(1)).alias("n"))
    return rounded(out, "symbol", "up_share", "n")


# Many equal scores: whole values of the events, judged against the parity of the user.
TIED = "tied AS (SELECT event_type AS symbol, CAST(floor(value / 5) AS DOUBLE) AS score, CAST(user_id % 2 AS INTEGER) AS y FROM events)"


def tied_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.floor(F.col("value") / 5).cast("double").alias("score"),
        (F.col("user_id") % 2).cast("int").alias("y"),
    )


@query(
    "roc_points",
    f"""WITH {TIED}, c AS (SELECT symbol, score, sum(y) AS pos, sum(1 - y) AS neg FROM tied GROUP BY symbol, score)
    SELECT symbol, score AS threshold, {R('sum(neg) OVER (PARTITION BY symbol ORDER BY score DESC) / sum(neg) OVER (PARTITION BY symbol)', 'fpr')},
      {R('sum(pos) OVER (PARTITION BY symbol ORDER BY score DESC) / sum(pos) OVER (PARTITION BY symbol)', 'tpr')} FROM c""",
)
def roc_points(spark, sf):
    return rounded(classify.roc_points(tied_rows(spark, sf), "y", "score"), "symbol", "threshold", "fpr", "tpr")


@query(
    "roc_auc",
    f"""WITH {TIED}, k AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY score) + (count(*) OVER (PARTITION BY symbol, score) - 1) / 2 AS r FROM tied),
    a AS (SELECT symbol, sum(r) FILTER (WHERE y = 1) AS ranks, sum(y) AS p, sum(1 - y) AS n FROM k GROUP BY symbol)
    SELECT symbol, {R('(ranks - p * (p + 1) / 2) / (p * n)', 'auc')} FROM a""",
)
def roc_auc(spark, sf):
    return rounded(classify.roc_auc(tied_rows(spark, sf), "y", "score"), "symbol", "auc")


@query("model_auc", f"""WITH {SCORED}, k AS (SELECT symbol, up AS y, rank() OVER (PARTITION BY symbol ORDER BY p) AS r FROM acted),
    a AS (SELECT symbol, sum(r) FILTER (WHERE y = 1) AS ranks, sum(y) AS p, sum(1 - y) AS n FROM k GROUP BY symbol)
    SELECT symbol, {R('(ranks - p * (p + 1) / 2) / (p * n)', 'auc')} FROM a""")
def model_auc(spark, sf):
    return rounded(classify.roc_auc(scored_rows(spark, sf), "up", "p"), "symbol", "auc")


# --- orders and fills ---------------------------------------------------------------

PAIRED = f"""{SIGNALS}, sized AS (SELECT symbol, datetime, CAST(open AS DECIMAL(18,8)) AS price,
      CAST(100e0 / open * dir_signal AS DECIMAL(18,8)) AS new_qty FROM signals),
    held AS (SELECT *, lag(new_qty) OVER (PARTITION BY symbol ORDER BY datetime) AS old_qty FROM sized),
    orders_out AS (SELECT symbol, datetime, 0 AS seq, -old_qty AS signed_qty, price FROM held WHERE old_qty <> 0
      UNION ALL SELECT symbol, datetime, 1 AS seq, new_qty AS signed_qty, price FROM held WHERE new_qty <> 0)"""


def _orders(spark, sf):
    """A hundred of capital behind every signal, at the bar's opening price."""
    rows = study_trades(spark, sf).withColumns(
        {"account": F.lit("main"), "equity": F.lit(100.0)}
    ).withColumn("qty", ledger.compound_order_size("y_hat", "equity", "open"))
    return ledger.order_pairs(rows, "qty", "open")


@query(
    "order_pairs",
    f"WITH {PAIRED} SELECT 'main' AS account, symbol, datetime, seq, {R('signed_qty')}, {R('price')} FROM orders_out",
)
def order_pairs(spark, sf):
    return rounded(_orders(spark, sf), "account", "symbol", "datetime", "seq", "signed_qty", "price")


@query(
    "fills_ledger",
    f"""WITH {PAIRED}, run AS (SELECT *, sum(signed_qty) OVER w AS position, -sum(CAST(signed_qty AS DOUBLE) * CAST(price AS DOUBLE)) OVER w AS cash
      FROM orders_out WINDOW w AS (PARTITION BY symbol ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING)),
    booked AS (SELECT *, coalesce(last_value(CASE WHEN position = 0 THEN cash END IGNORE NULLS)
      OVER (PARTITION BY symbol ORDER BY datetime, seq ROWS UNBOUNDED PRECEDING), 0) AS done FROM run)
    SELECT 'main' AS account, symbol, datetime, seq, {R('position')},
      {R('done - coalesce(lag(done) OVER (PARTITION BY symbol ORDER BY datetime, seq), 0)', 'pnl', 4)}, {R('1000 + done', 'balance', 4)} FROM booked""",
)
def fills_ledger(spark, sf):
    out = ledger.fills(_orders(spark, sf), 1000.0)
    return out.select(
        "account", "symbol", "datetime", "seq", r6("position").alias("position"), r6("pnl", 4).alias("pnl"),
        r6("balance", 4).alias("balance"),
    )


def _average_cost(orders: str) -> str:
    """Position, profit and balance of ``orders (symbol, n, datetime, s, p)`` at average cost, order after order."""
    closing = "f.position <> 0 AND sign(f.position) * sign(o.s) < 0"
    left = "f.position + o.s"
    cost = f"""CASE WHEN {left} = 0 THEN 0e0 WHEN sign({left}) * sign(f.position) < 0 THEN ({left}) * o.p
        WHEN {closing} THEN f.cost * CAST({left} AS DOUBLE) / CAST(f.position AS DOUBLE) ELSE f.cost + o.s * o.p END"""
    return f"""filled AS (
      SELECT symbol, n, datetime, s AS position, CAST(s * p AS DOUBLE) AS cost, 0e0 AS pnl, 1000e0 AS balance FROM {orders} WHERE n = 1
      UNION ALL
      SELECT symbol, n, datetime, position, cost, earned, balance + earned FROM (
        SELECT o.symbol, o.n, o.datetime, {left} AS position, {cost} AS cost, f.balance, CAST(-o.s * o.p AS DOUBLE) + ({cost}) - f.cost AS earned
        FROM filled f JOIN {orders} o ON o.symbol = f.symbol AND o.n = f.n + 1))"""


def _net_sql(target: str) -> str:
    """One order from each target quantity to the next."""
    return f"""{SIGNALS}, sized AS (SELECT symbol, datetime, CAST(open AS DECIMAL(18,8)) AS price, CAST({target} AS DECIMAL(18,8)) AS new_qty FROM signals),
    net AS (SELECT symbol, datetime, price, new_qty - coalesce(lag(new_qty) OVER (PARTITION BY symbol ORDER BY datetime), 0) AS signed_qty FROM sized),
    o AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS n, datetime, CAST(signed_qty AS DECIMAL(19,8)) AS s, price AS p
      FROM net WHERE signed_qty <> 0), {_average_cost('o')}
    SELECT symbol, datetime, {R('position')}, {R('pnl', digits=3)}, {R('balance', digits=3)} FROM filled"""


def _filled(orders):
    net = orders.groupBy("account", "symbol", "datetime", "price").agg(F.sum("signed_qty").cast(ledger.QTY).alias("signed_qty"))
    out = ledger.fills(net.where("signed_qty <> 0").withColumn("seq", F.lit(0)), 1000.0)
    return out.select("symbol", "datetime", r6("position").alias("position"), r6("pnl", 3).alias("pnl"), r6("balance", 3).alias("balance"))


@query("fills_reversal", "WITH RECURSIVE " + _net_sql("100e0 / open * dir_signal"))
def fills_reversal(spark, sf):
    """The same targets reached with one order each, which often turns the position around or closes a part of it."""
    return _filled(_orders(spark, sf))


@query("fills_partial", "WITH RECURSIVE " + _net_sql("100e0 / open * dir_signal * (1 + day(datetime) % 3)"))
def fills_partial(spark, sf):
    """One, two or three hundred of capital behind a signal, by the day: positions are added to and partly closed."""
    rows = study_trades(spark, sf).withColumns({"account": F.lit("main"), "equity": F.lit(100.0)})
    qty = ledger.compound_order_size("y_hat", "equity", "open", 1 + F.dayofmonth("datetime") % 3)
    return _filled(ledger.order_pairs(rows.withColumn("qty", qty), "qty", "open"))


# --- nets of known weights -----------------------------------------------------------

NET = {"w1": [[0.5, -0.2, 0.1], [-0.3, 0.4, 0.2]], "b1": [0.01, -0.02], "w2": [[1.5, -0.7]], "b2": [0.003]}


@query(
    "nn_forward",
    f"""WITH {rows_sql()}, h AS (SELECT symbol, datetime,
      greatest(0.5e0 * {LAGS[0]} - 0.2e0 * {LAGS[1]} + 0.1e0 * {LAGS[2]} + 0.01e0, 0) AS h1,
      greatest(-0.3e0 * {LAGS[0]} + 0.4e0 * {LAGS[1]} + 0.2e0 * {LAGS[2]} - 0.02e0, 0) AS h2,
      tanh(0.3e0 * {LAGS[0]} + 0.1e0 * {LAGS[0]} + 0.16421e0) AS y_tanh FROM study)
    SELECT symbol, datetime, {R('1.5e0 * h1 - 0.7e0 * h2 + 0.003e0', 'y_net')}, {R('y_tanh')} FROM h""",
)
def nn_forward(spark, sf):
    rows = features.drop_null_rows(study_features(spark, sf))
    rows = research.add_model_predictions(rows, nets.net_model("one_hidden", NET), LAGS, name="y_net")
    unit = nets.net_model("tanh_unit", {"w": [0.3, 0.1], "b": 0.16421})
    rows = research.add_model_predictions(rows, unit, [LAGS[0], LAGS[0]], name="y_tanh")
    return rounded(rows, "symbol", "datetime", "y_net", "y_tanh")


DEEP = {
    "w0": [[0.8, -0.3, 0.5], [-0.6, 0.9, 0.2]], "b0": [0.05, -0.01], "gamma0": [1.2, 0.7], "beta0": [0.1, 0.2], "mean0": [0.02, -0.03],
    "var0": [0.5, 2.0], "w": [[1.1, -0.4]], "b": [0.02],
}
ATTENTION = {f"{k}{n}": v for n in "qkv" for k, v in (("w", [[1.0, 0.0], [0.0, 1.0]]), ("b", [0.0, 0.0]))} | {"w": [[1.0, 0.5]], "b": [0.1]}


def _unit(i: int) -> str:
    w, (b, g, o, m, v) = DEEP["w0"][i], (DEEP[f"{k}0"][i] for k in ("b", "gamma", "beta", "mean", "var"))
    dense = " + ".join(f"({k}e0) * {x}" for k, x in zip(w, LAGS))
    return f"greatest((({dense}) + ({b}e0) - ({m}e0)) / sqrt({v}e0 + 1e-5) * {g}e0 + {o}e0, 0)"


def _attended(i: int) -> str:
    x = LAGS[:2]
    powers = [f"exp({x[i]} * {y} / sqrt(2e0))" for y in x]
    return f"({powers[0]} * {x[0]} + {powers[1]} * {x[1]}) / ({powers[0]} + {powers[1]})"


@query(
    "nn_deep",
    f"""WITH {rows_sql()} SELECT symbol, datetime, {R(f"1.1e0 * {_unit(0)} - 0.4e0 * {_unit(1)} + 0.02e0", 'y_deep')},
      {R(f"{_attended(0)} + 0.5e0 * ({_attended(1)}) + 0.1e0", 'y_attention')} FROM study""",
)
def nn_deep(spark, sf):
    """Batch-normalised layers and attention, as column expressions."""
    rows = features.drop_null_rows(study_features(spark, sf))
    rows = research.add_model_predictions(rows, nets.net_model("deep", DEEP), LAGS, name="y_deep")
    rows = research.add_model_predictions(rows, nets.net_model("attention", ATTENTION), LAGS[:2], name="y_attention")
    return rounded(rows, "symbol", "datetime", "y_deep", "y_attention")


LSTM = {"wx0": [[0.5], [0.4], [1.3], [0.2]], "wh0": [[0.1], [0.2], [-0.7], [0.4]], "b0": [0.0, 1.0, 0.1, 0.2], "w": [[2.0]], "b": [0.5]}


def _lstm_sql() -> str:
    """One unit over the three lags, oldest first, step by step."""
    steps, source = [], f"s0 AS (SELECT symbol, datetime, {', '.join(LAGS)}, 0e0 AS h, 0e0 AS c FROM study)"
    for n, x in enumerate(reversed(LAGS)):
        gates = [f"{LSTM['wx0'][k][0]}e0 * {x} + ({LSTM['wh0'][k][0]}e0) * h + {LSTM['b0'][k]}e0 AS {g}" for k, g in enumerate("zfgo")]
        cell = "c / (1 + exp(-f)) + tanh(g) / (1 + exp(-z))"
        steps.append(f"""s{n + 1} AS (SELECT symbol, datetime, {', '.join(LAGS)}, tanh({cell}) / (1 + exp(-o)) AS h, {cell} AS c
      FROM (SELECT *, {', '.join(gates)} FROM s{n}))""")
    return ", ".join([source, *steps])


@query("nn_lstm", f"WITH {rows_sql()}, {_lstm_sql()} SELECT symbol, datetime, {R('2e0 * h + 0.5e0', 'y_lstm')} FROM s3")
def nn_lstm(spark, sf):
    rows = features.drop_null_rows(study_features(spark, sf))
    rows = research.add_model_predictions(rows, nets.net_model("lstm", LSTM), list(reversed(LAGS)), name="y_lstm")
    return rounded(rows, "symbol", "datetime", "y_lstm")
