"""Catalogue: streams, run to the end of what is available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.maths import direction, dot, log_ratio
from ..operators.features import add_log_return, add_log_return_features, lag_names
from ..operators.ordered import BARS as CLOSES
from ..operators.ordered import with_lags, with_last_values
from ..sources.sample_tables import as_trades, table
from ..streaming import bars as live_bars
from ..streaming import ticks
from ..streaming.run import latest_rows, read_stream, run_to_table
from .base import BIAS, LAGS, R, RS, SAFE_LOG, TRADES, WEIGHTS, bucket, ohlc_sql, query, r6, rounded

DELAY = "10 minutes"


def _trades(spark, sf):
    return as_trades(read_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema))


@query("stream_ohlc", f"WITH {TRADES} {ohlc_sql('12 hours')}")
def stream_ohlc(spark, sf):
    """Every bar, open ones included (update mode, last version of each bar)."""
    path = run_to_table(live_bars.stream_bars(_trades(spark, sf), "12h", delay=DELAY), "update")
    return latest_rows(spark.read.parquet(path), ["symbol", "datetime"])


@query(
    "stream_closed_bars",
    f"""WITH {TRADES}, b AS ({ohlc_sql('12 hours')}) SELECT * FROM b
    WHERE datetime + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
)
def stream_closed_bars(spark, sf):
    """Only bars the watermark has closed, each once (append mode)."""
    path = run_to_table(live_bars.stream_bars(_trades(spark, sf), "12h", delay=DELAY))
    return spark.read.parquet(path).drop("batch_id")


@query("stream_last", f"WITH {TRADES} SELECT symbol, arg_max(price, (datetime, id)) AS price, max(datetime) AS datetime FROM trades GROUP BY symbol")
def stream_last(spark, sf):
    path = run_to_table(live_bars.stream_last(_trades(spark, sf)), "update")
    return latest_rows(spark.read.parquet(path), ["symbol"])


NAMES = lag_names("log_return", 3)
TICK_LAGS = f"""{TRADES}, r AS (SELECT symbol, datetime, id, {SAFE_LOG} AS r FROM trades),
  v AS (SELECT symbol, datetime, id, r AS log_return_lag_1, lag(r, 1) OVER w AS log_return_lag_2, lag(r, 2) OVER w AS log_return_lag_3
    FROM r WINDOW w AS (PARTITION BY symbol ORDER BY datetime, id))"""


@query("stream_lags", f"WITH {TICK_LAGS} SELECT symbol, id, {RS(*NAMES)} FROM v")
def stream_lags(spark, sf):
    out = ticks.run_lag_stream(_trades(spark, sf), 3)
    return rounded(out, "symbol", "id", *NAMES)


@query(
    "stream_signals",
    f"""WITH {TICK_LAGS}, p AS (SELECT *, log_return_lag_1 * -0.5e0 + log_return_lag_2 * -0.1e0 + log_return_lag_3 * 0.05e0 + 0.001e0 AS y_hat FROM v)
    SELECT symbol, id, {R('y_hat')}, CAST(sign(y_hat) AS DOUBLE) AS dir_signal FROM p""",
)
def stream_signals(spark, sf):
    out = ticks.run_lag_stream(_trades(spark, sf), 3, WEIGHTS, BIAS)
    return rounded(out, "symbol", "id", "y_hat", "dir_signal")


def _closed_means(spark, sf):
    """A stream over the table of closed bars (bar close = mean price)."""
    means = live_bars.stream_bars(_trades(spark, sf), "12h", F.avg("price").alias("close"), delay=DELAY)
    path = run_to_table(means)
    return read_stream(spark, f"{path}/batch_id=*", spark.read.parquet(path).drop("batch_id").schema)


MEANS = f"""{TRADES}, means AS (SELECT symbol, {bucket('12 hours')} AS datetime, avg(price) AS close FROM trades GROUP BY symbol, {bucket('12 hours')}),
  closed AS (SELECT * FROM means WHERE datetime + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)"""


@query(
    "stream_log_return",
    f"""WITH {MEANS}, r AS (SELECT symbol, datetime, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY datetime)) AS log_return FROM closed)
    SELECT symbol, datetime, {R('log_return')} FROM r WHERE log_return IS NOT NULL""",
)
def stream_log_return(spark, sf):
    """Log returns of closed bars: the batch operator, fed batch by batch."""
    out = ticks.run_step_stream(_closed_means(spark, sf), 1, lambda rows: add_log_return(rows, "close", line=CLOSES), CLOSES)
    return rounded(out.where("close_log_return IS NOT NULL").withColumnRenamed("close_log_return", "log_return"), "symbol", "datetime", "log_return")


@query(
    "stream_window",
    f"""WITH {MEANS} SELECT symbol, datetime, {R('lag(close, 3) OVER w', 'dropped')}, CAST(least(row_number() OVER w, 3) AS INTEGER) AS n_values,
      row_number() OVER w >= 3 AS is_full FROM closed WINDOW w AS (PARTITION BY symbol ORDER BY datetime)""",
)
def stream_window(spark, sf):
    """The last three closes, as every bar sees them."""
    out = ticks.run_step_stream(_closed_means(spark, sf), 3, lambda rows: with_last_values(rows, CLOSES, "close", 3), CLOSES)
    return out.select("symbol", "datetime", r6("dropped").alias("dropped"), F.size("window").alias("n_values"), "is_full")


RETURNS = f"""{MEANS}, p AS (SELECT *, lag(close) OVER w AS before, ln(close / lag(close) OVER w) AS r FROM closed
    WINDOW w AS (PARTITION BY symbol ORDER BY datetime))"""
RUN = "OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING)"


@query(
    "stream_equity",
    f"""WITH {RETURNS}, y AS (SELECT *, lag(r, 1) OVER w * -0.5e0 + lag(r, 2) OVER w * -0.1e0 + lag(r, 3) OVER w * 0.05e0 + 0.001e0 AS y_hat FROM p
      WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
    t AS (SELECT symbol, datetime, sign(y_hat) * r AS trade_log_return FROM y WHERE y_hat IS NOT NULL AND r IS NOT NULL),
    c AS (SELECT *, sum(trade_log_return) {RUN} AS equity_curve FROM t)
    SELECT symbol, datetime, {RS('trade_log_return', 'equity_curve')}, {R(f'equity_curve - max(equity_curve) {RUN}', 'drawdown_log_return')} FROM c""",
)
def stream_equity(spark, sf):
    """Trades of a fixed model on closed bars, their equity curve and its drawdown, batch after batch."""

    def step(rows):
        out = add_log_return_features(rows, "close", 1, 3, CLOSES)
        return out.withColumn("trade_log_return", direction(dot(LAGS, WEIGHTS, BIAS)) * F.col("close_log_return"))

    out = ticks.run_running_stream(_closed_means(spark, sf), 4, step, {"equity_curve": "trade_log_return"}, {"peak": "equity_curve"}, CLOSES)
    out = out.where("trade_log_return IS NOT NULL").withColumn("drawdown_log_return", F.col("equity_curve") - F.col("peak"))
    return rounded(out, "symbol", "datetime", "trade_log_return", "equity_curve", "drawdown_log_return")


CAPITAL, SHARE = 100.0, 0.1


@query(
    "stream_ledger",
    f"""WITH {RETURNS}, y AS (SELECT *, r * -0.5e0 + lag(r, 1) OVER w * -0.1e0 + lag(r, 2) OVER w * 0.05e0 + 0.001e0 AS y_hat FROM p
      WINDOW w AS (PARTITION BY symbol ORDER BY datetime)),
    s AS (SELECT symbol, datetime, close, before, sign(y_hat) AS side, lag(sign(y_hat)) OVER (PARTITION BY symbol ORDER BY datetime) AS held FROM y),
    g AS (SELECT *, 1 + {SHARE}e0 * coalesce(held, 0) * (close / before - 1) AS growth FROM s),
    b AS (SELECT *, {CAPITAL}e0 * exp(sum(ln(coalesce(growth, 1))) {RUN}) AS balance FROM g),
    q AS (SELECT *, {SHARE}e0 * held * balance / growth / before AS old_qty, {SHARE}e0 * side * balance / close AS qty FROM b)
    SELECT symbol, datetime, 0 AS seq, {R('-old_qty', 'signed_qty')}, {R('old_qty * (close - before)', 'pnl')}, {R('balance')} FROM q WHERE old_qty <> 0
    UNION ALL SELECT symbol, datetime, 1, {R('qty', 'signed_qty')}, 0e0 AS pnl, {R('balance')} FROM q WHERE qty <> 0""",
)
def stream_ledger(spark, sf):
    """Lags, prediction, close-and-open orders and a compounding balance, bar close by bar close.

    A position is worth a share of the balance, so a bar multiplies the balance by what follows from two prices
    and the side taken at the first: the balance is a running sum of logarithms.
    """

    def step(rows):
        back = {f"_p{i}": ("close", i) for i in range(1, 5)}
        out = with_lags(rows, CLOSES, back)
        returns = [log_ratio(a, b) for a, b in zip(["close", *back], back)]
        side = lambda r: direction(sum(w * x for w, x in zip(WEIGHTS, r)) + BIAS)
        growth = 1 + F.lit(SHARE) * F.coalesce(side(returns[1:]), F.lit(0.0)) * (F.col("close") / F.col("_p1") - 1)
        return out.withColumns({"side": side(returns[:3]), "held": side(returns[1:]), "before": F.col("_p1"), "growth": growth, "log_growth": F.ln(growth)}).drop(*back)

    out = ticks.run_running_stream(_closed_means(spark, sf), 5, step, {"log_balance": "log_growth"}, line=CLOSES)
    out = out.withColumn("balance", F.lit(CAPITAL) * F.exp(F.coalesce("log_balance", F.lit(0.0))))
    old = F.lit(SHARE) * F.col("held") * F.col("balance") / F.col("growth") / F.col("before")
    orders = F.array(
        F.struct(F.lit(0).alias("seq"), (-old).alias("signed_qty"), (old * (F.col("close") - F.col("before"))).alias("pnl")),
        F.struct(F.lit(1).alias("seq"), (F.lit(SHARE) * F.col("side") * F.col("balance") / F.col("close")).alias("signed_qty"), F.lit(0.0).alias("pnl")),
    )
    out = out.select("symbol", "datetime", "balance", F.explode(orders).alias("_o")).select("symbol", "datetime", "balance", "_o.*")
    return rounded(out.where("signed_qty <> 0"), "symbol", "datetime", "seq", "signed_qty", "pnl", "balance")
