"""Shared parts of the query catalogue: the registry, common frames and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maths import dot
from ..operators.backtest import add_signal
from ..operators.bars import ohlc_aggs, resample
from ..operators.features import add_log_return_features, drop_null_rows, lag_names
from ..operators.metrics import trade_results
from ..sources.sample_tables import event_trades

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return naive_times(f(spark, folder))

        run.__name__ = run.__qualname__ = name
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def naive_times(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the tables store them."""
    zoned = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned}) if zoned else df


def r6(value: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str, digits: int = 6, **named: str | Column) -> DataFrame:
    """``keep`` columns as they are; float ones rounded."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    cols = [r6(c, digits).alias(c) if c in floats else F.col(c) for c in keep]
    return df.select(*cols, *[r6(v, digits).alias(n) for n, v in named.items()])


def R(expr: str, name: str | None = None, digits: int = 6) -> str:
    """SQL counterpart of :func:`r6`."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name or expr}"


def RS(*names: str, digits: int = 6) -> str:
    return ", ".join(R(n, digits=digits) for n in names)


# --- common frames -----------------------------------------------------------

WEIGHTS, BIAS = (-0.5, -0.1, 0.05), 0.001  # a fixed AR(3) model
LAGS = lag_names("close_log_return", 3)
MAKER, TAKER = 0.0002, 0.00055
CAPITAL = 100.0


def study_bars(spark: SparkSession, folder: str, every: str = "12h") -> DataFrame:
    """Bars of the events whose close is the bar's mean price.

    Event values jump between 0 and 490 from one row to the next; the mean keeps
    log returns near one, so compounded figures stay comparable digit by digit.
    """
    trades = event_trades(spark, folder)
    opened, high, low, _ = ohlc_aggs()
    return resample(trades, every, opened, high, low, F.avg("price").alias("close"), F.sum("qty").alias("volume"))


def study_features(spark: SparkSession, folder: str, every: str = "12h") -> DataFrame:
    return add_log_return_features(study_bars(spark, folder, every), "close", 1, 3)


def study_rows(spark: SparkSession, folder: str, every: str = "12h") -> DataFrame:
    """Complete feature rows with the fixed model's prediction."""
    rows = drop_null_rows(study_features(spark, folder, every))
    return rows.withColumn("y_hat", dot(LAGS, WEIGHTS, BIAS))


def study_trades(spark: SparkSession, folder: str) -> DataFrame:
    return add_signal(study_rows(spark, folder))


def study_results(spark: SparkSession, folder: str) -> DataFrame:
    return trade_results(study_rows(spark, folder))


# --- the same frames in SQL ---------------------------------------------------

TRADES = """trades AS (
  SELECT 'Binance' AS exchange, event_type AS symbol, event_id AS id, ts AS datetime, value AS price,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS qty,
         value * CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS quoteQty,
         user_id % 2 = 0 AS isBuyerMaker, CAST(ts AS DATE) AS date
  FROM events)"""

LINES = """lines AS (
  SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS datetime, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         l_extendedprice / l_quantity AS price, l_quantity AS qty
  FROM lineitem)"""
LINE_KEY = "(datetime, l_orderkey, l_linenumber, l_partkey, l_suppkey)"


# A log return exists between two positive prices only.
SAFE_LOG = """CASE WHEN price > 0 AND lag(price) OVER (PARTITION BY symbol ORDER BY datetime, id) > 0
        THEN ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY datetime, id)) END"""


def bucket(every: str) -> str:
    return f"time_bucket(INTERVAL '{every}', datetime)"


def ohlc_sql(every: str, source: str = "trades", order: str = "(datetime, id)") -> str:
    return f"""SELECT symbol, {bucket(every)} AS datetime, arg_min(price, {order}) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, {order}) AS close
  FROM {source} GROUP BY symbol, {bucket(every)}"""


def bars_sql(every: str = "12 hours") -> str:
    return f"""{TRADES}, bars AS (
  SELECT symbol, {bucket(every)} AS datetime, arg_min(price, (datetime, id)) AS open, max(price) AS high,
         min(price) AS low, avg(price) AS close, sum(qty) AS volume
  FROM trades GROUP BY symbol, {bucket(every)})"""


def feats_sql(every: str = "12 hours") -> str:
    return f"""{bars_sql(every)}, returns AS (
  SELECT *, CASE WHEN close > 0 AND lag(close) OVER (PARTITION BY symbol ORDER BY datetime) > 0
      THEN ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY datetime)) END AS close_log_return FROM bars),
feats AS (
  SELECT *, lag(close_log_return, 1) OVER w AS close_log_return_lag_1,
         lag(close_log_return, 2) OVER w AS close_log_return_lag_2,
         lag(close_log_return, 3) OVER w AS close_log_return_lag_3
  FROM returns WINDOW w AS (PARTITION BY symbol ORDER BY datetime))"""


Y_HAT = "close_log_return_lag_1 * -0.5e0 + close_log_return_lag_2 * -0.1e0 + close_log_return_lag_3 * 0.05e0 + 0.001e0"


def rows_sql(every: str = "12 hours") -> str:
    return f"""{feats_sql(every)}, study AS (
  SELECT *, {Y_HAT} AS y_hat FROM feats WHERE close_log_return IS NOT NULL AND close_log_return_lag_1 IS NOT NULL
    AND close_log_return_lag_2 IS NOT NULL AND close_log_return_lag_3 IS NOT NULL)"""


RESULTS = f"""{rows_sql()}, signed AS (
  SELECT *, y_hat AS y_pred, close_log_return AS y_true, sign(y_hat) = sign(close_log_return) AS is_won,
         CAST(sign(y_hat) AS DOUBLE) AS position, sign(y_hat) * close_log_return AS trade_log_return FROM study),
curve AS (
  SELECT *, sum(trade_log_return) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS equity_curve FROM signed),
results AS (
  SELECT *, equity_curve - max(equity_curve) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS drawdown_log_return
  FROM curve)"""

SIGNALS = f"""{RESULTS}, signals AS (
  SELECT *, position AS dir_signal, equity_curve AS cum_trade_log_return FROM results)"""


def figures_sql(source: str, keys: str, factor: str) -> str:
    """The sixteen figures (without the two labels) of a results table."""
    return f"""SELECT {keys}, count(*) AS no_trades, avg(CAST(is_won AS DOUBLE)) AS win_rate,
    avg(trade_log_return) FILTER (WHERE is_won) AS avg_win, avg(trade_log_return) FILTER (WHERE NOT is_won) AS avg_loss,
    max(trade_log_return) AS best_trade, min(trade_log_return) AS worst_trade,
    avg(CAST(is_won AS DOUBLE)) * coalesce(avg(trade_log_return) FILTER (WHERE is_won), 0)
      + (1 - avg(CAST(is_won AS DOUBLE))) * coalesce(avg(trade_log_return) FILTER (WHERE NOT is_won), 0) AS ev,
    stddev_samp(trade_log_return) AS std, sum(trade_log_return) AS total_log_return,
    ln(exp(sum(trade_log_return))) AS log_compound_return, min(drawdown_log_return) AS max_drawdown,
    min(equity_curve) AS equity_trough, max(equity_curve) AS equity_peak,
    CASE WHEN stddev_samp(trade_log_return) > 0 THEN avg(trade_log_return) / stddev_samp(trade_log_return) * {factor} ELSE 0 END AS sharpe
  FROM {source} GROUP BY {keys}"""


FIGURES = [
    "win_rate", "avg_win", "avg_loss", "best_trade", "worst_trade", "ev", "std", "total_log_return",
    "log_compound_return", "max_drawdown", "equity_trough", "equity_peak", "sharpe",
]


def figures(df: DataFrame, *keys: str) -> DataFrame:
    out = df.withColumn("log_compound_return", F.ln("compound_return"))
    return rounded(out, *keys, "no_trades", *FIGURES)
