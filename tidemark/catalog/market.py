"""Catalogue: bars, ranges, features, splits and series statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import annualization_column, sharpe_annualization_factor
from ..functions.maths import dot
from ..operators import bars, features, metrics, ordered, split, stats
from ..operators.ordered import Timeline
from ..plans.research import add_model_predictions
from ..sources import store
from ..sources.exchanges import fee_schedule, with_fees
from ..sources.sample_tables import LINE_ORDER, event_trades, line_trades, portfolio_values, table
from .base import (
    BIAS, LAGS, LINE_KEY, LINES, R, RS, SAFE_LOG, TRADES, WEIGHTS, bars_sql, bucket, feats_sql, ohlc_sql, query, r6, rounded,
    rows_sql, study_bars, study_features, study_rows,
)

TICK_LINE = Timeline(("symbol",), ("datetime", "id"))
LINE_LINE = Timeline(("symbol",), LINE_ORDER, "30d")


@query("ohlc_12h", f"WITH {TRADES} {ohlc_sql('12 hours')}")
def ohlc_12h(spark, sf):
    return bars.ohlc(event_trades(spark, sf), "12h")


@query("ohlc_1d", f"WITH {TRADES} {ohlc_sql('1 day')}")
def ohlc_1d(spark, sf):
    return bars.ohlc(event_trades(spark, sf), "1d")


@query("ohlc_weekly", f"WITH {LINES} {ohlc_sql('7 days', 'lines', LINE_KEY)}")
def ohlc_weekly(spark, sf):
    return bars.ohlc(line_trades(spark, sf), "1w", order=LINE_ORDER)


@query("ohlc_monthly", f"WITH {LINES} {ohlc_sql('1 month', 'lines', LINE_KEY)}")
def ohlc_monthly(spark, sf):
    return bars.ohlc(line_trades(spark, sf), "1mo", order=LINE_ORDER)


@query(
    "bars_custom_aggs",
    f"""WITH {TRADES} SELECT symbol, {bucket('6 hours')} AS datetime, {R('stddev_samp(price)', 'price_volatility')},
    {R('sum(qty)', 'total_volume')} FROM trades GROUP BY symbol, {bucket('6 hours')}""",
)
def bars_custom_aggs(spark, sf):
    out = bars.resample(event_trades(spark, sf), "6h", *bars.activity_aggs())
    return rounded(out, "symbol", "datetime", "price_volatility", "total_volume")


@query(
    "bars_median",
    f"""WITH {TRADES} SELECT symbol, {bucket('12 hours')} AS datetime, {R('quantile_cont(price, 0.5)', 'median')}
    FROM trades GROUP BY symbol, {bucket('12 hours')}""",
)
def bars_median(spark, sf):
    return rounded(bars.median_bars(event_trades(spark, sf), "12h"), "symbol", "datetime", "median")


@query(
    "bars_range",
    f"""WITH {TRADES} {ohlc_sql('12 hours', "(SELECT * FROM trades WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')")}""",
)
def bars_range(spark, sf):
    return bars.ohlc(event_trades(spark, sf, "2024-01-05", "2024-01-20"), "12h")


CALENDAR_1995 = "SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY)) AS DATE) AS date"


def _line_days(spark, sf):
    return line_trades(spark, sf).withColumn("date", F.to_date("datetime"))


@query(
    "missing_days",
    f"""WITH {LINES}, present AS (SELECT DISTINCT symbol, CAST(datetime AS DATE) AS date FROM lines
      WHERE datetime >= DATE '1995-01-01' AND datetime < DATE '1996-01-01'),
    calendar AS ({CALENDAR_1995})
    SELECT s.symbol, c.date FROM (SELECT DISTINCT symbol FROM present) s CROSS JOIN calendar c
    WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.symbol = s.symbol AND p.date = c.date)""",
)
def missing_days(spark, sf):
    return store.missing_days(_line_days(spark, sf), "1995-01-01", "1995-12-31")


@query(
    "coverage",
    f"""WITH {LINES} SELECT symbol, 365 AS days_asked, count(DISTINCT CAST(datetime AS DATE)) AS days_present,
    365 - count(DISTINCT CAST(datetime AS DATE)) AS days_missing,
    CAST(count(*) FILTER (WHERE NOT coalesce(price > 0, false)) AS BIGINT) AS bad_rows
    FROM lines WHERE datetime >= DATE '1995-01-01' AND datetime < DATE '1996-01-01' GROUP BY symbol""",
)
def coverage(spark, sf):
    return store.coverage(_line_days(spark, sf), "1995-01-01", "1995-12-31")


@query(
    "coarsen_bars",
    f"""WITH {TRADES}, fine AS (
      SELECT symbol, {bucket('1 hour')} AS datetime, arg_min(price, (datetime, id)) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, (datetime, id)) AS close, sum(qty) AS volume
      FROM trades GROUP BY symbol, {bucket('1 hour')})
    SELECT symbol, {bucket('12 hours')} AS datetime, arg_min(open, datetime) AS open, max(high) AS high,
      min(low) AS low, arg_max(close, datetime) AS close, sum(volume) AS volume
    FROM fine GROUP BY symbol, {bucket('12 hours')}""",
)
def coarsen_bars(spark, sf):
    fine = bars.resample(event_trades(spark, sf), "1h", *bars.ohlc_aggs(), F.sum("qty").alias("volume"))
    return bars.coarsen(fine, "12h", volume="volume")


@query(
    "yearly_stats",
    f"""WITH {LINES} SELECT symbol, CAST(date_trunc('year', datetime) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS datetime,
    {R('avg(price)', 'mean', 4)}, {R('stddev_samp(price)', 'std', 4)}
    FROM lines GROUP BY symbol, date_trunc('year', datetime)""",
)
def yearly_stats(spark, sf):
    return rounded(bars.calendar_stats(line_trades(spark, sf), "price", "1y"), "symbol", "datetime", "mean", "std", digits=4)


@query(
    "one_price_bars",
    f"""WITH {TRADES} SELECT symbol, {bucket('12 hours')} AS datetime, arg_max(price, (datetime, id)) AS close
    FROM trades GROUP BY symbol, {bucket('12 hours')}""",
)
def one_price_bars(spark, sf):
    return bars.one_price(event_trades(spark, sf), "12h", "close")


# --- features ------------------------------------------------------------------

@query(
    "log_returns_lags",
    f"WITH {feats_sql()} SELECT symbol, datetime, {RS('close', 'close_log_return', *LAGS)} FROM feats",
)
def log_returns_lags(spark, sf):
    return rounded(study_features(spark, sf), "symbol", "datetime", "close", "close_log_return", *LAGS)


@query(
    "tick_log_returns",
    f"""WITH {TRADES}, r AS (SELECT symbol, datetime, id,
      {SAFE_LOG} AS price_log_return FROM trades)
    SELECT symbol, id, {R('price_log_return')},
      {R('lag(price_log_return, 1) OVER (PARTITION BY symbol ORDER BY datetime, id)', 'price_log_return_lag_1')},
      {R('lag(price_log_return, 2) OVER (PARTITION BY symbol ORDER BY datetime, id)', 'price_log_return_lag_2')} FROM r""",
)
def tick_log_returns(spark, sf):
    """Log returns of every tick, in even blocks so that no task holds a whole symbol."""
    ticks, line = ordered.even_blocks(event_trades(spark, sf).select("symbol", "datetime", "id", "price"), TICK_LINE)
    out = features.add_log_return_features(ticks, "price", 1, 2, line)
    return rounded(out, "symbol", "id", "price_log_return", *features.lag_names("price_log_return", 2))


@query(
    "diff_simple_return",
    f"""WITH {bars_sql()}, d AS (SELECT symbol, datetime, close, close - lag(close) OVER w AS close_diff,
      (close - lag(close) OVER w) / lag(close) OVER w AS close_return FROM bars
      WINDOW w AS (PARTITION BY symbol ORDER BY datetime))
    SELECT symbol, datetime, {RS('close_diff', 'close_return')},
      {R('lag(close_diff, 1) OVER w', 'close_diff_lag_1')}, {R('lag(close_diff, 4) OVER w', 'close_diff_lag_4')},
      {R('coalesce(lag(close) OVER w, 0)', 'previous_close')}
    FROM d WINDOW w AS (PARTITION BY symbol ORDER BY datetime)""",
)
def diff_simple_return(spark, sf):
    out = features.add_difference(study_bars(spark, sf), "close")
    out = features.add_difference_lags(out, "close", 4)
    out = features.previous_or(out, "close", 0.0, "previous_close")
    return rounded(
        out, "symbol", "datetime", "close_diff", "close_return", "close_diff_lag_1", "close_diff_lag_4", "previous_close"
    )


@query(
    "rolling_last_n",
    f"""WITH {TRADES} SELECT symbol, id, CAST(least(row_number() OVER w, 5) AS INTEGER) AS n_values,
      {R('sum(price) OVER (PARTITION BY symbol ORDER BY datetime, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)', 'window_sum')},
      first_value(price) OVER (PARTITION BY symbol ORDER BY datetime, id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS oldest,
      lag(price, 5) OVER w AS dropped, row_number() OVER w >= 5 AS is_full
    FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY datetime, id)""",
)
def rolling_last_n(spark, sf):
    ticks, line = ordered.even_blocks(event_trades(spark, sf).select("symbol", "datetime", "id", "price"), TICK_LINE)
    out = ordered.with_last_values(ticks, line, "price", 5)
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "symbol", "id", F.size("window").alias("n_values"), r6(total).alias("window_sum"),
        F.get("window", F.lit(0)).alias("oldest"), "dropped", "is_full",
    )


@query(
    "portfolio_path",
    f"""WITH {feats_sql()}, p AS (SELECT symbol, datetime, close_log_return,
      sum(coalesce(close_log_return, 0)) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS cum_log_return FROM feats)
    SELECT symbol, datetime, {RS('close_log_return', 'cum_log_return')}, {R('100 * exp(cum_log_return)', 'portfolio_value')} FROM p""",
)
def portfolio_path(spark, sf):
    out = features.portfolio_path(study_bars(spark, sf))
    return rounded(out, "symbol", "datetime", "close_log_return", "cum_log_return", "portfolio_value")


@query(
    "direction_target",
    f"""WITH {feats_sql()} SELECT symbol, datetime, CAST(close_log_return > 0 AS INTEGER) AS close_log_return_dir FROM feats""",
)
def direction_target(spark, sf):
    return features.add_direction_target(study_features(spark, sf)).select("symbol", "datetime", "close_log_return_dir")


@query(
    "standardise",
    f"""WITH {rows_sql()}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS row_no,
      count(*) OVER (PARTITION BY symbol) AS n_rows FROM study),
    marked AS (SELECT *, row_no < floor(n_rows * 0.75e0) AS is_train FROM numbered),
    stats AS (SELECT symbol, {', '.join(f'avg({c}) AS m{i}, stddev_pop({c}) AS s{i}' for i, c in enumerate(LAGS))}
      FROM marked WHERE is_train GROUP BY symbol)
    SELECT symbol, datetime, is_train, {', '.join(R(f'({c} - m{i}) / s{i}', f'{c}_scaled') for i, c in enumerate(LAGS))}
    FROM marked JOIN stats USING (symbol)""",
)
def standardise(spark, sf):
    out = features.standardise(split.with_split(study_rows(spark, sf)), LAGS)
    return rounded(out, "symbol", "datetime", "is_train", *[f"{c}_scaled" for c in LAGS])


# --- splits and folds ----------------------------------------------------------

@query(
    "chrono_split",
    f"""WITH {TRADES}, n AS (SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY datetime, id) - 1 AS row_no,
      count(*) OVER (PARTITION BY symbol) AS n_rows FROM trades)
    SELECT symbol, id, row_no, n_rows, row_no < floor(n_rows * 0.75e0) AS is_train FROM n""",
)
def chrono_split(spark, sf):
    """A split of raw ticks; positions come from block counts."""
    ticks, line = ordered.even_blocks(event_trades(spark, sf).select("symbol", "datetime", "id"), TICK_LINE)
    return split.with_split(ticks, 0.25, line).select("symbol", "id", "row_no", "n_rows", "is_train")


RATIOS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


@query(
    "split_ratios",
    f"""WITH {bars_sql()}, n AS (SELECT symbol, datetime, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS row_no,
      count(*) OVER (PARTITION BY symbol) AS n_rows FROM bars),
    x AS (SELECT *, row_no < floor(n_rows * train_size) AS is_train FROM n
      CROSS JOIN (SELECT unnest([{', '.join(f'{r}e0' for r in RATIOS)}]) AS train_size))
    SELECT symbol, train_size, is_train, count(*) AS n, min(datetime) AS first_bar, max(datetime) AS last_bar
    FROM x GROUP BY symbol, train_size, is_train""",
)
def split_ratios(spark, sf):
    out = split.with_train_ratios(study_bars(spark, sf), RATIOS)
    return out.groupBy("symbol", "train_size", "is_train").agg(
        F.count(F.lit(1)).alias("n"), F.min("datetime").alias("first_bar"), F.max("datetime").alias("last_bar")
    )


@query(
    "fold_rows",
    f"""WITH {bars_sql('6 hours')}, n AS (SELECT symbol, datetime, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS row_no,
      count(*) OVER (PARTITION BY symbol) AS n_rows FROM bars),
    f AS (SELECT * FROM (SELECT unnest(generate_series(0, 4)) AS window_no))
    SELECT n.symbol, n.datetime, f.window_no, CASE WHEN row_no // 20 = f.window_no THEN 'train' ELSE 'test' END AS part
    FROM n JOIN f ON row_no // 20 IN (f.window_no, f.window_no + 1) WHERE (f.window_no + 2) * 20 <= n_rows""",
)
def fold_rows(spark, sf):
    out = split.rolling_fold_rows(study_bars(spark, sf, "6h"), 20, 5)
    return out.select("symbol", "datetime", "window_no", "part")


@query(
    "expanding_folds",
    f"""WITH {bars_sql('6 hours')}, n AS (SELECT symbol, datetime, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS row_no,
      count(*) OVER (PARTITION BY symbol) AS n_rows FROM bars),
    f AS (SELECT unnest(generate_series(1, 4)) AS iteration_no)
    SELECT symbol, iteration_no, CAST(count(*) FILTER (WHERE row_no < 20 * iteration_no) AS BIGINT) AS train_rows,
      count(*) FILTER (WHERE row_no >= 20 * iteration_no) AS test_rows,
      min(datetime) AS train_start, max(datetime) FILTER (WHERE row_no < 20 * iteration_no) AS train_end,
      min(datetime) FILTER (WHERE row_no >= 20 * iteration_no) AS test_start, max(datetime) AS test_end
    FROM n JOIN f ON row_no < 20 * (iteration_no + 1) WHERE 20 * (iteration_no + 1) <= n_rows GROUP BY symbol, iteration_no""",
)
def expanding_folds(spark, sf):
    return split.expanding_folds(study_bars(spark, sf, "6h"), 20, 4)


# --- series statistics ----------------------------------------------------------

MATRIX = ["close_log_return", *LAGS]


@query(
    "autocorr_matrix",
    f"WITH {rows_sql()} "
    + " UNION ALL ".join(
        f"SELECT symbol, '{a}' AS \"row\", '{b}' AS \"column\", {R(f'corr({a}, {b})', 'corr')} FROM study GROUP BY symbol"
        for a in MATRIX for b in MATRIX
    ),
)
def autocorr_matrix(spark, sf):
    out = stats.autocorrelation_matrix(study_features(spark, sf), "close_log_return", 3)
    return rounded(out, "symbol", "row", "column", "corr")


KINDS = ["click", "error", "purchase", "signup", "view"]
PAIRS = [(a, b) for i, a in enumerate(KINDS) for b in KINDS[i + 1:]]


@query(
    "pair_corr",
    f"""WITH {bars_sql()} SELECT a.symbol AS symbol_x, b.symbol AS symbol_y, {R('corr(a.close, b.close)', 'corr')}, count(*) AS bars
    FROM bars a JOIN bars b ON a.datetime = b.datetime AND a.symbol < b.symbol GROUP BY a.symbol, b.symbol""",
)
def pair_corr(spark, sf):
    return rounded(stats.pair_correlations(study_bars(spark, sf), PAIRS), "symbol_x", "symbol_y", "corr", "bars")


@query(
    "two_symbol_corr",
    f"""WITH {TRADES}, c AS (SELECT symbol, {bucket('6 hours')} AS datetime, arg_max(price, (datetime, id)) AS close
      FROM trades WHERE symbol IN ('click', 'view') GROUP BY symbol, {bucket('6 hours')})
    SELECT 'click' AS symbol_x, 'view' AS symbol_y, {R('corr(a.close, b.close)', 'corr')}, count(*) AS bars
    FROM (SELECT * FROM c WHERE symbol = 'click') a JOIN (SELECT * FROM c WHERE symbol = 'view') b USING (datetime)""",
)
def two_symbol_corr(spark, sf):
    out = stats.compare_symbols(event_trades(spark, sf), "click", "view", "6h")
    return rounded(out, "symbol_x", "symbol_y", "corr", "bars")


@query(
    "portfolio_compare",
    f"""WITH d AS (SELECT o_orderpriority AS portfolio, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS pnl
      FROM orders GROUP BY ALL)
    SELECT portfolio, {R('sum(pnl)', 'total_pnl', 2)}, {R('avg(pnl)', 'mean_pnl', 2)}, {R('stddev_pop(pnl)', 'std_pnl', 2)},
      {R('avg(pnl) / stddev_pop(pnl)', 'sharpe')} FROM d GROUP BY portfolio""",
)
def portfolio_compare(spark, sf):
    out = metrics.compare_portfolios(portfolio_values(spark, sf), "pnl")
    return out.select(
        "portfolio", r6("total_pnl", 2).alias("total_pnl"), r6("mean_pnl", 2).alias("mean_pnl"),
        r6("std_pnl", 2).alias("std_pnl"), r6("sharpe").alias("sharpe"),
    )


@query(
    "value_counts",
    f"""WITH {rows_sql()}, s AS (SELECT symbol, CAST(sign(y_hat) AS DOUBLE) AS dir_signal FROM study)
    SELECT symbol, dir_signal, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY symbol)', 'share')}
    FROM s GROUP BY symbol, dir_signal""",
)
def value_counts(spark, sf):
    rows = study_rows(spark, sf).withColumn("dir_signal", F.signum("y_hat"))
    return rounded(stats.value_counts(rows, "dir_signal", ["symbol"]), "symbol", "dir_signal", "n", "share")


@query(
    "event_shares",
    f"""SELECT event_type, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()', 'share')} FROM events GROUP BY event_type""",
)
def event_shares(spark, sf):
    return rounded(stats.value_counts(table(spark, sf, "events"), "event_type"), "event_type", "n", "share")


@query(
    "describe_prices",
    f"""WITH {LINES} SELECT symbol, count(price) AS n, {R('avg(price)', 'mean', 4)}, {R('sum(price)', 'total', 2)},
      {R('var_pop(price)', 'var_pop', 2)}, {R('stddev_pop(price)', 'std_pop', 4)}, {R('quantile_cont(price, 0.5)', 'median', 4)} FROM lines GROUP BY symbol""",
)
def describe_prices(spark, sf):
    out = stats.describe(line_trades(spark, sf), "price")
    return out.select(
        "symbol", "n", r6("mean", 4).alias("mean"), r6("total", 2).alias("total"), r6("var_pop", 2).alias("var_pop"),
        r6("std_pop", 4).alias("std_pop"), r6("median", 4).alias("median"),
    )


@query(
    "histogram",
    f"""WITH {TRADES}, b AS (SELECT symbol, min(price) AS lo, (max(price) - min(price)) / 20 AS width FROM trades GROUP BY symbol),
    p AS (SELECT symbol, lo, width, least(CAST(floor((price - lo) / width) AS INTEGER), 19) AS bin FROM trades JOIN b USING (symbol))
    SELECT symbol, bin, count(*) AS n, {R('lo + width * bin', 'bin_start')}, {R('lo + width * (bin + 1)', 'bin_end')}
    FROM p GROUP BY symbol, bin, lo, width""",
)
def histogram(spark, sf):
    return rounded(stats.histogram(event_trades(spark, sf), "price", 20), "symbol", "bin", "n", "bin_start", "bin_end")


@query(
    "kde_grid",
    f"""WITH {TRADES}, b AS (SELECT symbol, min(price) AS lo, max(price) AS hi, count(*) AS n FROM trades GROUP BY symbol),
    g AS (SELECT symbol, lo, hi, n, i AS point_no, lo + (hi - lo) * (i / 24.0e0) AS x FROM b CROSS JOIN (SELECT CAST(unnest(generate_series(0, 24)) AS INTEGER) AS i))
    SELECT g.symbol, point_no, {R('x')}, {R('sum(exp(-0.5e0 * ((price - x) / 20) * ((price - x) / 20))) / (n * 20 * sqrt(2 * pi()))', 'density', 8)}
    FROM g JOIN trades t ON t.symbol = g.symbol GROUP BY g.symbol, point_no, x, n""",
)
def kde_grid(spark, sf):
    out = stats.kernel_density(event_trades(spark, sf), "price", 25, 20.0)
    return out.select("symbol", "point_no", r6("x").alias("x"), r6("density", 8).alias("density"))


@query(
    "kde_default",
    f"""WITH {TRADES}, b AS (SELECT symbol, 1.06e0 * least(stddev_samp(price), (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) / 1.34e0)
        * pow(count(*), -0.2e0) AS h, min(price) AS lo, max(price) AS hi, count(*) AS n FROM trades GROUP BY symbol),
    g AS (SELECT *, i AS point_no, lo + (hi - lo) * (i / 9.0e0) AS x FROM b CROSS JOIN (SELECT CAST(unnest(generate_series(0, 9)) AS INTEGER) AS i))
    SELECT g.symbol, point_no, {R('x')}, {R('sum(exp(-0.5e0 * ((price - x) / h) * ((price - x) / h))) / (n * h * sqrt(2 * pi()))', 'density', 8)}
    FROM g JOIN trades t ON t.symbol = g.symbol GROUP BY g.symbol, point_no, x, n, h""",
)
def kde_default(spark, sf):
    """Density with the bandwidth that the data ask for."""
    out = stats.kernel_density(event_trades(spark, sf), "price", 10)
    return out.select("symbol", "point_no", r6("x").alias("x"), r6("density", 8).alias("density"))


@query(
    "time_span_counts",
    f"WITH {LINES} SELECT symbol, count(*) AS n_rows, min(datetime) AS first_time, max(datetime) AS last_time FROM lines GROUP BY symbol",
)
def time_span_counts(spark, sf):
    return stats.span_and_count(line_trades(spark, sf))


@query(
    "sharpe_rf",
    f"""WITH {feats_sql()} SELECT symbol, {R('avg(close_log_return)', 'mean')}, {R('stddev_pop(close_log_return)', 'std')},
      {R('(avg(close_log_return) - 0.0001e0) / stddev_pop(close_log_return) * sqrt(730)', 'sharpe')} FROM feats GROUP BY symbol""",
)
def sharpe_rf(spark, sf):
    factor = sharpe_annualization_factor("12h")
    out = metrics.sharpe_with_risk_free(study_features(spark, sf), "close_log_return", 0.0001, factor)
    return rounded(out, "symbol", "mean", "std", "sharpe")


@query(
    "annualization",
    f"""WITH e AS (SELECT DISTINCT event_type, CASE event_type WHEN 'click' THEN '1m' WHEN 'error' THEN '15m' WHEN 'purchase' THEN '1h'
      WHEN 'signup' THEN '12h' ELSE '1d' END AS every FROM events)
    SELECT event_type, every, {R("sqrt(CASE every WHEN '1m' THEN 525600 WHEN '15m' THEN 35040 WHEN '1h' THEN 8760 WHEN '12h' THEN 730 ELSE 365 END)", 'factor')} FROM e""",
)
def annualization(spark, sf):
    kinds = table(spark, sf, "events").select("event_type").distinct()
    every = F.when(F.col("event_type") == "click", "1m").when(F.col("event_type") == "error", "15m")
    every = every.when(F.col("event_type") == "purchase", "1h").when(F.col("event_type") == "signup", "12h").otherwise("1d")
    return kinds.withColumn("every", every).select("event_type", "every", r6(annualization_column("every")).alias("factor"))


# --- joins, unions, calendars, text, scalar rules ---------------------------------

EXCHANGE_CASE = "CASE user_id % 5 WHEN 0 THEN 'Binance' WHEN 1 THEN 'Bybit' WHEN 2 THEN 'OKX' WHEN 3 THEN 'Kraken' ELSE 'Coinbase' END"


@query(
    "fee_by_exchange",
    f"""WITH fees(exchange, maker_fee, taker_fee) AS (VALUES ('Binance', 0.00045e0, 0.00045e0), ('Bybit', 0.0002e0, 0.00055e0),
      ('OKX', 0.0002e0, 0.0005e0), ('Kraken', 0.0002e0, 0.0005e0), ('Coinbase', 0.004e0, 0.006e0)),
    t AS (SELECT {EXCHANGE_CASE} AS exchange, value FROM events)
    SELECT exchange, count(*) AS n, {R('sum(value * maker_fee)', 'maker_paid', 4)}, {R('sum(value * taker_fee)', 'taker_paid', 4)}
    FROM t JOIN fees USING (exchange) GROUP BY exchange""",
)
def fee_by_exchange(spark, sf):
    place = F.col("user_id") % 5
    name = F.when(place == 0, "Binance").when(place == 1, "Bybit").when(place == 2, "OKX").when(place == 3, "Kraken").otherwise("Coinbase")
    rows = with_fees(table(spark, sf, "events").select(name.alias("exchange"), "value"), F.broadcast(fee_schedule(spark)))
    return rounded(
        rows.groupBy("exchange").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("maker_fee")).alias("maker_paid"),
            F.sum(F.col("value") * F.col("taker_fee")).alias("taker_paid"),
        ),
        "exchange", "n", "maker_paid", "taker_paid", digits=4,
    )


@query(
    "union_days",
    f"""WITH {TRADES} SELECT symbol, date, count(*) AS n FROM trades
    WHERE date IN (DATE '2024-01-03', DATE '2024-01-04', DATE '2024-01-09') GROUP BY symbol, date""",
)
def union_days(spark, sf):
    parts = [event_trades(spark, sf, day, day) for day in ("2024-01-03", "2024-01-04", "2024-01-09")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"))


@query(
    "last_days",
    f"""WITH {TRADES} {ohlc_sql('1 day', "(SELECT * FROM trades WHERE date BETWEEN DATE '2024-01-13' AND DATE '2024-01-19')")}""",
)
def last_days(spark, sf):
    return bars.ohlc(store.last_days(event_trades(spark, sf), 7, today="2024-01-20"), "1d")


@query(
    "dense_calendar",
    f"""WITH {LINES}, c AS ({CALENDAR_1995}), d AS (SELECT CAST(datetime AS DATE) AS date, count(*) AS n FROM lines GROUP BY 1)
    SELECT c.date, coalesce(d.n, 0) AS n FROM c LEFT JOIN d USING (date)""",
)
def dense_calendar(spark, sf):
    days = store.dense_days(spark, "1995-01-01", "1995-12-31")
    counts = _line_days(spark, sf).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "prefixed_pairs",
    f"""WITH {TRADES}, b AS ({ohlc_sql('12 hours')})
    SELECT x.datetime, x.open AS click_open, x.close AS click_close, y.open AS view_open, y.close AS view_close
    FROM (SELECT * FROM b WHERE symbol = 'click') x JOIN (SELECT * FROM b WHERE symbol = 'view') y USING (datetime)""",
)
def prefixed_pairs(spark, sf):
    trades = event_trades(spark, sf)
    left = bars.prefixed_ohlc(trades.where("symbol = 'click'"), "12h", "click", keep=("datetime",))
    right = bars.prefixed_ohlc(trades.where("symbol = 'view'"), "12h", "view", keep=("datetime",))
    return bars.align(left, right).select("datetime", "click_open", "click_close", "view_open", "view_close")


@query(
    "null_policy",
    """WITH t AS (SELECT event_id, CASE WHEN value >= 5 THEN value END AS price,
      CASE WHEN value > 480 THEN CAST('NaN' AS DOUBLE) ELSE value END AS other FROM events)
    SELECT event_id, price, isnan(other) AS other_is_nan, coalesce(nullif(price, price), 1) AS filled FROM t
    WHERE price IS NOT NULL AND other IS NOT NULL""",
)
def null_policy(spark, sf):
    """Prices below 5 count as missing, above 480 as not a number: NULL rows go, NaN rows stay."""
    value = F.col("value")
    rows = table(spark, sf, "events").select(
        "event_id", F.when(value >= 5, value).alias("price"),
        F.when(value > 480, F.lit(float("nan"))).otherwise(value).alias("other"),
    )
    kept = features.drop_null_rows(rows, ["price", "other"])
    missing = F.nullif("price", "price")
    return kept.select(
        "event_id", "price", F.isnan("other").alias("other_is_nan"), F.coalesce(missing, F.lit(1.0)).alias("filled")
    )


@query(
    "branches",
    """SELECT event_id, CASE WHEN value < 10 THEN 'low' WHEN value < 100 THEN 'mid' ELSE 'high' END AS level,
      CASE WHEN user_id % 2 = 0 THEN 1 ELSE -1 END AS side, 0.005e0 AS mmr, event_id AS original_id, NOT (value < 10) AS not_low
    FROM events""",
)
def branches(spark, sf):
    value = F.col("value")
    out = table(spark, sf, "events").withColumns(
        {
            "level": F.when(value < 10, "low").when(value < 100, "mid").otherwise("high"),
            "side": F.when(F.col("user_id") % 2 == 0, 1).otherwise(-1),
            "mmr": F.lit(0.005),
            "original_id": F.col("event_id"),
            "not_low": ~(value < 10),
        }
    )
    return out.select("event_id", "level", "side", "mmr", "original_id", "not_low")


@query(
    "epoch_iso_json",
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, ts AS from_micros, date_trunc('second', ts) AS from_iso, CAST(ts AS DATE) AS day,
      strftime(ts, '%Y-%m-%d') AS day_text, CAST(CAST(ts AS DATE) - INTERVAL 7 DAY AS DATE) AS week_before,
      CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, TRY_CAST(event_type AS DOUBLE) AS not_a_number
    FROM events""",
)
def epoch_iso_json(spark, sf):
    when = F.col("ts").cast("timestamp")
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select(
        "event_id", F.unix_millis(when).alias("ms"), F.timestamp_micros(F.unix_micros(when)).alias("from_micros"),
        F.to_timestamp(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("from_iso"), F.to_date("ts").alias("day"),
        F.date_format(when, "yyyy-MM-dd").alias("day_text"), F.date_sub(F.to_date("ts"), 7).alias("week_before"),
        parsed["k"].alias("k"), F.col("event_type").try_cast("double").alias("not_a_number"),
    )


@query(
    "ticker_text",
    """SELECT event_id, event_type || '_price' AS column_name, replace(event_type || '_price', '_', '-') AS dashed,
      split_part(event_type || '-price', '-', 2) AS kind, substr(event_type || '-price', 1, instr(event_type || '-price', '-') - 1) AS base,
      event_type AS symbol, CAST(round(value, 2) AS DOUBLE) AS price, format('{:,}', user_id * 1000) AS volume,
      100 * value AS held_value, 100 * (value - 50.0e0) AS open_pnl
    FROM events""",
)
def ticker_text(spark, sf):
    from ..functions import text

    name = text.price_column_name("event_type")
    dashed = F.replace(name, F.lit("_"), F.lit("-"))
    quote = F.concat_ws(":", "event_type", F.round("value", 2).cast("string"))
    symbol, price = text.parse_quote(quote)
    return table(spark, sf, "events").select(
        "event_id", name.alias("column_name"), dashed.alias("dashed"), text.after(dashed, "-").alias("kind"),
        text.before(dashed, "-").alias("base"), symbol, price,
        F.format_number(F.col("user_id") * 1000, 0).alias("volume"),
        text.position_value(F.lit(100), "value").alias("held_value"),
        text.unrealized_pnl(F.lit(100), F.lit(50.0), "value").alias("open_pnl"),
    )


@query(
    "maths",
    f"""SELECT event_id, {R('CASE WHEN value > 0 THEN ln(value) END', 'ln_value')}, {R('exp(-value / 100)', 'exp_value')}, {R('sqrt(value)', 'root')},
      {R('pow(value, 2)', 'square', 4)}, CAST(sign(value - 50) AS DOUBLE) AS side, {R('abs(value - 50)', 'distance')},
      {R('1 / (1 + exp(-(value - 50) / 100))', 'sigmoid')}, {R('tanh(value / 100)', 'tanh')},
      {R('greatest(value - 50, 0)', 'relu')}, {R('exp(value / 100) / (exp(value / 100) + exp(1))', 'softmax')},
      CASE WHEN user_id % 2 = 0 THEN NULL ELSE {R('value / (user_id % 2)', 'x').replace(' AS x', '')} END AS safe_ratio, (value > 50 AND NOT (user_id % 2 = 0)) OR value < 1 AS mixed
    FROM events""",
)
def maths(spark, sf):
    from ..functions import maths as m

    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", r6(F.ln(v)).alias("ln_value"), r6(F.exp(-v / 100)).alias("exp_value"), r6(F.sqrt(v)).alias("root"),
        r6(F.pow(v, F.lit(2.0)), 4).alias("square"), m.direction(v - 50).alias("side"), r6(F.abs(v - 50)).alias("distance"),
        r6(m.sigmoid((v - 50) / 100)).alias("sigmoid"), r6(F.tanh(v / 100)).alias("tanh"), r6(m.relu(v - 50)).alias("relu"),
        r6(m.softmax([v / 100, F.lit(1.0)])[0]).alias("softmax"), r6(m.ratio(v, F.col("user_id") % 2)).alias("safe_ratio"),
        (((v > 50) & ~(F.col("user_id") % 2 == 0)) | (v < 1)).alias("mixed"),
    )


@query(
    "linear_predict",
    f"WITH {rows_sql()} SELECT symbol, datetime, {R('y_hat')}, CAST(sign(y_hat) AS DOUBLE) AS dir_signal FROM study",
)
def linear_predict(spark, sf):
    rows = features.drop_null_rows(study_features(spark, sf))
    out = add_model_predictions(rows, (WEIGHTS, BIAS), LAGS)
    return out.select("symbol", "datetime", r6("y_hat").alias("y_hat"), F.signum("y_hat").alias("dir_signal"))


@query(
    "first_bars",
    f"WITH {TRADES}, b AS ({ohlc_sql('1 day')}) SELECT * FROM b ORDER BY datetime, symbol LIMIT 10",
)
def first_bars(spark, sf):
    return bars.ohlc(event_trades(spark, sf), "1d").orderBy("datetime", "symbol").limit(10)


@query(
    "distinct_bars",
    f"""WITH {LINES}, d AS (SELECT symbol, datetime, max(price) AS price FROM lines GROUP BY symbol, datetime) SELECT * FROM d""",
)
def distinct_bars(spark, sf):
    from ..sources.exchanges import one_per_time

    return one_per_time(line_trades(spark, sf).select("symbol", "datetime", "price"))


@query(
    "dot_product",
    f"WITH {rows_sql()} SELECT symbol, {R('sum(y_hat * close_log_return)', 'score')} FROM study GROUP BY symbol",
)
def dot_product(spark, sf):
    rows = features.drop_null_rows(study_features(spark, sf)).withColumn("y_hat", dot(LAGS, WEIGHTS, BIAS))
    return rounded(rows.groupBy("symbol").agg(F.sum(F.col("y_hat") * F.col("close_log_return")).alias("score")), "symbol", "score")
