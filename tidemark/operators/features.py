"""Features and targets of bar or tick series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import as_col, log_ratio, no_nulls, ratio
from ..session import written
from .ordered import BARS, Timeline, with_lags, with_running


def lag_names(col: str, n: int) -> list[str]:
    return [f"{col}_lag_{i}" for i in range(1, n + 1)]


def log_return_name(col: str) -> str:
    return f"{col}_log_return"


def add_log_return(df: DataFrame, col: str = "close", steps: int = 1, line: Timeline = BARS) -> DataFrame:
    """``ln(x / x[steps back])``, as ``{col}_log_return``."""
    out = with_lags(df, line, {"_before": (col, steps)})
    return out.withColumn(log_return_name(col), log_ratio(col, "_before")).drop("_before")


def add_lags(df: DataFrame, col: str, n: int, step: int = 1, line: Timeline = BARS) -> DataFrame:
    """``{col}_lag_1..n``, each ``step`` rows further back."""
    return with_lags(df, line, {name: (col, step * i) for i, name in enumerate(lag_names(col, n), 1)})


def add_log_return_features(
    df: DataFrame, col: str = "close", horizon: int = 1, lags: int | None = None, line: Timeline = BARS
) -> DataFrame:
    """Log return over ``horizon`` rows and its own lags, ``horizon`` apart.

    A lag of a log return is the log ratio of two lags of the price, so one pass
    over the series gives the return and all of its lags.
    """
    lags = lags or 0
    name = log_return_name(col)
    back = {f"_p{i}": (col, horizon * i) for i in range(1, lags + 2)}
    out = with_lags(df, line, back)
    prices = [col, *back]
    made = {name: log_ratio(prices[0], prices[1])}
    made |= {lag: log_ratio(prices[i], prices[i + 1]) for i, lag in enumerate(lag_names(name, lags), 1)}
    return out.withColumns(made).drop(*back)


def add_difference(df: DataFrame, col: str, line: Timeline = BARS) -> DataFrame:
    """``{col}_diff`` and ``{col}_return``: absolute and relative change from the row before."""
    out = with_lags(df, line, {"_before": (col, 1)})
    change = F.col(col) - F.col("_before")
    return out.withColumns({f"{col}_diff": change, f"{col}_return": ratio(change, "_before")}).drop("_before")


def add_difference_lags(df: DataFrame, col: str, n: int, line: Timeline = BARS) -> DataFrame:
    """``{col}_diff`` and ``{col}_diff_lag_1..n`` in one pass over the series."""
    back = {f"_p{i}": (col, i) for i in range(1, n + 2)}
    out = with_lags(df, line, back)
    prices = [col, *back]
    diffs = {f"{col}_diff": F.col(prices[0]) - F.col(prices[1])}
    diffs |= {f"{col}_diff_lag_{i}": F.col(prices[i]) - F.col(prices[i + 1]) for i in range(1, n + 1)}
    return out.withColumns(diffs).drop(*back)


def previous_or(df: DataFrame, col: str, default: float | Column, name: str, line: Timeline = BARS) -> DataFrame:
    """The row before's value, or ``default`` where there is none."""
    fill = default if isinstance(default, Column) else F.lit(default)
    return with_lags(df, line, {name: (col, 1)}).withColumn(name, F.coalesce(name, fill))


def portfolio_path(df: DataFrame, col: str = "close", start: float = 100.0, line: Timeline = BARS) -> DataFrame:
    """Log return, cumulative log return and value of ``start`` invested at the first row."""
    out = add_log_return(df, col, 1, line)
    out = with_running(out, line, sums={"cum_log_return": F.coalesce(log_return_name(col), F.lit(0.0))})
    return out.withColumn("portfolio_value", F.lit(start) * F.exp("cum_log_return"))


def add_direction_target(df: DataFrame, col: str = "close_log_return") -> DataFrame:
    """``{col}_dir``: 1 for a rise, 0 otherwise."""
    return df.withColumn(f"{col}_dir", (F.col(col) > 0).cast("int"))


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL in any (or the given) columns. NaN stays, unlike ``na.drop``."""
    return df.where(no_nulls(columns or df.columns))


def standardise(
    df: DataFrame, columns: Sequence[str], train: str | Column = "is_train", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """``{c}_scaled``: centred and divided by the population deviation of the train rows.

    A constant column is only centred. The statistics, one row per series, are
    written first: the join back to the rows is then planned on their real size.
    """
    rows = df.where(as_col(train))
    stats = rows.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_std_{c}") for c in columns]
    )
    stats = written(stats, "train-statistics")
    out = df.join(stats, list(keys), "left")
    scale = {c: F.when(F.col(f"_std_{c}") > 0, F.col(f"_std_{c}")).otherwise(F.lit(1.0)) for c in columns}
    out = out.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_mean_{c}")) / scale[c] for c in columns})
    return out.drop(*(f"_mean_{c}" for c in columns), *(f"_std_{c}" for c in columns))


def random_signal(order: str | Column, seed: int = 0) -> Column:
    """A coin flip of +1 / -1 that depends only on the row's own value.

    Multiplicative hashing of a whole number, so it is the same under any
    partitioning and after any retry, and can be written in plain SQL.
    """
    mixed = F.pmod(F.pmod(as_col(order).cast("long") + F.lit(seed), F.lit(2**31)) * F.lit(2654435761), F.lit(2**32))
    return F.when(mixed >= F.lit(2**31), F.lit(1)).otherwise(F.lit(-1))
