"""Bars: trades or finer bars aggregated onto a regular time grid.

Every function is one ``groupBy(series, bar start)``: rows are pre-aggregated
before the shuffle, so a symbol with a third of all trades sends one partial
row per bar and task. A bar that spans files or partitions is still one bar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import bar_start, period_end
from ..session import written
from .ordered import Timeline, even_blocks, with_running

ORDER = ("datetime", "id")


#: Numbers that a 64-bit id leaves between two instants of a packed order.
ID_SPAN = 2 * 10**19


def _rank(order: Sequence[str]) -> Column:
    """Ordering value for first/last. One column stands for itself. A time and an id are packed into one
    decimal, which hash aggregation can hold where a struct would need a sort; ids of any sign keep their
    order and NULL comes first. Longer orders are structs."""
    if len(order) == 1:
        return F.col(order[0])
    if tuple(order) == ORDER:
        number = F.coalesce(F.col("id").cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))
        instant = F.unix_micros(F.col("datetime").cast("timestamp")).cast("decimal(18,0)")
        return (instant * F.lit(str(ID_SPAN)).cast("decimal(20,0)") + number).cast("decimal(38,0)")
    return F.struct(*order)


def ohlc_aggs(price: str = "price", order: Sequence[str] = ORDER) -> list[Column]:
    """Open, high, low, close. ``order`` decides first and last, ties included."""
    return [
        F.min_by(price, _rank(order)).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, _rank(order)).alias("close"),
    ]


def activity_aggs(price: str = "price", qty: str = "qty") -> list[Column]:
    """Price volatility (sample deviation) and total volume."""
    return [F.stddev_samp(price).alias("price_volatility"), F.sum(qty).alias("total_volume")]


def resample(
    df: DataFrame, every: str, *aggs: Column, keys: Sequence[str] = ("symbol",), time: str = "datetime"
) -> DataFrame:
    """Group rows into left-closed bars and apply any aggregates. Empty bars are absent."""
    grid = df.withColumn("_bar", bar_start(time, every))
    return grid.groupBy(*keys, "_bar").agg(*aggs).withColumnRenamed("_bar", time)


def ohlc(df: DataFrame, every: str, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ORDER) -> DataFrame:
    return resample(df, every, *ohlc_aggs(order=order), keys=keys)


def one_price(
    df: DataFrame, every: str, which: str = "close", keys: Sequence[str] = ("symbol",), order: Sequence[str] = ORDER
) -> DataFrame:
    """Bars with a single price; the other three are never computed or shuffled."""
    pick = {
        "open": F.min_by("price", _rank(order)),
        "high": F.max("price"),
        "low": F.min("price"),
        "close": F.max_by("price", _rank(order)),
    }
    if which not in pick:
        raise ValueError(f"price must be one of {sorted(pick)}, not {which!r}")
    return resample(df, every, pick[which].alias(which), keys=keys)


def median_bars(
    df: DataFrame,
    every: str,
    price: str = "price",
    keys: Sequence[str] = ("symbol",),
    method: str = "linear",
    name: str = "median",
    time: str = "datetime",
    blocks: int | None = None,
) -> DataFrame:
    """Median price per bar.

    ``linear`` and ``nearest`` are exact. They first count equal prices (a
    pre-aggregated shuffle, as many rows as distinct prices) and then walk the
    counts, so no bar's trades are ever held in one buffer. A bar's distinct
    prices are walked in pieces of bounded size (or ``blocks`` of them).
    ``nearest`` takes the upper middle of an
    even count. ``approx`` is a mergeable sketch.
    """
    if method == "approx":
        return resample(df, every, F.percentile_approx(price, 0.5).alias(name), keys=keys, time=time)
    if method not in ("linear", "nearest"):
        raise ValueError("method must be linear, nearest or approx")
    bar = [*keys, time]
    counts = (
        df.where(F.col(price).isNotNull())
        .withColumn(time, bar_start(time, every))
        .groupBy(*bar, F.col(price).alias("_p"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    counts, line = even_blocks(written(counts, "price-counts"), Timeline(tuple(bar), ("_p",)), blocks)
    walked = with_running(counts, line, sums={"_upto": "_n"})
    walked = walked.join(counts.groupBy(*bar).agg(F.sum("_n").alias("_all")), bar)
    # 1-based ranks of the two middle rows; equal for an odd count.
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    holds = lambda rank: (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
    low, high = F.max(F.when(holds(lower), F.col("_p"))), F.max(F.when(holds(upper), F.col("_p")))
    value = high if method == "nearest" else (low + high) / 2
    return walked.groupBy(*bar).agg(value.alias(name))


def coarsen(
    bars: DataFrame, every: str, keys: Sequence[str] = ("symbol",), volume: str | None = None, time: str = "datetime"
) -> DataFrame:
    """Coarser bars from finer ones: first open, highest high, lowest low, last close, summed volume."""
    aggs = [
        F.min_by("open", time).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", time).alias("close"),
    ]
    if volume:
        aggs.append(F.sum(volume).alias(volume))
    return resample(bars, every, *aggs, keys=keys, time=time)


def calendar_stats(
    df: DataFrame,
    value: str,
    every: str = "1y",
    keys: Sequence[str] = ("symbol",),
    time: str = "datetime",
    end_label: bool = True,
) -> DataFrame:
    """Mean and sample deviation per calendar period, labelled by its last day or its start."""
    out = resample(df, every, F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), keys=keys, time=time)
    return out.withColumn(time, period_end(time, every)) if end_label else out


def bar_ladder(
    trades: DataFrame, intervals: Sequence[str], *aggs: Column, coarser: Sequence[Column] = (),
    keys: Sequence[str] = ("symbol",), time: str = "datetime",
) -> dict[str, DataFrame]:
    """Bars of several lengths from one reading of the trades.

    The first interval is built from trades and written; the others, multiples
    of it, are aggregated from those bars. OHLC by default; otherwise ``aggs``
    makes the first table and ``coarser`` combines its rows.
    """
    base = written(resample(trades, intervals[0], *(aggs or ohlc_aggs()), keys=keys, time=time), "bars")
    out = {intervals[0]: base}
    for every in intervals[1:]:
        out[every] = resample(base, every, *coarser, keys=keys, time=time) if coarser else coarsen(base, every, keys, time=time)
    return out


def prefix_columns(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix every column name except those in ``keep``."""
    return df.toDF(*[c if c in keep else f"{prefix}_{c}" for c in df.columns])


def prefixed_ohlc(trades: DataFrame, every: str, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return prefix_columns(ohlc(trades, every), prefix, keep)


def align(left: DataFrame, right: DataFrame, on: str = "datetime") -> DataFrame:
    """Two bar series side by side, matched on bar start (never by position)."""
    return left.join(right, on, "inner")
