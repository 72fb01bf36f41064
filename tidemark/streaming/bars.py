"""Bars and latest values of a live stream of trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import stream_window
from ..operators.bars import ORDER, ohlc_aggs


def stream_bars(
    trades: DataFrame, every: str, *aggs: Column, delay: str = "10 minutes", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Bars on the same grid as the batch ones. Trades later than ``delay`` are dropped.

    Append mode gives each bar once, when the watermark has passed its end;
    update mode gives every change. Each micro-batch is pre-aggregated before it
    meets the state, so a busy symbol sends one row per bar and task.
    """
    marked = trades.withWatermark("datetime", delay)
    out = marked.groupBy(*keys, stream_window("datetime", every).alias("_w")).agg(*(aggs or ohlc_aggs(order=ORDER)))
    return out.select(*keys, F.col("_w.start").alias("datetime"), *[c for c in out.columns if c not in (*keys, "_w")])


def stream_last(trades: DataFrame, value: str = "price", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The last value of each series so far (update mode)."""
    rank = F.struct(*ORDER)
    return trades.groupBy(*keys).agg(F.max_by(value, rank).alias(value), F.max("datetime").alias("datetime"))
