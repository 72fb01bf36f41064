"""The sample tables seen as market data (symbols, times, prices, quantities).

Times in those files carry no zone; they are cast to UTC timestamps once, here.
Range filters go onto the raw column so that they reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_trades(events: DataFrame) -> DataFrame:
    """``events`` rows as trades: one symbol per event type. ``ts`` may be a stream column."""
    qty = F.get_json_object("props", "$.k").cast("double")
    return events.select(
        F.lit("Binance").alias("exchange"),
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("id"),
        F.col("ts").cast("timestamp").alias("datetime"),
        F.col("value").alias("price"),
        qty.alias("qty"),
        (F.col("value") * qty).alias("quoteQty"),
        (F.col("user_id") % 2 == 0).alias("isBuyerMaker"),
        F.col("ts").cast("date").alias("date"),
    )


def event_trades(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Trades from ``events``, optionally of an inclusive range of days."""
    events = table(spark, folder, "events")
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        after = dt.date.fromisoformat(end) + dt.timedelta(days=1)
        events = events.where(F.col("ts") < F.lit(str(after)).cast("timestamp_ntz"))
    return as_trades(events)


LINE_ORDER = ("datetime", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def line_trades(spark: SparkSession, folder: str) -> DataFrame:
    """Trades from ``lineitem``: six symbols, many trades at the same time, so
    :data:`LINE_ORDER` (not a single id) orders them."""
    items = table(spark, folder, "lineitem")
    return items.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("datetime"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.try_divide("l_extendedprice", "l_quantity").alias("price"),
        F.col("l_quantity").alias("qty"),
    )


def portfolio_values(spark: SparkSession, folder: str) -> DataFrame:
    """Daily value per order priority, as a portfolio's value."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("portfolio"), F.to_date("o_orderdate").alias("date")
    ).agg(F.sum("o_totalprice").alias("pnl"))
