"""The trade store: Parquet partitioned by exchange, symbol and date.

Filters on those three prune directories; everything else is one scan that
Spark splits by file size. Nothing loops over files or days.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import ohlc_aggs, resample
from ..schema import MODELS, OHLC_CSV, TRADE_COLUMNS, TRADES
from ..session import use_utc

Day = str | dt.date | dt.datetime


def as_day(day: Day) -> dt.date:
    if isinstance(day, dt.datetime):
        return day.date()
    return day if isinstance(day, dt.date) else dt.date.fromisoformat(day)


def write_trades(trades: DataFrame, path: str) -> None:
    """Write symbol-days, replacing only the partitions present in ``trades``.

    Running it again with the same days gives the same table. Rows are
    rebalanced by partition: Spark splits a hot symbol's day over several tasks
    and puts small ones together, by their measured sizes.
    """
    keys = ["exchange", "symbol", "date"]
    rows = trades.select(*TRADE_COLUMNS).hint("rebalance", *keys).sortWithinPartitions(*keys, "datetime", "id")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def add_missing_days(trades: DataFrame, path: str) -> None:
    """Write only the symbol-days that the store does not have yet (its folders are listed, not read)."""
    keys = ["exchange", "symbol", "date"]
    there = trades.sparkSession.read.schema(TRADES).parquet(path).select(*keys).distinct()
    write_trades(trades.join(there, keys, "left_anti").select(trades.columns), path)


def read_trades(
    spark: SparkSession, path: str, symbols: str | Sequence[str] | None = None, start: Day | None = None,
    end: Day | None = None, exchange: str | None = None,
) -> DataFrame:
    """Trades of some symbols in an **inclusive** range of days (partition pruned)."""
    use_utc(spark)
    out = spark.read.schema(TRADES).parquet(path)
    return only(out, symbols, start, end, exchange)


def only(
    trades: DataFrame, symbols: str | Sequence[str] | None = None, start: Day | None = None, end: Day | None = None,
    exchange: str | None = None,
) -> DataFrame:
    if start is not None and end is not None and as_day(start) > as_day(end):
        raise ValueError(f"start {start} lies after end {end}")
    if symbols is not None:
        trades = trades.where(F.col("symbol").isin([symbols] if isinstance(symbols, str) else list(symbols)))
    if exchange is not None:
        trades = trades.where(F.col("exchange") == exchange)
    if start is not None:
        trades = trades.where(F.col("date") >= F.lit(as_day(start)))
    if end is not None:
        trades = trades.where(F.col("date") <= F.lit(as_day(end)))
    return trades


def symbol_files(spark: SparkSession, directory: str, symbol: str, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Flat layout: ``(file, day, bytes)`` of the files named ``{symbol}-trades*.parquet``, in an inclusive range of the
    days in their names. They are listed by Spark's reader, wherever they are; none is opened. A name without a day
    (``yyyy-mm-dd``) has a NULL one and is in every range."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{symbol}-trades*.parquet").load(directory)
    day = F.try_to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1))
    out = files.select(F.col("path").alias("file"), day.alias("day"), F.col("length").alias("bytes"))
    for bound, ok in ((start, lambda d: F.col("day") >= d), (end, lambda d: F.col("day") <= d)):
        if bound is not None:
            out = out.where(F.col("day").isNull() | ok(F.lit(as_day(bound))))
    return out


def check_symbol_files(spark: SparkSession, directory: str, symbol: str, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """``(file, day, rows, reason)`` per file: why it cannot be used, or a NULL reason. Reads one column of each."""
    files = symbol_files(spark, directory, symbol, start, end)
    paths = [r.file for r in files.select("file").collect()]  # names, as Spark's own file index holds them
    if not paths:
        return files.select("file", "day", F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("reason"))
    one = spark.read.schema("datetime timestamp").option("ignoreCorruptFiles", True).parquet(*paths)
    found = one.groupBy(F.col("_metadata.file_path").alias("_path")).agg(F.count(F.lit(1)).alias("rows"), F.count("datetime").alias("_times"))
    # the two readers write the scheme of a path differently
    key = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)/*", "$1/")
    joined = files.withColumn("_key", key("file")).join(found.withColumn("_key", key("_path")), "_key", "left")
    reason = F.when(F.col("rows").isNull(), "unreadable or empty").when(F.col("_times") == 0, "no datetime")
    return joined.select("file", "day", F.coalesce("rows", F.lit(0)).alias("rows"), reason.alias("reason"))


def read_symbol_files(
    spark: SparkSession, directory: str, symbol: str, schema: T.StructType | None = None, start: Day | None = None, end: Day | None = None,
    on_error: str = "fail",
) -> DataFrame:
    """Trades of the flat layout in an inclusive range of days. A file that cannot be used is an error; with
    ``on_error="skip"`` it is left out, and :func:`check_symbol_files` says why."""
    use_utc(spark)
    checked = check_symbol_files(spark, directory, symbol, start, end).collect()
    bad = [r for r in checked if r.reason]
    if bad and on_error == "fail":
        raise ValueError(f"column 'datetime' not found or file not readable: {bad[0].file} ({bad[0].reason}), {len(bad)} in all")
    paths = [r.file for r in checked if not r.reason]
    if not paths:
        raise ValueError(f"no files of {symbol} found in {directory}")
    out = (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", True)).parquet(*paths)
    out = out.withColumn("datetime", F.col("datetime").cast("timestamp"))
    out = out if "symbol" in out.columns else out.withColumn("symbol", F.lit(symbol))
    return only(out.withColumn("date", F.to_date("datetime")), start=start, end=end)


def last_days(trades: DataFrame, days: int, today: Day | Column | None = None) -> DataFrame:
    """The last ``days`` full days, ending yesterday."""
    now = today if isinstance(today, Column) else F.lit(as_day(today)) if today is not None else F.current_date()
    return trades.where(F.col("date").between(F.date_sub(now, days), F.date_sub(now, 1)))


def load_bars(
    spark: SparkSession, path: str, every: str, *aggs: Column, symbols: str | Sequence[str] | None = None,
    start: Day | None = None, end: Day | None = None, required: bool = True,
) -> DataFrame:
    """Bars straight from the store; OHLC unless other aggregates are given. A range without any trade is an
    error unless ``required`` is off."""
    trades = read_trades(spark, path, symbols, start, end)
    return resample(require_rows(trades) if required else trades, every, *(aggs or ohlc_aggs()))


def load_bars_and_gaps(
    spark: SparkSession, path: str, every: str, *aggs: Column, start: Day, end: Day, symbols: str | Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The bars of an inclusive range of days, and the days of it that each symbol lacks. A symbol that was asked
    for and has no trade at all lacks every day."""
    bars = load_bars(spark, path, every, *aggs, symbols=symbols, start=start, end=end)
    return bars, missing_days(read_trades(spark, path, symbols, start, end), start, end, asked=symbols)


def dense_days(spark: SparkSession, start: Day, end: Day, name: str = "date") -> DataFrame:
    """Every day of an inclusive range."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(as_day(start)), F.lit(as_day(end)))).alias(name)
    )


def missing_days(trades: DataFrame, start: Day, end: Day, key: str = "symbol", asked: str | Sequence[str] | None = None) -> DataFrame:
    """Days of an inclusive range without a trade, per symbol that has any in it or is ``asked`` for.

    Each symbol's present days are one row per day, compared with the calendar
    as arrays: at most one array of the range's length per symbol.
    """
    inside = only(trades, start=start, end=end).select(key, "date").distinct()
    if asked is not None:
        names = F.array(*[F.lit(s) for s in ([asked] if isinstance(asked, str) else asked)])
        every = trades.sparkSession.range(1).select(F.explode(names).alias(key), F.lit(None).cast("date").alias("date"))
        inside = inside.unionByName(every)  # no day of theirs is present yet; a NULL day is collected by none
    present = inside.groupBy(key).agg(F.collect_set("date").alias("_present"))
    calendar = F.sequence(F.lit(as_day(start)), F.lit(as_day(end)))
    return present.select(key, F.explode(F.array_except(calendar, "_present")).alias("date"))


def coverage(trades: DataFrame, start: Day, end: Day, key: str = "symbol") -> DataFrame:
    """Per symbol: days asked for, days present, days missing and unusable rows.

    ``bad_rows`` counts rows without a time or a positive price, so damaged data
    is told apart from absent data.
    """
    inside = only(trades, start=start, end=end)
    asked = (as_day(end) - as_day(start)).days + 1
    usable = F.col("datetime").isNotNull() & (F.col("price") > 0)
    per_day = inside.groupBy(key, "date").agg(F.count(F.lit(1)).alias("_n"), F.count_if(usable).alias("_ok"))
    return per_day.groupBy(key).agg(
        F.lit(asked).alias("days_asked"),
        F.count(F.lit(1)).alias("days_present"),
        (F.lit(asked) - F.count(F.lit(1))).alias("days_missing"),
        F.sum(F.col("_n") - F.col("_ok")).alias("bad_rows"),
    )


def require_rows(df: DataFrame, what: str = "trades") -> DataFrame:
    """Fail when a range holds nothing at all (reads one row)."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df


def read_ohlc_csv(spark: SparkSession, path: str, symbol: str | None = None, schema: T.StructType = OHLC_CSV) -> DataFrame:
    """OHLC bars from CSV with a header and an ``open_time`` column."""
    use_utc(spark)
    out = spark.read.schema(schema).option("header", True).csv(path).withColumnRenamed("open_time", "datetime")
    return out.withColumn("symbol", F.lit(symbol)) if symbol else out


def save_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str, schema: T.StructType = MODELS) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
