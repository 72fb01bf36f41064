"""Catalogue: the store and the exchange file layouts, written from the events and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import ohlc
from ..session import scratch_path
from ..sources import exchanges, store
from ..sources.sample_tables import event_trades
from .base import TRADES as TRADES_SQL
from .base import RS, ohlc_sql, query, rounded

#: Trades of one response of an exchange.
PAGE = 500
TRADE_COLUMNS = ("symbol", "datetime", "price", "qty", "quoteQty", "isBuyerMaker")
EVENTS = f"WITH {TRADES_SQL} SELECT symbol, datetime, {RS('price', 'qty', 'quoteQty')}, isBuyerMaker, id FROM trades"
WITHOUT_ID = EVENTS.replace(", id FROM trades", " FROM trades")
MILLIS = EVENTS.replace("SELECT symbol, datetime", "SELECT symbol, date_trunc('milliseconds', datetime) AS datetime")


def _with_symbol(layout: T.StructType) -> T.StructType:
    return T.StructType([*layout.fields, T.StructField("symbol", T.StringType())])


def _shown(trades: DataFrame, *more: str) -> DataFrame:
    return rounded(trades, *TRADE_COLUMNS, *more)


def _paged(rows: DataFrame, item, wrap=None) -> DataFrame:
    """Responses of one exchange: ``item`` of PAGE trades as JSON, in the exchange's envelope."""
    pages = rows.groupBy("symbol", F.floor(F.col("id") / PAGE).alias("page")).agg(F.collect_list(item).alias("data"))
    return pages.select("symbol", (wrap(F.col("data")) if wrap else F.to_json("data")).alias("body"))


def _text(column: str):
    """A double as text that reads back as the same double."""
    return F.col(column).cast("string")


def _store(spark, sf) -> str:
    path = scratch_path(spark, "trade-store")
    store.write_trades(event_trades(spark, sf), path)
    return path


@query("store_roundtrip", EVENTS)
def store_roundtrip(spark, sf):
    """Trades through the partitioned store; writing days again that are there changes nothing."""
    path = _store(spark, sf)
    store.add_missing_days(event_trades(spark, sf), path)
    return _shown(store.read_trades(spark, path), "id")


@query(
    "store_bars",
    f"""WITH {TRADES_SQL}, few AS (SELECT * FROM trades WHERE datetime >= TIMESTAMP '2024-01-05' AND datetime < TIMESTAMP '2024-01-12')
    {ohlc_sql('6 hours', 'few')}""",
)
def store_bars(spark, sf):
    """Bars of a range of days straight from the store."""
    bars, _ = store.load_bars_and_gaps(spark, _store(spark, sf), "6h", start="2024-01-05", end="2024-01-11")
    return bars


@query(
    "store_gaps",
    """WITH d AS (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS date FROM events),
    wanted AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-11', INTERVAL 1 DAY)) AS DATE) AS date)
    SELECT symbol, date FROM (SELECT DISTINCT symbol FROM d WHERE date BETWEEN DATE '2023-12-30' AND DATE '2024-01-11') CROSS JOIN wanted
    WHERE (symbol, date) NOT IN (SELECT symbol, date FROM d)""",
)
def store_gaps(spark, sf):
    _, missing = store.load_bars_and_gaps(spark, _store(spark, sf), "6h", start="2023-12-30", end="2024-01-11")
    return missing


@query(
    "store_asked_gaps",
    """WITH d AS (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS date FROM events),
    wanted AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-11', INTERVAL 1 DAY)) AS DATE) AS date),
    asked AS (SELECT unnest(['click', 'view', 'absent']) AS symbol)
    SELECT symbol, date FROM asked CROSS JOIN wanted WHERE (symbol, date) NOT IN (SELECT symbol, date FROM d)""",
)
def store_asked_gaps(spark, sf):
    """Days that symbols lack which were asked for, one of them without any trade."""
    asked = ["click", "view", "absent"]
    _, missing = store.load_bars_and_gaps(spark, _store(spark, sf), "6h", start="2023-12-30", end="2024-01-11", symbols=asked)
    return missing


def _symbol_day_files(spark, sf) -> str:
    """One file per day of a symbol; the first day's has another name for its time, the last day's is no Parquet."""
    path, staged = scratch_path(spark, "flat-files"), scratch_path(spark, "flat-staged")
    rows = event_trades(spark, sf).where("symbol = 'click'").drop("symbol").withColumn("day", F.col("date"))
    ends = rows.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
    rows = rows.where(F.col("day") < ends.high).repartition("day")
    rows.where(F.col("day") > ends.low).write.partitionBy("day").parquet(f"{staged}/good")
    rows.where(F.col("day") == ends.low).withColumnRenamed("datetime", "moment").write.partitionBy("day").parquet(f"{staged}/odd")
    spark.createDataFrame([("no parquet", ends.high)], "value string, day date").coalesce(1).write.partitionBy("day").text(f"{staged}/text")
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(place(path))
    for file in fs.globStatus(place(f"{staged}/*/day=*/part-*")):
        day = file.getPath().getParent().getName().removeprefix("day=")
        fs.rename(file.getPath(), place(f"{path}/click-trades-{day}.parquet"))
    return path


DAYS = f"""WITH {TRADES_SQL}, clicks AS (SELECT * FROM trades WHERE symbol = 'click'),
  ends AS (SELECT min(date) AS low, max(date) AS high FROM clicks)"""


@query(
    "flat_files",
    f"""{DAYS} SELECT symbol, datetime, {RS('price', 'qty', 'quoteQty')}, isBuyerMaker, id FROM clicks, ends
    WHERE date > low AND date < high AND date >= DATE '2024-01-03'""",
)
def flat_files(spark, sf):
    """One symbol's day files from a day on, without those that cannot be read."""
    out = store.read_symbol_files(spark, _symbol_day_files(spark, sf), "click", start="2024-01-03", on_error="skip")
    return _shown(out, "id")


@query(
    "bad_files",
    f"""{DAYS} SELECT 'click-trades-' || low || '.parquet' AS file, low AS day, count(*) AS rows, 'no datetime' AS reason FROM clicks, ends WHERE date = low GROUP BY low
    UNION ALL SELECT 'click-trades-' || high || '.parquet', high, 0, 'unreadable or empty' FROM ends""",
)
def bad_files(spark, sf):
    """Which of a symbol's day files cannot be used, and why."""
    checked = store.check_symbol_files(spark, _symbol_day_files(spark, sf), "click")
    return checked.where("reason IS NOT NULL").withColumn("file", F.regexp_extract("file", "[^/]*$", 0))


@query("normalise_binance", MILLIS)
def normalise_binance(spark, sf):
    path = scratch_path(spark, "binance-csv")
    rows = event_trades(spark, sf).select("id", "price", "qty", "quoteQty", F.unix_millis("datetime").alias("time"), "isBuyerMaker", "symbol")
    rows.write.option("header", True).partitionBy("symbol").csv(path)
    raw = spark.read.schema(_with_symbol(exchanges.BINANCE_CSV)).option("header", True).csv(path)
    return _shown(exchanges.normalise_binance(raw), "id")


@query("normalise_bybit", WITHOUT_ID)
def normalise_bybit(spark, sf):
    path = scratch_path(spark, "bybit-gz")
    t = event_trades(spark, sf)
    rows = t.select(
        (F.unix_micros("datetime") / 1e6).alias("timestamp"), "symbol", F.when(F.col("isBuyerMaker"), "Sell").otherwise("Buy").alias("side"),
        F.col("qty").alias("size"), "price", F.lit("PlusTick").alias("tickDirection"), F.col("id").cast("string").alias("trdMatchID"),
        F.lit(0.0).alias("grossValue"), F.lit(0.0).alias("homeNotional"), F.lit(0.0).alias("foreignNotional"),
    )
    rows.write.option("header", True).option("compression", "gzip").csv(path)
    return _shown(exchanges.read_exchange_trades(spark, "Bybit", path))


def _okx_pages(spark, sf):
    item = F.struct(
        F.col("symbol").alias("instId"), F.col("id").cast("string").alias("tradeId"), F.unix_millis("datetime").cast("string").alias("ts"),
        _text("price").alias("px"), _text("qty").alias("sz"), F.when(F.col("isBuyerMaker"), "sell").otherwise("buy").alias("side"),
    )
    wrap = lambda data: F.to_json(F.struct(F.lit("0").alias("code"), F.lit("").alias("msg"), data.alias("data")))
    return _paged(event_trades(spark, sf), item, wrap)


@query("normalise_okx", MILLIS)
def normalise_okx(spark, sf):
    """JSON responses, landed as one file each and read with the check for error pages."""
    path = scratch_path(spark, "okx-json")
    # a file per response, in a folder per symbol: a folder per response would take most of the time
    _okx_pages(spark, sf).select("body", "symbol").write.partitionBy("symbol").option("maxRecordsPerFile", 1).option("lineSep", " ").text(path)
    return _shown(exchanges.read_exchange_trades(spark, "OKX", f"{path}/*"), "id")


@query("normalise_kraken", EVENTS)
def normalise_kraken(spark, sf):
    seconds = F.format_string("%d.%06d", F.expr("unix_micros(datetime) div 1000000"), F.expr("unix_micros(datetime) % 1000000"))
    item = F.array(
        _text("price"), _text("qty"), seconds, F.when(F.col("isBuyerMaker"), "s").otherwise("b"), F.lit("l"), F.lit(""), F.col("id").cast("string"),
    )
    rows = event_trades(spark, sf)
    pages = rows.groupBy("symbol", F.floor(F.col("id") / PAGE).alias("page")).agg(F.collect_list(item).alias("data"))
    result = F.map_from_arrays(F.array(F.col("symbol"), F.lit("last")), F.array(F.to_json("data"), F.lit('"0"')))
    body = F.concat(F.lit('{"error":[],"result":{'), F.array_join(F.transform(F.map_entries(result), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}}"))
    return _shown(exchanges.normalise_kraken(pages.select(F.lit("").alias("symbol"), body.alias("body"))), "id")


@query("normalise_coinbase", EVENTS)
def normalise_coinbase(spark, sf):
    item = F.struct(
        F.col("id").alias("trade_id"), F.when(F.col("isBuyerMaker"), "sell").otherwise("buy").alias("side"), _text("qty").alias("size"),
        _text("price").alias("price"), F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
    )
    return _shown(exchanges.normalise_coinbase(_paged(event_trades(spark, sf), item)), "id")


CANDLES = f"WITH {TRADES_SQL} {ohlc_sql('12 hours')}"


def _candle_pages(spark, sf, *order: str, time, wrap=None) -> DataFrame:
    bars = ohlc(event_trades(spark, sf), "12h").withColumn("id", F.unix_seconds("datetime"))
    item = F.array(time, *[_text(c) for c in order], F.lit("0"))
    return _paged(bars, item, wrap)


@query("candles_okx", CANDLES)
def candles_okx(spark, sf):
    wrap = lambda data: F.to_json(F.struct(F.lit("0").alias("code"), F.lit("").alias("msg"), data.alias("data")))
    pages = _candle_pages(spark, sf, "open", "high", "low", "close", time=F.unix_millis("datetime").cast("string"), wrap=wrap)
    return exchanges.candles_okx(pages)


@query("candles_kraken", CANDLES)
def candles_kraken(spark, sf):
    wrap = lambda data: F.concat(F.lit('{"error":[],"result":{"PAIR":'), F.to_json(data), F.lit(',"last":"0"}}'))
    pages = _candle_pages(spark, sf, "open", "high", "low", "close", time=F.unix_seconds("datetime").cast("string"), wrap=wrap)
    return exchanges.candles_kraken(pages)


@query("candles_coinbase", CANDLES)
def candles_coinbase(spark, sf):
    pages = _candle_pages(spark, sf, "low", "high", "open", "close", time=F.unix_seconds("datetime").cast("string"))
    return exchanges.candles_coinbase(pages.unionByName(pages))  # overlapping pages


@query("ohlc_csv", CANDLES)
def ohlc_csv(spark, sf):
    path = scratch_path(spark, "ohlc-csv")
    bars = ohlc(event_trades(spark, sf), "12h").withColumns({"open_time": F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"), "volume": F.lit(0.0)})
    bars.select("open_time", "open", "high", "low", "close", "volume", "symbol").write.option("header", True).partitionBy("symbol").csv(path)
    return store.read_ohlc_csv(spark, path, schema=_with_symbol(store.OHLC_CSV)).select("symbol", "datetime", "open", "high", "low", "close")


@query(
    "rejected_pages",
    f"""WITH p AS (SELECT event_type AS symbol, event_id // {PAGE} AS page FROM events GROUP BY ALL)
    SELECT symbol, CASE WHEN page % 2 = 0 THEN 'unparsable' ELSE '50011: Too Many Requests' END AS reason, count(*) AS n FROM p GROUP BY ALL""",
)
def rejected_pages(spark, sf):
    """Every page of the exchange spoilt, cut off or replaced by an error."""
    rows = event_trades(spark, sf).select("symbol", F.floor(F.col("id") / PAGE).alias("page")).distinct()
    cut, error = F.lit('{"code":"0","data":[{"ins'), F.lit('{"code":"50011","msg":"Too Many Requests","data":[]}')
    raw = rows.select("symbol", F.when(F.col("page") % 2 == 0, cut).otherwise(error).alias("body"))
    return exchanges.rejected_pages(raw, "OKX").groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("n"))
