"""Raw exchange files to canonical trades and bars.

Files are landed by other means (this package opens no connection); each reader
takes a path or glob of landed files. A normaliser turns the raw table into the
canonical schema and can be registered for a further exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TRADE_COLUMNS, _struct
from ..session import use_utc

# Exchange file layouts.
BINANCE_CSV = _struct("id long, price double, qty double, quoteQty double, time long, isBuyerMaker boolean")
BYBIT_CSV = _struct(
    "timestamp double, symbol string, side string, size double, price double, tickDirection string,"
    " trdMatchID string, grossValue double, homeNotional double, foreignNotional double"
)
OKX_TRADES = "code string, msg string, data array<struct<instId string, tradeId string, ts string, px string, sz string, side string>>"
OKX_CANDLES = "code string, msg string, data array<array<string>>"
KRAKEN_RESULT = "error array<string>, result map<string,string>"
COINBASE_TRADES = "array<struct<trade_id bigint, side string, size string, price string, time string>>"
ROWS = "array<array<string>>"

# Fee rates per exchange.
FEE_SCHEDULE = [
    ("Binance", 0.00045, 0.00045),
    ("Bybit", 0.0002, 0.00055),
    ("OKX", 0.0002, 0.0005),
    ("Kraken", 0.0002, 0.0005),
    ("Coinbase", 0.004, 0.006),
]


def fee_schedule(spark: SparkSession) -> DataFrame:
    """Maker and taker rate of the five exchanges (five rows, so joins may broadcast it)."""
    return spark.createDataFrame(FEE_SCHEDULE, "exchange string, maker_fee double, taker_fee double")


def with_fees(df: DataFrame, fees: DataFrame | None = None) -> DataFrame:
    """Look up ``maker_fee`` and ``taker_fee`` by exchange."""
    if fees is None:
        fees = F.broadcast(fee_schedule(df.sparkSession))  # always five rows
    return df.join(fees, "exchange", "left")


def file_symbol() -> Column:
    """The symbol in a file name such as ``BTCUSDT-trades-2024-01-01.csv``."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.+?)-(?:trades|candles)", 1)


def _trades(df: DataFrame, exchange: str, **columns: Column) -> DataFrame:
    out = df.select(F.lit(exchange).alias("exchange"), *[c.alias(n) for n, c in columns.items()])
    out = out.withColumn("quoteQty", F.coalesce("quoteQty", F.col("price") * F.col("qty")))
    return out.withColumn("date", F.to_date("datetime")).select(*TRADE_COLUMNS)


def _responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed API responses, one per file. A response is one page (at most about a
    thousand trades), so reading a file whole is bounded by the exchange's page size."""
    use_utc(spark)
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("value").alias("body"), file_symbol().alias("symbol"))


def normalise_binance(raw: DataFrame) -> DataFrame:
    return _trades(
        raw, "Binance", symbol=F.col("symbol"), id=F.col("id"), datetime=F.timestamp_millis("time"),
        price=F.col("price"), qty=F.col("qty"), quoteQty=F.col("quoteQty"), isBuyerMaker=F.col("isBuyerMaker"),
    )


def read_binance(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    use_utc(spark)
    raw = spark.read.schema(BINANCE_CSV).option("header", header).csv(path)
    return normalise_binance(raw.select("*", file_symbol().alias("symbol")))


def normalise_bybit(raw: DataFrame) -> DataFrame:
    """Bybit has no number for a trade; its match id, hashed, breaks ties in time."""
    return _trades(
        raw, "Bybit", symbol=F.col("symbol"), id=F.xxhash64("trdMatchID"),
        datetime=F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("long")),
        price=F.col("price"), qty=F.col("size"), quoteQty=F.col("price") * F.col("size"),
        isBuyerMaker=F.col("side") == "Sell",
    )


def read_bybit(spark: SparkSession, path: str) -> DataFrame:
    """Gzipped CSV, one file per symbol and day (a gzip file is one task)."""
    use_utc(spark)
    return normalise_bybit(spark.read.schema(BYBIT_CSV).option("header", True).csv(path))


def normalise_okx(raw: DataFrame) -> DataFrame:
    rows = raw.select("symbol", F.from_json("body", OKX_TRADES).alias("r"))
    rows = rows.where(F.col("r.code") == "0").select("symbol", F.explode("r.data").alias("t"))
    return _trades(
        rows, "OKX", symbol=F.coalesce("t.instId", "symbol"),
        id=F.coalesce(F.col("t.tradeId").try_cast("long"), F.xxhash64("t.ts", "t.px", "t.sz", "t.side")),
        datetime=F.timestamp_millis(F.col("t.ts").cast("long")),
        price=F.col("t.px").cast("double"), qty=F.col("t.sz").cast("double"),
        quoteQty=F.col("t.px").cast("double") * F.col("t.sz").cast("double"), isBuyerMaker=F.col("t.side") == "sell",
    )


def _kraken_rows(raw: DataFrame) -> DataFrame:
    """Kraken names its result after the pair; every entry but ``last`` is a table."""
    rows = raw.select("symbol", F.from_json("body", KRAKEN_RESULT).alias("r"))
    rows = rows.where(F.size(F.coalesce("r.error", F.array())) == 0)
    rows = rows.select("symbol", F.explode("r.result").alias("key", "table")).where(F.col("key") != "last")
    return rows.select("symbol", "key", F.explode(F.from_json("table", ROWS)).alias("v"))


def normalise_kraken(raw: DataFrame) -> DataFrame:
    rows = _kraken_rows(raw)
    at = lambda i: F.get("v", F.lit(i))
    return _trades(
        rows, "Kraken", symbol=F.when(F.col("symbol") != "", F.col("symbol")).otherwise(F.col("key")),
        id=F.coalesce(at(6).try_cast("long"), F.xxhash64("v")),
        datetime=F.timestamp_micros((at(2).cast("decimal(20,6)") * 1_000_000).cast("long")),
        price=at(0).cast("double"), qty=at(1).cast("double"), quoteQty=at(0).cast("double") * at(1).cast("double"),
        isBuyerMaker=at(3) == "s",
    )


def normalise_coinbase(raw: DataFrame) -> DataFrame:
    rows = raw.select("symbol", F.explode(F.from_json("body", COINBASE_TRADES)).alias("t"))
    return _trades(
        rows, "Coinbase", symbol=F.col("symbol"), id=F.col("t.trade_id"), datetime=F.to_timestamp("t.time"),
        price=F.col("t.price").cast("double"), qty=F.col("t.size").cast("double"),
        quoteQty=F.col("t.price").cast("double") * F.col("t.size").cast("double"), isBuyerMaker=F.col("t.side") == "sell",
    )


def _bars(symbol: Column, time: Column, prices: dict[str, Column], rows: DataFrame) -> DataFrame:
    return rows.select(
        symbol.alias("symbol"), time.alias("datetime"),
        *[prices[n].cast("double").alias(n) for n in ("open", "high", "low", "close")],
    )


def candles_okx(raw: DataFrame) -> DataFrame:
    rows = raw.select("symbol", F.from_json("body", OKX_CANDLES).alias("r")).where(F.col("r.code") == "0")
    rows = rows.select("symbol", F.explode("r.data").alias("v"))
    at = lambda i: F.get("v", F.lit(i))
    prices = {"open": at(1), "high": at(2), "low": at(3), "close": at(4)}
    return _bars(F.col("symbol"), F.timestamp_millis(at(0).cast("long")), prices, rows)


def candles_kraken(raw: DataFrame) -> DataFrame:
    at = lambda i: F.get("v", F.lit(i))
    symbol = F.when(F.col("symbol") != "", F.col("symbol")).otherwise(F.col("key"))
    prices = {"open": at(1), "high": at(2), "low": at(3), "close": at(4)}
    return _bars(symbol, F.timestamp_seconds(at(0).cast("long")), prices, _kraken_rows(raw))


def candles_coinbase(raw: DataFrame) -> DataFrame:
    """Coinbase puts low and high before open and close; overlapping pages repeat candles."""
    rows = raw.select("symbol", F.explode(F.from_json("body", ROWS)).alias("v"))
    at = lambda i: F.get("v", F.lit(i))
    prices = {"low": at(1), "high": at(2), "open": at(3), "close": at(4)}
    bars = _bars(F.col("symbol"), F.timestamp_seconds(at(0).cast("long")), prices, rows)
    return one_per_time(bars)


def one_per_time(bars: DataFrame) -> DataFrame:
    """One bar per symbol and time; of repeated ones the same is always kept."""
    body = [c for c in bars.columns if c not in ("symbol", "datetime")]
    kept = bars.groupBy("symbol", "datetime").agg(F.max(F.struct(*body)).alias("_b"))
    return kept.select("symbol", "datetime", "_b.*")


def _okx_reason(body: Column) -> Column:
    reply = F.from_json(body, "code string, msg string")
    return F.when(reply["code"].isNull(), "unparsable").when(reply["code"] != "0", F.concat_ws(": ", reply["code"], reply["msg"]))


def _kraken_reason(body: Column) -> Column:
    reply = F.from_json(body, KRAKEN_RESULT)
    return F.when(F.size(reply["error"]) > 0, F.array_join(reply["error"], "; ")).when(reply["result"].isNull(), "unparsable")


def _coinbase_reason(body: Column) -> Column:
    return F.when(F.from_json(body, "array<string>").isNull(), "unparsable")


#: Why a landed response holds no table, NULL where it does.
REASONS: dict[str, Callable[[Column], Column]] = {"okx": _okx_reason, "kraken": _kraken_reason, "coinbase": _coinbase_reason}


def rejected_pages(raw: DataFrame, exchange: str) -> DataFrame:
    """``(symbol, reason, body)`` of the responses that are errors or cannot be read."""
    reason = REASONS[exchange.lower()](F.col("body"))
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("symbol", "reason", "body")


def _checked(raw: DataFrame, exchange: str, on_error: str) -> DataFrame:
    if on_error not in ("raise", "skip"):
        raise ValueError("on_error must be raise or skip")
    if on_error == "skip" or exchange not in REASONS:
        return raw
    reason = REASONS[exchange](F.col("body"))
    failed = F.raise_error(F.concat(F.lit(f"{exchange} response: "), reason)).cast("string")
    return raw.withColumn("body", F.when(reason.isNotNull(), failed).otherwise(F.col("body")))


TRADE_NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "binance": normalise_binance, "bybit": normalise_bybit, "okx": normalise_okx,
    "kraken": normalise_kraken, "coinbase": normalise_coinbase,
}
TRADE_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"binance": read_binance, "bybit": read_bybit}
CANDLE_NORMALISERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "okx": candles_okx, "kraken": candles_kraken, "coinbase": candles_coinbase,
}


def register_exchange(
    name: str, normaliser: Callable[[DataFrame], DataFrame], reader: Callable[[SparkSession, str], DataFrame] | None = None
) -> None:
    """Add an exchange. Without a reader its files are JSON responses (``body``, ``symbol``)."""
    TRADE_NORMALISERS[name.lower()] = normaliser
    if reader:
        TRADE_READERS[name.lower()] = reader


def read_exchange_trades(spark: SparkSession, exchange: str, path: str, on_error: str = "raise") -> DataFrame:
    """Canonical trades of one exchange's landed files.

    A response that is an error or cannot be read fails the job, or with
    ``on_error="skip"`` is left out; :func:`read_rejects` lists such responses.
    """
    name = exchange.lower()
    if name in TRADE_READERS:
        return TRADE_READERS[name](spark, path)
    return TRADE_NORMALISERS[name](_checked(_responses(spark, path), name, on_error))


def read_exchange_candles(spark: SparkSession, exchange: str, path: str, on_error: str = "raise") -> DataFrame:
    name = exchange.lower()
    return CANDLE_NORMALISERS[name](_checked(_responses(spark, path), name, on_error))


def read_rejects(spark: SparkSession, exchange: str, path: str) -> DataFrame:
    """The landed responses of an exchange that hold no table, with the reason."""
    return rejected_pages(_responses(spark, path), exchange)


def union_exchanges(*tables: DataFrame) -> DataFrame:
    """Trades of several exchanges in one table, matched by column name."""
    out = tables[0].select(*TRADE_COLUMNS)
    for table in tables[1:]:
        out = out.unionByName(table.select(*TRADE_COLUMNS))
    return out


