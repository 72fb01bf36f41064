"""Canonical schemas. Nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    out = T.StructType()
    for part in text.split(","):
        name, kind = part.split()
        out = out.add(name, kind)
    return out


TRADES = _struct(
    "exchange string, symbol string, id long, datetime timestamp, price double, qty double,"
    " quoteQty double, isBuyerMaker boolean, date date"
)
TRADE_COLUMNS = [f.name for f in TRADES.fields]
BARS = _struct("symbol string, datetime timestamp, open double, high double, low double, close double")
FEES = _struct("exchange string, maker_fee double, taker_fee double")
MODELS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("model_id", T.IntegerType()),
        T.StructField("features", T.StringType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("bias", T.DoubleType()),
        T.StructField("n_train", T.DoubleType()),
        T.StructField("rms", T.DoubleType()),
    ]
)
ORDERS = T.StructType(
    [
        T.StructField("account", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("datetime", T.TimestampType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("signed_qty", T.DecimalType(18, 8)),
        T.StructField("price", T.DecimalType(18, 8)),
    ]
)
OHLC_CSV = _struct("open_time timestamp, open double, high double, low double, close double, volume double")
