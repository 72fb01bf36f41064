from __future__ import annotations

import datetime as dt
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.schema import TRADE_COLUMNS
from tidemark.sources import exchanges, store

NOON = dt.datetime(2024, 1, 2, 12, 0, 0, 250000)
MS = int(NOON.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def put(path, text):
    with open(path, "w") as f:
        f.write(text if isinstance(text, str) else json.dumps(text))
    return str(path)


def one(df):
    assert df.columns == TRADE_COLUMNS
    rows = df.collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.datetime, r.date) == (NOON, NOON.date())
    return r


def test_binance(spark, tmp_path):
    put(tmp_path / "BTCUSDT-trades-2024-01-02.csv", f"id,price,qty,quote_qty,time,is_buyer_maker\n7,100.5,2.0,201.0,{MS},true\n")
    r = one(exchanges.read_exchange_trades(spark, "binance", f"{tmp_path}/*.csv"))
    assert (r.exchange, r.symbol, r.id, r.price, r.quoteQty, r.isBuyerMaker) == ("Binance", "BTCUSDT", 7, 100.5, 201.0, True)


def test_bybit(spark, tmp_path):
    head = "timestamp,symbol,side,size,price,tickDirection,trdMatchID,grossValue,homeNotional,foreignNotional\n"
    with gzip.open(tmp_path / "BTCUSDT2024-01-02.csv.gz", "wt") as f:
        f.write(head + f"{MS / 1000},BTCUSDT,Sell,2,100.5,PlusTick,m-1,1,2,201\n")
    r = one(exchanges.read_exchange_trades(spark, "Bybit", str(tmp_path)))
    assert (r.qty, r.quoteQty, r.isBuyerMaker) == (2, 201, True)


def test_okx(spark, tmp_path):
    body = {"code": "0", "msg": "", "data": [{"instId": "BTC-USDT", "tradeId": "9", "px": "100.5", "sz": "2", "side": "buy", "ts": str(MS)}]}
    put(tmp_path / "a-trades-1.json", body)
    put(tmp_path / "b-trades-1.json", {"code": "51001", "msg": "no such instrument", "data": []})
    r = one(exchanges.read_exchange_trades(spark, "okx", str(tmp_path), on_error="skip"))
    assert (r.symbol, r.id, r.price, r.isBuyerMaker) == ("BTC-USDT", 9, 100.5, False)
    with pytest.raises(Exception, match="51001: no such instrument"):
        exchanges.read_exchange_trades(spark, "okx", str(tmp_path)).collect()
    with pytest.raises(ValueError):
        exchanges.read_exchange_trades(spark, "okx", str(tmp_path), on_error="ignore")
    (r,) = exchanges.read_rejects(spark, "okx", str(tmp_path)).collect()
    assert (r.symbol, r.reason) == ("b", "51001: no such instrument")


@pytest.mark.parametrize("name, body, reason", [
    ("kraken", '{"error":["EQuery:Unknown asset pair"]}', "EQuery:Unknown asset pair"), ("kraken", "<html>", "unparsable"),
    ("coinbase", '{"message":"NotFound"}', "unparsable"), ("okx", "", "unparsable"),
])
def test_spoilt_pages_are_named(spark, name, body, reason):
    raw = spark.createDataFrame([("X", body)], "symbol string, body string")
    assert [r.reason for r in exchanges.rejected_pages(raw, name).collect()] == [reason]


def test_an_empty_range_is_an_error(spark, tmp_path):
    from tidemark.sources import store

    rows = spark.sql("SELECT 'Binance' AS exchange, 'X' AS symbol, 1L AS id, timestamp'2024-01-02 03:00:00' AS datetime, 1.0D AS price, 2.0D AS qty, "
                     "2.0D AS quoteQty, true AS isBuyerMaker, date'2024-01-02' AS date")
    path = str(tmp_path / "store")
    store.write_trades(rows, path)
    with pytest.raises(ValueError):
        store.load_bars(spark, path, "1h", start="2024-02-01", end="2024-02-02")
    assert store.load_bars(spark, path, "1h", start="2024-02-01", end="2024-02-02", required=False).count() == 0
    bars, gaps = store.load_bars_and_gaps(spark, path, "1h", start="2024-01-01", end="2024-01-03")
    assert bars.count() == 1 and [str(r.date) for r in gaps.orderBy("date").collect()] == ["2024-01-01", "2024-01-03"]
    _, gaps = store.load_bars_and_gaps(spark, path, "1h", start="2024-01-01", end="2024-01-03", symbols=["X", "Y"])
    assert sorted((r.symbol, r.date.day) for r in gaps.collect()) == [("X", 1), ("X", 3), ("Y", 1), ("Y", 2), ("Y", 3)]
    store.add_missing_days(rows.withColumn("price", rows.price * 2), path)  # the day is there and stays
    assert store.read_trades(spark, path).first().price == 1.0


def test_kraken(spark, tmp_path):
    body = {"error": [], "result": {"XXBTZUSD": [["100.5", "2.0", MS / 1000, "s", "l", "", 12]], "last": "1688671200000000000"}}
    put(tmp_path / "page.json", body)
    r = one(exchanges.read_exchange_trades(spark, "kraken", str(tmp_path)))
    assert (r.symbol, r.id, r.qty, r.isBuyerMaker) == ("XXBTZUSD", 12, 2.0, True)


def test_coinbase(spark, tmp_path):
    put(tmp_path / "BTC-USD-trades-1.json", [{"trade_id": 3, "side": "sell", "size": "2", "price": "100.5", "time": "2024-01-02T12:00:00.250000Z"}])
    r = one(exchanges.read_exchange_trades(spark, "coinbase", str(tmp_path)))
    assert (r.symbol, r.id, r.quoteQty, r.isBuyerMaker) == ("BTC-USD", 3, 201.0, True)


def test_candles(spark, tmp_path):
    for name in ("okx", "kraken", "coinbase"):
        (tmp_path / name).mkdir()
    put(tmp_path / "okx" / "X-candles-1.json", {"code": "0", "msg": "", "data": [[str(MS), "1", "4", "0.5", "2", "9", "9", "9", "1"]]})
    put(tmp_path / "kraken" / "X-candles-1.json", {"error": [], "result": {"P": [[MS // 1000, "1", "4", "0.5", "2", "1.5", "9", 3]], "last": 1}})
    put(tmp_path / "coinbase" / "X-candles-1.json", [[MS // 1000, 0.5, 4, 1, 2, 9]])
    put(tmp_path / "coinbase" / "X-candles-2.json", [[MS // 1000, 0.5, 4, 1, 2, 9]])
    for name in ("okx", "kraken", "coinbase"):
        rows = exchanges.read_exchange_candles(spark, name, str(tmp_path / name)).collect()
        assert [(r.symbol, r.open, r.high, r.low, r.close) for r in rows] == [("X", 1, 4, 0.5, 2)], name


def test_a_further_exchange(spark, tmp_path):
    def mine(raw):
        return raw.select(
            F.lit("Mine").alias("exchange"), "symbol", F.lit(1).cast("long").alias("id"), F.lit(NOON).alias("datetime"),
            F.col("body").cast("double").alias("price"), F.lit(1.0).alias("qty"), F.lit(1.0).alias("quoteQty"),
            F.lit(True).alias("isBuyerMaker"), F.lit(NOON.date()).alias("date"),
        )

    exchanges.register_exchange("mine", mine)
    put(tmp_path / "A-trades-1.txt", "5")
    assert one(exchanges.read_exchange_trades(spark, "Mine", str(tmp_path))).price == 5


def test_fee_schedule(spark):
    rows = {r.exchange: (r.maker_fee, r.taker_fee) for r in exchanges.fee_schedule(spark).collect()}
    assert rows["Binance"] == (0.00045, 0.00045) and rows["Bybit"] == (0.0002, 0.00055) and len(rows) == 5
    df = exchanges.with_fees(spark.createDataFrame([("OKX",), ("Nowhere",)], "exchange string"))
    assert {r.exchange: r.taker_fee for r in df.collect()} == {"OKX": 0.0005, "Nowhere": None}


@pytest.fixture()
def trades(spark):
    def make(days, symbol="BTC", price=1.0):
        rows = [("Binance", symbol, i, dt.datetime(2024, 1, d, 9, i % 60), float(price), 1.0, 1.0, True, dt.date(2024, 1, d)) for i, d in enumerate(days)]
        from tidemark.schema import TRADES

        return spark.createDataFrame(rows, TRADES)

    return make


def test_store_round_trip_ranges_and_rewrites(spark, tmp_path, trades):
    path = str(tmp_path / "store")
    store.write_trades(trades([1, 1, 2, 3, 5]), path)
    store.write_trades(trades([2, 2, 2]), path)
    counts = {r.date.day: r["count"] for r in store.read_trades(spark, path).groupBy("date").count().collect()}
    assert counts == {1: 2, 2: 3, 3: 1, 5: 1}
    part = store.read_trades(spark, path, "BTC", "2024-01-02", dt.date(2024, 1, 3))
    assert part.count() == 4
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "date" in plan.split("PartitionFilters:")[1]
    with pytest.raises(ValueError):
        store.read_trades(spark, path, start="2024-01-03", end="2024-01-02")
    with pytest.raises(ValueError):
        store.require_rows(store.read_trades(spark, path, "ETH"))
    assert store.load_bars(spark, path, "1d", symbols="BTC").count() == 4


def test_missing_days_and_coverage(spark, trades):
    df = trades([1, 2, 5]).unionByName(trades([3], "ETH", price=0.0))
    got = sorted((r.symbol, r.date.day) for r in store.missing_days(df, "2024-01-01", "2024-01-05").collect())
    assert got == [("BTC", 3), ("BTC", 4), ("ETH", 1), ("ETH", 2), ("ETH", 4), ("ETH", 5)]
    rows = {r.symbol: r for r in store.coverage(df, "2024-01-01", "2024-01-05").collect()}
    assert (rows["BTC"].days_present, rows["BTC"].days_missing, rows["BTC"].bad_rows) == (3, 2, 0)
    assert rows["ETH"].bad_rows == 1


def test_last_days_end_yesterday(trades):
    got = store.last_days(trades([1, 2, 3, 4, 5]), 2, today="2024-01-05")
    assert sorted(r.date.day for r in got.collect()) == [3, 4]


def test_flat_files_of_a_symbol(spark, tmp_path, trades):
    for symbol in ("BTC", "BTCUP"):
        for day in (1, 2):
            source = trades([day], symbol).drop("symbol", "exchange", "date").coalesce(1)
            source.write.parquet(str(tmp_path / f"w-{symbol}-{day}"))
            made = next(p for p in (tmp_path / f"w-{symbol}-{day}").iterdir() if p.name.endswith(".parquet"))
            os.link(made, tmp_path / f"{symbol}-trades-2024-01-{day:02d}.parquet")
    os.link(made, tmp_path / "BTC-trades-notes.txt")
    out = store.read_symbol_files(spark, str(tmp_path), "BTC")
    assert out.count() == 2 and {r.symbol for r in out.collect()} == {"BTC"}
    assert bars.ohlc(out, "1d").count() == 2
    assert store.read_symbol_files(spark, str(tmp_path), "BTC", start="2024-01-02").count() == 1
    (tmp_path / "BTC-trades-2024-01-03.parquet").write_text("no parquet")
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "odd"))
    os.link(next(p for p in (tmp_path / "odd").iterdir() if p.name.endswith(".parquet")), tmp_path / "BTC-trades-2024-01-04.parquet")
    with pytest.raises(ValueError, match="2024-01-0[34]"):
        store.read_symbol_files(spark, str(tmp_path), "BTC")
    assert store.read_symbol_files(spark, str(tmp_path), "BTC", on_error="skip").count() == 2
    assert store.read_symbol_files(spark, str(tmp_path), "BTC", end="2024-01-02").count() == 2
    checked = {str(r.day): (r.rows, r.reason) for r in store.check_symbol_files(spark, str(tmp_path), "BTC").collect()}
    assert checked == {"2024-01-01": (1, None), "2024-01-02": (1, None), "2024-01-03": (0, "unreadable or empty"), "2024-01-04": (2, "no datetime")}
    with pytest.raises(ValueError, match="no files"):
        store.read_symbol_files(spark, str(tmp_path), "ETH")


def test_ohlc_csv(spark, tmp_path):
    path = put(tmp_path / "bars.csv", "open_time,open,high,low,close,volume\n2024-01-01 00:00:00,1,2,0.5,1.5,10\n")
    r = store.read_ohlc_csv(spark, path, "BTC").first()
    assert (r.symbol, r.datetime, r.close) == ("BTC", dt.datetime(2024, 1, 1), 1.5)


def test_dense_days(spark):
    assert [r.date.day for r in store.dense_days(spark, "2024-02-27", "2024-03-01").collect()] == [27, 28, 29, 1]


def test_okx_responses_share_a_folder_per_symbol(spark, tmp_path):
    from tidemark.catalog import QUERIES

    rows = [(250 * i, "ab"[i % 2], dt.datetime(2024, 1, 1, 0, 0, i), 1.5 + i, '{"k": 2}', i) for i in range(40)]
    rows += [rows[0], (9, None, dt.datetime(2024, 1, 2), 3.0, '{"k": 1}', 1)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz, value double, props string, user_id long")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["normalise_okx"](spark, str(tmp_path))
    files = got.inputFiles()
    assert len(files) == 41  # a file per response: one per symbol and page
    assert len({f.rsplit("/", 1)[0] for f in files}) == 3  # a folder per symbol, none per response
    assert sorted((r.id, r.price, r.qty, r.isBuyerMaker) for r in got.collect()) == sorted((i, v, float(p[6]), u % 2 == 0) for i, _, _, v, p, u in rows)
