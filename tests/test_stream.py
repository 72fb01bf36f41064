from __future__ import annotations

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars
from tidemark.operators.features import add_log_return_features, lag_names
from tidemark.operators.ordered import Timeline, with_running
from tidemark.streaming import bars as live_bars
from tidemark.streaming import state, ticks
from tidemark.streaming.run import latest_rows, read_stream, run_to_table

SCHEMA = "symbol string, datetime timestamp, id long, price double"


@pytest.fixture()
def landed(spark, tmp_path):
    """Three files of ticks in time order, each its own micro-batch; one symbol is hot."""
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(240):
        symbol = "HOT" if i % 4 else ("a" if i % 8 else "b")
        rows.append((symbol, start + dt.timedelta(minutes=7 * i), i, 50 + 30 * math.sin(i) + i % 5))
    df = spark.createDataFrame(rows, SCHEMA)
    folder = str(tmp_path / "ticks")
    for part in range(3):
        df.where(F.floor(F.col("id") / 80) == part).coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def stream(spark, folder):
    df = spark.read.schema(SCHEMA).parquet(folder)
    return read_stream(spark, folder, df.schema, {"maxFilesPerTrigger": "1"})


def rows(df, *names):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


def test_lags_across_batches_equal_one_batch(spark, landed):
    df, folder = landed
    names = lag_names("log_return", 3)
    out = ticks.run_lag_stream(stream(spark, folder), 3, [0.1, 0.2, 0.3], 0.01)
    assert {r.batch_id for r in out.select("batch_id").distinct().collect()} == {0, 1, 2}
    want = ticks.lag_vector(df, 3, line=Timeline(("symbol",), ("datetime", "id")))
    assert rows(out, "symbol", "id", *names) == rows(want, "symbol", "id", *names)
    assert out.where("y_hat is not null").count() == 240 - 3 * 3


def test_features_after_a_tick_are_the_batch_lags_of_the_next(spark, landed):
    df, folder = landed
    line = Timeline(("symbol",), ("datetime", "id"))
    batch = add_log_return_features(df, "price", 1, 2, line)
    live = ticks.run_lag_stream(stream(spark, folder), 2)
    for symbol in ("HOT", "a"):
        b = batch.where(F.col("symbol") == symbol).orderBy("datetime").collect()
        s = live.where(F.col("symbol") == symbol).orderBy("datetime").collect()
        assert [r.log_return_lag_2 for r in s[:-1]] == [r.price_log_return_lag_2 for r in b[1:]]


def test_a_retried_batch_changes_nothing(spark, landed):
    df, folder = landed
    step = ticks.RememberedStream(spark, 1, lambda r: ticks.lag_vector(r, 1))
    parts = [df.where(F.floor(F.col("id") / 80) == p) for p in range(3)]
    for n in (0, 1, 1, 2, 2):
        step(parts[n], n)
    want = ticks.lag_vector(df, 1, line=Timeline(("symbol",), ("datetime", "id")))
    got = spark.read.parquet(step.result)
    assert rows(got, "symbol", "id", "log_return_lag_1") == rows(want, "symbol", "id", "log_return_lag_1")


def test_restart_continues_where_it_stopped(spark, landed, tmp_path):
    df, folder = landed
    first, whole = str(tmp_path / "first"), str(tmp_path / "out")
    checkpoint = str(tmp_path / "checkpoint")
    df.where("id < 100").coalesce(1).write.parquet(first)
    schema = spark.read.schema(SCHEMA).parquet(first).schema
    ticks.run_lag_stream(read_stream(spark, first, schema), 2, checkpoint=checkpoint, path=whole)
    df.where("id >= 100").coalesce(1).write.mode("append").parquet(first)
    out = ticks.run_lag_stream(read_stream(spark, first, schema), 2, checkpoint=checkpoint, path=whole)
    names = lag_names("log_return", 2)
    want = ticks.lag_vector(df, 2, line=Timeline(("symbol",), ("datetime", "id")))
    assert rows(out, "symbol", "id", *names) == rows(want, "symbol", "id", *names)


def test_restart_without_a_path_goes_on_with_its_tables(spark, landed, tmp_path):
    df, folder = landed
    folder, line = str(tmp_path / "first"), Timeline(("symbol",), ("datetime", "id"))
    runs = {
        "lags": lambda s, c: ticks.run_lag_stream(s, 2, checkpoint=c),
        "step": lambda s, c: ticks.run_step_stream(s, 2, lambda r: ticks.lag_vector(r, 2), checkpoint=c),
        "table": lambda s, c: spark.read.parquet(run_to_table(s, checkpoint=c)),
    }
    for part in ("id < 100", "id >= 100"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
        schema = spark.read.schema(SCHEMA).parquet(folder).schema
        out = {n: run(read_stream(spark, folder, schema), str(tmp_path / n)) for n, run in runs.items()}
    names = lag_names("log_return", 2)
    want = ticks.lag_vector(df, 2, line=line)
    for n in ("lags", "step"):
        assert rows(out[n], "symbol", "id", *names) == rows(want, "symbol", "id", *names)
    assert out["table"].count() == df.count()


def test_any_look_back_step(spark, landed):
    df, folder = landed
    line = Timeline(("symbol",), ("datetime", "id"), "1h")
    out = ticks.run_step_stream(stream(spark, folder), 240, lambda r: with_running(r, line, maxima={"top": "price"}))
    want = with_running(df, Timeline(("symbol",), ("datetime", "id")), maxima={"top": "price"})
    assert rows(out, "symbol", "id", "top") == rows(want, "symbol", "id", "top")


def test_bars_across_batches(spark, landed):
    df, folder = landed
    path = run_to_table(live_bars.stream_bars(stream(spark, folder), "6h"), "update")
    got = latest_rows(spark.read.parquet(path), ["symbol", "datetime"])
    want = bars.ohlc(df, "6h")
    names = ("symbol", "datetime", "open", "high", "low", "close")
    assert rows(got, *names) == rows(want, *names)
    closed = spark.read.parquet(run_to_table(live_bars.stream_bars(stream(spark, folder), "6h", delay="0 seconds")))
    end = df.agg(F.max("datetime")).first()[0]
    finished = want.where(F.col("datetime") <= F.lit(end - dt.timedelta(hours=6)))
    assert rows(closed, *names) == rows(finished, *names)


def test_weekly_stream_bars_share_the_batch_grid(spark, landed):
    df, folder = landed
    path = run_to_table(live_bars.stream_bars(stream(spark, folder), "1w"), "update")
    got = latest_rows(spark.read.parquet(path), ["symbol", "datetime"])
    assert rows(got, "symbol", "datetime", "close") == rows(bars.ohlc(df, "1w"), "symbol", "datetime", "close")


def test_last_values(spark, landed):
    df, folder = landed
    got = latest_rows(spark.read.parquet(run_to_table(live_bars.stream_last(stream(spark, folder)), "update")), ["symbol"])
    want = {r.symbol: r.price for r in df.groupBy("symbol").agg(F.max_by("price", "id").alias("price")).collect()}
    assert {r.symbol: r.price for r in got.collect()} == want


LINE = Timeline(("symbol",), ("datetime", "id"))


def changes(rows):
    return ticks.lag_vector(rows, 1, line=LINE)


def equity(rows):
    """Batch form of the running stream below."""
    return with_running(changes(rows), LINE, {"total": "log_return_lag_1"}, {"peak": "total"})


@pytest.mark.parametrize("order", [(0, 1, 2), (0, 1, 1, 2, 2), (0, 0, 1, 2)])
def test_running_totals_over_batches_and_retries(spark, landed, order):
    df, _ = landed
    step = ticks.RunningStream(spark, 1, changes, {"total": "log_return_lag_1"}, {"peak": "total"}, LINE)
    parts = [df.where(F.floor(F.col("id") / 80) == p).where("symbol <> 'b' OR id < 80") for p in range(3)]
    for n in order:
        step(parts[n], n)
    got = spark.read.parquet(step.result)
    want = equity(df.where("symbol <> 'b' OR id < 80"))  # one symbol falls silent, and its totals are kept
    assert rows(got, "symbol", "id", "total", "peak") == rows(want, "symbol", "id", "total", "peak")
    totals = {r.symbol for r in spark.read.parquet(f"{step.path}/totals/batch_id=2").collect()}
    assert totals == {"HOT", "a", "b"}


def test_running_totals_after_a_restart(spark, landed, tmp_path):
    df, _ = landed
    folder = str(tmp_path / "first")
    for part in ("id < 100", "id >= 100"):
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
        source = read_stream(spark, folder, spark.read.schema(SCHEMA).parquet(folder).schema)
        out = ticks.run_running_stream(source, 1, changes, {"total": "log_return_lag_1"}, {"peak": "total"}, LINE, str(tmp_path / "c"))
    assert rows(out, "symbol", "id", "total", "peak") == rows(equity(df), "symbol", "id", "total", "peak")
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_own_processor_on_a_stream(spark, landed):
    class Count(state.SeriesProcessor):
        output = "symbol string, seen long"
        remember = "n long"

        def first_state(self):
            return (0,)

        def on_events(self, key, events, memory):
            n = memory[0] + len(events)
            return pd.DataFrame({"symbol": [key[0]], "seen": [n]}), (n,)

    df, folder = landed
    out = spark.read.parquet(run_to_table(state.apply(stream(spark, folder), Count())))
    got = {r.symbol: r.n for r in out.groupBy("symbol").agg(F.max("seen").alias("n")).collect()}
    assert got == {r.symbol: r["count"] for r in df.groupBy("symbol").count().collect()}
