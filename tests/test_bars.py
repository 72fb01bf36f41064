from __future__ import annotations

import datetime as dt
import statistics

import pytest
from conftest import column
from pyspark.sql import functions as F

from tidemark.functions.intervals import bar_start
from tidemark.operators import bars


@pytest.fixture()
def trades(spark):
    def make(*rows):
        data = [(s, dt.datetime.fromisoformat(t), i, float(p), 1.0) for s, t, i, p in rows]
        return spark.createDataFrame(data, "symbol string, datetime timestamp, id long, price double, qty double").repartition(4)

    return make


def test_left_closed_grid_without_empty_bars(trades):
    out = bars.ohlc(
        trades(("a", "2024-01-01 00:00:00", 1, 5), ("a", "2024-01-01 11:59:59", 2, 7), ("a", "2024-01-01 12:00:00", 3, 6), ("a", "2024-01-03 01:00:00", 4, 9)),
        "12h",
    )
    got = [(str(r.datetime), r.open, r.high, r.low, r.close) for r in out.orderBy("datetime").collect()]
    assert got == [("2024-01-01 00:00:00", 5, 7, 5, 7), ("2024-01-01 12:00:00", 6, 6, 6, 6), ("2024-01-03 00:00:00", 9, 9, 9, 9)]


def test_equal_times_are_settled_by_id(trades):
    rows = [("a", "2024-01-01 00:00:01", i, p) for i, p in [(3, 30), (1, 10), (2, 20)]]
    for parts in (1, 4, 16):
        one = bars.ohlc(trades(*rows).repartition(parts), "1h").first()
        assert (one.open, one.close) == (10, 30)


def test_weeks_begin_on_monday(trades):
    out = bars.ohlc(trades(("a", "2024-01-07 23:59:59", 1, 1), ("a", "2024-01-08 00:00:00", 2, 2)), "1w")
    assert [str(d.date()) for d in column(out, "datetime")] == ["2024-01-01", "2024-01-08"]


def test_calendar_bars(spark):
    days = spark.createDataFrame([("2024-02-29",), ("2023-12-31",), ("1969-07-20",)], "d string").withColumn("t", F.to_timestamp("d"))
    got = {r.d: (str(r.m.date()), str(r.q.date()), str(r.y.date())) for r in days.select("d", bar_start("t", "1mo").alias("m"), bar_start("t", "1q").alias("q"), bar_start("t", "2y").alias("y")).collect()}
    assert got["2024-02-29"] == ("2024-02-01", "2024-01-01", "2024-01-01")
    assert got["2023-12-31"] == ("2023-12-01", "2023-10-01", "2022-01-01")
    assert got["1969-07-20"] == ("1969-07-01", "1969-07-01", "1968-01-01")


def test_a_bar_across_inputs_is_one_bar(trades):
    a = trades(("a", "2024-01-02 23:00:00", 1, 5))
    b = trades(("a", "2024-01-03 01:00:00", 2, 8))
    assert bars.resample(a.unionByName(b), "2d", F.count(F.lit(1)).alias("n")).first().n == 2


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_medians_are_exact(trades, n):
    prices = [3, 1, 4, 1, 5, 9, 2, 6][:n]
    df = trades(*[("a", "2024-01-01 00:00:01", i, p) for i, p in enumerate(prices)])
    assert bars.median_bars(df, "1h").first().median == statistics.median(prices)
    assert bars.median_bars(df, "1h", method="nearest").first().median == statistics.median_high(prices)
    assert bars.median_bars(df, "1h", blocks=3).first().median == statistics.median(prices)
    with pytest.raises(ValueError):
        bars.median_bars(df, "1h", method="guess")


def test_coarsening_equals_direct_bars(trades):
    rows = [("a", f"2024-01-01 {h:02d}:30:00", h, (h * 7) % 11 + 1) for h in range(24)]
    fine = bars.ohlc(trades(*rows), "1h")
    a = [tuple(r) for r in bars.coarsen(fine, "6h").orderBy("datetime").collect()]
    b = [tuple(r) for r in bars.ohlc(trades(*rows), "6h").orderBy("datetime").collect()]
    assert a == b


def test_a_ladder_equals_separate_bars(trades):
    rows = trades(*[("a", f"2024-01-01 {h:02d}:{m:02d}:00", h * 60 + m, (h * 7 + m) % 11 + 1) for h in range(24) for m in (1, 40)])
    for every, table in bars.bar_ladder(rows, ["1h", "6h", "1d"]).items():
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, bars.ohlc(rows, every).collect()))


def test_one_price_reads_one_price(trades):
    df = trades(("a", "2024-01-01 00:00:01", 1, 5), ("a", "2024-01-01 00:00:02", 2, 7))
    assert bars.one_price(df, "1h", "low").columns == ["symbol", "datetime", "low"]
    with pytest.raises(ValueError):
        bars.one_price(df, "1h", "vwap")


def test_prefix_and_align(trades):
    a = bars.prefixed_ohlc(trades(("a", "2024-01-01 00:00:01", 1, 5), ("a", "2024-01-01 05:00:01", 2, 5)), "1h", "a", keep=("datetime",))
    b = bars.prefixed_ohlc(trades(("b", "2024-01-01 05:10:01", 1, 9)), "1h", "b", keep=("datetime",))
    both = bars.align(a, b).collect()
    assert len(both) == 1 and both[0].a_close == 5 and both[0].b_close == 9


def test_bars_use_hash_aggregation_when_one_column_orders(trades):
    df = trades(("a", "2024-01-01 00:00:01", 1, 5))
    plan = bars.ohlc(df, "1h", order=("datetime",))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_bars_need_no_sort(spark):
    """Open and close are decided by a packed (time, id), which hash aggregation can hold; ids of any sign keep their order."""
    import datetime as dt

    from tidemark.operators import bars

    at = dt.datetime(2024, 1, 1)
    rows = [("a", -5, at, 1.0), ("a", 2**63 - 1, at, 4.0), ("a", -(2**63), at, 0.5), ("a", 7, at, 3.0), ("a", None, at, 9.0)]
    df = spark.createDataFrame(rows, "symbol string, id long, datetime timestamp, price double")
    out = bars.ohlc(df, "1h")
    (r,) = out.collect()
    assert (r["open"], r["high"], r["low"], r["close"]) == (9.0, 9.0, 0.5, 4.0)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
