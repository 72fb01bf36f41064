"""Blocked and plain runs of the ordered operators give the same answer."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.classify import roc_auc, roc_points
from tidemark.operators.features import add_log_return_features
from tidemark.operators.metrics import trade_results
from tidemark.operators import ordered
from tidemark.operators.ordered import Timeline, even_blocks, with_lags, with_last_values, with_position, with_recurrence, with_running, with_scan
from tidemark.operators.split import with_split
from tidemark.session import written

ORDER = ("datetime", "id")
PLAIN = Timeline(("symbol",), ORDER)


@pytest.fixture(scope="module")
def ticks(spark):
    """One symbol holds most rows; gaps, bursts, equal times and NULLs included."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        symbol = "HOT" if rng.random() < 0.8 else rng.choice(["a", "b", "lonely"] if i % 900 == 0 else ["a", "b"])
        when = rng.choice([rng.randrange(0, 90_000), rng.randrange(40_000, 40_050), 86_400 * 5])
        value = None if rng.random() < 0.03 else round(rng.uniform(1, 100), 3)
        rows.append((symbol, when, i, value))
    df = spark.createDataFrame(rows, "symbol string, t long, id long, price double")
    return df.select("symbol", F.timestamp_seconds("t").alias("datetime"), "id", "price").repartition(5).cache()


def same(a, b):
    left = a.toPandas().sort_values(["symbol", *ORDER]).reset_index(drop=True)
    right = b.toPandas().sort_values(["symbol", *ORDER]).reset_index(drop=True)[list(left.columns)]
    pd.testing.assert_frame_equal(left, right, rtol=1e-9, check_dtype=False)
    return left


@pytest.mark.parametrize("block", ["1s", "10m", "3h", "30d"])
def test_every_operator_under_blocks(ticks, block):
    line = Timeline(("symbol",), ORDER, block)

    def run(which):
        out = with_lags(ticks, which, {"one": ("price", 1), "three": ("price", 3), "later": (F.col("id") * 2, 7)})
        value = F.coalesce("price", F.lit(0.0)) - 40
        out = with_running(
            out, which, {"total": value}, {"peak": "total"}, {"top": "price"}, {"seen": F.when(F.col("id") % 5 == 0, F.col("price"))}
        )
        return with_position(out, which)

    got = same(run(PLAIN), run(line))
    assert (got["peak"] >= got["total"] - 1e-9).all()


@pytest.mark.parametrize("block", [None, "1s", "10m", "30d"])
def test_recurrence_under_blocks(ticks, block):
    """Halving and doubling without end neither vanishes nor overflows; NULLs change nothing."""
    factor = F.when(F.col("id") % 3 == 0, F.lit(0.5)).when(F.col("id") % 97 == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    got = with_recurrence(ticks, Timeline(("symbol",), ORDER, block), "x", factor, "price").toPandas().sort_values(["symbol", *ORDER])
    for _, part in got.groupby("symbol"):
        x = 0.0
        for row in part.itertuples():
            if row.price == row.price:
                x = x * (0.5 if row.id % 3 == 0 else 0.0 if row.id % 97 == 0 else 1.0) + row.price
            assert row.x == pytest.approx(x, rel=1e-12)
    assert list(got.columns) == ["symbol", "datetime", "id", "price", "x"]


def test_recurrence_of_nothing(spark):
    none = spark.createDataFrame([], "symbol string, datetime timestamp, id long, price double")
    for block in (None, "1h"):
        assert with_recurrence(none, Timeline(("symbol",), ORDER, block), "x", F.lit(1.0), "price").count() == 0


def test_windows_and_splits_under_blocks(ticks):
    line = Timeline(("symbol",), ORDER, "20m")
    same(with_split(ticks, 0.3, PLAIN), with_split(ticks, 0.3, line))
    filled = ticks.where("price is not null")
    same(
        with_last_values(filled, PLAIN, "price", 4).withColumn("window", F.col("window").cast("string")),
        with_last_values(filled, line, "price", 4).withColumn("window", F.col("window").cast("string")),
    )


def test_features_and_trades_under_blocks(ticks):
    line = Timeline(("symbol",), ORDER, "15m")

    def run(which):
        out = add_log_return_features(ticks.where("price is not null"), "price", 1, 2, which)
        out = out.where("price_log_return_lag_2 is not null").withColumn("y_hat", -F.col("price_log_return_lag_1"))
        return trade_results(out, "price_log_return", "y_hat", which)

    got = same(run(PLAIN), run(line))
    assert (got["drawdown_log_return"] <= 1e-9).all()


@pytest.fixture()
def plans(monkeypatch):
    """Plans of the tables that scans write, by name."""
    seen = []

    def watched(df, label="table"):
        seen.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, label)

    monkeypatch.setattr(ordered, "written", watched)
    return seen


def exchanges(plan):
    return plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning")


def test_a_scan_moves_the_rows_once(ticks, plans):
    """Lags, a total with its peak, a maximum and places: one exchange, and none when the table is read."""
    line = Timeline(("symbol",), ORDER, "10m")
    more = {"one": ("price", 1), "three": ("price", 3)}, {"total": F.coalesce("price", F.lit(0.0))}, {"peak": "total"}, {"top": "price"}

    def run(which):
        return with_scan(ticks, which, *more, index="row_no", count="n_rows")

    got = run(line)
    same(run(PLAIN), got)
    assert [label for label, _ in plans] == ["scan", "scan-carry"]
    assert exchanges(plans[0][1]) == 1 and "scan-" in plans[1][1] and "Join" not in plans[1][1]
    read = got._jdf.queryExecution().executedPlan().toString()
    assert exchanges(read) == 0 and "BroadcastHashJoin" in read and "Window" not in read


@pytest.mark.parametrize("name", ["ordered_scan_equity", "rolling_last_n", "tick_log_returns"])
def test_tick_queries_move_their_rows_once(spark, plans, monkeypatch, name):
    from tidemark.catalog import QUERIES

    monkeypatch.setattr(ordered.even_blocks, "__defaults__", (None, 500, 100, 17))
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    scans = [plan for label, plan in plans if label == "scan"]
    assert len(scans) == 1 and exchanges(scans[0]) == 1 and exchanges(out._jdf.queryExecution().executedPlan().toString()) == 0


def test_partitioning_does_not_matter(ticks):
    line = Timeline(("symbol",), ORDER, "1h")
    lags = {"one": ("price", 1), "two": ("price", 2)}
    same(with_lags(ticks.repartition(1), line, lags), with_lags(ticks.repartition(16), line, lags))


def test_even_blocks_cut_bursts_and_equal_times(spark, ticks):
    """A third of the rows share one instant; no block is much larger than its share."""
    marked, line = even_blocks(ticks, PLAIN, 12)
    sizes = [r["count"] for r in marked.where("symbol = 'HOT'").groupBy("_even").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 1.5 * min(sizes)
    thin, thin_line = even_blocks(ticks, PLAIN, 12, sampled=8)
    for rows, which in ((marked, line), (thin, thin_line)):
        lags, sums = {"one": ("price", 1), "five": ("price", 5)}, {"total": F.col("id") * 1.0}
        plain = with_position(with_running(with_lags(ticks, PLAIN, lags), PLAIN, sums), PLAIN)
        same(plain, with_position(with_running(with_lags(rows, which, lags), which, sums), which).drop("_even"))
    with pytest.raises(ValueError):
        even_blocks(ticks, Timeline(("symbol",), ("-id",)), 4)


def test_roc_under_blocks(spark, ticks):
    scored = ticks.where("price is not null").select("symbol", F.floor("price").alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = {r.symbol: r.auc for r in roc_auc(scored, "y", "s", blocks=None).collect()}
    b = {r.symbol: r.auc for r in roc_auc(scored, "y", "s", blocks=7).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) if a[k] is not None else b[k] is None for k in a)
    rows = scored.where("symbol = 'HOT'").toPandas()
    pos, neg = rows.s[rows.y == 1].to_numpy(), rows.s[rows.y == 0].to_numpy()
    wins = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert a["HOT"] == pytest.approx(wins)
    points = roc_points(scored, "y", "s", blocks=7).where("symbol = 'HOT'").orderBy("threshold").collect()
    assert (points[0].fpr, points[0].tpr) == (1.0, 1.0)


def test_bar_lines_are_blocked_only_when_long():
    assert not Timeline.of_bars("1m").blocked and not Timeline.of_bars("12h").blocked and not Timeline.of_bars("1mo").blocked
    assert Timeline.of_bars("1s").blocked


def test_blocks_need_no_single_window_over_a_series(ticks, plans):
    line = Timeline(("symbol",), ORDER, "1h")
    with_running(ticks, line, {"total": "price"})
    plan = plans[0][1]
    rows = [s for s in plan.split("\n") if "Window [" in s and "(_stotal" in s]
    assert rows and all("_block" in s.split("windowspecdefinition")[1] for s in rows)


def test_a_null_keeps_its_place_in_the_window(series):
    out = with_last_values(series("price", a=[1, None, 3, 4]), PLAIN if not PLAIN.order[1:] else Timeline(), "price", 3).orderBy("datetime").collect()
    assert [r["window"] for r in out] == [[1.0], [1.0, None], [1.0, None, 3.0], [None, 3.0, 4.0]]
    assert [r["is_full"] for r in out] == [False, False, True, True]


def test_log_ratio_needs_two_positive_prices(spark):
    from tidemark.functions.maths import log_ratio

    rows = spark.createDataFrame([(-2.0, -1.0), (2.0, 1.0), (0.0, 1.0), (1.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in rows.select(log_ratio("a", "b")).collect()]
    assert got[1] > 0 and [g for i, g in enumerate(got) if i != 1] == [None] * 4


def test_blocks_keep_their_size(spark):
    """One hour holds nine tenths of a series; blocks follow the rows, not the clock."""
    at = F.when(F.col("id") % 10 == 0, F.timestamp_seconds(F.col("id") * 600)).otherwise(F.timestamp_seconds(F.lit(4_000) + F.col("id") % 60))
    rows = spark.range(6000).select(F.lit("a").alias("symbol"), "id", at.alias("datetime"), (F.col("id") % 7).cast("double").alias("price"))
    rows = rows.unionByName(rows.where("id < 300").withColumn("symbol", F.lit("b")))
    cut, line = even_blocks(rows, Timeline(("symbol",), ("datetime", "id")), rows_per_block=500)
    sizes = {tuple(r)[:2]: r["count"] for r in cut.groupBy("symbol", "_even").count().collect()}
    assert sum(sizes.values()) == 6300 and max(sizes.values()) <= 1000
    assert len([k for k in sizes if k[0] == "a"]) == 12 and len([k for k in sizes if k[0] == "b"]) == 1
    whole, one = even_blocks(rows, Timeline(("symbol",), ("datetime", "id")))
    assert {r[0] for r in whole.select("_even").distinct().collect()} == {0} and one.block_column == "_even"
