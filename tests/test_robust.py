"""Fits under Huber, least-absolute and logistic loss against enumeration, copies of rows and each other."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.plans import regression, robust


def fitted(loss, x, y):
    """A fit in plain arrays."""
    a = np.c_[x, np.ones(len(y))]
    use = robust.independent(a.T @ a / len(y), range(a.shape[1] - 1))
    at = np.zeros(a.shape[1])
    at[use > 0] = np.linalg.lstsq(a[:, use > 0], 4 * y - 2 if loss == "logistic" else y, rcond=None)[0]
    fit = robust.Fit.begin(loss, at, float(len(y)), float(np.sqrt(np.mean((y - a @ at) ** 2))), float(np.sqrt(np.mean(y * y))), use)
    noise = np.random.default_rng(0).uniform(-1, 1, len(y))
    while fit.mode != "done":
        robust._advance(fit, a, y, noise)
    return fit, a


def least_absolute(a, y):
    """The least sum of absolute errors over all vertices."""
    own = [list(c) for c in combinations(range(len(y)), a.shape[1]) if abs(np.linalg.det(a[list(c)])) > 1e-9]
    return min((np.abs(y - a @ np.linalg.solve(a[c], y[c])).sum() for c in own), default=None)


@pytest.mark.parametrize("seed", range(60))
def test_least_absolute_error_is_a_vertex(seed):
    rng = np.random.default_rng(seed)
    n, p = rng.integers(4, 22), rng.integers(1, 3)
    whole = seed % 2  # whole numbers: ties, equal rows, dependent columns
    x = rng.integers(0, 4, (n, p)).astype(float) if whole else rng.standard_normal((n, p))
    y = rng.integers(-2, 3, n).astype(float) if whole else rng.standard_t(2, n)
    if seed % 5 == 0:
        x, y = np.r_[x, x[:3]], np.r_[y, y[:3]]
    fit, a = fitted("l1", x, y)
    best = least_absolute(a, y)
    if best is not None:
        assert np.abs(y - a @ fit.at).sum() == pytest.approx(best, abs=1e-9)
    assert fit.converged and fit.left <= 1e-9


@pytest.mark.parametrize("seed", range(40))
def test_reported_optimality_is_what_is_left(seed):
    rng = np.random.default_rng(seed)
    n, p = rng.integers(20, 1500), rng.integers(1, 5)
    x = rng.standard_normal((n, p))
    y = x @ rng.standard_normal(p) + rng.standard_t(2, n) * rng.choice([0.01, 1, 10])
    for loss in ("huber", "logistic"):
        t = (y + rng.standard_normal(n) * 3 > 0).astype(float) if loss == "logistic" else y
        fit, a = fitted(loss, x, t)
        r = t - 1 / (1 + np.exp(-a @ fit.at)) if loss == "logistic" else np.clip(t - a @ fit.at, -1, 1)
        gradient = np.abs(a.T @ r).max() / n * (1 if loss == "logistic" else min(1, 1 / fit.rms))
        assert fit.converged and gradient <= max(fit.left, 1e-12) <= robust.OPTIMAL


def test_an_unfinished_fit_says_so(monkeypatch):
    monkeypatch.setattr(robust, "GIVE_UP", 2)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 2))
    y = (x[:, 0] * 3 + rng.standard_normal(300) > 1).astype(float)
    fit, _ = fitted("logistic", x, y)
    assert not fit.converged and fit.left > robust.OPTIMAL


@pytest.mark.parametrize("rows_together", [50_000, 3])
def test_classes_without_an_optimum(spark, monkeypatch, rows_together):
    monkeypatch.setattr(robust, "GROUP_ROWS", rows_together)
    rows = [("parted", float(i), float(i > 4)) for i in range(10)] + [("one", float(i), 1.0) for i in range(10)]
    rows += [("touching", x, y) for x, y in ((0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (2.0, 1.0), (2.0, 1.0))]
    rows += [("mixed", float(i), y) for i, y in enumerate((0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0))]
    table = spark.createDataFrame(rows, "symbol string, x double, y double")
    got = {r.symbol: r for r in regression.fit_linear(table, ["x"], "y", loss="logistic").collect()}
    assert {s: r.converged for s, r in got.items()} == {"parted": False, "one": False, "touching": False, "mixed": True}
    assert got["parted"].optimality > robust.OPTIMAL


def two_places(monkeypatch, fit):
    """Results of ``fit()`` with rows that meet and with rows that stay, by all but the figures."""
    out = []
    for many in (50_000, 5):
        monkeypatch.setattr(robust, "GROUP_ROWS", many)
        rows = fit().collect()
        out.append({tuple(r[k] for k in r.__fields__ if k not in FIGURES): r for r in rows})
    return out


FIGURES = {"weights", "bias", "n_train", "rms", "steps", "optimality", "converged"}


def test_ties_and_dependent_columns_in_both_places(spark, monkeypatch):
    rng = np.random.default_rng(4)
    parts = []
    for symbol, n in (("a", 40), ("b", 25)):
        x = rng.integers(0, 4, (n, 2)).astype(float)
        parts.append(pd.DataFrame(x, columns=["x1", "x2"]).assign(y=rng.integers(-2, 3, n).astype(float), symbol=symbol))
    table = pd.concat(parts)
    table["x3"], table["x4"] = table.x1 - 2 * table.x2, 7.0
    df = spark.createDataFrame(table).repartition(3).cache()
    names = ["x1", "x2", "x3", "x4"]
    for places in two_places(monkeypatch, lambda: regression.fit_linear(df, names, "y", loss="l1")):
        assert len(places) == 2
        for (symbol, *_), r in places.items():
            part = table[table.symbol == symbol]
            off = np.abs(part.y - part[names] @ np.array(r.weights) - r.bias).sum()
            assert r.converged and off == pytest.approx(least_absolute(np.c_[part[["x1", "x2"]], np.ones(len(part))], part.y.to_numpy()), abs=1e-7)


@pytest.mark.parametrize("loss", ["huber", "l1", "logistic"])
def test_folds_are_fits_of_their_rows(spark, monkeypatch, loss):
    rng = np.random.default_rng(7)
    table = pd.concat(
        pd.DataFrame({"x1": rng.standard_normal(n), "x2": rng.standard_normal(n), "part": np.arange(n) // 20}).assign(symbol=s)
        for s, n in (("a", 90), ("b", 61))
    )
    table["y"] = 2 * table.x1 - table.x2 + rng.standard_t(2, len(table)) * 2
    if loss == "logistic":
        table["y"] = (table.y > 0).astype(float)
    df = spark.createDataFrame(table).repartition(3).cache()
    folds = regression.Folds("upto", "part", ["one", "two", "four"], [1, 2, 4])
    subsets = [("x1",), ("x1", "x2")]
    fits = two_places(monkeypatch, lambda: regression.fit_linear(df, ["x1", "x2"], "y", subsets=subsets, loss=loss, folds=folds))
    for got in fits:
        assert len(got) == 2 * 3 * 2
        for label, cut in zip(folds.labels, folds.cuts):
            monkeypatch.setattr(robust, "GROUP_ROWS", 50_000)
            for r in regression.fit_linear(df.where(F.col("part") < cut), ["x1", "x2"], "y", subsets=subsets, loss=loss).collect():
                f = got[r.symbol, label, r.model_id, r.features]
                assert f.weights == pytest.approx(r.weights, abs=1e-6) and f.bias == pytest.approx(r.bias, abs=1e-6)
                assert f.n_train == r.n_train and f.converged and r.converged


def test_folds_of_an_own_rule(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i + i % 3, i // 5) for i in range(20)], "symbol string, x double, y double, part int")
    folds = regression.Folds("upto", "part", [1, 3], [1, 3])
    rule = lambda eta, y, scale, step: (F.lit(1.0), y)
    got = {r.upto: r for r in regression.fit_linear(df, ["x"], "y", loss=rule, folds=folds).collect()}
    for cut in (1, 3):
        (want,) = regression.fit_linear(df.where(F.col("part") < cut), ["x"], "y").collect()
        assert got[cut].weights == pytest.approx(want.weights) and got[cut].converged and got[cut].steps == 1
    (cut_short,) = regression.fit_linear(df, ["x"], "y", loss=lambda eta, y, scale, step: (1 / (1 + F.abs(y - eta)), y), iterations=1).collect()
    assert not cut_short.converged and cut_short.optimality > 1e-6


def test_rows_are_read_once_a_step(spark, monkeypatch):
    """However many models and folds a row serves, a step scans the rows once and does not shuffle them."""
    seen = []
    answers = robust._answers
    monkeypatch.setattr(robust, "_answers", lambda *a: seen.append(answers(*a)) or seen[-1])
    monkeypatch.setattr(robust, "GROUP_ROWS", 5)
    rng = np.random.default_rng(2)
    table = pd.DataFrame({"x1": rng.standard_normal(60), "y": rng.standard_normal(60), "part": np.arange(60) // 10, "symbol": "a"})
    regression.fit_linear(spark.createDataFrame(table), ["x1"], "y", loss="huber", folds=regression.Folds("k", "part", [1, 3, 5], [1, 3, 5])).count()
    assert seen
    for step in seen:
        plan = step._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("fit-scaled") == 1 and "BroadcastHashJoin" in plan and "Generate" not in plan and "ObjectHash" not in plan


def test_many_large_groups(spark, monkeypatch):
    """10,000 groups whose rows stay where they are: their states are a table."""
    monkeypatch.setattr(robust, "GROUP_ROWS", 4)
    n = 10_000
    rows = spark.range(n * 12).select((F.col("id") % n).alias("symbol"), F.rand(3).alias("x"), F.rand(4).alias("e"))
    rows = rows.withColumn("y", F.col("x") * (F.col("symbol") % 7) + F.when(F.col("e") > 0.9, 3.0).otherwise(F.col("e")))
    out = regression.fit_linear(rows, ["x"], "y", loss="huber")
    assert out.count() == n and out.where("converged AND optimality <= 1e-8 AND n_train = 12").count() == n
    few = rows.where("symbol < 20").toPandas()
    got = {r.symbol: r for r in out.where("symbol < 20").collect()}
    for symbol, part in few.groupby("symbol"):
        fit, _ = fitted("huber", part[["x"]].to_numpy(), part.y.to_numpy())
        assert [*got[symbol].weights, got[symbol].bias] == pytest.approx(fit.at.tolist(), abs=1e-6)


def test_empty_table(spark):
    none = spark.createDataFrame([], "symbol string, x double, y double, part int")
    for folds in (None, regression.Folds("k", "part", [1], [1])):
        assert regression.fit_linear(none, ["x"], "y", loss="l1", folds=folds).count() == 0
