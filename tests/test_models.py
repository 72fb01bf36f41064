from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.features import add_direction_target, drop_null_rows, random_signal, standardise
from tidemark.operators.ordered import Timeline
from tidemark.operators.split import chrono_split, expanding_folds, rolling_fold_rows, with_split, with_train_ratios
from tidemark.plans import crossval, nets, regression, research, robust

NAMES = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    frames = []
    for symbol, n in (("HOT", 400), ("b", 60), ("c", 45)):
        x = rng.standard_normal((n, 3))
        y = x @ [0.5, -1.0, 0.2] + 0.3 + rng.standard_t(2, n) * 0.5
        frames.append(pd.DataFrame(x, columns=NAMES).assign(y=y, symbol=symbol, datetime=pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h")))
    local = pd.concat(frames, ignore_index=True)
    return local, spark.createDataFrame(local).repartition(6).cache()


def by_symbol(df, *more):
    return {tuple(r[k] for k in ("symbol", *more)) if more else r["symbol"]: r for r in df.collect()}


def ols(part, names):
    a = np.c_[part[list(names)].to_numpy(), np.ones(len(part))]
    return np.linalg.lstsq(a, part.y.to_numpy(), rcond=None)[0]


def test_all_subsets_equal_separate_fits(data):
    local, df = data
    subsets = regression.feature_subsets(NAMES, 3)
    assert len(subsets) == 7 and len(regression.feature_subsets(list("abcd"), 3)) == 14
    got = by_symbol(regression.fit_linear(df, NAMES, "y", subsets=subsets), "features")
    for symbol, part in local.groupby("symbol"):
        for names in subsets:
            r = got[symbol, ",".join(names)]
            want = ols(part, names)
            assert [r.weights[NAMES.index(f)] for f in names] == pytest.approx(want[:-1])
            assert r.bias == pytest.approx(want[-1]) and r.n_train == len(part)
            assert [w for f, w in zip(NAMES, r.weights) if f not in names] == [0.0] * (3 - len(names))


def test_a_constant_feature_gets_no_weight(data):
    _, df = data
    out = by_symbol(regression.fit_linear(df.withColumn("x2", F.lit(2.0)), NAMES, "y"))
    assert all(abs(r.weights[1]) < 1e-9 for r in out.values())


def test_huber_and_l1_reach_their_minimum(data):
    local, df = data
    for loss in ("huber", "l1"):
        got = by_symbol(regression.fit_linear(df, NAMES, "y", loss=loss))
        reached = by_symbol(regression.mean_loss(df, regression.fit_linear(df, NAMES, "y", loss=loss), NAMES, "y", ["symbol"], loss))
        for symbol, part in local.groupby("symbol"):
            a = np.c_[part[NAMES].to_numpy(), np.ones(len(part))]

            def value(b):
                r = np.abs(part.y.to_numpy() - a @ b)
                return r.mean() if loss == "l1" else np.where(r <= 1, r * r / 2, r - 0.5).mean()

            b = np.array([*got[symbol].weights, got[symbol].bias])
            assert reached[symbol].loss == pytest.approx(value(b))
            assert value(b) <= value(ols(part, NAMES)) + 1e-12
            best = ols(part, NAMES)
            for i in range(4000):
                r = np.abs(part.y.to_numpy() - a @ best)
                w = 1 / np.maximum(r, 1e-9) if loss == "l1" else np.where(r <= 1, 1.0, 1 / np.maximum(r, 1))
                best = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * part.y.to_numpy()))
            assert value(b) <= value(best) * (1 + 1e-6)
            assert got[symbol].converged and got[symbol].optimality <= 1e-8


@pytest.mark.parametrize("loss", regression.LOSSES)
def test_fits_of_large_groups_take_the_same_steps(data, monkeypatch, loss):
    """Rows that stay where they are, and rows that meet in their group, lead to one optimum."""
    _, df = data
    rows = add_direction_target(df, "y")
    target = "y_dir" if loss == "logistic" else "y"
    subsets = [("x1",), ("x2", "x3"), tuple(NAMES)]
    together = by_symbol(regression.fit_linear(rows, NAMES, target, subsets=subsets, loss=loss), "model_id")
    monkeypatch.setattr(robust, "GROUP_ROWS", 50)
    apart = by_symbol(regression.fit_linear(rows, NAMES, target, subsets=subsets, loss=loss), "model_id")
    assert set(together) == set(apart) and len(apart) == 9
    for key, r in apart.items():
        assert r.converged and together[key].converged
        assert r.weights == pytest.approx(together[key].weights, abs=1e-6) and r.bias == pytest.approx(together[key].bias, abs=1e-6)


def test_features_of_unlike_size(spark):
    rng = np.random.default_rng(5)
    x = np.c_[50_000 + 10_000 * rng.standard_normal(300), 1e-3 * rng.standard_normal(300)]
    y = 1e-6 * x[:, 0] - 0.5 * x[:, 1] + 1e-3 * rng.standard_normal(300)
    rows = spark.createDataFrame([("a", *map(float, v), float(t)) for v, t in zip(x, y)], "symbol string, x1 double, x2 double, y double")
    a = np.c_[x, np.ones(300)]
    want = np.linalg.lstsq(a / np.abs(a).max(0), y, rcond=None)[0] / np.abs(a).max(0)
    for loss in ("mse", "huber"):  # Huber's width is far beyond these residuals, so it is least squares too
        (r,) = regression.fit_linear(rows, ["x1", "x2"], "y", loss=loss).collect()
        assert r.weights == pytest.approx(list(want[:-1]), rel=1e-6) and r.bias == pytest.approx(want[-1], rel=1e-4)


def test_unknown_loss(data):
    with pytest.raises(ValueError):
        regression.fit_linear(data[1], NAMES, "y", loss="l3")


def test_logistic_agrees_with_spark_ml(data):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    _, df = data
    rows = add_direction_target(df, "y")
    got = by_symbol(regression.fit_linear(rows, NAMES, "y_dir", loss="logistic"))
    for symbol in ("HOT", "b"):
        part = VectorAssembler(inputCols=NAMES, outputCol="v").transform(rows.where(F.col("symbol") == symbol))
        model = LogisticRegression(featuresCol="v", labelCol="y_dir", regParam=0.0, standardization=False, tol=1e-10, maxIter=200).fit(part)
        assert got[symbol].weights == pytest.approx(list(model.coefficients), abs=1e-3)
        assert got[symbol].bias == pytest.approx(model.intercept, abs=1e-3)


def test_own_weighting_rule(data):
    local, df = data
    flat = regression.fit_linear(df, NAMES, "y", loss=lambda eta, y, scale, step: (F.lit(2.0), y))
    for symbol, r in by_symbol(flat).items():
        assert r.weights == pytest.approx(ols(local[local.symbol == symbol], NAMES)[:-1])


def test_standardise_uses_train_rows_only(data):
    local, df = data
    out = standardise(with_split(df, 0.25), NAMES).where("is_train").toPandas()
    for _, part in out.groupby("symbol"):
        assert np.allclose(part["x1_scaled"].mean(), 0) and np.allclose(part["x1_scaled"].std(ddof=0), 1)


def test_splits(data):
    _, df = data
    train, test = chrono_split(df, 0.25)
    assert {r.symbol: r["count"] for r in train.groupBy("symbol").count().collect()} == {"HOT": 300, "b": 45, "c": 33}
    assert train.count() + test.count() == df.count()
    for bad in (0, 1, 1.5):
        with pytest.raises(ValueError):
            with_split(df, bad)
    sizes = with_train_ratios(df, [0.4, 0.9]).where("is_train and symbol = 'b'").groupBy("train_size").count().collect()
    assert {r.train_size: r["count"] for r in sizes} == {0.4: 24, 0.9: 54}


def test_folds_are_disjoint_and_complete(data):
    _, df = data
    rows = rolling_fold_rows(df, 20, 10).toPandas()
    assert set(rows[rows.symbol == "c"].window_no) == {0} and set(rows[rows.symbol == "b"].window_no) == {0, 1}
    for _, fold in rows.groupby(["symbol", "window_no"]):
        assert list(fold.part.value_counts().sort_index()) == [20, 20]
        assert fold[fold.part == "train"].datetime.max() < fold[fold.part == "test"].datetime.min()
    grown = expanding_folds(df, 20, 10).where("symbol = 'b'").orderBy("iteration_no").collect()
    assert [(r.iteration_no, r.train_rows, r.test_rows) for r in grown] == [(1, 20, 20), (2, 40, 20)]


@pytest.mark.parametrize("loss", ["mse", "huber"])
def test_cross_validation_against_loops(data, loss):
    local, df = data
    size = 20

    def fit(part):
        if loss == "mse":
            return ols(part, NAMES)
        a, y, b = np.c_[part[NAMES].to_numpy(), np.ones(len(part))], part.y.to_numpy(), ols(part, NAMES)
        for _ in range(200):
            r = np.abs(y - a @ b)
            w = np.where(r <= 1, 1.0, 1 / np.maximum(r, 1))
            b = np.linalg.solve(a.T @ (w[:, None] * a), a.T @ (w * y))
        return b

    def ev(b, part):
        return (np.sign(part[NAMES].to_numpy() @ b[:-1] + b[-1]) * part.y.to_numpy()).mean()

    rolling = {(r.symbol, r.window_no): r.ev for r in crossval.rolling_cv(df, NAMES, "y", size, 3, loss=loss).collect()}
    expanding = {(r.symbol, r.iteration_no): r.ev for r in crossval.expanding_cv(df, NAMES, "y", size, 3, loss=loss).collect()}
    ratios = {(r.symbol, r.train_size): r.ev for r in crossval.ratio_cv(df, NAMES, "y", [0.5, 0.9, 0.51], loss=loss).collect()}
    want_r, want_e, want_s = {}, {}, {}
    for symbol, part in local.groupby("symbol"):
        part = part.sort_values("datetime")
        for i in range(3):
            if size * (i + 2) > len(part):
                break
            test = part[size * (i + 1): size * (i + 2)]
            want_r[symbol, i] = ev(fit(part[size * i: size * (i + 1)]), test)
            want_e[symbol, i + 1] = ev(fit(part[: size * (i + 1)]), test)
        for ratio in (0.5, 0.51, 0.9):
            cut = int(len(part) * ratio)
            want_s[symbol, ratio] = ev(fit(part[:cut]), part[cut:])
    assert rolling == pytest.approx(want_r, abs=1e-6)
    assert expanding == pytest.approx(want_e, abs=1e-6)
    assert ratios == pytest.approx(want_s, abs=1e-6)


def test_walk_forward_picks_and_refits(data):
    local, df = data
    settings = [("x1",), ("x2",), ("x1", "x2", "x3")]
    got = {(r.symbol, r.window_no): (r.model_id, r.ev) for r in crossval.walk_forward(df, NAMES, settings, "y", 20, 3).collect()}

    def ev(b, part, names):
        return (np.sign(part[list(names)].to_numpy() @ b[:-1] + b[-1]) * part.y.to_numpy()).mean()

    for (symbol, i), (model, value) in got.items():
        part = local[local.symbol == symbol].sort_values("datetime")
        block, test = part[20 * i: 20 * (i + 1)], part[20 * (i + 1): 20 * (i + 2)]
        scores = [ev(ols(block[:15], s), block[15:], s) for s in settings]
        assert model == int(np.argmax(scores))
        assert value == pytest.approx(ev(ols(block, settings[model]), test, settings[model]))
    assert len(got) == 3 + 2 + 1


def test_search_ranks_by_sharpe(data):
    _, df = data
    out = research.search_linear_models(df, "y", NAMES, 10.0, 2, "mse").collect()
    assert len(out) == 3 * 6 and [r.sharpe for r in out] == sorted((r.sharpe for r in out), reverse=True)
    one = research.benchmark_model(df, NAMES, "y", 10.0, "mse").collect()
    trades = research.learn_model_trades(df, NAMES, "y", "mse")
    counts = {r.symbol: r["count"] for r in trades.groupBy("symbol").count().collect()}
    assert {r.symbol: r.no_trades for r in one} == counts


def test_random_signal_depends_on_the_row_only(data):
    _, df = data
    flips = df.withColumn("s", random_signal(F.unix_seconds("datetime"), 5))
    a = sorted((r.symbol, r.datetime, r.s) for r in flips.collect())
    b = sorted((r.symbol, r.datetime, r.s) for r in flips.repartition(13).collect())
    assert a == b and {r[2] for r in a} == {1, -1} and abs(np.mean([r[2] for r in a])) < 0.2


def test_nan_is_not_null(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (None, 1.0), (2.0, 3.0)], "a double, b double")
    assert drop_null_rows(df).count() == 2


# --- nets, against sums written out by hand -------------------------------------

def test_nets_by_hand():
    x = np.array([[0.2, -0.4]])
    hidden = {"w1": np.array([[1.0, 2.0], [-1.0, 0.5]]), "b1": np.array([0.7, 0.1]), "w2": np.array([[2.0, 3.0]]), "b2": np.array([0.5])}
    assert nets.one_hidden(x, hidden)[0] == pytest.approx(2 * 0.1 + 0.5)
    assert nets.tanh_unit(x, {"w": np.array([1.0, 1.0]), "b": np.array(0.1)})[0] == pytest.approx(np.tanh(-0.1))
    norm = {"w0": np.eye(2), "b0": np.zeros(2), "mean0": np.array([0.1, 0.0]), "var0": np.array([4.0, 1.0]), "gamma0": np.array([2.0, 1.0]), "beta0": np.array([0.0, 1.0]), "w": np.array([[1.0, 1.0]]), "b": np.zeros(1)}
    want = 2 * 0.1 / np.sqrt(4 + 1e-5) + (-0.4 / np.sqrt(1 + 1e-5) + 1)
    assert nets.deep(x, norm)[0] == pytest.approx(want)
    att = {f"w{n}": np.eye(2) for n in "qkv"} | {f"b{n}": np.zeros(2) for n in "qkv"} | {"w": np.array([[1.0, 1.0]]), "b": np.zeros(1)}
    v = x[0]
    total = 0.0
    for i in range(2):
        e = np.exp([v[i] * v[j] / np.sqrt(2) for j in range(2)])
        total += float(e @ v / e.sum())
    assert nets.attention(x, att)[0] == pytest.approx(total)


def test_lstm_by_hand():
    def s(z):
        return 1 / (1 + np.exp(-z))

    wx, wh, b = np.array([[0.5], [0.4], [0.3], [0.2]]), np.array([[0.1], [0.2], [0.3], [0.4]]), np.array([0.0, 1.0, 0.1, 0.2])
    h = c = 0.0
    for value in (0.2, -0.4, 0.6):
        i, f, g, o = (wx[k, 0] * value + wh[k, 0] * h + b[k] for k in range(4))
        c = s(f) * c + s(i) * np.tanh(g)
        h = s(o) * np.tanh(c)
    got = nets.lstm(np.array([[0.2, -0.4, 0.6]]), {"wx0": wx, "wh0": wh, "b0": b, "w": np.array([[2.0]]), "b": np.array([0.5])})
    assert got[0] == pytest.approx(2 * h + 0.5)


def test_net_columns_equal_their_numpy_forms(data):
    _, df = data
    rng = np.random.default_rng(8)
    r = rng.standard_normal
    kinds = {
        "tanh_unit": {"w": r(3), "b": r()},
        "one_hidden": {"w1": r((4, 3)), "b1": r(4), "w2": r((1, 4)), "b2": r(1)},
        "deep": {f"{k}{i}": v for i, (n, m) in enumerate(((4, 3), (3, 4))) for k, v in (
            ("w", r((n, m))), ("b", r(n)), ("gamma", r(n)), ("beta", r(n)), ("mean", r(n)), ("var", rng.uniform(0.5, 2, n)))} | {"w": r((1, 3)), "b": r(1)},
        "lstm": {"wx0": r((16, 1)), "wh0": r((16, 4)), "b0": r(16), "wx1": r((8, 4)), "wh1": r((8, 2)), "b1": r(8), "w": r((1, 2)), "b": r(1)},
        "attention": {f"w{n}": r((3, 3)) for n in "qkv"} | {f"b{n}": r(3) for n in "qkv"} | {"w": r((1, 3)), "b": r(1)},
    }
    assert set(kinds) == set(nets.COLUMNS)
    out = df.select(*NAMES, *[nets.net_model(k, w)(NAMES).alias(k) for k, w in kinds.items()]).toPandas()
    for k, w in kinds.items():
        want = nets.NETS[k](out[NAMES].to_numpy(), {n: np.asarray(v, float) for n, v in w.items()})
        assert out[k].to_numpy() == pytest.approx(want, abs=1e-9), k


def test_net_scoring_on_rows(data):
    _, df = data
    rows = df.withColumn("x1", F.when(F.col("x2") > 0, F.col("x1")))
    model = nets.net_model("one_hidden", {"w1": np.eye(3), "b1": np.zeros(3), "w2": np.ones((1, 3)), "b2": np.zeros(1)})
    out = research.add_model_predictions(rows, model, NAMES)
    want = F.greatest("x1", F.lit(0.0)) + F.greatest("x2", F.lit(0.0)) + F.greatest("x3", F.lit(0.0))
    off = out.where(F.col("x1").isNotNull()).agg(F.max(F.abs(F.col("y_hat") - want))).first()[0]
    assert off < 1e-12 and out.where(F.col("x1").isNull() & F.col("y_hat").isNotNull()).count() == 0


def test_models_survive_saving(spark, data, tmp_path):
    from tidemark.sources.store import load_models, save_models

    _, df = data
    models = regression.fit_linear(df, NAMES, "y")
    save_models(models, str(tmp_path / "m"))
    a = by_symbol(research.add_model_predictions(df, models, NAMES).groupBy("symbol").agg(F.sum("y_hat").alias("s")))
    b = by_symbol(research.add_model_predictions(df, load_models(spark, str(tmp_path / "m")), NAMES).groupBy("symbol").agg(F.sum("y_hat").alias("s")))
    assert all(a[k].s == pytest.approx(b[k].s) for k in a)


def test_search_on_a_blocked_line(data):
    _, df = data
    a = {(r.symbol, r.model_id): r.sharpe for r in research.search_linear_models(df, "y", NAMES, 1.0, 1, "mse").collect()}
    line = Timeline(("symbol",), ("datetime",), "7h")
    b = {(r.symbol, r.model_id): r.sharpe for r in research.search_linear_models(df, "y", NAMES, 1.0, 1, "mse", line=line).collect()}
    assert a == pytest.approx(b)
