"""Catalogue: fitting, subset search, cross-validation and stored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import sharpe_annualization_factor
from ..operators import features, split
from ..plans import crossval, regression, research
from ..sources import store
from ..sources.sample_tables import event_trades
from ..session import scratch_path, written
from .base import (
    FIGURES, LAGS, R, RS, figures, figures_sql, query, r6, rounded, rows_sql, study_features,
)

TARGET = "close_log_return"


def _weights(df, *keys, digits=6):
    return df.select(
        *keys, *[r6(F.get("weights", F.lit(i)), digits).alias(f"w{i + 1}") for i in range(len(LAGS))], r6("bias", digits).alias("bias")
    )


@query(
    "ar1_fit",
    f"""WITH {rows_sql()} SELECT symbol, {R(f'regr_slope({TARGET}, {LAGS[0]})', 'w1')}, {R(f'regr_intercept({TARGET}, {LAGS[0]})', 'bias')}
    FROM study GROUP BY symbol""",
)
def ar1_fit(spark, sf):
    rows = features.drop_null_rows(study_features(spark, sf))
    out = regression.fit_linear(rows, LAGS[:1], TARGET)
    return out.select("symbol", r6(F.get("weights", F.lit(0))).alias("w1"), r6("bias").alias("bias"))


NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS row_no,
    count(*) OVER (PARTITION BY symbol) AS n_rows FROM study),
  marked AS (SELECT *, row_no < floor(n_rows * 0.75e0) AS is_train FROM numbered)"""

X = {1: LAGS[0], 2: LAGS[1], 3: LAGS[2]}
SUMS = "sums AS (SELECT symbol, " + ", ".join(
    [f"avg({X[i]}) AS m{i}" for i in X]
    + [f"covar_pop({X[i]}, {X[j]}) AS s{i}{j}" for i in X for j in X if i <= j]
    + [f"covar_pop({X[i]}, {TARGET}) AS t{i}" for i in X]
    + [f"avg({TARGET}) AS my"]
) + " FROM marked WHERE is_train GROUP BY symbol)"


def _det(a: list[list[str]]) -> str:
    (p, q, r), (s, t, u), (v, w, x) = a
    return f"({p}*({t}*{x}-{u}*{w}) - {q}*({s}*{x}-{u}*{v}) + {r}*({s}*{w}-{t}*{v}))"


_S = [["s11", "s12", "s13"], ["s12", "s22", "s23"], ["s13", "s23", "s33"]]


def _replaced(col: int) -> list[list[str]]:
    return [[f"t{i + 1}" if j == col else _S[i][j] for j in range(3)] for i in range(3)]


AR3 = f"""{SUMS}, w AS (SELECT *, {', '.join(f'{_det(_replaced(i))} / {_det(_S)} AS w{i + 1}' for i in range(3))} FROM sums),
  ar3 AS (SELECT *, my - w1*m1 - w2*m2 - w3*m3 AS bias FROM w)"""


@query("ar3_fit", f"WITH {rows_sql()}, {NUMBERED}, {AR3} SELECT symbol, {RS('w1', 'w2', 'w3', 'bias')} FROM ar3")
def ar3_fit(spark, sf):
    rows = research.split_rows(study_features(spark, sf), LAGS, TARGET)
    return _weights(regression.fit_linear(rows.where("is_train"), LAGS, TARGET), "symbol")


LEARNED = f"""{rows_sql()}, {NUMBERED}, {AR3},
  tested AS (SELECT k.symbol, datetime, {TARGET} AS y_true, {LAGS[0]}*w1 + {LAGS[1]}*w2 + {LAGS[2]}*w3 + bias AS y_pred
    FROM marked k JOIN ar3 USING (symbol) WHERE NOT is_train),
  signed AS (SELECT *, sign(y_pred) = sign(y_true) AS is_won, sign(y_pred) * y_true AS trade_log_return FROM tested),
  curve AS (SELECT *, sum(trade_log_return) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS equity_curve FROM signed),
  results AS (SELECT *, equity_curve - max(equity_curve) OVER (PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS drawdown_log_return FROM curve)"""


@query(
    "learned_trades",
    f"WITH {LEARNED} SELECT symbol, datetime, is_won, {RS('y_pred', 'y_true', 'trade_log_return', 'equity_curve', 'drawdown_log_return')} FROM results",
)
def learned_trades(spark, sf):
    out = research.learn_model_trades(study_features(spark, sf), LAGS, TARGET, "mse")
    return rounded(out, "symbol", "datetime", "is_won", "y_pred", "y_true", "trade_log_return", "equity_curve", "drawdown_log_return")


@query(
    "model_benchmark",
    f"""WITH {LEARNED}, f AS ({figures_sql('results', 'symbol', 'sqrt(730)')})
    SELECT symbol, no_trades, {RS(*FIGURES)}, {RS('w1', 'w2', 'w3', 'bias')} FROM f JOIN ar3 USING (symbol)""",
)
def model_benchmark(spark, sf):
    out = research.benchmark_model(study_features(spark, sf), LAGS, TARGET, sharpe_annualization_factor("12h"), "mse")
    out = out.withColumns({f"w{i + 1}": F.get("weights", F.lit(i)) for i in range(3)})
    return figures(out, "symbol", "w1", "w2", "w3", "bias")


@query(
    "model_roundtrip",
    f"""WITH {rows_sql()}, {NUMBERED}, {AR3}
    SELECT symbol, feature, {R('weight')}, {R('bias')} FROM (
      SELECT symbol, '{LAGS[0]}' AS feature, w1 AS weight, bias FROM ar3 UNION ALL SELECT symbol, '{LAGS[1]}', w2, bias FROM ar3
      UNION ALL SELECT symbol, '{LAGS[2]}', w3, bias FROM ar3)""",
)
def model_roundtrip(spark, sf):
    """Fit, save, load again, and list the coefficients."""
    rows = research.split_rows(study_features(spark, sf), LAGS, TARGET)
    path = scratch_path(spark, "saved-models")
    store.save_models(regression.fit_linear(rows.where("is_train"), LAGS, TARGET), path)
    out = regression.coefficient_rows(store.load_models(spark, path), LAGS, ["symbol"])
    return rounded(out, "symbol", "feature", "weight", "bias")


def _one(i):
    return f"t{i}/s{i}{i}"


def _two(i, j):
    det = f"(s{i}{i}*s{j}{j} - s{i}{j}*s{i}{j})"
    return f"(s{j}{j}*t{i} - s{i}{j}*t{j})/{det}", f"(s{i}{i}*t{j} - s{i}{j}*t{i})/{det}"


def _subset_models() -> str:
    parts, models = [], []
    for i in X:
        models.append(({i: _one(i)}, LAGS[i - 1]))
    for i in X:
        for j in X:
            if i < j:
                a, b = _two(i, j)
                models.append(({i: a, j: b}, f"{LAGS[i - 1]},{LAGS[j - 1]}"))
    for number, (w, label) in enumerate(models):
        cols = ", ".join(f"{w.get(i, '0e0')} AS w{i}" for i in X)
        parts.append(f"SELECT symbol, {number} AS model_id, '{label}' AS features, {cols}, m1, m2, m3, my FROM sums")
    return "models AS (SELECT *, my - w1*m1 - w2*m2 - w3*m3 AS bias FROM (" + " UNION ALL ".join(parts) + "))"


OVER = "OVER (PARTITION BY symbol, model_id ORDER BY datetime ROWS UNBOUNDED PRECEDING)"


@query(
    "subset_search",
    f"""WITH {rows_sql()}, {NUMBERED}, {SUMS}, {_subset_models()},
    signed AS (SELECT symbol, model_id, datetime, {TARGET} AS y, {LAGS[0]}*w1 + {LAGS[1]}*w2 + {LAGS[2]}*w3 + bias AS p
      FROM marked JOIN models USING (symbol) WHERE NOT is_train),
    won AS (SELECT *, sign(p) = sign(y) AS is_won, sign(p) * y AS trade_log_return FROM signed),
    curve AS (SELECT *, sum(trade_log_return) {OVER} AS equity_curve FROM won),
    results AS (SELECT *, equity_curve - max(equity_curve) {OVER} AS drawdown_log_return FROM curve),
    f AS ({figures_sql('results', 'symbol, model_id', 'sqrt(730)')})
    SELECT symbol, model_id, features, no_trades, {RS(*FIGURES)}, {RS('w1', 'w2', 'w3', 'bias')} FROM f JOIN models USING (symbol, model_id)""",
)
def subset_search(spark, sf):
    """All one- and two-lag models of every symbol."""
    out = research.search_linear_models(
        study_features(spark, sf), TARGET, LAGS, sharpe_annualization_factor("12h"), 2, "mse"
    )
    out = out.withColumns({f"w{i + 1}": F.get("weights", F.lit(i)) for i in range(3)})
    return figures(out, "symbol", "model_id", "features", "w1", "w2", "w3", "bias")


@query(
    "mixed_scale_fit",
    f"""WITH {rows_sql()}, scaled AS (SELECT symbol, {TARGET}, {LAGS[0]} AS x1, 1e7 * {LAGS[1]} + 5e4 AS x2 FROM study),
    s AS (SELECT symbol, avg(x1) AS m1, avg(x2) AS m2, avg({TARGET}) AS my, covar_pop(x1, x1) AS s11, covar_pop(x1, x2) AS s12,
      covar_pop(x2, x2) AS s22, covar_pop(x1, {TARGET}) AS t1, covar_pop(x2, {TARGET}) AS t2 FROM scaled GROUP BY symbol),
    w AS (SELECT *, (s22*t1 - s12*t2) / (s11*s22 - s12*s12) AS w1, (s11*t2 - s12*t1) / (s11*s22 - s12*s12) AS w2 FROM s)
    SELECT symbol, {R('w1')}, {R('w2 * 1e7', 'w2')} FROM w""",
)
def mixed_scale_fit(spark, sf):
    """A feature of the size of a price beside one of the size of a return."""
    rows = features.drop_null_rows(study_features(spark, sf)).withColumn("big", F.lit(1e7) * F.col(LAGS[1]) + 5e4)
    out = regression.fit_linear(rows, [LAGS[0], "big"], TARGET)
    return out.select("symbol", r6(F.get("weights", F.lit(0))).alias("w1"), r6(F.get("weights", F.lit(1)) * 1e7).alias("w2"))


# --- cross-validation on 6h bars, one lag, blocks of 20 rows ------------------------

SIZE, FOLDS, RATIOS = 20, 5, (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
LAG = LAGS[:1]
CV = f"""{rows_sql('6 hours')}, rows_no AS (SELECT symbol, {TARGET} AS y, {LAGS[0]} AS x1, {LAGS[1]} AS x2, {LAGS[2]} AS x3,
    row_number() OVER (PARTITION BY symbol ORDER BY datetime) - 1 AS row_no, count(*) OVER (PARTITION BY symbol) AS n_rows FROM study)"""
_FIT = "regr_slope(y, x1) AS w, regr_intercept(y, x1) AS b"
ROLLING = f"""rolling_fit AS (SELECT symbol, row_no // {SIZE} AS window_no, {_FIT} FROM rows_no GROUP BY symbol, row_no // {SIZE}),
  rolling AS (SELECT r.symbol, f.window_no, avg(sign(f.w * x1 + f.b) * y) AS ev FROM rows_no r
    JOIN rolling_fit f ON f.symbol = r.symbol AND f.window_no = r.row_no // {SIZE} - 1
    WHERE f.window_no < {FOLDS} AND (f.window_no + 2) * {SIZE} <= n_rows GROUP BY r.symbol, f.window_no)"""
EXPANDING = f"""its AS (SELECT unnest(generate_series(1, {FOLDS})) AS iteration_no),
  expanding_fit AS (SELECT symbol, iteration_no, {_FIT} FROM rows_no JOIN its ON row_no < {SIZE} * iteration_no GROUP BY symbol, iteration_no),
  expanding AS (SELECT r.symbol, f.iteration_no, avg(sign(f.w * x1 + f.b) * y) AS ev FROM rows_no r
    JOIN expanding_fit f ON f.symbol = r.symbol AND f.iteration_no = r.row_no // {SIZE}
    WHERE (f.iteration_no + 1) * {SIZE} <= n_rows GROUP BY r.symbol, f.iteration_no)"""
BY_RATIO = f"""sizes AS (SELECT unnest([{', '.join(f'{r}e0' for r in RATIOS)}]) AS train_size),
  ratio_fit AS (SELECT symbol, train_size, {_FIT} FROM rows_no JOIN sizes ON row_no < floor(n_rows * train_size) GROUP BY symbol, train_size),
  by_ratio AS (SELECT r.symbol, f.train_size, avg(sign(f.w * x1 + f.b) * y) AS ev FROM rows_no r
    JOIN ratio_fit f ON f.symbol = r.symbol AND r.row_no >= floor(n_rows * f.train_size) GROUP BY r.symbol, f.train_size)"""


def _cv_rows(spark, sf):
    return study_features(spark, sf, "6h").where(F.col(LAGS[2]).isNotNull())


def _rolling(rows, loss="mse"):
    return crossval.rolling_cv(rows, LAG, TARGET, SIZE, FOLDS, loss=loss)


def _expanding(rows, loss="mse"):
    return crossval.expanding_cv(rows, LAG, TARGET, SIZE, FOLDS, loss=loss)


def _ratio(rows, loss="mse"):
    return crossval.ratio_cv(rows, LAG, TARGET, RATIOS, loss=loss)


@query("cv_rolling", f"WITH {CV}, {ROLLING} SELECT symbol, window_no, {R('ev')} FROM rolling")
def cv_rolling(spark, sf):
    return rounded(_rolling(_cv_rows(spark, sf)), "symbol", "window_no", "ev")


@query("cv_expanding", f"WITH {CV}, {EXPANDING} SELECT symbol, iteration_no, {R('ev')} FROM expanding")
def cv_expanding(spark, sf):
    return rounded(_expanding(_cv_rows(spark, sf)), "symbol", "iteration_no", "ev")


@query("cv_ratios", f"WITH {CV}, {BY_RATIO} SELECT symbol, train_size, {R('ev')} FROM by_ratio")
def cv_ratios(spark, sf):
    return rounded(_ratio(_cv_rows(spark, sf)), "symbol", "train_size", "ev")


@query(
    "cv_compare",
    f"""WITH {CV}, {ROLLING}, {EXPANDING}, {BY_RATIO}, e AS (SELECT symbol, 'rolling' AS method, ev FROM rolling
      UNION ALL SELECT symbol, 'expanding', ev FROM expanding UNION ALL SELECT symbol, 'split', ev FROM by_ratio)
    SELECT symbol, method, {R('avg(ev)', 'mean_ev')}, {R('stddev_samp(ev)', 'std_ev')} FROM e GROUP BY symbol, method""",
)
def cv_compare(spark, sf):
    rows = written(_cv_rows(spark, sf).select("symbol", "datetime", TARGET, *LAGS), "study-rows")
    out = crossval.compare_methods({"rolling": _rolling(rows), "expanding": _expanding(rows), "split": _ratio(rows)})
    return rounded(out, "symbol", "method", "mean_ev", "std_ev")


@query(
    "walk_forward",
    f"""WITH {CV}, long AS (SELECT symbol, row_no, n_rows, y, model_id, CASE model_id WHEN 0 THEN x1 WHEN 1 THEN x2 ELSE x3 END AS x,
      row_no // {SIZE} AS block FROM rows_no CROSS JOIN (SELECT unnest([0, 1, 2]) AS model_id)),
    trial AS (SELECT symbol, block, model_id, regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM long
      WHERE row_no - block * {SIZE} < 15 GROUP BY symbol, block, model_id),
    judged AS (SELECT l.symbol, l.block, l.model_id, avg(sign(w * x + b) * y) AS ev FROM long l JOIN trial USING (symbol, block, model_id)
      WHERE row_no - block * {SIZE} >= 15 GROUP BY l.symbol, l.block, l.model_id),
    best AS (SELECT symbol, block, arg_max(model_id, (ev, -model_id)) AS model_id FROM judged GROUP BY symbol, block),
    refit AS (SELECT l.symbol, l.block AS window_no, l.model_id, regr_slope(y, x) AS w, regr_intercept(y, x) AS b FROM long l
      JOIN best USING (symbol, block, model_id) GROUP BY l.symbol, l.block, l.model_id)
    SELECT l.symbol, f.window_no, f.model_id, CASE f.model_id WHEN 0 THEN '{LAGS[0]}' WHEN 1 THEN '{LAGS[1]}' ELSE '{LAGS[2]}' END AS features,
      {R('avg(sign(f.w * x + f.b) * y)', 'ev')}
    FROM long l JOIN refit f ON f.symbol = l.symbol AND f.model_id = l.model_id AND f.window_no = l.block - 1
    WHERE f.window_no < {FOLDS} AND (f.window_no + 2) * {SIZE} <= n_rows GROUP BY l.symbol, f.window_no, f.model_id""",
)
def walk_forward(spark, sf):
    out = crossval.walk_forward(_cv_rows(spark, sf), LAGS, [(c,) for c in LAGS], TARGET, SIZE, FOLDS)
    return rounded(out, "symbol", "window_no", "model_id", "features", "ev")


# The flagship study closes its bars at the last trade, not at the mean price.
TRUE_CLOSE = LEARNED.replace("avg(price) AS close", "arg_max(price, (datetime, id)) AS close")


@query(
    "flagship",
    f"""WITH {TRUE_CLOSE}, f AS ({figures_sql('results', 'symbol', 'sqrt(730)')})
    SELECT symbol, '{','.join(LAGS)}' AS features, '{TARGET}' AS target, no_trades, {RS(*FIGURES)} FROM f""",
)
def flagship(spark, sf):
    """Trades -> 12h bars -> lags -> AR(3) per symbol -> out-of-sample trades -> figures."""
    return figures(research.ar_study(event_trades(spark, sf), "12h", 3), "symbol", "features", "target")
