"""Catalogue: fits under other losses than squared error.

The SQL counterparts reach the optimum by other ways: least absolute error by trying every vertex (every choice of
as many rows as coefficients), Huber loss by reweighted least squares and logistic loss by plain Newton steps, both
repeated in a recursive query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import sharpe_annualization_factor
from ..operators import features, split
from ..plans import crossval, regression, research
from ..session import written
from ..sources.sample_tables import event_trades
from .base import FIGURES, LAGS, R, RS, figures, figures_sql, query, r6, rounded, rows_sql, study_features
from .models import CV, FOLDS, LAG, NUMBERED, RATIOS, SIZE, TARGET, TRUE_CLOSE, _cv_rows, _det

FACTOR = sharpe_annualization_factor("12h")
#: Returns in tenths, so that Huber's width of 1 lies among the residuals.
TENTHS = 10.0


# --- the optimum in SQL --------------------------------------------------------------


def vertices(rows: str, name: str, xs: list[str], y: str = "y") -> str:
    """CTEs that leave in ``name`` each symbol's ``w1.., bias`` of least absolute error over ``rows (symbol, no, y, xs)``."""
    p = len(xs)
    rows_of = " JOIN ".join([f"{rows} r0", *[f"{rows} r{k} ON r{k}.symbol = r0.symbol AND r{k}.no > r{k - 1}.no" for k in range(1, p + 1)]])
    dx = [[f"(r{k}.{x} - r0.{x})" for x in xs] for k in range(1, p + 1)]
    dy = [f"(r{k}.{y} - r0.{y})" for k in range(1, p + 1)]

    def det(a: list[list[str]]) -> str:
        return a[0][0] if p == 1 else f"({a[0][0]}*{a[1][1]} - {a[0][1]}*{a[1][0]})" if p == 2 else _det(a)

    whole = det(dx)
    with_y = [[[dy[i] if j == col else dx[i][j] for j in range(p)] for i in range(p)] for col in range(p)]
    weights = [f"{det(a)} / {whole} AS w{col + 1}" for col, a in enumerate(with_y)]
    names = [f"w{i + 1}" for i in range(p)]
    line = " + ".join(f"w{i + 1}*{x}" for i, x in enumerate(xs))
    return f"""{name}_lines AS (SELECT r0.symbol, row_number() OVER () AS vertex, {', '.join(weights)},
      r0.{y} AS y0, {', '.join(f'r0.{x} AS x0_{i + 1}' for i, x in enumerate(xs))} FROM {rows_of} WHERE {whole} <> 0),
    {name}_loss AS (SELECT symbol, vertex, {', '.join(f'any_value({n}) AS {n}' for n in names)}, any_value(bias) AS bias,
      sum(abs({y} - ({line} + bias))) AS loss
      FROM (SELECT *, y0 - ({' + '.join(f'{n}*x0_{i + 1}' for i, n in enumerate(names))}) AS bias FROM {name}_lines) JOIN {rows} USING (symbol)
      GROUP BY symbol, vertex),
    {name} AS (SELECT symbol, {', '.join(f'arg_min({n}, loss) AS {n}' for n in names)}, arg_min(bias, loss) AS bias, min(loss) AS loss
      FROM {name}_loss GROUP BY symbol)"""


def reweighted(rows: str, name: str, keys: str, p: int, steps: int) -> str:
    """CTEs that leave in ``name`` the ``w1.., b`` of least Huber loss over ``rows (keys, y, x1..)``, by ``steps``
    weighted least-squares fits (none before the first)."""
    xs = [f"x{i + 1}" for i in range(p)]
    own = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    line = " + ".join(f"w{i + 1}*{x}" for i, x in enumerate(xs))
    sums = [("sq", "q"), ("sy", "q*y"), *[(f"sx{i}", f"q*{x}") for i, x in enumerate(xs)], *[(f"xy{i}", f"q*{x}*y") for i, x in enumerate(xs)]]
    sums += [(f"x{i}_{j}", f"q*{a}*{b}") for i, a in enumerate(xs) for j, b in enumerate(xs) if i <= j]
    var = lambda i, j: f"(x{min(i, j)}_{max(i, j)} - sx{i}*sx{j}/sq)"
    cov = [f"(xy{i} - sx{i}*sy/sq)" for i in range(p)]
    whole = [[var(i, j) for j in range(p)] for i in range(p)]
    det = (lambda a: a[0][0]) if p == 1 else _det
    weights = [f"{det([[cov[i] if j == col else whole[i][j] for j in range(p)] for i in range(p)])} / {det(whole)}" for col in range(p)]
    named = ", ".join(f"{w} AS w{i + 1}" for i, w in enumerate(weights))
    mean = " - ".join(["sy/sq", *[f"w{i + 1}*sx{i}/sq" for i in range(p)]])
    return f"""{name}_step AS (
      SELECT {keys}, 0 AS step, {', '.join(f'0e0 AS w{i + 1}' for i in range(p))}, 0e0 AS b FROM {rows} GROUP BY {keys}
      UNION ALL
      SELECT {keys}, step, {', '.join(f'w{i + 1}' for i in range(p))}, {mean} AS b FROM (SELECT *, {named} FROM (
        SELECT {keys}, step, {', '.join(f'sum({e}) AS {n}' for n, e in sums)} FROM (
          SELECT {own}, s.step + 1 AS step, y, {', '.join(xs)},
            CASE WHEN s.step = 0 OR abs(y - ({line} + b)) <= 1 THEN 1e0 ELSE 1 / abs(y - ({line} + b)) END AS q
          FROM {rows} t JOIN {name}_step s USING ({keys}) WHERE s.step < {steps})
        GROUP BY {keys}, step))),
    {name} AS (SELECT * FROM {name}_step WHERE step = {steps})"""


def logistic(rows: str, name: str, steps: int = 25) -> str:
    """CTEs that leave in ``name`` each symbol's ``w1, b`` of least logistic loss over ``rows (symbol, y, x1)``."""
    return f"""{name}_step AS (
      SELECT symbol, 0 AS step, 0e0 AS w1, 0e0 AS b FROM {rows} GROUP BY symbol
      UNION ALL
      SELECT symbol, step, w1 + (h0*gx - hx*g) / (hxx*h0 - hx*hx), b + (hxx*g - hx*gx) / (hxx*h0 - hx*hx) FROM (
        SELECT symbol, step, w1, b, sum(c*(1 - c)*x1*x1) AS hxx, sum(c*(1 - c)*x1) AS hx, sum(c*(1 - c)) AS h0, sum((y - c)*x1) AS gx, sum(y - c) AS g
        FROM (SELECT t.symbol, s.step + 1 AS step, w1, b, y, x1, 1 / (1 + exp(-(w1*x1 + b))) AS c
              FROM {rows} t JOIN {name}_step s USING (symbol) WHERE s.step < {steps})
        GROUP BY symbol, step, w1, b)),
    {name} AS (SELECT * FROM {name}_step WHERE step = {steps})"""


STUDY = f"{TARGET} AS y, {', '.join(f'{x} AS x{i + 1}' for i, x in enumerate(LAGS))}"
NO = f"t AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY datetime) AS no, {STUDY} FROM study)"
TRAIN = f"t AS (SELECT symbol, row_no AS no, {STUDY} FROM marked WHERE is_train)"


# --- fits -----------------------------------------------------------------------------


def _fitted(rows, target, loss, by="symbol"):
    """One-lag coefficients, their loss, and what is left of the condition for an optimum."""
    fitted = regression.fit_linear(rows, LAG, target, (by,), loss=loss)
    losses = regression.mean_loss(rows, fitted, LAG, target, [by], loss)
    out = fitted.join(losses, [by, "model_id"]).withColumn("w1", F.get("weights", F.lit(0)))
    return rounded(out.withColumn("optimality", r6("optimality")), by, "converged", "n_train", "w1", "bias", "loss", "optimality")


@query(
    "fit_l1",
    f"""WITH {rows_sql()}, {NO}, {vertices('t', 'best', ['x1'])}, n AS (SELECT symbol, count(*) AS n FROM t GROUP BY symbol)
    SELECT symbol, true AS converged, {R('n', 'n_train')}, {RS('w1', 'bias')}, {R('loss / n', 'loss')}, 0e0 AS optimality FROM best JOIN n USING (symbol)""",
)
def fit_l1(spark, sf):
    """Least absolute error, one lag."""
    return _fitted(written(features.drop_null_rows(study_features(spark, sf)), "study-rows"), TARGET, "l1")


_TENTHS = f"t AS (SELECT symbol, {TENTHS}e0 * {TARGET} AS y, {TENTHS}e0 * {LAGS[0]} AS x1 FROM study)"


def in_tenths(rows):
    return rows.withColumns({c: F.lit(TENTHS) * F.col(c) for c in (TARGET, *LAGS)})


@query(
    "fit_huber",
    f"""WITH RECURSIVE {rows_sql()}, {_TENTHS}, {reweighted('t', 'best', 'symbol', 1, 400)},
    r AS (SELECT symbol, w1, b, abs(y - (w1*x1 + b)) AS off FROM t JOIN best USING (symbol))
    SELECT symbol, true AS converged, {R('count(*)', 'n_train')}, {R('any_value(w1)', 'w1')}, {R('any_value(b)', 'bias')},
      {R('avg(CASE WHEN off <= 1 THEN off * off / 2 ELSE off - 0.5e0 END)', 'loss')}, 0e0 AS optimality FROM r GROUP BY symbol""",
)
def fit_huber(spark, sf):
    """Huber loss, one lag, returns in tenths."""
    rows = in_tenths(features.drop_null_rows(study_features(spark, sf)))
    return _fitted(written(rows, "study-rows"), TARGET, "huber")


@query(
    "logreg_fit",
    f"""WITH RECURSIVE {rows_sql()}, {NUMBERED}, lags AS (SELECT symbol, avg({LAGS[0]}) AS m, stddev_pop({LAGS[0]}) AS s FROM marked WHERE is_train GROUP BY symbol),
    t AS (SELECT symbol, CASE WHEN {TARGET} > 0 THEN 1e0 ELSE 0e0 END AS y, ({LAGS[0]} - m) / s AS x1 FROM marked JOIN lags USING (symbol) WHERE is_train),
    {logistic('t', 'best')}
    SELECT symbol, true AS converged, {R('count(*)', 'n_train')}, {R('any_value(w1)', 'w1')}, {R('any_value(b)', 'bias')},
      {R('avg(ln(1 + exp(w1*x1 + b)) - y*(w1*x1 + b))', 'loss')}, 0e0 AS optimality FROM t JOIN best USING (symbol) GROUP BY symbol""",
)
def logreg_fit(spark, sf):
    """Logistic regression per symbol on the standardised lag."""
    rows = features.add_direction_target(features.drop_null_rows(study_features(spark, sf)), TARGET)
    rows = features.standardise(split.with_split(rows), LAG).where("is_train").withColumn(LAG[0], F.col(f"{LAG[0]}_scaled"))
    return _fitted(written(rows, "study-rows"), f"{TARGET}_dir", "logistic")


# --- studies with the default loss ------------------------------------------------------


def _results(fit: str, line: str, keys: str = "symbol") -> str:
    """Trades of the test rows under the coefficients in ``fit``, with their curves."""
    over = f"OVER (PARTITION BY {keys} ORDER BY datetime ROWS UNBOUNDED PRECEDING)"
    return f"""tested AS (SELECT {keys}, datetime, {TARGET} AS y_true, {line} AS y_pred FROM marked JOIN {fit} USING (symbol) WHERE NOT is_train),
    signed AS (SELECT *, sign(y_pred) = sign(y_true) AS is_won, sign(y_pred) * y_true AS trade_log_return FROM tested),
    curve AS (SELECT *, sum(trade_log_return) {over} AS equity_curve FROM signed),
    results AS (SELECT *, equity_curve - max(equity_curve) {over} AS drawdown_log_return FROM curve)"""


_THREE = " + ".join([*[f"w{i + 1}*{x}" for i, x in enumerate(LAGS)], "bias"])
_L1 = f"{NUMBERED}, {TRAIN}, {vertices('t', 'best', ['x1', 'x2', 'x3'])}, {_results('best', _THREE)}"


@query(
    "learned_trades_l1",
    f"WITH {rows_sql()}, {_L1} SELECT symbol, datetime, is_won, {RS('y_pred', 'y_true', 'trade_log_return', 'equity_curve', 'drawdown_log_return')} FROM results",
)
def learned_trades_l1(spark, sf):
    """Trades of a model fitted under the default loss."""
    out = research.learn_model_trades(study_features(spark, sf), LAGS, TARGET)
    return rounded(out, "symbol", "datetime", "is_won", "y_pred", "y_true", "trade_log_return", "equity_curve", "drawdown_log_return")


@query(
    "model_benchmark_l1",
    f"""WITH {rows_sql()}, {_L1}, f AS ({figures_sql('results', 'symbol', 'sqrt(730)')})
    SELECT symbol, no_trades, {RS(*FIGURES)}, {RS('w1', 'w2', 'w3', 'bias')} FROM f JOIN best USING (symbol)""",
)
def model_benchmark_l1(spark, sf):
    out = research.benchmark_model(study_features(spark, sf), LAGS, TARGET, FACTOR)
    out = out.withColumns({f"w{i + 1}": F.get("weights", F.lit(i)) for i in range(3)})
    return figures(out, "symbol", "w1", "w2", "w3", "bias")


@query(
    "flagship_l1",
    f"""WITH {rows_sql().replace('avg(price) AS close', 'arg_max(price, (datetime, id)) AS close')}, {_L1},
    f AS ({figures_sql('results', 'symbol', 'sqrt(730)')})
    SELECT symbol, '{','.join(LAGS)}' AS features, '{TARGET}' AS target, no_trades, {RS(*FIGURES)} FROM f""",
)
def flagship_l1(spark, sf):
    """The flagship study with the least-absolute-error loss."""
    return figures(research.ar_study(event_trades(spark, sf), "12h", 3, loss="l1"), "symbol", "features", "target")


def _subset_fits() -> str:
    """Every one- and two-lag model by vertices, as ``models (symbol, model_id, features, w1, w2, w3, bias)``."""
    subsets = regression.feature_subsets([1, 2, 3], 2)
    fits = [vertices("t", f"v{n}", [f"x{i}" for i in s]) for n, s in enumerate(subsets)]
    rows = []
    for n, s in enumerate(subsets):
        place = {i: f"w{k + 1}" for k, i in enumerate(s)}
        cols = ", ".join(f"{place.get(i, '0e0')} AS w{i}" for i in (1, 2, 3))
        rows.append(f"SELECT symbol, {n} AS model_id, '{','.join(LAGS[i - 1] for i in s)}' AS features, {cols}, bias FROM v{n}")
    return ", ".join(fits) + ", models AS (" + " UNION ALL ".join(rows) + ")"


@query(
    "subset_search_l1",
    f"""WITH {rows_sql()}, {NUMBERED}, {TRAIN}, {_subset_fits()}, {_results('models', _THREE, 'symbol, model_id')},
    f AS ({figures_sql('results', 'symbol, model_id', 'sqrt(730)')})
    SELECT symbol, model_id, features, no_trades, {RS(*FIGURES)}, {RS('w1', 'w2', 'w3', 'bias')} FROM f JOIN models USING (symbol, model_id)""",
)
def subset_search_l1(spark, sf):
    """All one- and two-lag models of every symbol under the default loss."""
    out = research.search_linear_models(study_features(spark, sf), TARGET, LAGS, FACTOR, 2)
    out = out.withColumns({f"w{i + 1}": F.get("weights", F.lit(i)) for i in range(3)})
    return figures(out, "symbol", "model_id", "features", "w1", "w2", "w3", "bias")


# --- cross-validation with the default loss, returns in tenths --------------------------

_T = f"{TENTHS}e0 * "
_CV_ROWS = f"cv AS (SELECT symbol, row_no, n_rows, {_T}y AS y, {_T}x1 AS x1 FROM rows_no)"
_EV = "avg(sign(f.w1 * x1 + f.b) * r.y)"


@query(
    "cv_huber",
    f"""WITH RECURSIVE {CV}, t AS (SELECT symbol, row_no // {SIZE} AS window_no, y, x1, x2, x3 FROM rows_no
      WHERE row_no // {SIZE} < {FOLDS} AND (row_no // {SIZE} + 2) * {SIZE} <= n_rows), {reweighted('t', 'f0', 'symbol, window_no', 3, 60)}
    SELECT r.symbol, f.window_no, {R('avg(sign(f.w1*r.x1 + f.w2*r.x2 + f.w3*r.x3 + f.b) * r.y)', 'ev', digits=4)} FROM rows_no r
    JOIN f0 f ON f.symbol = r.symbol AND f.window_no = r.row_no // {SIZE} - 1 GROUP BY r.symbol, f.window_no""",
)
def cv_huber(spark, sf):
    """Rolling folds with the Huber loss and all three lags."""
    out = crossval.rolling_cv(_cv_rows(spark, sf), LAGS, TARGET, SIZE, FOLDS, loss="huber")
    return rounded(out, "symbol", "window_no", "ev", digits=4)


@query(
    "cv_expanding_huber",
    f"""WITH RECURSIVE {CV}, {_CV_ROWS}, its AS (SELECT unnest(generate_series(1, {FOLDS})) AS iteration_no),
    t AS (SELECT symbol, iteration_no, y, x1 FROM cv JOIN its ON row_no < {SIZE} * iteration_no), {reweighted('t', 'f0', 'symbol, iteration_no', 1, 400)}
    SELECT r.symbol, f.iteration_no, {R(_EV, 'ev')} FROM cv r JOIN f0 f ON f.symbol = r.symbol AND f.iteration_no = r.row_no // {SIZE}
    WHERE (f.iteration_no + 1) * {SIZE} <= n_rows GROUP BY r.symbol, f.iteration_no""",
)
def cv_expanding_huber(spark, sf):
    out = crossval.expanding_cv(in_tenths(_cv_rows(spark, sf)), LAG, TARGET, SIZE, FOLDS)
    return rounded(out, "symbol", "iteration_no", "ev")


@query(
    "cv_ratios_huber",
    f"""WITH RECURSIVE {CV}, {_CV_ROWS}, sizes AS (SELECT unnest([{', '.join(f'{r}e0' for r in RATIOS)}]) AS train_size),
    t AS (SELECT symbol, train_size, y, x1 FROM cv JOIN sizes ON row_no < floor(n_rows * train_size)), {reweighted('t', 'f0', 'symbol, train_size', 1, 400)}
    SELECT r.symbol, f.train_size, {R(_EV, 'ev')} FROM cv r JOIN f0 f ON f.symbol = r.symbol AND r.row_no >= floor(n_rows * f.train_size)
    GROUP BY r.symbol, f.train_size""",
)
def cv_ratios_huber(spark, sf):
    out = crossval.ratio_cv(in_tenths(_cv_rows(spark, sf)), LAG, TARGET, RATIOS)
    return rounded(out, "symbol", "train_size", "ev")
