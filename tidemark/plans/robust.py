"""Fits under Huber, least-absolute and logistic loss, to the optimum.

A :class:`Fit` is the state of one model: it asks one question of its rows, and the answer moves it on.
Newton steps with a line search lead Huber and logistic fits to where the gradient vanishes. A least-absolute
fit follows Huber losses of shrinking width, and is then finished exactly: the rows nearest to it make a
vertex (as many rows of zero residual as coefficients), and rows are exchanged until the vertex's dual
weights all lie within [-1, 1], which proves it optimal. Targets carry a noise of a hundred-billionth while
rows are exchanged, so that ties cannot turn in circles; the coefficients come from the targets themselves.

Rows answer in two places. Groups of at most ``GROUP_ROWS`` rows meet in one task. The rows of larger ones
stay where they are: the states of all open models are a written table, one aggregation joined to it answers
them all, whatever each asks, and the answers make the next table. Nothing of it is held by the driver.

With ``cuts`` a group has one model per cut, trained on the rows whose segment is below it. The rows are
still read once per step and moved once, not once per model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maths import sigmoid
from ..session import written

HUBER_DELTA = 1.0
#: A fit has converged when its mean gradient is this small, in units in which a row counts at most about 1.
OPTIMAL = 1e-8
#: Width of the Huber losses that lead to a least-absolute fit: its start as a share of the start's residual
#: deviation, how it shrinks once the gradient is small, and its end, or where a tenth of a row lies within it.
WIDTH, SHRINK, LEAST_WIDTH, NEARLY = 0.3, 0.01, 1e-8, 1e-2
#: Curvature that rows beyond the width keep, as a share of what a majorising parabola has.
BEYOND = 0.01
#: Steps along the Newton direction, of which the one with the least loss is taken.
REACHES = (1.0, 2.0, *(0.5**k for k in range(1, 13)))
#: A logistic optimum is one only if the next step would be short: without one, the gradient vanishes all the same.
SETTLED = 1e-3
#: Noise of the targets in the search among vertices, as a share of the targets' size; what counts as dependent; as optimal.
NOISE, DEPENDENT, DUAL = 1e-11, 1e-7, 1e-7
#: Groups of at most this many rows are fitted where their rows meet.
GROUP_ROWS = 50_000
#: Steps after which a fit is given up and marked as not converged, and after which a least-absolute one goes on
#: from vertex to vertex, however near it is.
GIVE_UP, NEAR_ENOUGH = 500, 60

STATE = (
    "mode string, at array<double>, way array<double>, width double, beyond double, steps int, left double, converged boolean, "
    "n double, rms double, noise double, used array<double>, held array<array<double>>, span array<array<double>>, "
    "rows array<long>, leaving int"
)
STATE_NAMES = [part.split()[0] for part in STATE.split(", ")]


class Fit:
    """One model's state, in standardised features with the bias last. ``mode`` is what it asks:

    * ``slope``: Newton sums at ``at``;
    * ``reach``: losses at REACHES steps along ``way``, and Newton sums after the first of them;
    * ``basis``: the nearest row that does not depend on those held;
    * ``dual``: the sum of the signed rows that are not held;
    * ``ratio``: the first row that the line along ``way`` meets;
    * ``done``: nothing.
    """

    def __init__(self, loss: str, **state):
        self.loss = loss
        self.__dict__.update(state)

    @classmethod
    def begin(cls, loss: str, at: np.ndarray, n: float, rms: float, size: float, used: np.ndarray) -> Fit:
        """From the least-squares fit: ``rms`` of its residuals, ``size`` of the targets, the columns ``used``."""
        exact = loss != "logistic" and rms <= 1e-13 * size
        p = len(at)
        return cls(
            loss, mode="done" if exact else "slope", at=at, way=np.zeros(p), width=HUBER_DELTA if loss == "huber" else max(WIDTH * rms, 1e-300),
            beyond=BEYOND, steps=0, left=0.0 if exact else np.inf, converged=exact, n=n, rms=rms, noise=NOISE * size, used=used,
            held=np.zeros((0, p + 2)), span=np.zeros((0, p)), rows=[], leaving=-1,
        )

    @classmethod
    def load(cls, loss: str, row: dict) -> Fit:
        state = {name: row[name] for name in STATE_NAMES}
        for name in ("at", "way", "used"):
            state[name] = np.array(state[name], float)
        p = len(state["at"])
        for name, wide in (("held", p + 2), ("span", p)):
            state[name] = np.array([list(v) for v in state[name]], float).reshape(-1, wide)
        return cls(loss, **(state | {"rows": [int(r) for r in state["rows"]]}))

    def row(self) -> dict:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items() if k != "loss"}

    # -- Newton steps --

    def _left(self, gradient: np.ndarray) -> float:
        left = float(np.abs(gradient).max()) / (self.n if self.loss == "logistic" else self.n * self.width)
        return left * min(1.0, self.width / self.rms) if self.loss == "huber" else left

    def slope(self, matrix: np.ndarray, gradient: np.ndarray, margin: float) -> None:
        """Sums at ``at``; ``margin`` is the least of the rows' margins (logistic)."""
        self.steps += 1
        gradient = gradient * self.used
        left, least = self._left(gradient), max(min(max(LEAST_WIDTH, 0.1 / self.n), WIDTH) * self.rms, 1e-300)
        narrow = self.loss != "l1" or self.width <= least * 1.01
        if narrow:
            self.left = left
        if self.loss == "logistic" and margin > 0:  # a line parts the classes: the further out, the better
            self._end(False)
            return
        use = self.used > 0
        way = np.zeros_like(self.at)
        way[use] = np.linalg.pinv(matrix[np.ix_(use, use)], rcond=1e-12, hermitian=True) @ gradient[use]
        if narrow and left <= OPTIMAL:
            settled = self.loss != "logistic" or float(np.abs(way).max()) <= SETTLED
            self.at = self.at + way * settled  # the last step, shorter than what counts as left
            self._end(settled)
        elif self.steps >= (NEAR_ENOUGH if self.loss == "l1" else GIVE_UP):
            self._end(False)
        elif not narrow and left <= NEARLY:
            self.width, self.mode = max(self.width * SHRINK, least), "slope"
        else:
            self.way, self.mode = way, "reach"

    def reach(self, now: float, losses: np.ndarray, matrix: np.ndarray, gradient: np.ndarray, margin: float) -> None:
        best = int(np.argmin(losses))
        # where no digit of the loss is left to gain, a step that halves the gradient still is one
        polish = self.beyond >= 1 and self.loss != "l1" and self._left(gradient * self.used) < self.left / 2
        if losses[best] < now or polish:
            best = best if losses[best] < now else 0
            self.at, self.mode = self.at + REACHES[best] * self.way, "slope"
            if best == 0:
                self.slope(matrix, gradient, margin)
        elif self.beyond < 1:
            self.beyond, self.mode = min(1.0, self.beyond * 10), "slope"  # a safer direction
        else:
            self._end(self.left <= OPTIMAL)

    def _end(self, settled: bool) -> None:
        if self.loss == "l1":
            self.mode = "basis"
        else:
            self.mode, self.converged = "done", settled

    # -- vertices --

    def first(self, row: int | None, noisy: float, target: float, x: np.ndarray) -> None:
        """The row that ``basis`` or ``ratio`` asked for; None if there is none."""
        if row is None:
            self.mode = "done"
            return
        line = np.concatenate([[noisy, target], x * self.used])
        if self.mode == "ratio":
            self.held[self.leaving], self.rows[self.leaving] = line, row
        else:
            self.held, self.rows = np.vstack([self.held, line]), [*self.rows, row]
            new = line[2:] - self.span.T @ (self.span @ line[2:])
            self.span = np.vstack([self.span, new / np.linalg.norm(new)])
        if len(self.rows) == int(self.used.sum()):
            self.at, self.mode = self._vertex(0), "dual"

    def _vertex(self, column: int) -> np.ndarray:
        use = self.used > 0
        at = np.zeros_like(self.at)
        at[use] = np.linalg.solve(self.held[:, 2:][:, use], self.held[:, column])
        return at

    def dual(self, signed: np.ndarray) -> None:
        use = self.used > 0
        held = self.held[:, 2:][:, use]
        weights = np.linalg.solve(held.T, signed[use])
        beyond = np.abs(weights) - 1
        k = int(np.argmax(beyond))
        self.left, self.steps = max(0.0, float(beyond[k])) / self.n, self.steps + 1
        if beyond[k] <= DUAL or self.steps >= GIVE_UP:
            self.at, self.mode, self.converged = self._vertex(1), "done", bool(beyond[k] <= DUAL)
            return
        self.way = np.zeros_like(self.at)
        self.way[use] = np.linalg.solve(held, np.sign(weights[k]) * np.eye(len(held))[k])
        self.leaving, self.mode = k, "ratio"

    def coefficients(self, mean: np.ndarray, sd: np.ndarray) -> tuple[list[float], float]:
        """Weights and bias in the features' own units."""
        weights = np.where(sd > 0, self.at[:-1] / np.where(sd > 0, sd, 1), 0.0)
        return weights.tolist(), float(self.at[-1] - weights @ mean)


def independent(products: np.ndarray, chosen: Sequence[int]) -> np.ndarray:
    """1 for those of the ``chosen`` columns, taken in turn after the last one (the bias), that the ones before
    do not make up; 0 for all others. ``products`` are mean products of the columns."""
    used = np.zeros(len(products))
    for c in [len(products) - 1, *chosen]:
        if products[c, c] > 0:
            at = np.flatnonzero(used)
            rest = products[c, c] - products[c, at] @ np.linalg.lstsq(products[np.ix_(at, at)], products[at, c], rcond=None)[0]
            used[c] = rest > 1e-10 * products[c, c]
    return used


# --- rows that meet in a task ------------------------------------------------


def _curves(loss: str, eta: np.ndarray, y: np.ndarray, width: float, beyond: float) -> tuple[np.ndarray, np.ndarray]:
    """Row curvature and row slope of a loss."""
    if loss == "logistic":
        p = 1 / (1 + np.exp(-eta))
        return np.maximum(p * (1 - p), 1e-9), y - p
    r = y - eta
    size = np.abs(r)
    return np.where(size <= width, 1.0, beyond * width / np.maximum(size, 1e-300)), np.clip(r, -width, width)


def _total(loss: str, eta: np.ndarray, y: np.ndarray, width: float) -> float:
    if loss == "logistic":
        return float((np.log1p(np.exp(-np.abs(eta))) + np.maximum(eta, 0) - y * eta).sum())
    size = np.abs(y - eta)
    return float(np.where(size <= width, size * size / (2 * width), size - width / 2).sum())


def _advance(fit: Fit, a: np.ndarray, y: np.ndarray, noise: np.ndarray) -> None:
    """Answer the question of ``fit`` from its rows."""
    eta = a @ fit.at
    if fit.mode in ("slope", "reach"):
        move = a @ fit.way
        probe = eta + REACHES[0] * move if fit.mode == "reach" else eta
        curve, slope = _curves(fit.loss, probe, y, fit.width, fit.beyond)
        sums = (a * curve[:, None]).T @ a, a.T @ slope, float(((2 * y - 1) * probe).min())
        if fit.mode == "slope":
            fit.slope(*sums)
        else:
            fit.reach(_total(fit.loss, eta, y, fit.width), np.array([_total(fit.loss, eta + t * move, y, fit.width) for t in REACHES]), *sums)
        return
    noisy = y + fit.noise * noise
    r = noisy - eta
    free = np.ones(len(y), bool)
    free[fit.rows] = False
    if fit.mode == "dual":
        fit.dual(a[free].T @ np.sign(r[free]))
        return
    x = a * fit.used
    if fit.mode == "basis":
        outside = (x * x).sum(1) - ((x @ fit.span.T) ** 2).sum(1)
        rows = np.flatnonzero(free & (outside > DEPENDENT * (x * x).sum(1)))
        best = rows[np.argmin(np.abs(r[rows]))] if len(rows) else None
    else:
        move = a @ fit.way
        rows = np.flatnonzero(free & (np.abs(move) > 1e-12) & (r * move > 0))
        t = r[rows] / move[rows]
        order = np.argsort(t, kind="stable")
        # as far as the loss falls: each row that is passed turns the slope by twice its own
        slope = fit.left * fit.n - 2 * np.cumsum(np.abs(move[rows[order]]))
        best = rows[order[min(int((slope > 0).sum()), len(rows) - 1)]] if len(rows) else None
    fit.first(*((None, 0.0, 0.0, x[0]) if best is None else (int(best), noisy[best], y[best], x[best])))


def _fit_together(rows: DataFrame, features: list[str], by: list[str], places: list[list[int]], loss: str, cuts: Sequence[int] | None, schema) -> DataFrame:
    p = len(features)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_target", *features], kind="stable")  # the same noise in every run
        y = frame["_target"].to_numpy(float)
        mean, sd = (np.array(frame[c].iloc[0], float) for c in ("_mean", "_sd"))
        z = np.where(sd > 0, (frame[features].to_numpy(float) - mean) / np.where(sd > 0, sd, 1), 0)
        a_all, noise_all = np.column_stack([z, np.ones(len(y))]), np.random.default_rng(0).uniform(-1, 1, len(y))
        out = []
        for fold, cut in enumerate(cuts or [None]):
            mine = slice(None) if cut is None else frame["_segment"].to_numpy() < cut
            a, t, noise = a_all[mine], y[mine], noise_all[mine]
            if not len(t):
                continue
            for model, chosen in enumerate(places):
                use = independent(a.T @ a / len(t), chosen)
                at = np.zeros(p + 1)
                response = 4 * t - 2 if loss == "logistic" else t
                at[use > 0] = np.linalg.lstsq(a[:, use > 0], response, rcond=None)[0]
                f = Fit.begin(loss, at, float(len(t)), float(np.sqrt(np.mean((t - a @ at) ** 2))), float(np.sqrt(np.mean(t * t))), use)
                while f.mode != "done":
                    _advance(f, a, t, noise)
                key = [frame[k].iloc[0] for k in by] + ([fold] if cuts else [])
                out.append((*key, model, *f.coefficients(mean, sd), f.n, f.rms, f.steps, f.left, f.converged))
        return pd.DataFrame(out, columns=schema.names)

    return rows.groupBy(*by).applyInPandas(fit, schema)


# --- rows that stay where they are -------------------------------------------


def _begin(loss: str, p: int, places: list[list[int]]) -> Callable:
    """First states from sums of products of ``1, x1..xp, y`` and of the least-squares response."""
    upper = np.triu_indices(p + 3)

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                full = np.zeros((p + 3, p + 3))
                full[upper] = full[upper[::-1]] = row.pop("_sums")
                n = full[0, 0]
                order = [*range(1, p + 1), 0, p + 1, p + 2]  # the bias after the features, then target and response
                full = full[np.ix_(order, order)] / n
                for model, chosen in enumerate(places):
                    use = independent(full[: p + 1, : p + 1], chosen)
                    at, some = np.zeros(p + 1), use > 0
                    at[some] = np.linalg.solve(full[: p + 1, : p + 1][np.ix_(some, some)], full[: p + 1, p + 2][some])
                    rest = full[p + 1, p + 1] - 2 * at @ full[: p + 1, p + 1] + at @ full[: p + 1, : p + 1] @ at
                    f = Fit.begin(loss, at, float(n), float(np.sqrt(max(rest, 0.0))), float(np.sqrt(full[p + 1, p + 1])), use)
                    out.append(row | {"model_id": model} | f.row())
            yield pd.DataFrame(out)

    return begin


def _moved(loss: str, p: int) -> Callable:
    """The next states, from states with the answers to their questions."""
    pairs = list(combinations_with_replacement(range(p + 1), 2))

    def moved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                answer = {k.removeprefix("_a_"): row.pop(k) for k in list(row) if k.startswith("_a_")}
                f = Fit.load(loss, row)
                gradient = np.array([answer[f"g{i}"] for i in range(p + 1)])
                matrix = np.zeros((p + 1, p + 1))
                for i, j in pairs:
                    matrix[i, j] = matrix[j, i] = answer[f"h{i}_{j}"]
                if f.mode == "slope":
                    f.slope(matrix, gradient, answer["margin"])
                elif f.mode == "reach":
                    f.reach(answer["now"], np.array([answer[f"t{i}"] for i in range(len(REACHES))]), matrix, gradient, answer["margin"])
                elif f.mode == "dual":
                    f.dual(gradient)
                else:
                    found = int(answer["row"])
                    f.first(found if found >= 0 else None, answer["noisy"], answer["target"], np.array([answer[f"x{i}"] for i in range(p + 1)]))
                out.append(row | f.row())
            yield pd.DataFrame(out)

    return moved


def _answers(rows: DataFrame, states: DataFrame, keys: list[str], by: list[str], p: int, loss: str, folds: bool) -> DataFrame:
    """What the open ``states`` ask, from one pass over the rows, by ``keys``. All sums are plain numbers, so that
    rows are aggregated by hash."""
    asked = rows.join(states, by)
    if folds:
        asked = asked.where(F.col("_segment") < F.col("_cut"))
    x = [*[F.col(f"_x{i}") for i in range(p)], F.lit(1.0)]
    line = lambda c: reduce(Column.__add__, [F.get(F.col(c), F.lit(i)) * v for i, v in enumerate(x)])
    asked = asked.withColumns({"_eta": line("at"), "_move": line("way")})
    mode, y, width = F.col("mode"), F.col("_target"), F.col("width")
    probe = F.col("_eta") + F.when(mode == "reach", F.lit(REACHES[0]) * F.col("_move")).otherwise(0.0)
    newton, reaching = mode.isin("slope", "reach"), mode == "reach"
    off = y - F.col("_probe")
    if loss == "logistic":
        chance = sigmoid(F.col("_probe"))
        curve, slope = F.greatest(chance * (1 - chance), F.lit(1e-9)), y - chance
    else:
        curve = F.when(F.abs(off) <= width, 1.0).otherwise(F.col("beyond") * width / F.abs(off))
        slope = F.greatest(F.least(off, width), -width)

    def value(eta: Column) -> Column:
        if loss == "logistic":
            return F.log1p(F.exp(-F.abs(eta))) + F.greatest(eta, F.lit(0.0)) - y * eta
        size = F.abs(y - eta)
        return F.when(size <= width, size * size / (2 * width)).otherwise(size - width / 2)

    free = ~F.array_contains("rows", F.col("_row"))
    noisy = y + F.col("noise") * F.col("_noise")
    rest = F.col("_noisy") - F.col("_eta")
    own = [v * F.get("used", F.lit(i)) for i, v in enumerate(x)]
    length = reduce(Column.__add__, [v * v for v in own])
    along = [reduce(Column.__add__, [F.get(F.get("span", F.lit(j)), F.lit(i)) * v for i, v in enumerate(own)]) for j in range(p)]
    outside = reduce(Column.__sub__, [F.coalesce(a * a, F.lit(0.0)) for a in along], length)
    near = F.when((mode == "basis") & free & (outside > DEPENDENT * length), F.abs(rest))
    near = near.when((mode == "ratio") & free & (F.abs("_move") > 1e-12) & (rest * F.col("_move") > 0), rest / F.col("_move"))
    asked = asked.withColumns({"_probe": probe, "_noisy": noisy})
    asked = asked.withColumns({
        "_curve": F.when(newton, curve),
        "_slope": F.when(newton, slope).when((mode == "dual") & free, F.signum(rest)),
        "_near": near if loss == "l1" else F.lit(None).cast("double"),
    })
    sums = [F.sum(F.col("_curve") * x[i] * x[j]).alias(f"_a_h{i}_{j}") for i, j in combinations_with_replacement(range(p + 1), 2)]
    sums += [F.coalesce(F.sum(F.col("_slope") * v), F.lit(0.0)).alias(f"_a_g{i}") for i, v in enumerate(x)]
    sums += [F.sum(F.when(reaching, value(F.col("_eta")))).alias("_a_now")]
    sums += [F.sum(F.when(reaching, value(F.col("_eta") + t * F.col("_move")))).alias(f"_a_t{i}") for i, t in enumerate(REACHES)]
    margin = F.min(F.when(newton, (2 * y - 1) * F.col("_probe"))) if loss == "logistic" else F.lit(0.0)
    wanted = {"noisy": F.col("_noisy"), "target": y} | {f"x{i}": v for i, v in enumerate(x)}
    firsts = [F.min_by(v, F.col("_near")).alias(f"_a_{name}") for name, v in wanted.items()] if loss == "l1" else []
    row = F.min_by("_row", "_near") if loss == "l1" else F.lit(None)
    firsts.append(F.coalesce(row, F.lit(-1)).cast("long").alias("_a_row"))
    return asked.groupBy(*keys).agg(*sums, margin.alias("_a_margin"), *firsts)


def _fit_apart(rows: DataFrame, features: list[str], by: list[str], places: list[list[int]], loss: str, cuts: Sequence[int] | None, schema) -> DataFrame:
    p, folds = len(features), bool(cuts)
    scaled = rows.select(
        *by, "_target", *(["_segment"] if folds else []),
        *[F.when(F.col("_sd")[i] > 0, (F.col(f).cast("double") - F.col("_mean")[i]) / F.col("_sd")[i]).otherwise(0.0).alias(f"_x{i}") for i, f in enumerate(features)],
        F.monotonically_increasing_id().alias("_row"),
    )
    noise = F.pmod(F.xxhash64("_row"), F.lit(1 << 53)) / F.lit(float(1 << 52)) - 1
    scaled = written(scaled.withColumn("_noise", noise), "fit-scaled")
    keys = [*by, *(["_fold"] if folds else []), "model_id"]
    # sums of products by segment, then by fold: a fold has the sums of all segments before its cut
    terms = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(p)], F.col("_target"), F.col("_target") * 4 - 2 if loss == "logistic" else F.col("_target")]
    names = [f"m{k}" for k in range((p + 3) * (p + 4) // 2)]
    products = [F.sum(a * b).alias(n) for n, (a, b) in zip(names, combinations_with_replacement(terms, 2))]
    sums = scaled.groupBy(*by, *(["_segment"] if folds else [])).agg(*products)
    if folds:
        of_fold = [F.when(F.col("_segment") < c, F.lit(k)) for k, c in enumerate(cuts)]
        sums = sums.withColumn("_fold", F.explode(F.array_compact(F.array(*of_fold)))).groupBy(*by, "_fold").agg(*[F.sum(n).alias(n) for n in names])
    own = T.StructType([f for f in sums.schema.fields if f.name in keys])
    schema_of_states = T.StructType([*own.fields, T.StructField("model_id", T.IntegerType()), *T.StructType.fromDDL(STATE).fields])
    states = written(sums.select(*own.names, F.array(*names).alias("_sums")).mapInPandas(_begin(loss, p, places), schema_of_states), "fit-states")
    while (open_ := states.where("mode <> 'done'")).limit(1).count():
        if folds:
            open_ = open_.withColumn("_cut", F.get(F.array(*[F.lit(c) for c in cuts]), F.col("_fold")))
        answers = _answers(scaled, open_, keys, by, p, loss, folds)
        moved = open_.drop("_cut").join(answers, keys).mapInPandas(_moved(loss, p), schema_of_states)
        states = written(moved.unionByName(states.where("mode = 'done'")), "fit-states")
    scales = written(rows.groupBy(*by).agg(F.first("_mean").alias("_mean"), F.first("_sd").alias("_sd")), "fit-scales")

    def results(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                f = Fit.load(loss, row)
                own = f.coefficients(np.array(row["_mean"], float), np.array(row["_sd"], float))
                out.append((*[row[k] for k in keys], *own, f.n, f.rms, f.steps, f.left, f.converged))
            yield pd.DataFrame(out, columns=schema.names)

    return states.join(scales, by).mapInPandas(results, schema)


# --- the fit -----------------------------------------------------------------


def fit_robust(
    rows: DataFrame, features: list[str], by: list[str], subsets: Sequence[Sequence[str]], loss: str, cuts: Sequence[int] | None = None
) -> DataFrame:
    """Every subset for every group of ``rows`` (``by``, ``features``, ``_target`` and, with ``cuts``, ``_segment``,
    a written table without NULLs): ``by``, ``_fold`` (with ``cuts``), ``model_id, weights, bias, n_train, rms, steps,
    optimality, converged``. ``optimality`` is the mean gradient that is left or, for a least-absolute fit, how far
    its dual weights lie beyond 1, per row."""
    places = [[features.index(f) for f in s] for s in subsets]
    sizes = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.array(*[F.avg(F.col(f).cast("double")) for f in features]).alias("_mean"),
        F.array(*[F.stddev_pop(F.col(f).cast("double")) for f in features]).alias("_sd"),  # a constant feature has 0
    )
    sizes = written(sizes, "fit-groups")
    fields = [rows.schema[k] for k in by]
    if cuts:
        fields.append(T.StructField("_fold", T.IntegerType()))
    result = T.StructType.fromDDL(
        "model_id int, weights array<double>, bias double, n_train double, rms double, steps int, optimality double, converged boolean"
    )
    schema = T.StructType([*fields, *result.fields])
    small = rows.join(sizes.where(F.col("_n") <= GROUP_ROWS), by)
    fitted = [_fit_together(small, features, by, places, loss, cuts, schema)]
    large = sizes.where(F.col("_n") > GROUP_ROWS)
    if large.limit(1).count():
        fitted.append(_fit_apart(rows.join(large, by), features, by, places, loss, cuts, schema))
    return written(reduce(DataFrame.unionByName, fitted), "fitted")
