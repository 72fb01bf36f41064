"""Fitting linear models for every series, feature subset and fold at once.

A linear model needs only sums of products of its columns. One aggregation
gives those sums (*moments*) for a whole pool of features, per group; the
small system of each model is then solved from its group's single row. Losses
other than squared error repeat that aggregation with row weights that follow
from the last fit. Models are tables: ``weights`` (one per feature of the pool,
0 where unused) and ``bias``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.maths import as_col, no_nulls
from ..session import written
from .robust import fit_robust

# What an own loss asks of a fit: (prediction, target, scale, step) -> (row weight,
# working target). ``scale`` is the residual RMS of the squared-error start.
Weighting = Callable[[Column, Column, Column, int], tuple[Column, Column]]

#: Named losses that are minimised step by step.
LOSSES = ("huber", "l1", "logistic")


@dataclass(frozen=True)
class Folds:
    """Several training sets in one group: fold ``labels[k]`` trains on the rows whose ``segment`` is below ``cuts[k]``.
    The coefficient table has the label as column ``name``."""

    name: str
    segment: str
    labels: Sequence
    cuts: Sequence[int]


def feature_subsets(pool: Sequence[str], largest: int) -> list[tuple[str, ...]]:
    """Every subset of 1..largest features, in the pool's order."""
    return [s for k in range(1, largest + 1) for s in combinations(pool, k)]


def moment_names(p: int) -> list[str]:
    return [f"m{i}" for i in range((p + 2) * (p + 3) // 2)]


def moments(
    df: DataFrame,
    features: Sequence[str],
    target: str | Column,
    by: Sequence[str],
    weight: Column | None = None,
) -> DataFrame:
    """Weighted sums of products of ``1, x1..xp, y`` over complete rows, one row per group."""
    scale = weight if weight is not None else F.lit(1.0)
    rows = df.select(
        *by, *[F.col(f).cast("double").alias(f"_z{i}") for i, f in enumerate(features, 1)],
        as_col(target).cast("double").alias("_zy"), scale.cast("double").alias("_wt"),
    )
    rows = rows.where(no_nulls([c for c in rows.columns if c.startswith("_z")]))
    terms = ["1.0D", *[f"_z{i}" for i in range(1, len(features) + 1)], "_zy"]
    products = [f"sum(_wt * {a} * {b})" for a, b in combinations_with_replacement(terms, 2)]
    names = moment_names(len(features))
    return rows.groupBy(*by).agg(*[F.expr(e).alias(n) for e, n in zip(products, names, strict=True)])


def cumulative_moments(table: DataFrame, p: int, keys: Sequence[str], along: str) -> DataFrame:
    """Moments of each block and all blocks before it (expanding training sets)."""
    w = Window.partitionBy(*keys).orderBy(along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table.withColumns({n: F.sum(n).over(w) for n in moment_names(p)})


def _unpack(table: np.ndarray, size: int) -> np.ndarray:
    """Rows of upper-triangle sums -> stack of symmetric matrices."""
    out = np.zeros((len(table), size, size))
    upper = np.triu_indices(size)
    out[:, upper[0], upper[1]] = table
    out[:, upper[1], upper[0]] = table
    return out


def _least_squares(full: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, bias and residual RMS for the chosen columns, for a stack of moment matrices."""
    n = full[:, 0, 0]
    mean = full[:, 0, :] / n[:, None]
    centred = full - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    cols = np.array(chosen)
    # in correlation form: features of very unlike size are equally well determined
    size = np.sqrt(np.maximum(centred[:, cols, cols], 0.0))
    size = np.where(size > 1e-12 * np.sqrt(full[:, cols, cols]), size, np.inf)  # constant columns get no weight
    xx = centred[:, cols[:, None], cols[None, :]] / size[:, :, None] / size[:, None, :]
    xy = centred[:, cols, -1] / size
    weights = np.einsum("bij,bj->bi", np.linalg.pinv(xx, rcond=1e-12, hermitian=True), xy) / size
    left = np.maximum(centred[:, -1, -1] - np.einsum("bi,bi->b", weights, centred[:, cols, -1]), 0.0)
    return weights, mean[:, -1] - np.einsum("bi,bi->b", weights, mean[:, cols]), np.sqrt(left / n)


def solve(
    table: DataFrame,
    features: Sequence[str],
    subsets: Sequence[Sequence[str]],
    by: Sequence[str],
    own_model: bool = False,
) -> DataFrame:
    """Coefficient table from a moment table.

    Gives ``by, model_id, features, weights, bias, n_train, rms`` (total weight
    and residual deviation): one row per group and subset, or, with ``own_model``, per group for the subset its
    ``model_id`` names.
    """
    p = len(features)
    places = [[features.index(f) + 1 for f in s] for s in subsets]
    labels = [",".join(s) for s in subsets]
    keys = [c for c in by if c != "model_id"]
    names = moment_names(p)
    schema = T.StructType(
        [table.schema[k] for k in keys]
        + [
            T.StructField("model_id", T.IntegerType()),
            T.StructField("features", T.StringType()),
            T.StructField("weights", T.ArrayType(T.DoubleType())),
            T.StructField("bias", T.DoubleType()),
            T.StructField("n_train", T.DoubleType()),
            T.StructField("rms", T.DoubleType()),
        ]
    )

    def fit(rows: pd.DataFrame, model: int) -> pd.DataFrame:
        full = _unpack(rows[names].to_numpy(dtype=float), p + 2)
        part, bias, rms = _least_squares(full, places[model])
        weights = np.zeros((len(rows), p))
        weights[:, [c - 1 for c in places[model]]] = part
        return rows[keys].assign(
            model_id=np.int32(model), features=labels[model], weights=list(weights), bias=bias,
            n_train=full[:, 0, 0], rms=rms,
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["m0"] > 0]
            for model in range(len(places)):
                rows = batch[batch["model_id"] == model] if own_model else batch
                if len(rows):
                    yield fit(rows, model)

    kept = [*keys, "model_id"] if own_model else keys
    return table.select(*kept, *names).mapInPandas(run, schema)


def linear_prediction(features: Sequence[str], weights: str = "weights", bias: str = "bias") -> Column:
    """``sum(w * x) + b`` from coefficient columns, inside generated code."""
    terms = [F.col(f) * F.get(F.col(weights), F.lit(i)) for i, f in enumerate(features)]
    return sum(terms[1:], terms[0]) + F.col(bias)


def score(df: DataFrame, coefficients: DataFrame, features: Sequence[str], by: Sequence[str], name: str = "y_hat") -> DataFrame:
    """Attach each group's models to its rows (one copy per model) and predict.

    The coefficient table has one row per group and model. No hint is given:
    read from a written table its real size is known, so Spark broadcasts it
    while it is small and otherwise joins by shuffle, splitting a hot group's
    rows.
    """
    models = coefficients.select(*by, "model_id", "features", "weights", "bias")
    return df.join(models, list(by)).withColumn(name, linear_prediction(features))


def fit_linear(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    by: Sequence[str] = ("symbol",),
    subsets: Sequence[Sequence[str]] | None = None,
    loss: str | Weighting = "mse",
    iterations: int | None = None,
    tolerance: float = 1e-6,
    folds: Folds | None = None,
) -> DataFrame:
    """Fit every subset for every group (and fold). ``loss``: mse, huber, l1, logistic, or a weighting rule.

    ``mse`` is one aggregation and stays lazy. The named others start from it and go on to the optimum; they add
    ``steps``, ``optimality`` (what is left of the condition for one) and ``converged``, which is false where there
    is none, as for classes that a line separates. A weighting rule of your own is refitted until no coefficient
    moves by more than ``tolerance`` or ``iterations`` (25 by default) are reached; ``steps``, ``optimality`` (the
    last move) and ``converged`` tell which.
    """
    subsets = [tuple(s) for s in (subsets or [tuple(features)])]
    by, features = list(by), list(features)
    if loss == "mse" and folds is None:
        return solve(moments(df, features, target, by), features, subsets, by)
    if isinstance(loss, str) and loss not in LOSSES:
        raise ValueError(f"loss must be {', '.join(LOSSES)}, a rule or (without folds) mse, not {loss!r}")
    segment = [F.col(folds.segment).cast("long").alias("_segment")] if folds else []
    rows = df.select(*by, *features, F.col(target).cast("double").alias("_target"), *segment)
    rows = written(rows.where(no_nulls([*features, "_target"])), "fit-rows")
    if isinstance(loss, str):
        fitted = fit_robust(rows, features, by, subsets, loss, folds.cuts if folds else None)
    else:
        if folds:
            into = [F.when(F.col("_segment") < c, F.lit(k)) for k, c in enumerate(folds.cuts)]
            rows = rows.withColumn("_fold", F.explode(F.array_compact(F.array(*into))))
        own = [*by, *(["_fold"] if folds else [])]
        fitted = _reweighted(rows, features, own, subsets, loss, iterations or 25, tolerance)
    names = F.array(*[F.lit(",".join(s)) for s in subsets])
    label = [F.get(F.array(*[F.lit(v) for v in folds.labels]), F.col("_fold")).alias(folds.name)] if folds else []
    figures = ["weights", "bias", "n_train", "rms", "steps", "optimality", "converged"]
    return fitted.select(*by, *label, "model_id", F.get(names, F.col("model_id")).alias("features"), *figures)


def _reweighted(
    rows: DataFrame, features: list[str], by: list[str], subsets: Sequence[Sequence[str]], rule: Weighting, limit: int, tolerance: float
) -> DataFrame:
    """Refits with the row weights of an own rule. The fits use all rows; only coefficients pass between steps."""
    fitted = solve(moments(rows, features, "_target", by), features, subsets, by)
    new = {"steps": F.lit(0), "optimality": F.lit(float("inf")), "converged": F.lit(False)}
    fitted = written(fitted.withColumns(new), "fit-step")
    keys = [*by, "model_id"]
    result = fitted.columns
    for step in range(limit):
        before = fitted.select(*keys, F.col("weights").alias("_w"), F.col("bias").alias("_b"), F.col("rms").alias("_scale"))
        models = fitted.select(*keys, "features", "weights", "bias", F.col("rms").alias("_scale"))
        scored = rows.join(models, by).withColumn("_eta", linear_prediction(features))
        weight, response = rule(F.col("_eta"), F.col("_target"), F.col("_scale"), step)
        sums = moments(scored, features, response, keys, weight)
        found = solve(sums, features, subsets, keys, own_model=True).join(before, keys)
        moves = F.transform(F.zip_with("weights", "_w", lambda new, old: new - old), F.abs)
        found = found.withColumns({
            "rms": F.col("_scale"), "steps": F.lit(step + 1),
            "optimality": F.greatest(F.abs(F.col("bias") - F.col("_b")), F.array_max(moves)),
        })
        fitted = written(found.withColumn("converged", F.col("optimality") <= tolerance).select(*result), "fit-step")
        if not fitted.where("NOT converged").limit(1).count():
            break
    return fitted


def mean_loss(df: DataFrame, coefficients: DataFrame, features: Sequence[str], target: str, by: Sequence[str], loss: str) -> DataFrame:
    """Average loss of each model over the given rows."""
    off = F.abs(F.col(target) - F.col("_eta"))
    values = {
        "mse": off * off,
        "l1": off,
        "huber": F.when(off <= 1, off * off / 2).otherwise(off - 0.5),
        "logistic": F.log1p(F.exp(-F.abs("_eta"))) + F.greatest(F.col("_eta"), F.lit(0.0)) - F.col(target) * F.col("_eta"),
    }
    scored = score(df.where(no_nulls([*features, target])), coefficients, features, by, "_eta")
    return scored.groupBy(*by, "model_id").agg(F.avg(values[loss]).alias("loss"))


def coefficient_rows(coefficients: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The table in long form: one row per feature a model uses, with its weight."""
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), F.get("weights", F.lit(i)).alias("weight"))
            for i, f in enumerate(features)
        ]
    )
    used = F.array_contains(F.split("features", ","), F.col("_c.feature"))
    out = coefficients.select(*by, "model_id", "features", "bias", F.explode(cells).alias("_c")).where(used)
    return out.select(*by, "model_id", "_c.feature", "_c.weight", "bias")
