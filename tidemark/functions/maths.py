"""Scalar expressions with the NULL and divide-by-zero rules used throughout.

Spark raises on ``1D/0D`` and on ``corr`` of a constant column in ANSI mode;
every ratio here goes through ``try_divide`` and gives NULL instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_value(value: float | str | Column) -> Column:
    """A number as a literal, a string as a column name, a Column as it is."""
    return F.lit(float(value)) if isinstance(value, (int, float)) else as_col(value)


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(as_col(a), as_col(b))


def log_ratio(now: str | Column, before: str | Column) -> Column:
    """``ln(now / before)``; NULL when either price is missing, zero or negative."""
    a, b = as_col(now), as_col(before)
    return F.when((a > 0) & (b > 0), F.ln(ratio(a, b)))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant column."""
    both = as_col(x).isNotNull() & as_col(y).isNotNull()
    a, b = F.when(both, as_col(x)), F.when(both, as_col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def sharpe(mean: Column, std: Column, factor: float | Column = 1.0) -> Column:
    """``mean / std * factor``, 0 unless the deviation is positive."""
    scale = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.when(std > 0, F.try_divide(mean, std) * scale).otherwise(F.lit(0.0))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def relu(x: str | Column) -> Column:
    return F.greatest(as_col(x), F.lit(0.0))


def softmax(xs: Sequence[str | Column]) -> list[Column]:
    """Softmax across columns, shifted by the row maximum so it cannot overflow."""
    cols = [as_col(x) for x in xs]
    top = F.greatest(*cols) if len(cols) > 1 else cols[0]
    powers = [F.exp(c - top) for c in cols]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def dot(columns: Sequence[str | Column], weights: Sequence[float], bias: float = 0.0) -> Column:
    """``sum(w * x) + b`` as one expression (stays inside generated code)."""
    terms = [as_col(c) * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)]
    return sum(terms[1:], terms[0]) + F.lit(float(bias))


def direction(x: str | Column) -> Column:
    """Sign of a prediction: +1 long, -1 short, 0 flat."""
    return F.signum(as_col(x))


def no_nulls(columns: Sequence[str]) -> Column:
    """Row filter: no NULL in any column. NaN is a value and stays."""
    test = F.lit(True)
    for name in columns:
        test = test & F.col(name).isNotNull()
    return test
