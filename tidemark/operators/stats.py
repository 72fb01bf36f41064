"""Correlations, counts and distributions. All are aggregations; none pairs up rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import ratio, safe_corr
from ..session import written
from .bars import ORDER, one_price
from .features import drop_null_rows, lag_names
from .ordered import Timeline, even_blocks, with_running


def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Pearson correlation of every two columns, long form: ``row, column, corr``.

    One aggregation over the rows without NULLs; each covariance is computed
    once and reported for both orders of its pair.
    """
    rows = drop_null_rows(df.select(*keys, *columns), columns)
    spread = {c: F.stddev_pop(c) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = rows.groupBy(*keys).agg(
        *[
            F.try_divide(F.covar_pop(a, b), spread[a] * spread[b]).alias(f"_c{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append((a, b, f"_c{i}"))
        if a != b:
            cells.append((b, a, f"_c{i}"))
    entries = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("column"), F.col(c).alias("corr")) for a, b, c in cells]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")


def autocorrelation_matrix(
    df: DataFrame, target: str = "close_log_return", lags: int = 3, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Correlation of a target with its own lag columns."""
    return correlation_matrix(df, [target, *lag_names(target, lags)], keys)


def pair_correlations(
    bars: DataFrame, pairs: Sequence[tuple[str, str]], value: str = "close", key: str = "symbol", time: str = "datetime"
) -> DataFrame:
    """Correlation of each requested pair of symbols over the bars both have.

    Each bar is sent once to every pair that asks for its symbol; two steps of
    grouping put the sides together, so symbols are never joined to symbols.
    """
    asked: dict[str, list[tuple[int, str]]] = {}
    for i, (a, b) in enumerate(pairs):
        asked.setdefault(a, []).append((i, "x"))
        asked.setdefault(b, []).append((i, "y"))
    roles = F.create_map(
        *[
            part
            for symbol, uses in asked.items()
            for part in (
                F.lit(symbol),
                F.array(*[F.struct(F.lit(i).alias("pair_no"), F.lit(s).alias("side")) for i, s in uses]),
            )
        ]
    )
    sent = bars.where(F.col(key).isin(*asked)).select(
        time, F.col(value).alias("_v"), F.explode(F.try_element_at(roles, F.col(key))).alias("_r")
    )
    met = sent.groupBy(F.col("_r.pair_no").alias("pair_no"), time).agg(
        F.max(F.when(F.col("_r.side") == "x", F.col("_v"))).alias("_x"),
        F.max(F.when(F.col("_r.side") == "y", F.col("_v"))).alias("_y"),
    )
    both = met.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    out = both.groupBy("pair_no").agg(safe_corr("_x", "_y").alias("corr"), F.count(F.lit(1)).alias("bars"))
    names = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in pairs])
    return out.withColumn("_n", F.get(names, F.col("pair_no"))).select(
        F.col("_n.x").alias("symbol_x"), F.col("_n.y").alias("symbol_y"), "corr", "bars"
    )


def compare_symbols(
    trades: DataFrame, x: str, y: str, every: str, value: str = "close", order: Sequence[str] = ORDER
) -> DataFrame:
    """Correlation of one price of two symbols, straight from trades; only that price is aggregated."""
    chosen = trades.where(F.col("symbol").isin(x, y))
    return pair_correlations(one_price(chosen, every, value, order=order), [(x, y)], value)


def value_counts(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """``n`` and ``share`` of each value, within the keys or overall."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n"))
    if not keys:
        total = counts.select(F.sum("n")).scalar()
        return counts.withColumn("share", ratio(F.col("n").cast("double"), total.cast("double")))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_all"))
    out = counts.join(totals, list(keys))
    return out.withColumn("share", ratio(F.col("n").cast("double"), F.col("_all").cast("double"))).drop("_all")


def span_and_count(df: DataFrame, keys: Sequence[str] = ("symbol",), time: str = "datetime") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def exact_quantiles(df: DataFrame, col: str, shares: dict[str, float], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Quantiles per group, ``{name: share}``, linear between neighbours.

    Equal values are counted first; the counts are then walked in blocks, so no
    group's values meet in one buffer.
    """
    keys = list(keys)
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).cast("double").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    rows, line = even_blocks(written(counts, "value-counts"), Timeline(tuple(keys), ("_p",)))
    walked = with_running(rows, line, sums={"_upto": "_n"}).join(rows.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
    out = {}
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_all") - 1)
        value = [
            F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("_p")))
            for rank in (F.floor(at) + 1, F.ceil(at) + 1)
        ]
        within = F.lit(share) * (F.max("_all") - 1)
        out[name] = value[0] + (value[1] - value[0]) * (within - F.floor(within))
    return walked.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])


def describe(df: DataFrame, col: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Count, mean, sum, median, population variance and deviation."""
    keys = list(keys)
    middle = exact_quantiles(df, col, {"median": 0.5}, keys)
    return _moments_of(df, col, keys).join(middle, keys, "left")


def _moments_of(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(col).alias("n"),
        F.avg(col).alias("mean"),
        F.sum(col).alias("total"),
        F.var_pop(col).alias("var_pop"),
        F.stddev_pop(col).alias("std_pop"),
    )


def _bounds(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """One row per group. Callers write it before joining it back to the rows, so
    that the join is planned on its real size: broadcast while small, and no
    shuffle of the rows."""
    return df.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))


def histogram(df: DataFrame, col: str, bins: int = 100, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Counts in ``bins`` equal bins between each group's minimum and maximum.

    ``bin`` runs from 0; the maximum belongs to the last bin. Empty bins are
    absent. The bounds are one row per group.
    """
    if bins < 1:
        raise ValueError("a histogram needs at least one bin")
    rows = df.where(F.col(col).isNotNull())
    out = rows.join(written(_bounds(rows, col, keys), "bounds"), list(keys))
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.coalesce(F.floor(ratio(F.col(col) - F.col("_lo"), width)), F.lit(0)).cast("int")
    placed = out.withColumn("bin", F.least(index, F.lit(bins - 1)))
    return (
        placed.groupBy(*keys, "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumns({"bin_start": F.col("_lo") + width * F.col("bin"), "bin_end": F.col("_lo") + width * (F.col("bin") + 1)})
        .drop("_lo", "_hi")
    )


def kde_bandwidth(df: DataFrame, col: str, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Normal-reference bandwidth ``1.06 * min(std, iqr / 1.34) * n^-0.2``, quartiles exact."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.count(col).alias("_n"), F.stddev_samp(col).alias("_s"))
    stats = stats.join(exact_quantiles(df, col, {"_q1": 0.25, "_q3": 0.75}, keys), keys)
    iqr = (F.col("_q3") - F.col("_q1")) / 1.34
    spread = F.when(iqr > 0, F.least(F.col("_s"), iqr)).otherwise(F.col("_s"))
    return stats.select(*keys, (F.lit(1.06) * spread * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("bandwidth"))


def kernel_density(
    df: DataFrame,
    col: str,
    points: int = 25,
    bandwidth: float | None = None,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Gaussian density estimate on an even grid between each group's minimum and maximum.

    One sum per grid point in a single aggregation, so rows are never multiplied
    by the grid. Result: keys, ``point_no``, ``x``, ``density``.
    """
    if points < 2:
        raise ValueError("the grid needs at least two points")
    rows = df.where(F.col(col).isNotNull()).select(*keys, col)
    scale = _bounds(rows, col, keys)
    if bandwidth is None:
        scale = scale.join(kde_bandwidth(rows, col, keys).withColumnRenamed("bandwidth", "_h"), list(keys))
    else:
        scale = scale.withColumn("_h", F.lit(float(bandwidth)))
    spaced = rows.join(written(scale, "bounds"), list(keys))

    def at(i: int) -> Column:
        return F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / (points - 1))

    def bump(i: int) -> Column:
        z = ratio(F.col(col) - at(i), "_h")
        return F.exp(z * z * -0.5)

    sums = spaced.groupBy(*keys, "_lo", "_hi", "_h").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(bump(i)).alias(f"_g{i}") for i in range(points)]
    )
    unit = F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("point_no"), at(i).alias("x"), ratio(F.col(f"_g{i}"), unit).alias("density"))
            for i in range(points)
        ]
    )
    return sums.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
