"""Orders, fills, positions and balances as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import as_col, as_value, direction
from .ordered import Timeline, with_lags, with_recurrence, with_running

# Money is decimal. Products of two (18,8) values fit 38 digits exactly.
QTY = "decimal(18,8)"
ACCOUNT_LINE = Timeline(("account", "symbol"), ("datetime", "seq"))


def compound_order_size(
    y_hat: str | Column, equity: str | Column, price: str | Column, scale: float | str | Column = 1.0
) -> Column:
    """Signed quantity that puts the whole equity (times ``scale``) behind a prediction."""
    return direction(y_hat) * F.try_divide(as_col(equity), as_col(price)) * as_value(scale)


def order_pairs(targets: DataFrame, qty: str = "signed_trade_qty", price: str = "open", line: Timeline | None = None) -> DataFrame:
    """Close the old position, then open the new one, at each row of a target-quantity series.

    Result: the series keys, ``datetime``, ``seq`` (0 close, 1 open),
    ``signed_qty`` and ``price``. Orders of zero quantity do not exist.
    """
    line = line or Timeline(("account", "symbol"))
    out = targets.select(*line.keys, *line.order, F.col(qty).cast(QTY).alias("_new"), F.col(price).cast(QTY).alias("price"))
    out = with_lags(out, line, {"_old": ("_new", 1)})
    both = F.array(
        F.struct(F.lit(0).alias("seq"), (-F.col("_old")).cast(QTY).alias("signed_qty")),
        F.struct(F.lit(1).alias("seq"), F.col("_new").alias("signed_qty")),
    )
    out = out.select(*line.keys, *line.order, "price", F.explode(both).alias("_o"))
    return out.select(*line.keys, *line.order, "_o.seq", "_o.signed_qty", "price").where(F.col("signed_qty") != 0)


def fills(orders: DataFrame, opening_balance: float | str | Column = 0.0, line: Timeline = ACCOUNT_LINE) -> DataFrame:
    """Every order filled at its price, netted into a position.

    Adds ``position`` (quantity held after the fill), ``pnl`` and ``balance``.
    The position is held at its average cost: an order that adds to it raises
    the cost by its own, one that closes a part of it takes the same share of
    the cost away and books the difference to what it earned. A full close books
    what the round trip earned; an order that turns a position around closes it
    first and opens the rest at its price. ``balance`` is the opening balance
    plus everything booked so far. Full closes and turns are exact decimals, the
    cost left after a partial close is rounded to ten decimals.
    """
    cash = -(F.col("signed_qty") * F.col("price"))
    out = with_running(orders, line, sums={"position": "signed_qty", "_cash": cash})
    held = F.col("position") - F.col("signed_qty")
    turned = F.signum(held) * F.signum("position") < 0
    reduced = (F.col("position") != 0) & ~turned & (F.signum(held) * F.signum("signed_qty") < 0)
    # the cost of what is held: a sum while it grows, a share while it shrinks, anew when it turns
    share = F.col("position").cast("double") / held.cast("double")
    factor = F.when((F.col("position") == 0) | turned, 0.0).when(reduced, share).otherwise(1.0)
    spent = F.when(turned, F.col("position")).when((F.col("position") == 0) | reduced, F.lit(0)).otherwise(F.col("signed_qty"))
    out = with_recurrence(out, line, "_cost", factor, spent.cast("double") * F.col("price").cast("double"))
    # what the open rest of a turned position cost is no profit or loss yet
    booked = F.when(F.col("position") == 0, F.col("_cash")).when(
        turned, (F.col("_cash") + F.col("position") * F.col("price")).cast("decimal(38,16)")
    ).when(reduced, (F.col("_cash") + F.round("_cost", 10).cast("decimal(28,10)")).cast("decimal(38,16)"))
    out = with_running(out, line, latest={"_booked": booked})
    out = out.withColumn("_booked", F.coalesce("_booked", F.lit(0).cast("decimal(38,16)")))
    out = with_lags(out, line, {"_earlier": ("_booked", 1)})
    out = out.withColumn("pnl", F.col("_booked") - F.coalesce("_earlier", F.lit(0).cast("decimal(38,16)")))
    opening = as_value(opening_balance).cast("decimal(38,16)")
    return out.withColumn("balance", opening + F.col("_booked")).drop("_cash", "_cost", "_booked", "_earlier")


def account_summary(filled: DataFrame, opening_balance: float = 0.0) -> DataFrame:
    """Per account: number of fills, total booked profit and closing balance over all symbols."""
    sums = filled.groupBy("account").agg(F.count(F.lit(1)).alias("fills"), F.sum("pnl").alias("pnl"))
    return sums.withColumn("balance", F.lit(opening_balance).cast("decimal(38,16)") + F.col("pnl"))


def open_positions(filled: DataFrame, line: Timeline = ACCOUNT_LINE) -> DataFrame:
    """What each account still holds of each symbol after its last fill."""
    held = filled.groupBy(*line.keys).agg(F.sum("signed_qty").alias("signed_qty"))
    return held.where(F.col("signed_qty") != 0)
