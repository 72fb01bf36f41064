"""Ticker text: building, splitting, formatting and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import as_col


def price_column_name(symbol: str | Column) -> Column:
    return F.concat(as_col(symbol), F.lit("_price"))


def before(text: str | Column, mark: str) -> Column:
    """Everything before the first ``mark``."""
    return F.substring_index(as_col(text), mark, 1)


def after(text: str | Column, mark: str) -> Column:
    """Everything after the first ``mark``; NULL when there is none."""
    col = as_col(text)
    at = F.instr(col, mark)
    return F.when(at > 0, col.substr(at + F.lit(len(mark)), F.length(col)))


def parse_quote(text: str | Column) -> tuple[Column, Column]:
    """``'AAPL:262.82' -> ('AAPL', 262.82)``; a bad number gives NULL."""
    col = as_col(text)
    return (
        F.split_part(col, F.lit(":"), F.lit(1)).alias("symbol"),
        F.split_part(col, F.lit(":"), F.lit(2)).try_cast("double").alias("price"),
    )


def price_label(symbol: str | Column, price: str | Column) -> Column:
    return F.format_string("%s price is $%.2f", as_col(symbol), as_col(price))


def volume_label(symbol: str | Column, volume: str | Column) -> Column:
    return F.concat(as_col(symbol), F.lit(" volume: "), F.format_number(as_col(volume), 0))


def change_label(symbol: str | Column, change: str | Column) -> Column:
    return F.format_string("%s change: %.2f%%", as_col(symbol), as_col(change) * 100)


def position_value(quantity: str | Column, price: str | Column) -> Column:
    return as_col(quantity) * as_col(price)


def unrealized_pnl(quantity: str | Column, entry: str | Column, price: str | Column) -> Column:
    """Open profit of a signed quantity: positive when the price moved its way."""
    return as_col(quantity) * (as_col(price) - as_col(entry))
