"""Interval strings (``15m``, ``12h``, ``1d``, ``1w``, ``1mo``, ``1y``) and what follows from them."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per unit.
UNIT_MICROS = {
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
    "w": 604_800_000_000,
}
CALENDAR_MONTHS = {"mo": 1, "q": 3, "y": 12}
MONDAY_OFFSET = 4 * UNIT_MICROS["d"]  # 1970-01-05 was a Monday

# Interval names as each exchange spells them.
OKX_INTERVALS = {
    "1m": "1m", "5m": "5m", "15m": "15m", "30m": "30m",
    "1h": "1H", "2h": "2H", "4h": "4H", "6h": "6H", "12h": "12H",
    "1d": "1D", "1w": "1W",
}
KRAKEN_MINUTES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440, "1w": 10080}
COINBASE_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}
EXCHANGE_INTERVALS = {"okx": OKX_INTERVALS, "kraken": KRAKEN_MINUTES, "coinbase": COINBASE_SECONDS}


def parse_interval(text: str) -> tuple[int, str]:
    """``'12h' -> (12, 'h')``. The whole string must match; anything else raises."""
    found = re.fullmatch(r"(\d+)(mo|q|y|w|d|h|m|s)", text.strip().lower())
    if not found or int(found.group(1)) == 0:
        raise ValueError(f"interval must look like '15m', '12h', '1d', '1w', '1mo', not {text!r}")
    return int(found.group(1)), found.group(2)


def interval_micros(text: str) -> int | None:
    """Length in microseconds, or None for calendar units of varying length."""
    n, unit = parse_interval(text)
    return n * UNIT_MICROS[unit] if unit in UNIT_MICROS else None


def bar_start(time: str | Column, every: str) -> Column:
    """Start of the left-closed bar ``[start, start + every)`` holding ``time``.

    Bars sit on round times; weeks begin on Monday; months, quarters and years
    follow the calendar.
    """
    col = F.col(time) if isinstance(time, str) else time
    n, unit = parse_interval(every)
    step = interval_micros(every)
    if step is not None:
        origin = MONDAY_OFFSET if unit == "w" else 0
        micros = F.unix_micros(col)
        return F.timestamp_micros(micros - F.pmod(micros - F.lit(origin), F.lit(step)))
    months = n * CALENDAR_MONTHS[unit]
    index = (F.year(col) * 12 + F.month(col) - 1).cast("int")
    first = (index - F.pmod(index, F.lit(months))).cast("int")
    return F.make_date(F.floor(first / 12).cast("int"), (F.pmod(first, F.lit(12)) + 1).cast("int"), F.lit(1)).cast(
        "timestamp"
    )


def period_end(start: str | Column, every: str) -> Column:
    """Last day of a month / quarter / year bar: the end label of a calendar resample."""
    col = F.col(start) if isinstance(start, str) else start
    n, unit = parse_interval(every)
    if unit not in CALENDAR_MONTHS:
        raise ValueError("end labels are for calendar intervals")
    return F.last_day(F.add_months(col, n * CALENDAR_MONTHS[unit] - 1))


def stream_window(time: str, every: str) -> Column:
    """The same grid as :func:`bar_start`, as ``window()`` for watermarked streams."""
    n, unit = parse_interval(every)
    if interval_micros(every) is None:
        raise ValueError("a streaming bar needs a fixed length")
    words = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}
    length = f"{n} {words[unit]}"
    return F.window(time, length, length, "4 days") if unit == "w" else F.window(time, length)


def sharpe_annualization_factor(interval: str, days_per_year: float = 365, hours_per_day: float = 24) -> float:
    """Square root of the number of trading periods in a year."""
    n, unit = parse_interval(interval)
    per_day = {"h": hours_per_day, "m": hours_per_day * 60, "s": hours_per_day * 3600}
    if unit in per_day:
        periods = days_per_year * per_day[unit] / n
    elif unit in ("d", "w"):
        periods = days_per_year / (n * (7 if unit == "w" else 1))
    else:
        periods = 12 / (n * CALENDAR_MONTHS[unit])
    return math.sqrt(periods)


def annualization_column(interval: str | Column, days_per_year: float = 365, hours_per_day: float = 24) -> Column:
    """Column form of :func:`sharpe_annualization_factor` for a table of intervals."""
    col = F.lower(F.col(interval) if isinstance(interval, str) else interval)
    n = F.regexp_extract(col, r"^(\d+)([wdhms])$", 1)
    unit = F.regexp_extract(col, r"^(\d+)([wdhms])$", 2)
    per_year = (
        F.when(unit == "w", F.lit(days_per_year / 7))
        .when(unit == "d", F.lit(float(days_per_year)))
        .when(unit == "h", F.lit(float(days_per_year * hours_per_day)))
        .when(unit == "m", F.lit(float(days_per_year * hours_per_day * 60)))
        .when(unit == "s", F.lit(float(days_per_year * hours_per_day * 3600)))
    )
    return F.sqrt(F.try_divide(per_year, n.try_cast("double")))


def exchange_interval(exchange: str, every: str) -> str | int:
    """An interval in the exchange's own spelling; an interval it does not offer raises."""
    table = EXCHANGE_INTERVALS[exchange.lower()]
    if every not in table:
        raise ValueError(f"{exchange} has no interval {every!r}")
    return table[every]
