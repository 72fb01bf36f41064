from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    return session("tests", "local[4]", partitions=4)


@pytest.fixture()
def series(spark):
    """Bars of one or more symbols, an hour apart, from lists of prices."""

    def make(column: str = "close", **prices):
        start = dt.datetime(2024, 1, 1)
        rows = [
            (symbol, start + dt.timedelta(hours=i), None if p is None else float(p))
            for symbol, values in prices.items()
            for i, p in enumerate(values)
        ]
        return spark.createDataFrame(rows, f"symbol string, datetime timestamp, {column} double").repartition(3)

    return make


def column(df, name, order="datetime"):
    return [r[name] for r in df.orderBy("symbol", order).collect()]
