"""Stream operators of your own with private state per series.

For bar closes and other thinned-out series whose logic no batch operator has. A
subclass says what it remembers and what it does with the next events, which
arrive in order. Look-back features, running totals and peaks need none of this:
see :mod:`tidemark.streaming.ticks`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeriesProcessor(StatefulProcessor):
    """Base of user-defined stream operators.

    output:   DDL of the result columns
    remember: DDL of the state kept per series (one row)
    """

    output: str
    remember: str

    def first_state(self) -> tuple:
        raise NotImplementedError

    def on_events(self, key: tuple, events: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame | None, tuple]:
        """Handle the next events of one series, in order; return results and the new state."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("memory", self.remember)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A series' rows in one micro-batch: bounded by the trigger's size.
        events = pd.concat(list(rows), ignore_index=True)
        order = [c for c in ("datetime", "id") if c in events.columns]
        events = events.sort_values(order, kind="stable", ignore_index=True)
        state = tuple(self._state.get()) if self._state.exists() else self.first_state()
        out, state = self.on_events(key, events, state)
        self._state.update(state)
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def apply(stream: DataFrame, processor: SeriesProcessor, keys: Sequence[str] = ("symbol",), mode: str = "append") -> DataFrame:
    """Run a processor over a stream, one state per key. Needs the RocksDB state store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode=mode, timeMode="None"
    )
