"""Tick features of a live stream: log return, lag vector, fixed window, score.

Each micro-batch is joined to a small memory of every series - its last few
rows - and then goes through the same blocked operators as batch data. A symbol
with a third of the ticks is spread over tasks by time block; no Python runs per
tick. The memory is a table per batch, so a retried batch starts from the same
memory and writes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.maths import dot, log_ratio
from ..operators.features import lag_names
from ..operators.ordered import TICKS, Timeline, with_lags, with_running
from ..session import remove_table, scratch_path
from .run import run_to_table, table_path

# A batch step: rows of the batch preceded by remembered rows -> result rows.
Step = Callable[[DataFrame], DataFrame]


def lag_vector(ticks: DataFrame, lags: int, price: str = "price", line: Timeline = TICKS) -> DataFrame:
    """``log_return_lag_1..n`` as seen *after* each tick, newest first.

    ``log_return_lag_1`` is the tick's own log return: these are the features
    for what comes next. Rows with fewer than n + 1 prices have NULLs.
    """
    back = {f"_p{i}": (price, i) for i in range(1, lags + 1)}
    out = with_lags(ticks, line, back)
    prices = [price, *back]
    made = {n: log_ratio(prices[i], prices[i + 1]) for i, n in enumerate(lag_names("log_return", lags))}
    return out.withColumns(made).drop(*back)


def newest(rows: DataFrame, depth: int, line: Timeline) -> DataFrame:
    """The last ``depth`` rows of each series. The rank filter runs before the
    shuffle, so each task sends at most ``depth`` rows per series."""
    w = Window.partitionBy(*line.keys).orderBy(*line.sort_columns(reverse=True))
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= depth).drop("_rank")


class RememberedStream:
    """A ``foreachBatch`` step with a memory of the last ``depth`` rows per series.

    The memory of batch N is written as ``memory/batch_id=N``; batch N reads the
    newest memory before it. Results go to ``result/batch_id=N``.
    """

    def __init__(self, spark: SparkSession, depth: int, step: Step, line: Timeline = TICKS, path: str | None = None):
        self.depth, self.step, self.line = depth, step, line
        self.path = path or scratch_path(spark, "remembered-stream")

    @property
    def result(self) -> str:
        return f"{self.path}/result"

    def _memory(self, spark: SparkSession, batch_id: int, schema) -> DataFrame | None:
        if batch_id == 0:
            return None
        # Batch ids are consecutive, so the memory before batch N is that of N - 1.
        return spark.read.schema(schema).parquet(f"{self.path}/memory/batch_id={batch_id - 1}")

    def _finished(self, out: DataFrame, batch_id: int) -> DataFrame:
        """What is written of the batch's own rows."""
        return out

    def _written(self, out: DataFrame, batch_id: int) -> None:
        """Called with the batch's written rows."""

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_old", F.lit(False))
        memory = self._memory(spark, batch_id, batch.schema)
        if memory is not None:
            rows = rows.unionByName(memory.withColumn("_old", F.lit(True)))
        out = self._finished(self.step(rows).where(~F.col("_old")).drop("_old"), batch_id)
        out.write.mode("overwrite").parquet(f"{self.result}/batch_id={batch_id}")
        written = spark.read.schema(out.schema).parquet(f"{self.result}/batch_id={batch_id}")
        self._written(written, batch_id)
        new = batch
        if set(batch.columns) <= set(out.columns):  # what was written has the rows: the batch is not computed again
            new = written.select(batch.columns)
        keep = newest(new if memory is None else new.unionByName(memory), self.depth, self.line)
        keep.write.mode("overwrite").parquet(f"{self.path}/memory/batch_id={batch_id}")
        remove_table(spark, f"{self.path}/memory/batch_id={batch_id - 2}")  # no retry goes back that far


class RunningStream(RememberedStream):
    """A step with running totals and peaks that go on from batch to batch.

    ``sums`` and ``peaks`` are as in :func:`with_running`, over columns of the step's result. Within a batch they
    run like batch data; a second memory holds one row per series, its totals and peaks so far
    (``totals/batch_id=N``). A retried batch starts from the same totals. The step keeps the batch's rows: a row
    without a value has a NULL one.
    """

    def __init__(
        self, spark: SparkSession, depth: int, step: Step, sums: Mapping[str, str | Column], peaks: Mapping[str, str] | None = None,
        line: Timeline = TICKS, path: str | None = None,
    ):
        super().__init__(spark, depth, step, line, path)
        self.sums, self.peaks = dict(sums), dict(peaks or {})

    def _totals(self, spark: SparkSession, batch_id: int, out: DataFrame) -> DataFrame | None:
        if batch_id == 0:
            return None
        schema = out.select(*self.line.keys, *self.sums, *self.peaks).schema
        return spark.read.schema(schema).parquet(f"{self.path}/totals/batch_id={batch_id - 1}")

    def _finished(self, out: DataFrame, batch_id: int) -> DataFrame:
        out = with_running(out, self.line, self.sums, self.peaks)
        before = self._totals(out.sparkSession, batch_id, out)
        if before is None:
            return out
        names = [*self.sums, *self.peaks]
        before = before.select(*self.line.keys, *[F.col(n).alias(f"_{n}") for n in names])
        base = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in self.sums}
        later = {n: F.when(F.col(f"_{n}").isNull(), F.col(n)).otherwise(base[n] + F.coalesce(F.col(n), F.lit(0))) for n in self.sums}
        later |= {n: F.greatest(f"_{n}", base[of] + F.col(n)) for n, of in self.peaks.items()}
        kept = [later[c].cast(out.schema[c].dataType).alias(c) if c in later else F.col(c) for c in out.columns]
        return out.join(before, list(self.line.keys), "left").select(*kept)

    def _written(self, out: DataFrame, batch_id: int) -> None:
        last = [F.max_by(n, F.when(F.col(n).isNotNull(), self.line.rank())).alias(n) for n in self.sums]
        new = out.groupBy(*self.line.keys).agg(*last, *[F.max(n).alias(n) for n in self.peaks])
        before = self._totals(out.sparkSession, batch_id, out)
        if before is not None:
            new = new.unionByName(before.join(new.select(*self.line.keys), list(self.line.keys), "left_anti"))
        new.write.mode("overwrite").parquet(f"{self.path}/totals/batch_id={batch_id}")
        remove_table(out.sparkSession, f"{self.path}/totals/batch_id={batch_id - 2}")


def run_lag_stream(
    ticks: DataFrame, lags: int = 3, weights: Sequence[float] | None = None, bias: float = 0.0,
    line: Timeline = TICKS, checkpoint: str | None = None, path: str | None = None,
) -> DataFrame:
    """Lag vectors of a tick stream; with ``weights`` also ``y_hat`` and ``dir_signal``."""
    spark = ticks.sparkSession
    names = lag_names("log_return", lags)

    def step(rows: DataFrame) -> DataFrame:
        out = lag_vector(rows, lags, line=line)
        if weights is not None:
            out = out.withColumn("y_hat", dot(names, weights, bias))
            out = out.withColumn("dir_signal", F.signum("y_hat"))
        return out

    stream = RememberedStream(spark, lags, step, line, path or table_path(spark, checkpoint, "remembered-stream"))
    run_to_table(ticks, writer=stream, checkpoint=checkpoint)
    return spark.read.parquet(stream.result)


def run_step_stream(
    ticks: DataFrame, depth: int, step: Step, line: Timeline = TICKS, checkpoint: str | None = None, path: str | None = None,
) -> DataFrame:
    """Any batch operator that looks back at most ``depth`` rows, on a stream."""
    path = path or table_path(ticks.sparkSession, checkpoint, "remembered-stream")
    stream = RememberedStream(ticks.sparkSession, depth, step, line, path)
    run_to_table(ticks, writer=stream, checkpoint=checkpoint)
    return ticks.sparkSession.read.parquet(stream.result)



def run_running_stream(
    ticks: DataFrame, depth: int, step: Step, sums: Mapping[str, str | Column], peaks: Mapping[str, str] | None = None,
    line: Timeline = TICKS, checkpoint: str | None = None, path: str | None = None,
) -> DataFrame:
    """A batch operator that looks back at most ``depth`` rows, and running totals and peaks of what it gives."""
    path = path or table_path(ticks.sparkSession, checkpoint, "running-stream")
    stream = RunningStream(ticks.sparkSession, depth, step, sums, peaks, line, path)
    run_to_table(ticks, writer=stream, checkpoint=checkpoint)
    return ticks.sparkSession.read.parquet(stream.result)
