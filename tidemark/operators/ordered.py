"""Ordered operators: lags, running totals and row positions of a series.

A :class:`Timeline` says which columns name a series and which columns order it.
Two ways of running the same operators follow from it:

* **plain** - one window per series. Right for bars, whose number per series is
  bounded by calendar span / bar length, however many trades there are.
* **blocked** - for ticks, where one symbol may hold a third of all rows. Each
  series is cut into blocks along its order; windows run inside a block, and
  what a block needs from earlier ones (a total, a maximum, a few last rows) is
  carried over through a table with one row per block. No task sees a whole
  series, and the rows are shuffled once, on ``(series, block)``, and written
  as they lie then (:func:`with_scan`).

Both give the same answer (up to floating-point rounding of sums).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.intervals import bar_start, interval_micros
from ..functions.maths import as_col
from ..session import written

BLOCK = "_block"
# Longest series one plain window should get: bars per series in a decade.
PLAIN_ROWS = 8_000_000
DECADE_MICROS = 3_653 * 86_400_000_000


@dataclass(frozen=True)
class Timeline:
    """How rows form ordered series.

    keys:  columns naming a series
    order: columns ordering it, together unique per series; ``-name`` descends
    block: None (plain), an interval such as ``"1d"`` cut along ``order[0]``, or
           the name of a column that never decreases along the order
    """

    keys: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("datetime",)
    block: str | None = None
    block_column: str | None = None

    @staticmethod
    def of_bars(every: str, keys: Sequence[str] = ("symbol",)) -> Timeline:
        """Series of bars: plain while a decade of bars fits one window, else blocked."""
        step = interval_micros(every)
        if step is None or DECADE_MICROS // step <= PLAIN_ROWS:
            return Timeline(tuple(keys))
        return Timeline(tuple(keys), block=f"{step}s")  # a million bars: 1e6 * step microseconds

    @staticmethod
    def of_ticks(block: str = "1h", keys: Sequence[str] = ("symbol",)) -> Timeline:
        return Timeline(tuple(keys), ("datetime", "id"), block)

    def by(self, *more: str) -> Timeline:
        """The same order within finer series (one per model, fold, ...)."""
        return replace(self, keys=self.keys + tuple(more))

    @property
    def blocked(self) -> bool:
        return self.block is not None or self.block_column is not None

    def order_names(self) -> list[str]:
        return [o.removeprefix("-") for o in self.order]

    def sort_columns(self, reverse: bool = False) -> list[Column]:
        down = [o.startswith("-") != reverse for o in self.order]
        return [F.col(o).desc() if d else F.col(o).asc() for o, d in zip(self.order_names(), down, strict=True)]

    def rank(self) -> Column:
        """The order as one comparable value (ascending orders only)."""
        if any(o.startswith("-") for o in self.order):
            raise ValueError("a descending order has no rank")
        return F.col(self.order[0]) if len(self.order) == 1 else F.struct(*self.order)

    @property
    def block_name(self) -> str:
        return self.block_column or BLOCK

    def block_keys(self) -> list[str]:
        return [*self.keys, self.block_name]

    def columns(self) -> list[str]:
        """Every column the line needs."""
        return [*self.keys, *self.order_names(), *([self.block_column] if self.block_column else [])]

    def window(self, *, blocked: bool = False, reverse: bool = False):
        keys = self.block_keys() if blocked else list(self.keys)
        return Window.partitionBy(*keys).orderBy(*self.sort_columns(reverse))

    def with_block(self, df: DataFrame) -> DataFrame:
        if self.block_column is not None:
            return df
        return df.withColumn(BLOCK, F.unix_micros(bar_start(self.order[0], self.block)))

    def without_block(self, df: DataFrame) -> DataFrame:
        """Drop the block column again, unless the rows came with it."""
        return df if self.block_column else df.drop(BLOCK)

    def carry_window(self):
        """Over the one-row-per-block table: everything before this block."""
        return Window.partitionBy(*self.keys).orderBy(self.block_name).rowsBetween(Window.unboundedPreceding, -1)


BARS = Timeline()
TICKS = Timeline.of_ticks()


def with_scan(
    df: DataFrame,
    line: Timeline,
    lags: Mapping[str, tuple[str | Column, int]] | None = None,
    sums: Mapping[str, str | Column] | None = None,
    peaks: Mapping[str, str] | None = None,
    maxima: Mapping[str, str | Column] | None = None,
    latest: Mapping[str, str | Column] | None = None,
    index: str | None = None,
    count: str | None = None,
) -> DataFrame:
    """Add lags, running aggregates and positions in one pass over the series.

    lags:   new column -> (value, steps); the value that many rows back, NULL at the head
    sums:   new column -> value to add up, from the series' first row to the current one
    peaks:  new column -> name of one of ``sums``; its highest value so far
    maxima: new column -> value whose highest so far is wanted
    latest: new column -> value whose most recent non-NULL is wanted
    index:  the row's place in its series (from 0); count: the rows of the series

    Under blocks the rows are shuffled once, on ``(series, block)``. All windows of a block run there, and the
    rows are written with what they found; the last rows of each block, read back from that table, say what its
    later blocks carry. The carry has one row per block and is a written table too, so that it is broadcast while
    it is small.
    """
    lags, sums, peaks = dict(lags or {}), dict(sums or {}), dict(peaks or {})
    maxima, latest = dict(maxima or {}), dict(latest or {})
    if not (lags or sums or maxima or latest or index or count):
        return df
    if not line.blocked:
        w = line.window()
        run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = {name: F.lag(as_col(value), n).over(w) for name, (value, n) in lags.items()}
        added |= {n: F.sum(as_col(v)).over(run) for n, v in sums.items()}
        added |= {n: F.max(as_col(v)).over(run) for n, v in maxima.items()}
        added |= {n: F.last(as_col(v), ignorenulls=True).over(run) for n, v in latest.items()}
        added |= {index: F.row_number().over(w).cast("long") - 1} if index else {}
        added |= {count: F.count(F.lit(1)).over(Window.partitionBy(*line.keys))} if count else {}
        out = df.withColumns(added)
        return out.withColumns({n: F.max(of).over(run) for n, of in peaks.items()}) if peaks else out

    keys = line.block_keys()
    w = line.window(blocked=True)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    depth = max((n for _, n in lags.values()), default=0)
    # Each distinct value is carried once, however many lags it has.
    seen: dict[object, str] = {}
    values: dict[str, Column] = {}
    source = {}
    for name, (value, _) in lags.items():
        token = value if isinstance(value, str) else id(value)
        if token not in seen:
            seen[token] = f"_v{len(seen)}"
            values[seen[token]] = as_col(value)
        source[name] = seen[token]
    local = line.with_block(df)
    given = local.columns
    taken = {f"_s{n}": as_col(v) for n, v in sums.items()} | {f"_m{n}": as_col(v) for n, v in maxima.items()}
    taken |= {f"_k{n}": as_col(v) for n, v in latest.items()}
    local = local.withColumns(values | taken)
    within = {f"_l{i}": F.lag(source[name], n).over(w) for i, (name, (_, n)) in enumerate(lags.items())}
    within |= {f"_r{n}": F.sum(f"_s{n}").over(run) for n in sums} | {f"_q{n}": F.max(f"_m{n}").over(run) for n in maxima}
    within |= {f"_w{n}": F.last(f"_k{n}", ignorenulls=True).over(run) for n in latest}
    within |= {"_scan_no": F.row_number().over(w).cast("long"), "_scan_rows": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
    scanned = local.withColumns(within)
    tops = {f"_p{n}": F.max(f"_r{of}").over(run) for n, of in peaks.items()}
    scanned = scanned.withColumns(tops) if tops else scanned
    laid = written(scanned.select(*given, *values, *within, *tops), "scan")

    left = F.col("_scan_rows") - F.col("_scan_no")
    ends = [f"_r{n}" for n in sums] + [f"_p{n}" for n in peaks] + [f"_q{n}" for n in maxima] + [f"_w{n}" for n in latest] + ["_scan_rows"]
    kept = [F.max(F.when(left == 0, F.col(f"`{c}`"))).alias(c) for c in ends]
    if lags:
        kept.append(F.array_sort(F.collect_list(F.struct("_scan_no", *values))).alias("_scan_tail"))
    blocks = laid.where(left < max(depth, 1)).groupBy(*keys).agg(*kept)
    earlier = line.carry_window()
    carry = blocks.withColumns(
        {f"_b{n}": F.coalesce(F.sum(f"_r{n}").over(earlier), F.lit(0)) for n in sums}
        | {f"_c{n}": F.max(f"_q{n}").over(earlier) for n in maxima}
        | {f"_e{n}": F.last(f"_w{n}", ignorenulls=True).over(earlier) for n in latest}
        | {"_scan_before": F.coalesce(F.sum("_scan_rows").over(earlier), F.lit(0)), "_scan_all": F.sum("_scan_rows").over(Window.partitionBy(*line.keys))}
    )
    if peaks:
        carry = carry.withColumns({f"_g{n}": F.max(F.col(f"_b{of}") + F.col(f"_p{n}")).over(earlier) for n, of in peaks.items()})
    if lags:  # every block has at least one row, so as many blocks as the deepest lag has steps suffice
        before = Window.partitionBy(*line.keys).orderBy(line.block_name).rowsBetween(-depth, -1)
        carry = carry.withColumn("_scan_halo", F.flatten(F.collect_list("_scan_tail").over(before)))
    carried = [f"_b{n}" for n in sums] + [f"_g{n}" for n in peaks] + [f"_c{n}" for n in maxima] + [f"_e{n}" for n in latest]
    carried += ["_scan_before", "_scan_all", *(["_scan_halo"] if lags else [])]
    joined = laid.join(written(carry.select(*keys, *carried), "scan-carry"), keys, "left")

    result = {}
    for i, (name, (_, n)) in enumerate(lags.items()):
        back = F.try_element_at("_scan_halo", (F.col("_scan_no") - F.lit(n + 1)).cast("int"))
        result[name] = F.when(F.col("_scan_no") > n, F.col(f"_l{i}")).otherwise(back[source[name]])
    result |= {n: F.col(f"_b{n}") + F.col(f"_r{n}") for n in sums}
    result |= {n: F.greatest(f"_g{n}", F.col(f"_b{of}") + F.col(f"_p{n}")) for n, of in peaks.items()}
    result |= {n: F.greatest(f"_c{n}", f"_q{n}") for n in maxima}
    result |= {n: F.coalesce(f"_w{n}", f"_e{n}") for n in latest}
    result |= {index: F.col("_scan_before") + F.col("_scan_no") - 1} if index else {}
    result |= {count: F.col("_scan_all")} if count else {}
    return line.without_block(joined.withColumns(result)).drop(*values, *within, *tops, *carried)


def with_lags(df: DataFrame, line: Timeline, lags: Mapping[str, tuple[str | Column, int]]) -> DataFrame:
    """Add ``{name: (value, steps)}`` as the value ``steps`` rows back, NULL at the head."""
    return with_scan(df, line, lags)


def with_running(
    df: DataFrame,
    line: Timeline,
    sums: Mapping[str, str | Column] | None = None,
    peaks: Mapping[str, str] | None = None,
    maxima: Mapping[str, str | Column] | None = None,
    latest: Mapping[str, str | Column] | None = None,
) -> DataFrame:
    """Add running aggregates, each from the series' first row to the current one (see :func:`with_scan`)."""
    return with_scan(df, line, None, sums, peaks, maxima, latest)


def _composed(factor: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps ``x -> factor * x + shift`` one after the other: entry ``i`` is what the first ``i + 1`` of them do together."""
    step = 1
    while step < len(factor):
        shift = np.concatenate([shift[:step], factor[step:] * shift[:-step] + shift[step:]])
        factor = np.concatenate([factor[:step], factor[step:] * factor[:-step]])
        step *= 2
    return factor, shift


def with_recurrence(df: DataFrame, line: Timeline, name: str, factor: str | Column, shift: str | Column) -> DataFrame:
    """Add ``name``: what ``x = factor * x + shift`` makes of 0, row after row.

    A NULL factor or shift leaves ``x`` as it is. Such maps can be joined before ``x`` is known, so a block
    composes its own, the blocks' maps are composed per series in a table with one row per block, and the value
    at a row is its block's map applied to what the blocks before it left.
    """
    keys = line.block_keys() if line.blocked else list(line.keys)
    local = line.with_block(df) if line.blocked else df
    idle = as_col(factor).isNull() | as_col(shift).isNull()
    local = local.withColumns({
        "_f": F.when(idle, 1.0).otherwise(as_col(factor).cast("double")), "_g": F.when(idle, 0.0).otherwise(as_col(shift).cast("double")),
    })
    sorting = [(o.removeprefix("-"), "descending" if o.startswith("-") else "ascending") for o in line.order]

    def composed(table: pa.Table, last: bool = False) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=sorting))
        maps = _composed(table.column("_f").to_numpy(), table.column("_g").to_numpy())
        for column, values in zip(("_f", "_g"), maps):
            table = table.set_column(table.column_names.index(column), column, pa.array(values))
        return table.slice(len(table) - 1) if last else table

    scanned = local.groupBy(*keys).applyInArrow(lambda table: composed(table), local.schema)
    if not line.blocked:
        return scanned.withColumn(name, F.col("_g")).drop("_f", "_g")
    narrow = local.select(*keys, *[o for o in line.order_names() if o not in keys], "_f", "_g")
    ends = narrow.groupBy(*keys).applyInArrow(lambda table: composed(table, True), narrow.schema).select(*keys, "_f", "_g")
    block = line.block_name

    def carried(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(block, "ascending")]))
        _, left = _composed(table.column("_f").to_numpy(), table.column("_g").to_numpy())
        return table.drop_columns(["_f", "_g"]).append_column("_before", pa.array(np.append(0.0, left[:-1])))

    schema = T.StructType([*[ends.schema[k] for k in keys], T.StructField("_before", T.DoubleType())])
    before = ends.groupBy(*line.keys).applyInArrow(carried, schema)
    joined = scanned.join(before, keys, "left")
    return line.without_block(joined.withColumn(name, F.col("_f") * F.col("_before") + F.col("_g"))).drop("_f", "_g", "_before")


def with_position(df: DataFrame, line: Timeline, index: str = "row_no", count: str | None = "n_rows") -> DataFrame:
    """Add the row's position in its series (from 0) and, if named, the series length."""
    return with_scan(df, line, index=index, count=count)


def with_last_values(df: DataFrame, line: Timeline, value: str | Column, n: int) -> DataFrame:
    """A window of the last ``n`` values, as the row sees it.

    Adds ``window`` (oldest first, at most n; a NULL value keeps its place),
    ``dropped`` (what the row pushed out, NULL until the window was full) and
    ``is_full``.
    """
    if n <= 0:
        raise ValueError("the window needs a positive size")
    df = df.withColumn("_now", as_col(value))
    df = with_scan(df, line, {f"_lag{i}": ("_now", i) for i in range(1, n + 1)}, index="_at")
    newest_last = [f"_lag{i}" for i in range(n - 1, 0, -1)] + ["_now"]
    return df.withColumns(
        {
            "window": F.slice(F.array(*newest_last), -F.least(F.col("_at") + 1, F.lit(n)), F.lit(n)),
            "dropped": F.col(f"_lag{n}"),
            "is_full": F.col("_at") >= n - 1,
        }
    ).drop("_now", "_at", *(f"_lag{i}" for i in range(1, n + 1)))


#: Rows of a series that one block is meant to hold, and sampled rows per block that place the cuts. Neither
#: changes a result.
ROWS_PER_BLOCK = 250_000
SAMPLED_PER_BLOCK = 100


def even_blocks(
    df: DataFrame, line: Timeline, blocks: int | None = None, rows_per_block: int = ROWS_PER_BLOCK,
    sampled: int = SAMPLED_PER_BLOCK, seed: int = 17,
) -> tuple[DataFrame, Timeline]:
    """Cut each series into about equal shares of its rows, wherever they lie.

    A series of n rows gets ``n / rows_per_block`` blocks (or ``blocks``, if
    given), so blocks keep their size as data grows. Time blocks are cheaper,
    but a burst puts many rows into one. Here the cut points come from a sample
    of the whole order (ties included), drawn in proportion to the number of
    blocks, so a single instant holding a third of all rows is cut as well. Costs
    a count and a sampled read. The sample only places the cuts; every row is
    kept. The cuts are written once, so that all branches of a plan see the same
    blocks. Returns the rows with a block column and the line to use with them.
    """
    if any(o.startswith("-") for o in line.order):
        raise ValueError("even blocks need an ascending order")
    cut_line = replace(line, block=None, block_column="_even")
    wanted = F.lit(blocks) if blocks else F.ceil(F.col("_rows") / rows_per_block)
    sizes = df.groupBy(*line.keys).agg(F.count(F.lit(1)).alias("_rows"))
    sizes = written(sizes.withColumn("_blocks", wanted.cast("long")), "series-sizes")
    rows, total, most = sizes.agg(F.sum("_rows"), F.sum("_blocks"), F.max("_blocks")).first()
    if (most or 0) <= 1:
        return df.withColumn("_even", F.lit(0)), cut_line
    place = F.struct(*line.order)
    share = min(1.0, sampled * total / rows)
    drawn = df.select(*line.keys, place.alias("_o"))
    drawn = drawn.sample(share, seed) if share < 1 else drawn
    w = Window.partitionBy(*line.keys)
    ranked = drawn.withColumns({"_i": F.row_number().over(w.orderBy("_o")), "_n": F.count(F.lit(1)).over(w)})
    ranked = ranked.join(sizes.select(*line.keys, "_blocks"), list(line.keys))
    piece = F.floor((F.col("_i") - 1) * F.col("_blocks") / F.col("_n"))
    firsts = ranked.groupBy(*line.keys, piece.alias("_piece")).agg(F.min("_o").alias("_o")).where(F.col("_piece") > 0)
    cuts = written(firsts.groupBy(*line.keys).agg(F.array_sort(F.collect_list("_o")).alias("_cuts")), "cut-points")
    # Count the cuts at or before the row by halving steps: a few comparisons in
    # generated code. Rows of a series without cuts are block 0.
    marked = df.join(cuts, list(line.keys), "left").withColumn("_even", F.lit(0))
    step = 1 << (most - 1).bit_length()
    while step := step >> 1:
        behind = F.get("_cuts", F.col("_even") + (step - 1)) <= place
        marked = marked.withColumn("_even", F.col("_even") + F.when(behind, step).otherwise(0))
    return marked.drop("_cuts"), cut_line
