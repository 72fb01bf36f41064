"""Periodic runs of words, found on a grammar of the text, and texts with the repetitions taken out.

A run is a maximal stretch of words that repeats its first ``period`` words, the smallest such number, and is
at least ``max(6, 4 * period)`` words long. Re-Pair turns the word ids of each text into a grammar: pairs of
neighbouring symbols that occur more than once become a new symbol, the more frequent of overlapping pairs
first, until no pair occurs twice; a balanced tree over what is left makes it one derivation. The first and
the last word of a run part at one node of that tree, so every run crosses the boundary between the two
children of a node and lies within it. Boundaries are searched once per rule, not once per occurrence; what
is found is carried to all places of the rule, and stretches that are part of a longer one go.

Stretches are compared by two polynomial hashes modulo primes. Spark deals the texts; a task handles a few of
them at a time, all texts of such a slice in the same vectorised steps.

Defined results: a NULL or empty text has no words and no runs; repeated rows and NULL ids each get their row;
other columns are ignored; an empty table gives an empty result. A text is never cut; memory grows with the
longest one, by about 150 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, named, text_slices

#: Least words of a run, and least periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: (node, period) pairs that are looked at together.
STEP = 1 << 18


# --- words -------------------------------------------------------------------


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(id, start, end, first)`` of the words of a slice: equal words have equal ids, and the words of text ``i``
    are ``first[i]:first[i + 1]``."""
    solid = ~_SPACE[data]
    before = np.append(False, solid)
    before[offsets[:-1]] = False  # texts meet without white space
    after = np.append(solid, False)
    after[offsets[1:]] = False
    start = np.flatnonzero(solid & ~before[:-1])
    end = np.flatnonzero(solid & ~after[1:]) + 1
    length = np.append(0, np.cumsum(end - start))
    letters = [None, pa.py_buffer(length.astype(np.int64)), pa.py_buffer(data[solid].copy())]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), letters)
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    return ids, start, end, np.searchsorted(start, offsets)


# --- the grammar -------------------------------------------------------------


class Nodes:
    """Boundaries to search: a node is ``begin:mid:end`` at one of its places; ``places`` lists all of them."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.places: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, begin: np.ndarray, mid: np.ndarray, end: np.ndarray, owner: np.ndarray, places: np.ndarray) -> None:
        """New nodes; place ``places[i]`` is one of node ``owner[i]`` of them. Those too short for a run are left out."""
        wide = end - begin >= LEAST_WORDS
        number = np.cumsum(wide) - 1 + self.count
        self.parts.append((begin[wide], mid[wide], end[wide]))
        self.places.append((number[owner][wide[owner]], places[wide[owner]]))
        self.count += int(wide.sum())

    def arrays(self) -> tuple[np.ndarray, ...]:
        """``begin, mid, end`` by node, then ``owner, place`` ordered by owner."""
        owner, place = (np.concatenate(x) for x in zip(*self.places))
        order = np.argsort(owner, kind="stable")
        return *(np.concatenate(x) for x in zip(*self.parts)), owner[order], place[order]


def _chosen(weight: np.ndarray) -> np.ndarray:
    """Positions that outweigh both neighbours; of equal neighbours (one pair, as in ``a a a``) every other one."""
    starts = np.flatnonzero(np.append(True, weight[1:] != weight[:-1]))
    value = weight[starts]
    best = (value >= 0) & (value > np.append(-1, value[:-1])) & (value > np.append(value[1:], -1))
    long = np.diff(np.append(starts, len(weight)))
    at, many = starts[best], (long[best] + 1) // 2
    return np.repeat(at, many) + 2 * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))


def repair(ids: np.ndarray, first: np.ndarray) -> Nodes:
    """The nodes of the derivations of all texts of a slice."""
    n, nodes = len(ids), Nodes()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    _, symbol = np.unique(text * (n + 1) + ids, return_inverse=True)  # a text has its own symbols, so its own pairs
    symbols = int(symbol.max(initial=-1)) + 1
    begin, end = np.arange(n), np.arange(1, n + 1)
    last = np.append(text[1:] != text[:-1], True) if n else np.zeros(0, bool)
    open_ = ~last  # whether the pair that begins here may occur twice; one that does not never will again
    while True:
        at = np.flatnonzero(open_)
        pair, back, often = np.unique(symbol[at] << 32 | symbol[np.minimum(at + 1, n - 1)], return_inverse=True, return_counts=True)
        open_[at] = often[back] > 1
        if not open_.any():
            break
        weight = np.full(len(symbol), -1)
        tie = np.random.default_rng(len(pair)).permutation(len(pair))  # no order, so that ties fall everywhere at once
        weight[at] = np.where(open_[at], often[back] * len(pair) + tie[back], -1)
        left = _chosen(weight)
        right = left + 1
        _, one, rule = np.unique(symbol[left] << 32 | symbol[right], return_index=True, return_inverse=True)
        nodes.add(begin[left[one]], begin[right[one]], end[right[one]], rule, begin[left])
        symbol[left] = symbols + rule
        symbols += len(one)
        end[left], last[left] = end[right], last[right]
        open_[left] = ~last[left]
        ahead = left[left > 0] - 1
        open_[ahead] = ~last[ahead]
        kept = np.ones(len(symbol), bool)
        kept[right] = False
        symbol, begin, end, last, open_ = (x[kept] for x in (symbol, begin, end, last, open_))
        n = len(symbol)
    while len(begin):  # a balanced tree over what is left, level by level
        text = np.searchsorted(first, begin, "right")
        new = np.append(True, text[1:] != text[:-1])
        place = np.arange(len(begin)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        even = place % 2 == 0
        left = np.flatnonzero(even & ~np.append(new[1:], True))
        if not len(left):
            break
        nodes.add(begin[left], begin[left + 1], end[left + 1], np.arange(len(left)), begin[left])
        end[left] = end[left + 1]
        begin, end = begin[even], end[even]
    return nodes


# --- runs --------------------------------------------------------------------


class Stretches:
    """Comparison of stretches of ids a fixed distance apart."""

    PRIMES = ((2147483647, 1103515245), (2147483629, 1664525))

    def __init__(self, ids: np.ndarray):
        self.rows = []
        for prime, base in self.PRIMES:
            power = np.ones(1, np.int64)
            while len(power) <= len(ids):
                power = np.concatenate([power, power * pow(base, len(power), prime) % prime])
            total = np.append(0, np.cumsum((ids + 1) % prime * power[: len(ids)] % prime))
            self.rows.append((prime, power, total))

    def same(self, at: np.ndarray, length: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Whether ``ids[at:at + length]`` is ``ids[at + apart:at + apart + length]``."""
        out = np.ones(len(at), bool)
        for prime, power, total in self.rows:
            here, there = total[at + length] - total[at], total[at + apart + length] - total[at + apart]
            out &= here % prime * power[apart] % prime == there % prime
        return out

    def reach(self, at: np.ndarray, apart: np.ndarray, limit: np.ndarray, sign: int) -> np.ndarray:
        """How many ids from ``at`` on (sign 1) or before ``at`` (sign -1), at most ``limit``, equal those ``apart`` later."""
        got = np.zeros(len(at), np.int64)
        step = 1 << int(limit.max(initial=0)).bit_length()
        while step:
            some = np.flatnonzero(got + step <= limit)
            origin = at[some] + got[some] if sign > 0 else at[some] - got[some] - step
            got[some[self.same(origin, np.full(len(some), step), apart[some])]] += step
            step //= 2
        return got


def _crossing(ids: np.ndarray, compare: Stretches, begin, mid, end) -> tuple[np.ndarray, ...]:
    """``(node, start, stop, period)`` of the stretches within a node that cross its boundary and are long enough."""
    periods = (end - begin) // LEAST_PERIODS
    ahead = np.append(0, np.cumsum(periods))
    found = []
    for flat in range(0, int(ahead[-1]), STEP):
        flat = np.arange(flat, min(flat + STEP, int(ahead[-1])))
        node = np.searchsorted(ahead, flat, "right") - 1
        q = flat - ahead[node] + 1
        a, b, c = begin[node], mid[node], end[node]
        # a run has two whole periods before the boundary or two after it: look at one word, then at all
        before = b - 2 * q >= a
        before[before] = ids[b[before] - 1] == ids[b[before] - 1 - q[before]]
        after = b + 2 * q <= c
        after[after] = ids[b[after]] == ids[b[after] + q[after]]
        before[before] = compare.same(b[before] - 2 * q[before], q[before], q[before])
        after[after] = compare.same(b[after], q[after], q[after])
        some = before | after
        node, q, a, b, c = (x[some] for x in (node, q, a, b, c))
        for anchor in (b, b - q):  # words equal to those a period later reach to one of these, or begin there
            ok = (anchor >= a) & (anchor + q <= c)
            n_, q_, x, lo, hi, m = (v[ok] for v in (node, q, anchor, a, c, b))
            start = x - compare.reach(x, q_, x - lo, -1)
            stop = x + q_ + compare.reach(x, q_, hi - x - q_, 1)
            enough = (stop - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q_)) & (start < m) & (stop > m)
            found.append((n_[enough], start[enough], stop[enough], q_[enough]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return _shortest_periods(*(np.concatenate(x) for x in zip(*found)))


def _shortest_periods(owner, start, stop, period) -> tuple[np.ndarray, ...]:
    """One period, the smallest, for each stretch: the others are its multiples."""
    order = np.lexsort((period, stop, start, owner))
    owner, start, stop, period = (x[order] for x in (owner, start, stop, period))
    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(owner)]
    return owner[new], start[new], stop[new], period[new]


def find_runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, stop, period)`` of all runs, ordered by text, start and period; places count over the slice."""
    nodes = repair(ids, first)
    if not nodes.count:
        return (np.zeros(0, np.int64),) * 4
    begin, mid, end, owner, place = nodes.arrays()
    node, start, stop, period = _crossing(ids, Stretches(ids), begin, mid, end)
    low, high = np.searchsorted(owner, node), np.searchsorted(owner, node, "right")
    many = high - low
    which = np.repeat(np.arange(len(node)), many)
    at = place[low[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)] - begin[node[which]]
    start, stop, period = start[which] + at, stop[which] + at, period[which]
    # by period, what lies within an earlier stretch is a part of the same run
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    reach = np.maximum.accumulate(period * (len(ids) + 1) + stop) if len(stop) else stop
    whole = np.append(True, period[1:] * (len(ids) + 1) + stop[1:] > reach[:-1])[: len(stop)]
    text = np.searchsorted(first, start[whole], "right") - 1
    text, start, stop, period = _shortest_periods(text, start[whole], stop[whole], period[whole])
    order = np.lexsort((period, start, text))
    return text[order], start[order], stop[order], period[order]


# --- the operator ------------------------------------------------------------


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The given words with a space between them."""
    long = end - start + 1
    to = np.cumsum(long)
    at = np.repeat(start - (to - long), long) + np.arange(to[-1] if len(to) else 0)
    out = data[np.minimum(at, len(data) - 1)]
    out[to - 1] = 32
    return out[:-1].tobytes()


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in text_slices(batch.column(1)):
            ids, start, end, first = word_ids(data, offsets)
            text, begin, stop, period = find_runs(ids, first)
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, begin + period, 1)
            np.add.at(change, stop, -1)
            kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
            of_text = np.searchsorted(kept, first)
            collapsed = [
                "" if a == b else _joined(data, start[kept[a:b]], end[kept[a:b]]).decode() for a, b in zip(of_text, of_text[1:])
            ]
            split = pa.array(np.searchsorted(text, np.arange(to - at + 1)).astype(np.int32))
            fields = [pa.array(x) for x in (begin - first[text], stop - begin, period)]
            runs = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
            columns = [batch.column(0).slice(at, to - at), pa.array(np.diff(first)), pa.ListArray.from_arrays(split, runs), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, runs, collapsed)`` per row of ``docs``: the runs ``(start, length, period)`` by start, then
    period, in words, and the words outside their repetitions (a run's first period stays), joined by a space."""
    own = named(docs, id=id_col, text=text_col)
    runs = "array<struct<start:long,length:long,period:long>>"
    found = own.mapInArrow(_finder, f"id {dict(own.dtypes)['id']}, n_words long, runs {runs}, collapsed string")
    return found.withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text)``: texts of every tenth id, by its crc32, repeat some of their words from one word on to the end.
    A NULL id changes nothing."""
    own = named(docs, id=id_col, text=text_col).withColumn("h", F.crc32(F.col("id").cast("string").cast("binary")))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = own.withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.expr("h div 10 % n")))
    planted = planted.withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    tail = F.expr("transform(slice(w, int(a + 1), int(n - a)), (x, i) -> w[int(a + i % p)])")
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.expr("slice(w, 1, int(a))"), tail), " ")).otherwise(F.col("text"))
    return planted.select(F.col("id").alias(id_col), text.alias(text_col))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every document, after some documents were made to repeat their words."""
    found = periodic_runs(with_planted_runs(spark.read.parquet(f"{folder}/documents.parquet")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    order = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))
    best = F.array_max(F.transform("runs", order))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.shorter")).alias("period"),
        F.expr("1000 * best.length div -best.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
