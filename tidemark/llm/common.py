"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What counts as a word everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the operator's own names; extra columns and their names stay out of the way."""
    return df.select(*[F.col(f"`{given}`").alias(name) for name, given in columns.items()])


def one_text_per_digest(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(digest, text)`` once for every digest in ``wanted (digest, id, mark)``.

    ``docs`` has ``id`` and ``text``. The chosen row is found by its id and ``mark`` (a fast hash of its
    text, see :func:`first_rows`), so a text that a third of all rows repeat is read from one row and its
    copies never meet in one task. The join keeps only the small side in memory.
    """
    left = docs.select("id", "text", F.xxhash64("text").alias("mark")).alias("a")
    right = wanted.select("digest", F.col("id").alias("w_id"), F.col("mark").alias("w_mark")).hint("shuffle_hash")
    on = F.col("a.id").eqNullSafe(F.col("w_id")) & (F.col("a.mark") == F.col("w_mark"))
    return left.join(right, on).select("digest", "text")


#: Rows of a small side (ids and a few numbers) up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def small(side: DataFrame) -> DataFrame:
    """``side`` (a written table of narrow rows), marked for broadcast if it is counted to be small."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def first_rows(keyed: DataFrame) -> DataFrame:
    """``(digest, id, mark)``: the first row of every digest in ``keyed (digest, id, mark)``, combined before the shuffle."""
    return keyed.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("r")).select("digest", "r.id", "r.mark")


# --- texts as byte arrays ----------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
#: White space and ASCII punctuation, for words without their punctuation.
_SPACE_OR_MARK = _SPACE.copy()
_SPACE_OR_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULT = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64
)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, factor in (("up", _BASE), ("down", inverse)):
            row = np.full(size, factor, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def text_slices(
    column: pa.Array, budget: int = 1 << 18, rows: int = 1024
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` in slices of about ``budget`` bytes and at most ``rows`` texts.

    A text is never cut: one that is longer than the budget is a slice of its own. NULL is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for base in range(0, len(column), rows):  # a few rows at a time are copied, never the whole batch
        part = column.slice(base, rows).cast(pa.large_string()).fill_null("")
        n, buffers = len(part), part.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[part.offset : part.offset + n + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(offsets, offsets[at] + budget, "right")) - 1))
            yield base + at, base + to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words_of(
    data: np.ndarray, offsets: np.ndarray, lower: bool = True, marks: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts of one slice: ``(hash, start, end, first)``.

    ``first[i]:first[i + 1]`` are the words of text ``i``; the hash is over the bytes, with A-Z lowered
    unless ``lower`` is off. Without ``marks``, ASCII punctuation separates words like white space.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    space = (_SPACE if marks else _SPACE_OR_MARK)[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts_here = ~space
    starts_here[1:] &= space[:-1] | cut[1:n]
    ends_here = ~space
    ends_here[:-1] &= space[1:] | cut[1:n]
    start, end = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER if lower else _SAME)[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    word = (total[end] - total[start]) * down[start]
    return mix(word + (end - start).astype(np.uint64)), start, end, np.searchsorted(start, offsets)


def grams_of(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of every run of ``size`` words; ``text`` is the row within the slice.

    A text of fewer words (but some) has one run: all of them.
    """
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), count)
    m = len(word)
    if m >= size:
        run = mix(word[: m - size + 1] * _MULT[0])
        for k in range(1, size):
            run = mix(run ^ (word[k : m - size + 1 + k] * _MULT[k % 5]))
        whole = rows[: m - size + 1] == rows[size - 1 :]
        run, at = run[whole], rows[: m - size + 1][whole]
    else:
        run, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j, row in enumerate(short):
            own = word[first[row] : first[row + 1]]
            h = mix(own[:1] * _MULT[0])
            for k in range(1, len(own)):
                h = mix(h ^ (own[k : k + 1] * _MULT[k % 5]))
            extra[j] = mix(h + np.uint64(len(own)))[0]
        run, at = np.concatenate([run, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        run, at = run[order], at[order]
    return run, at
