"""Positions of regular-expression matches, in code points, with Spark's own functions.

A text is split at the matches of a pattern; the lengths of the pieces and of the matches, summed up
in order, are the positions. Everything happens within the row: no key, no shuffle, and repeated rows
or NULL ids make no difference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths are summed in runs of this many, so that positions of n matches cost about n * RUN additions, not n * n.
RUN = 64


@dataclass(frozen=True)
class Pattern:
    """``kind`` names the spans; ``group`` of each match is handed on as its value."""

    kind: str
    regex: str
    group: int = 0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running(lengths: Column) -> Column:
    """Running totals of a non-empty array of int."""

    def totals(values: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), ((F.size(values) - 1) / RUN).cast("int")),
            lambda b: total(F.slice(values, b * RUN + 1, RUN)),
        )

        def with_runs(run: Column) -> Column:
            base = F.transform(run, lambda _, b: total(F.slice(run, F.lit(1), b)))
            return let(
                base,
                lambda start: F.transform(
                    values,
                    lambda _, i: start[(i / RUN).cast("int")]
                    + total(F.slice(values, (i / RUN).cast("int") * RUN + 1, i % RUN + 1)),
                ),
            )

        return let(runs, with_runs)

    return let(lengths, totals)


def spans_of(text: Column, rank: int, p: Pattern) -> Column:
    """All matches of ``p``, leftmost and not overlapping: array of
    ``(rank, start, kind, end, match, value, before)``; ``before`` holds up to 64 code points since the last match."""

    def placed(s: Column) -> Column:
        def at(ends: Column) -> Column:
            return F.transform(
                s["m"],
                lambda m, i: F.struct(
                    F.lit(rank).alias("rank"),
                    (ends[i] - F.length(m)).cast("long").alias("start"),
                    F.lit(p.kind).alias("kind"),
                    ends[i].cast("long").alias("end"),
                    m.alias("match"),
                    (s["v"][i] if p.group else m).alias("value"),
                    F.substring(s["gap"][i], F.lit(-64), F.lit(64)).alias("before"),
                ),
            )

        lengths = F.transform(s["m"], lambda m, i: F.length(m) + F.length(s["gap"][i]))
        return let(running(lengths), at)

    parts = [
        F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)).alias("m"),
        F.split(text, p.regex, -1).alias("gap"),
    ]
    if p.group:
        parts.append(F.regexp_extract_all(text, F.lit(p.regex), F.lit(p.group)).alias("v"))
    return F.when(text.rlike(p.regex), let(F.struct(*parts), placed))


def all_spans(text: Column, patterns: tuple[Pattern, ...]) -> Column:
    """The matches of all patterns in one array, by pattern, then start; empty for NULL."""
    found = F.array(*[spans_of(text, i, p) for i, p in enumerate(patterns)])
    return F.flatten(F.filter(found, lambda a: a.isNotNull()))


def listed(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, of an array of structs in its order."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def replaced(text: Column, p: Pattern, applies: Callable[[Column], Column], by: Column) -> Column:
    """``text`` with the matches for which ``applies(match)`` holds replaced."""

    def rebuilt(s: Column) -> Column:
        return F.array_join(
            F.transform(
                s["gap"],
                lambda g, i: F.concat(
                    g, F.when(i >= F.size(s["m"]), F.lit("")).when(applies(s["m"][i]), by).otherwise(s["m"][i])
                ),
            ),
            "",
        )

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(p.regex), F.lit(0)).alias("m"), F.split(text, p.regex, -1).alias("gap")
    )
    return F.when(text.rlike(p.regex), let(parts, rebuilt)).otherwise(text)
