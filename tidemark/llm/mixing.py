"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of times that the mix takes it. Rates stay as close in
entropy to 1 as the constraints allow: per source, rates times sizes must add up to the target. The
solution has the form ``rate = 3 / (1 + 2 * exp(-multiplier * size / mean size))``: exponential tilting
with a ceiling of 3 (relative entropy of a rate within 0..3 against 1), so that the ceiling needs no
clipping. The dual is convex and one-dimensional per source; Newton steps run for all sources at once,
each step one aggregation over the distinct (source, size) pairs. Rates are then rounded to whole copies
in order of size, so that a source's words miss its target by about one document.

Spark expressions only. Defined results: NULL texts have size 0 and are taken 0 times; NULL is a source
of its own, last in order; repeated rows count each; other input columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .common import WORD, named

CEILING = 3.0
WEIGHTS = (5, 2, 1)
TOLERANCE = 1e-9
#: Newton steps with bisection as a safeguard halve the bracket at worst; this many always reach the tolerance.
STEPS = 80
#: Parts into which the rows of one (source, size) are dealt for numbering.
PARTS = 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` of ``sizes (source, size, n)``.

    All words are shared by weight. A source's target stops at three times its size; the excess is shared
    again by weight among the others until no target is above. The final level is found at once: with
    sources ordered by size / weight, the first k are at their ceilings, and the rest share what is left.
    Windows over the whole here run on one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = per.withColumn("weight", weights[(F.row_number().over(order) - 1) % len(WEIGHTS)])
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumns(
        {
            "all_size": F.sum("source_size").over(everything).cast("double"),
            "all_weight": F.sum("weight").over(everything),
            "full_size": F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double"),
            "full_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("all_size") - CEILING * F.col("full_size")) / (F.col("all_weight") - F.col("full_weight"))
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= CEILING * F.col("source_size"), F.col("level"))
    per = per.withColumn("final", F.min_by(fits, F.when(fits.isNotNull(), F.col("source_size") / F.col("weight"))).over(everything))
    target = F.least(F.coalesce("final", F.col("level")) * F.col("weight"), CEILING * F.col("source_size"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def exact_sum(value: Column) -> Column:
    """A sum of doubles that does not depend on the order of the rows, so that reruns agree to the last copy."""
    return F.sum(value.cast("decimal(38,12)")).cast("double")


def rate(multiplier: Column, scaled_size: Column) -> Column:
    return F.lit(CEILING) / (1 + (CEILING - 1) * F.exp(-multiplier * scaled_size))


def solve(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``(source, source_size, target, mean, multiplier)``: the dual solution of every source.

    ``sizes`` is ``(source, size, n)``. One step is one aggregation of ``sizes`` with the multipliers of
    the last one; the loop ends when every source is within the tolerance of its target.
    """
    spread = sizes.where("size > 0").groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    known = F.col("a.source").eqNullSafe(F.col("b.source"))
    state = goals.alias("a").join(spread.alias("b"), known, "left").select("a.*", F.coalesce("mean", F.lit(1.0)).alias("mean"))
    open_ = (F.col("target") > 0) & (F.col("target") < CEILING * F.col("source_size") * (1 - 1e-12))
    edge = F.when(F.col("target") <= 0, F.lit(-1e300)).when(open_, F.lit(0.0)).otherwise(F.lit(1e300))
    state = written(
        state.withColumns({"multiplier": edge, "low": F.lit(-1e3), "high": F.lit(1e3), "done": ~open_}), "mix-dual"
    )
    rows = sizes.where("size > 0").alias("a")
    for _ in range(STEPS):
        if not state.where(~F.col("done")).limit(1).count():
            break
        pairs = rows.join(state.where(~F.col("done")).alias("b"), known).select(
            "b.*", "size", "n", (F.col("size") / F.col("mean")).alias("scaled")
        )
        r = rate(F.col("multiplier"), F.col("scaled"))
        step = pairs.groupBy("source", "source_size", "target", "mean", "multiplier", "low", "high").agg(
            exact_sum(r * F.col("size") * F.col("n")).alias("got"),
            exact_sum(r * (1 - r / CEILING) * F.col("scaled") * F.col("size") * F.col("n")).alias("slope"),
        )
        gap = F.col("got") - F.col("target")
        step = step.withColumns(
            {
                "done": F.abs(gap) <= TOLERANCE * F.col("target"),
                "low": F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low")),
                "high": F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high")),
                "next": F.col("multiplier") - F.when(F.col("slope") > 0, gap / F.col("slope")),
            }
        )
        inside = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        moved = F.when(F.col("done"), F.col("multiplier")).when(inside, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        step = step.withColumn("multiplier", moved).select(state.columns)
        state = written(step.unionByName(state.where("done")), "mix-dual")
    return state.drop("low", "high", "done")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id, size, source, source_size, target, rate, copies, taken)`` per row of ``docs``."""
    own = named(docs, id=id_col, text=text_col, source=source_col)
    rows = written(
        own.select("id", "source", size_of(F.col("text")).alias("size"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).alias("part")),
        "mix-sizes",
    )
    counts = written(rows.groupBy("source", "size", "part").agg(F.count("*").alias("n")), "mix-counts")
    sizes = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = written(targets(sizes), "mix-targets")
    dual = solve(sizes, goals)
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    rates = counts.alias("a").join(dual.alias("b"), same).select(
        "a.*", "source_size", "target", rate(F.col("multiplier"), F.col("size") / F.col("mean")).alias("rate")
    )
    # expected copies of all rows before this (source, size, part), in order of size: first a line of one row per
    # size, at most as many as a text has words, then the parts of each size
    of_size = rates.groupBy("source", "size").agg(exact_sum(F.col("rate") * F.col("n")).alias("copies"))
    order = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.select(
        F.col("source").alias("s_source"), F.col("size").alias("s_size"), F.coalesce(F.sum("copies").over(order), F.lit(0.0)).alias("start")
    )
    parts = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rates = rates.join(of_size, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")))
    within = F.coalesce(F.sum(F.col("rate") * F.col("n")).over(parts), F.lit(0.0))
    rates = rates.withColumn("before", F.col("start") + within).drop("n", "s_source", "s_size", "start")
    # a row's place within its triple: a triple holds a 64th of the rows of a size and source
    place = Window.partitionBy("source", "size", "part").orderBy("id")
    placed = rows.withColumn("place", F.row_number().over(place) - 1)
    key = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.part") == F.col("b.part"))
    out = placed.alias("a").join(rates.alias("b"), key).select(
        "a.id", "a.size", "a.source", "source_size", "target", "rate", (F.col("before") + F.col("place") * F.col("rate")).alias("from")
    )
    # whole copies: how many of the marks 0.5, 1.5, 2.5 ... fall into this row's share of the line
    copies = F.floor(F.col("from") + F.col("rate") + 0.5) - F.floor(F.col("from") + 0.5)
    copies = F.least(F.when(F.col("size") == 0, F.lit(0)).otherwise(copies), F.lit(int(CEILING))).cast("long")
    return out.withColumn("copies", copies).select(
        F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", "rate", "copies",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def op10_mix(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to the 5, 2, 1 weights of their sources."""
    mixed = mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
