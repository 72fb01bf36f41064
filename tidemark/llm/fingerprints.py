"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines; a line of more than ``LONG`` code points is cut after its sentences) are
hashed to 64-bit digests. Each distinct digest is added to one cell in each of three sub-tables; a cell
keeps a count, the XOR of its digests and the XOR of their check values. Two sketches of one size
subtract cell by cell; what is left holds only the paragraphs that differ, and peeling cells with a
single digest recovers them. Peeling that gets stuck is tried again with a larger sketch; a pair of
texts with many paragraphs is first dealt into blocks by digest, so that every sketch stays small.

The likeness of two texts is ``shared / all`` distinct paragraphs, from the recovered difference.

Spark expressions only. Defined results: NULL is an empty text; texts without paragraphs are alike (1);
repeated rows follow one another in order; NULL ids come last; other input columns are ignored; a
single row is followed by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written
from .common import named
from .spans import let

LONG = 320
TABLES = 3
#: Cells of the fingerprint itself, and how a stuck pair's sketch grows.
BASE_CELLS, GROWTH = 12, 4
#: Peeling rounds; a sketch below its capacity needs fewer.
ROUNDS = 10
#: Paragraphs of a pair that go to one block.
BLOCK = 32
#: Ids in a row that are kept together to find each document's next one.
RANGE_BITS = 7


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of the paragraphs, in order of their values."""
    lines = F.split(text, "\n", -1)
    pieces = F.flatten(
        F.transform(lines, lambda x: F.when(F.length(x) > LONG, F.split(x, r"(?<=[.!?])\x20", -1)).otherwise(F.array(x)))
    )
    return F.array_sort(F.array_distinct(F.transform(F.filter(pieces, lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _place(digest: Column, table: int, cells: int) -> Column:
    """The digest's cell in a sub-table, counted over the whole sketch."""
    width = cells // TABLES
    return (F.pmod(F.xxhash64(digest, F.lit(cells), F.lit(table)), F.lit(width)) + table * width).cast("int")


def sketch(digests: Column, cells: int) -> Column:
    """Array of ``(c, k, h)``: count, XOR of digests, XOR of check values."""
    width = cells // TABLES

    def cell(entries: Column, table: int, j: Column) -> Column:
        own = F.filter(entries, lambda e: e[f"p{table}"] == j)
        zero = F.lit(0).cast("long")
        return let(
            own,
            lambda x: F.struct(
                F.size(x).alias("c"),
                F.aggregate(x, zero, lambda a, e: a.bitwiseXOR(e["d"])).alias("k"),
                F.aggregate(x, zero, lambda a, e: a.bitwiseXOR(e["h"])).alias("h"),
            ),
        )

    def table_of(entries: Column, t: int) -> Column:
        js = F.sequence(F.lit(t * width), F.lit((t + 1) * width - 1))
        return F.transform(js, lambda j: cell(entries, t, j))

    entries = F.transform(
        digests,
        lambda d: F.struct(d.alias("d"), _check(d).alias("h"), *[_place(d, t, cells).alias(f"p{t}") for t in range(TABLES)]),
    )
    return let(entries, lambda e: F.concat(*[table_of(e, t) for t in range(TABLES)]))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(
        a,
        b,
        lambda x, y: F.struct(
            (x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")
        ),
    )


def peeled(difference: Column, cells: int) -> Column:
    """``(cells, found)`` after peeling: what is left, and ``(s, d)`` of each recovered digest (1: only in the first)."""
    key = "array<struct<s:int,d:bigint>>"

    def pure(rest: Column) -> Column:
        single = F.filter(rest, lambda x: (F.abs(x["c"]) == 1) & (_check(x["k"]) == x["h"]))
        return F.array_distinct(F.transform(single, lambda x: F.struct(x["c"].alias("s"), x["k"].alias("d"))))

    def without(rest: Column, keys: Column) -> Column:
        places = F.transform(
            keys,
            lambda e: F.struct(
                e["s"].alias("s"), e["d"].alias("d"), _check(e["d"]).alias("h"),
                *[_place(e["d"], t, cells).alias(f"p{t}") for t in range(TABLES)],
            ),
        )

        def less(x: Column, j: Column, entries: Column) -> Column:
            mine = F.filter(entries, lambda e: (e["p0"] == j) | (e["p1"] == j) | (e["p2"] == j))
            return F.aggregate(
                mine,
                x,
                lambda a, e: F.struct(
                    (a["c"] - e["s"]).alias("c"), a["k"].bitwiseXOR(e["d"]).alias("k"), a["h"].bitwiseXOR(e["h"]).alias("h")
                ),
            )

        return let(places, lambda p: F.transform(rest, lambda x, j: less(x, j, p)))

    def step(state: Column, _: Column) -> Column:
        return let(
            pure(state["cells"]),
            lambda keys: F.when(F.size(keys) == 0, state).otherwise(
                F.struct(without(state["cells"], keys).alias("cells"), F.concat(state["found"], keys).alias("found"))
            ),
        )

    start = F.struct(difference.alias("cells"), F.array().cast(key).alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def decoded(a: Column, b: Column, cells: int) -> Column:
    """Number of digests that differ, by the sketches of two digest arrays; NULL where peeling got stuck."""
    return _count(peeled(minus(sketch(a, cells), sketch(b, cells)), cells))


def _count(result: Column) -> Column:
    clear = F.forall  # every cell empty: all differences were recovered
    return let(
        result,
        lambda r: F.when(
            clear(r["cells"], lambda x: (x["c"] == 0) & (x["k"] == 0) & (x["h"] == 0)), F.size(r["found"])
        ),
    )


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(".", x["c"].cast("string"), F.hex(x["k"]), F.hex(x["h"]))), "_")


def differing(pairs: DataFrame) -> DataFrame:
    """``(pair, differ)`` of ``pairs (pair, a, b)``, arrays of distinct digests; ``pair`` is unique.

    Pairs that hold many paragraphs are dealt into blocks by digest. Each round sketches what is still
    open, with more cells, until nothing is.
    """
    count = F.size("a") + F.size("b")
    few = pairs.where(count <= 2 * BLOCK)
    entry = lambda side: F.transform(side, lambda d: F.struct(F.lit(side == "a").alias("first"), d.alias("d")))
    many = pairs.where(count > 2 * BLOCK).select(
        "pair", F.ceil(count / BLOCK).alias("blocks"), F.explode(F.concat(entry("a"), entry("b"))).alias("e")
    )
    blocks = many.groupBy("pair", F.pmod(F.xxhash64("e.d", F.lit("block")), F.col("blocks")).alias("block")).agg(
        F.collect_list(F.when(F.col("e.first"), F.col("e.d"))).alias("a"),
        F.collect_list(F.when(~F.col("e.first"), F.col("e.d"))).alias("b"),
    )
    todo = few.select("pair", "a", "b").unionByName(blocks.select("pair", "a", "b"))
    cells, done = BASE_CELLS * GROWTH, []
    while True:
        tried = todo.withColumn("differ", decoded(F.col("a"), F.col("b"), cells))
        still = F.col("differ").isNull()  # only these are needed again
        tried = written(tried.withColumns({"a": F.when(still, F.col("a")), "b": F.when(still, F.col("b"))}), "sketch-round")
        done.append(tried.where(F.col("differ").isNotNull()).select("pair", "differ"))
        todo = tried.where(F.col("differ").isNull()).drop("differ")
        if not todo.limit(1).count():
            break
        cells *= GROWTH
    return reduce(DataFrame.unionByName, done).groupBy("pair").agg(F.sum("differ").alias("differ"))


def likeness(a: Column, b: Column, differ: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise((both - differ) / (both + differ))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs (id, text)`` with ``next``: the text of the next row in descending id; the last row's is the first's.

    Rows are dealt out by ranges of ids. The first row of a range is also sent to the range before it;
    only the table of ranges, one row each, is ordered as a whole, and that in two steps.
    """
    order = F.coalesce("id", F.lit(-(2**63)))
    own = docs.select(
        "id", F.coalesce("text", F.lit("")).alias("text"), order.alias("k")
    ).withColumns({"h": F.xxhash64("text"), "range": F.shiftright("k", RANGE_BITS)})
    heads = written(own.groupBy("range").agg(F.max(F.struct("k", "h")).alias("head")), "range-heads")
    heads = heads.withColumn("group", F.shiftright("range", 12))
    in_group = Window.partitionBy("group").orderBy(F.col("range").desc())
    heads = heads.withColumn("follows", F.lead("head").over(in_group))
    groups = heads.groupBy("group").agg(F.max_by("head", "range").alias("g_head"))
    whole = Window.orderBy(F.col("group").desc())
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select("group", F.coalesce(F.lead("g_head").over(whole), F.first("g_head").over(everything)).alias("g_next"))
    links = written(
        heads.join(groups, "group").select("range", F.coalesce("follows", "g_next").alias("n")).select(
            "range", F.col("n.k").alias("k"), F.col("n.h").alias("h")
        ),
        "range-links",
    )
    lent = own.select("k", "h", "text").join(links, ["k", "h"]).groupBy("range").agg(F.first("text").alias("text"))
    rows = own.select("range", "id", "k", "h", "text", F.lit(0).alias("lent")).unionByName(
        lent.select("range", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("h"), "text", F.lit(1).alias("lent"))
    )
    down = Window.partitionBy("range").orderBy("lent", F.col("k").desc(), F.col("h").desc())
    return rows.withColumn("next", F.lead("text").over(down)).where("lent = 0").select("id", "text", "next")


def edited(text: Column, follower: Column) -> Column:
    """``text`` with its last half replaced by the beginning of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(follower, F.lit(1), half))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` per row."""
    rows = with_next(named(docs, id=id_col, text=text_col)).withColumn("other", edited(F.col("text"), F.col("next")))
    rows = rows.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("other", 256).alias("edited_sha256"),
        paragraph_digests(F.col("text")).alias("a"),
        paragraph_digests(F.col("other")).alias("e"),
        paragraph_digests(F.col("next")).alias("n"),
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "paragraphs")
    # the fingerprints themselves are compared first; those that do not peel go to larger sketches
    cells = {c: sketch(F.col(c), BASE_CELLS) for c in "aen"}
    base = rows.withColumns({f"s{c}": v for c, v in cells.items()})
    base = base.withColumns(
        {f"d{c}": _count(peeled(minus(F.col("sa"), F.col(f"s{c}")), BASE_CELLS)) for c in "en"}
    )
    base = written(
        base.withColumns({"fingerprint": as_text(F.col("sa")), "edited_fingerprint": as_text(F.col("se"))}).drop("sa", "se", "sn"),
        "fingerprints",
    )
    opened = [
        base.where(F.col(f"d{c}").isNull()).select((F.col("row") * 2 + i).alias("pair"), "a", F.col(c).alias("b"))
        for i, c in enumerate("en")
    ]
    rest = differing(opened[0].unionByName(opened[1]))
    rest = rest.groupBy(F.expr("pair div 2").alias("row")).agg(
        F.max(F.when(F.col("pair") % 2 == 0, F.col("differ"))).alias("e2"),
        F.max(F.when(F.col("pair") % 2 == 1, F.col("differ"))).alias("n2"),
    )
    out = base.join(rest, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("a"), F.col("e"), F.coalesce("de", "e2")).alias("near_edited"),
        likeness(F.col("a"), F.col("n"), F.coalesce("dn", "n2")).alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document, its edited text and the likeness to the next document."""
    return fingerprints(spark.read.parquet(f"{folder}/documents.parquet"))
