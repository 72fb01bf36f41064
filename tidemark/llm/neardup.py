"""Near-duplicate documents: an exact Jaccard join on word shingles with a count-vector tree.

A document's set holds its distinct shingles of five words. Shingles are hashed into ``GROUPS`` groups;
a document's counts by group are its point, and the overlap of two documents is at most the sum of the
coordinate minima of their points. Points are indexed under the rarest shingles of their set (enough of
them that two linked sets share one), ordered by size and packed into pages; a page keeps the maximum
of every coordinate and its sizes. Pages, then points, whose summed minima or sizes rule a link out are
never looked at again; what survives is verified on the sets themselves.

Equal sets are one class from the start. Within a long list only pairs of different components matter:
first everyone is compared with the list's first and last member, which joins groups of copies with as
many pairs as members; the pages then find all that is left. No link between different texts is lost.

Defined results: NULL or word-less texts have an empty set and link with nothing; NULL ids take no part
(component NULL); rows that share an id are one document; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .common import grams_of, mix, named, small, text_slices, words_of
from .components import join_components

WORDS = 5
#: A link needs 100 * overlap >= PERCENT * union.
PERCENT = 80
#: Groups of the count vectors.
GROUPS = 32
#: Points of one page.
PAGE = 16
#: Counters for the rarity of shingles, a table of fixed size that every task gets; kept in pages.
BINS, BIN_PAGE = 1 << 22, 1 << 16
#: Partial counter tables that are added up in one task.
FAN_IN = 64
TOKEN_BITS = 52

PROFILE = "id long, n int, d1 long, d2 long, page int, part int, counts binary"
SIGNED = "id long, n int, tokens array<long>, point array<int>"


def shingle_sets(column: pa.Array, size: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after, row of token, token)`` per slice: the distinct shingles, by row, then token."""
    low = np.uint64((1 << TOKEN_BITS) - 1)
    for at, to, data, offsets in text_slices(column):
        word, _, _, first = words_of(data, offsets)
        run, row = grams_of(word, first, size)
        key = np.sort((row.astype(np.uint64) << np.uint64(TOKEN_BITS)) | (run >> np.uint64(64 - TOKEN_BITS)))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        yield at, to, (key >> np.uint64(TOKEN_BITS)).astype(np.int64), key & low


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and digest of every set, and at the end the task's shingle counts by bin."""
    bins = np.zeros(BINS, np.uint32)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()),
                        ("page", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])
    for batch in batches:
        for at, to, row, token in shingle_sets(batch.column(1)):
            m = to - at
            n = np.bincount(row, minlength=m)
            np.add.at(bins, (token & np.uint64(BINS - 1)).astype(np.int64), np.uint32(1))
            ends = np.cumsum(n)
            sums = []
            for salt in (np.uint64(0x51ED270B0A1F39C1), np.uint64(0xA24BAED4963EE407)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(token ^ salt))])
                sums.append((total[ends] - total[ends - n]).view(np.int64))
            none = pa.nulls(m, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, m), pa.array(n.astype(np.int32)), pa.array(sums[0]), pa.array(sums[1]), none, none, pa.nulls(m, pa.binary())],
                schema=schema,
            )
    if bins.any():
        part = TaskContext.get().partitionId()
        pages = [p for p in range(BINS // BIN_PAGE) if bins[p * BIN_PAGE : (p + 1) * BIN_PAGE].any()]
        blobs = [zlib.compress(bins[p * BIN_PAGE : (p + 1) * BIN_PAGE].tobytes(), 1) for p in pages]
        none, none8 = pa.nulls(len(pages), pa.int32()), pa.nulls(len(pages), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none8, none, none8, none8, pa.array(pages, pa.int32()), pa.array([part] * len(pages), pa.int32()), pa.array(blobs, pa.binary())],
            schema=schema,
        )


def _added(pages: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BIN_PAGE, np.uint64)
    for blob in pages["counts"]:
        total += np.frombuffer(zlib.decompress(blob), np.uint32)
    total = np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return pd.DataFrame({"page": [pages["page"].iloc[0]], "part": [pages["part"].iloc[0] // FAN_IN], "counts": [zlib.compress(total.tobytes(), 1)]})


def rarity(pages: DataFrame) -> np.ndarray:
    """How often each bin's shingles occur in the corpus: a table of ``BINS`` counters, whatever the corpus."""
    schema = "page int, part int, counts binary"
    pages = pages.select("page", "part", "counts")
    for _ in range(3):  # FAN_IN ** 3 tasks of a first pass
        pages = pages.groupBy("page", F.floor(F.col("part") / FAN_IN)).applyInPandas(_added, schema)
    counts = np.zeros(BINS, np.uint32)
    for r in pages.toLocalIterator():  # at most BINS / BIN_PAGE rows
        counts[r["page"] * BIN_PAGE : (r["page"] + 1) * BIN_PAGE] += np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return counts


def prefix_length(n):
    """Rarest shingles under which a set of ``n`` is indexed: any linked set shares at least one of them."""
    return n - (PERCENT * n + 99) // 100 + 1


def _signer(counts):
    """Index shingles and count vector of every set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = counts.value
        for batch in batches:
            for at, to, row, token in shingle_sets(batch.column(1)):
                m = to - at
                n = np.bincount(row, minlength=m)
                often = np.minimum(bins[(token & np.uint64(BINS - 1)).astype(np.int64)], (1 << 22) - 1).astype(np.uint64)
                # one order of all shingles: by count, then by hash; equal keys keep their order by token
                key = (row.astype(np.uint64) << np.uint64(52)) | (often << np.uint64(30)) | (token >> np.uint64(TOKEN_BITS - 30))
                order = np.argsort(key, kind="stable")
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                take = order[place < np.repeat(prefix_length(n), n)]
                length = np.where(n > 0, prefix_length(n), 0)
                group = row * GROUPS + ((token >> np.uint64(20)) % np.uint64(GROUPS)).astype(np.int64)
                point = np.bincount(group, minlength=m * GROUPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, m),
                        pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), token[take].view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, m * GROUPS + 1, GROUPS, dtype=np.int32), point),
                    ],
                    names=["id", "n", "tokens", "point"],
                )

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, row, token in shingle_sets(batch.column(1)):
            n = np.bincount(row, minlength=to - at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), token.view(np.int64))],
                names=["id", "tokens"],
            )


def linked(overlap: Column, n_a: Column, n_b: Column) -> Column:
    return 100 * overlap >= PERCENT * (n_a + n_b - overlap)


def summed_minima(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def may_link(n_a: Column, pos_a: Column, n_b: Column, pos_b: Column) -> Column:
    """Whether two sets can link whose first common shingle, in order of rarity, has these places in them.

    No shingle before it is common, so the overlap is at most what is left from there on. A pair is found
    under its first common shingle at the latest, so other places need not be looked at.
    """
    return linked(F.least(n_a - pos_a, n_b - pos_b), n_a, n_b)


def candidates_of_hubs(lists: DataFrame) -> DataFrame:
    """``(a, b)``: the members of every list against its first and its last one."""
    pairs = lists.select("id", "n", "pos", F.explode(F.array("low", "high")).alias("hub")).where("id != hub.id")
    pairs = pairs.where(may_link(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos")))
    return pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def candidates_of_pages(lists: DataFrame, labels: DataFrame, points: DataFrame) -> DataFrame:
    """``(a, b)``: all pairs of different components that the pages of a list and the bounds leave over."""
    here = lists.select("token", "id", "n", "pos").join(labels, "id")
    mixed = here.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    here = here.join(mixed, "token").join(points.select("id", "point"), "id")
    order = Window.partitionBy("token").orderBy("n", "id")
    leaf = written(here.withColumn("page", F.floor((F.row_number().over(order) - 1) / PAGE)), "leaves")
    boxes = leaf.groupBy("token", "page").agg(
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("comp").alias("low"), F.max("comp").alias("high"),
        *[F.max(F.col("point")[g]).alias(f"m{g}") for g in range(GROUPS)],
    )
    boxes = boxes.select("token", "page", "n_min", "n_max", "low", "high", F.array(*[F.col(f"m{g}") for g in range(GROUPS)]).alias("top"))
    boxes = written(boxes, "boxes")
    p, q = boxes.alias("p"), boxes.alias("q")
    near = (
        (F.col("p.token") == F.col("q.token"))
        & (F.col("p.page") <= F.col("q.page"))
        & (100 * F.col("p.n_max") >= PERCENT * F.col("q.n_min"))
        & (F.least("p.low", "q.low") < F.greatest("p.high", "q.high"))
        # overlap * (100 + PERCENT) >= PERCENT * (n_a + n_b) holds for the least sizes of two pages too
        & ((100 + PERCENT) * summed_minima(F.col("p.top"), F.col("q.top")) >= PERCENT * (F.col("p.n_min") + F.col("q.n_min")))
    )
    pages = p.join(q, near).select(F.col("p.token").alias("token"), F.col("p.page").alias("page"), F.col("q.page").alias("q_page"))
    side = lambda x, page: leaf.select(
        "token", F.col("page").alias(page), *[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "pos", "comp", "point")]
    )
    left = pages.join(side("a", "page"), ["token", "page"])
    pairs = left.join(side("b", "q_page"), ["token", "q_page"]).where(
        ((F.col("page") < F.col("q_page")) | (F.col("id_a") < F.col("id_b")))
        & (F.col("comp_a") != F.col("comp_b"))
        & may_link(F.col("n_a"), F.col("pos_a"), F.col("n_b"), F.col("pos_b"))
        & linked(summed_minima(F.col("point_a"), F.col("point_b")), F.col("n_a"), F.col("n_b"))
    )
    return pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs that the summed coordinate minima do not rule out: ``(a, b, na, nb)``."""
    side = lambda x: points.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("point").alias(f"p{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    return near.where(linked(summed_minima(F.col("pa"), F.col("pb")), F.col("na"), F.col("nb"))).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among ``pairs (a, b, na, nb)``, by the whole sets of their texts."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
    sets = written(docs.join(small(ids), "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, tokens array<long>"), "sets")
    side = lambda x: sets.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(linked(F.size(F.array_intersect("ta", "tb")), F.col("na"), F.col("nb"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` per row of ``docs``."""
    spark = docs.sparkSession
    own = named(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    profile = written(own.mapInArrow(_profiles, PROFILE), "set-profiles")
    rows = profile.where("n IS NOT NULL").select("id", "n", "d1", "d2")
    counts = spark.sparkContext.broadcast(rarity(profile.where("page IS NOT NULL")))
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))
    classes = written(classes, "set-classes")
    # copies step aside: only the first document of each class is indexed
    copies = written(
        rows.where("id IS NOT NULL").join(classes, ["d1", "d2", "n"], "left").where("rep IS NULL OR rep != id").select("id").distinct(),
        "copies",
    )
    firsts = own.where("id IS NOT NULL").join(small(copies), "id", "left_anti").select("id", "text")
    signed = written(firsts.mapInArrow(_signer(counts), SIGNED), "signed-sets")
    points = signed.select("id", "n", "point")
    postings = signed.select("id", "n", F.posexplode("tokens").alias("pos", "token"))
    member = F.struct("id", "n", "pos")
    shared = postings.groupBy("token").agg(F.min(member).alias("low"), F.max(member).alias("high")).where("low.id < high.id")
    lists = written(postings.join(shared, "token"), "lists")
    labels = written(lists.select("id").distinct().withColumn("comp", F.col("id")), "labels")
    pairs = written(bounded(candidates_of_hubs(lists), points), "near-pairs")
    labels = join_components(labels, written(verified(pairs, firsts), "near-links"))
    rest = candidates_of_pages(lists, labels, points).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    pairs = written(bounded(rest, points), "near-pairs")
    labels = join_components(labels, written(verified(pairs, firsts), "near-links"))
    out = rows.join(classes, ["d1", "d2", "n"], "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    # rows that share an id share its component
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component: the one with the smallest id. Rows that share an
    id are one document, of which one row stays; rows without an id stay."""
    found = written(near_duplicates(docs, id_col, text_col), "components").withColumnRenamed(id_col, "id")
    per = found.where("id IS NOT NULL").groupBy("id").agg(F.min("component_id").alias("first"), F.count("*").alias("n"))
    per = written(per.where("first != id OR n > 1"), "not-alone")
    gone = per.where("first != id").select(F.col("id").alias(id_col))
    out = docs.join(small(gone), id_col, "left_anti").select(docs.columns)
    again = per.where("first = id AND n > 1").select(F.col("id").alias(id_col))
    if again.limit(1).count():  # only these rows meet to be told apart
        once = docs.join(small(again), id_col, "left_semi").select(docs.columns).dropDuplicates([id_col])
        out = out.join(small(again), id_col, "left_anti").select(docs.columns).unionByName(once)
    return out


def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))
