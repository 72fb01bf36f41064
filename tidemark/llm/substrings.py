"""Substring deduplication by sliding spans of sentences.

Texts are cut into sentences (after ``. ! ?`` at the end of a word, and at line ends; a sentence of more
than ``PIECE`` words into pieces of that many). ``by_content`` also cuts within sentences, at gaps that the
words around them choose: where a hash of the two words at the gap is least among the gaps ``NEAR`` words
about, ``EDGE`` words or more from the sentence's ends. Such cuts fall alike wherever a passage begins, so a
repeat is found in the middle of a sentence too. Every run of at least ``RUN`` consecutive sentences with at
least ``LEAST`` words is hashed, over words without regard to white space and the case of A-Z. All runs
are joined globally by hash; of equal runs the first, in order of id and place, stays, and every sentence
that any other one covers is removed. The rest of each text is kept as it is.

Defined results: NULL stays NULL, texts without runs stay as they are; rows that repeat another one's id
and text count as the same text and get the same result; NULL ids come first in order; other columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import grams_of, mix, named, text_slices, words_of

RUN = 3
LEAST = 15
PIECE = 16
#: Cuts by content: gaps on each side that are compared, and words that stay together at a sentence's ends.
NEAR, EDGE = 2, 4
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_Q = np.uint64(0xD1342543DE82EF95)
_Q_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _chosen(word: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each word whether the text before and after it chooses a cut in front of it; ``begin`` as in :func:`sentences`."""
    m = len(word)
    place, length = np.arange(m), np.diff(begin)
    none = np.iinfo(np.uint64).max
    gap = np.full(m + 2 * NEAR, none, np.uint64)
    gap[NEAR + 1 : NEAR + m] = grams_of(word, np.array([0, m]), 2)[0][: m - 1]
    inner = (place - np.repeat(begin[:-1], length) >= EDGE) & (np.repeat(begin[1:], length) - place >= EDGE)
    gap[NEAR : NEAR + m][~inner] = none
    here, least = gap[NEAR : NEAR + m], inner
    for d in range(1, NEAR + 1):
        least = least & (here <= gap[NEAR - d : NEAR - d + m]) & (here <= gap[NEAR + d : NEAR + d + m])
    return least


def sentences(data: np.ndarray, offsets: np.ndarray, by_content: bool = False) -> tuple[np.ndarray, ...]:
    """Sentences of the texts of one slice: ``(word hashes, word starts, word ends, first word of each sentence,
    first sentence of each text)``; the last two have one entry more."""
    word, start, end, first = words_of(data, offsets)
    m = len(word)
    if not m:
        return word, start, end, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    cut = np.zeros(m + 1, bool)
    cut[1:m] = _ENDS[data[end[:-1] - 1]] | (lines[start[1:]] > lines[end[:-1]])
    cut[first] = True
    cut[m] = True
    begin = np.flatnonzero(cut)
    if by_content:
        cut[:m] |= _chosen(word, begin)
        begin = np.flatnonzero(cut)
    # long sentences: a cut after every PIECE words, counted from their first (or from the last cut by content)
    since = np.arange(m) - np.repeat(begin[:-1], np.diff(begin))
    cut[:m] |= since % PIECE == 0
    begin = np.flatnonzero(cut)
    return word, start, end, begin, np.searchsorted(begin, first)


def runs(word: np.ndarray, begin: np.ndarray, of_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first sentence, sentence after the last, hash)`` of every run: the shortest ones, from each sentence on."""
    n = len(begin) - 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    s = np.arange(n)
    stop = np.maximum(s + RUN, np.searchsorted(begin, begin[:-1] + LEAST))
    last = of_text[np.searchsorted(of_text, s, "right")]  # where the text ends
    s, stop = s[stop <= last], stop[stop <= last]
    m = len(word)
    up, down = np.full(m + 1, _Q, np.uint64), np.full(m + 1, _Q_INVERSE, np.uint64)
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * up[:m])])
    a, b = begin[s], begin[stop]
    return s, stop, mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))


def _hashed(by_content: bool):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in text_slices(batch.column(2)):
                word, _, _, begin, of_text = sentences(data, offsets, by_content)
                s, _, h = runs(word, begin, of_text)
                text = np.searchsorted(of_text, s, "right") - 1
                split = np.searchsorted(text, np.arange(to - at + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        batch.column(1).slice(at, to - at),
                        pa.ListArray.from_arrays(split, h.view(np.int64)),
                        pa.ListArray.from_arrays(split, (s - of_text[text]).astype(np.int32)),
                    ],
                    names=["id", "mark", "runs", "places"],
                )

    return hashed


def _cut(by_content: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts without the sentences of the runs that begin at ``places``; NULL places: nothing to remove."""
        for batch in batches:
            places = batch.column(2)
            texts, removed = [], []
            for at, to, data, offsets in text_slices(batch.column(1)):
                word, start, end, begin, of_text = sentences(data, offsets, by_content)
                s, stop, _ = runs(word, begin, of_text)
                for i in range(to - at):
                    text = batch.column(1)[at + i].as_py()
                    if not places[at + i].is_valid:
                        texts.append(text)
                        removed.append(0)
                        continue
                    gone = np.zeros(of_text[i + 1] - of_text[i] + 1, np.int64)
                    k = np.searchsorted(s, of_text[i] + np.array(places[at + i].as_py()))
                    np.add.at(gone, s[k] - of_text[i], 1)
                    np.add.at(gone, stop[k] - of_text[i], -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    parts, raw = [], data[offsets[i] : offsets[i + 1]].tobytes()
                    for j in np.flatnonzero(~gone):
                        # a kept sentence with the white space after it
                        a = start[begin[of_text[i] + j]] - offsets[i]
                        nxt = of_text[i] + j + 1
                        b = start[begin[nxt]] - offsets[i] if nxt < of_text[i + 1] else len(raw)
                        parts.append(raw[a:b])
                    texts.append(b"".join(parts).decode())
                    removed.append(int(gone.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int32())], names=["id", "text", "n_removed"]
            )

    return cut


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_content: bool = False) -> DataFrame:
    """``(id, text, n_removed)`` per row of ``docs``: the text that is left and how many sentences (or pieces) went.

    Without ``by_content``, repeats are looked for only from the beginnings of sentences on.
    """
    own = named(docs, id=id_col, text=text_col)
    marked = own.select("id", F.xxhash64("text").alias("mark"), "text")
    kind = dict(own.dtypes)["id"]
    hashed = written(marked.mapInArrow(_hashed(by_content), f"id {kind}, mark long, runs array<long>, places array<int>"), "sentence-runs")
    spans = hashed.where(F.size("runs") > 0).select("id", "mark", F.explode(F.arrays_zip("runs", "places")).alias("r"))
    spans = spans.select("id", "mark", F.col("r.runs").alias("run"), F.col("r.places").alias("place"))
    order = F.struct("id", "mark", "place")
    repeated = spans.groupBy("run").agg(F.min(order).alias("kept"), F.count("*").alias("often")).where("often > 1").select("run", "kept")
    # a table of its own, so that a run which very many texts have is split by the join
    repeated = written(repeated, "repeated-runs")
    gone = spans.join(repeated, "run").where(F.struct("id", "mark", "place") > F.col("kept"))
    gone = gone.groupBy("id", "mark").agg(F.array_sort(F.collect_set("place")).alias("places"))
    left = marked.alias("a").join(
        gone.alias("b").hint("shuffle_hash"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.mark") == F.col("b.mark")), "left"
    )
    cut = left.select("a.id", "text", "places").mapInArrow(_cut(by_content), f"id {kind}, text string, n_removed int")
    return cut.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_removed")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without passages that an earlier place already has."""
    cut = without_repeats(spark.read.parquet(f"{folder}/documents.parquet"), by_content=True)
    return cut.select("doc_id", "text", "n_removed", F.length("text").cast("long").alias("n_chars"))
