"""Benchmark decontamination: rare n-gram seeds and Smith-Waterman alignment over words.

The seeds of a test item are its rarest words (n-grams of one word, rare by how many items have them; case
and ASCII punctuation do not count), as many as the threshold allows to be missing and SEEDS more: an edited
copy that reaches the threshold has at least SEEDS of them, wherever it was edited. Seeds are counted in
windows that hold every stretch as long as an alignment can be; a window with that many of an item's seeds is
a candidate. Its stretches that have enough of the item's words for the threshold (a bound
that no alignment exceeds) are aligned with the whole item: local alignment, words as letters, so that
replaced, dropped and added words cost little. The score is the share of the best possible alignment score.
Every pair that reaches the threshold is found, whatever words it has in common.

The test items are taken in blocks of bounded size, each against all texts.

Defined results: NULL or word-less texts and items match nothing; items of one or two words are looked
for as a whole; repeated rows count each; NULL ids are kept as ids; other columns are ignored; with an
empty table on either side nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import named, text_slices, words_of

#: Seeds that a candidate has at least (all words of an item that matches with fewer).
SEEDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignment score, as a share of a perfect one, from which a text counts as contaminated.
THRESHOLD = 0.5
#: Words of the items of one block: what a task holds of the benchmark at a time.
BLOCK_WORDS = 500_000


def words_in(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text."""
    out = []
    for at, to, data, offsets in text_slices(pa.array(texts, pa.string())):
        word, _, _, first = words_of(data, offsets, marks=False)
        out += [word[first[i] : first[i + 1]] for i in range(to - at)]
    return out


class Items:
    """The items of a block, their seeds and how often they have each word."""

    def __init__(self, words: list[np.ndarray], threshold: float):
        self.words = words
        self.bag = [np.unique(w, return_counts=True) for w in words]
        length = np.array([len(w) for w in words])
        # the score that counts, the matches that it takes, and the words of text that an alignment of it spans at most
        self.least = np.maximum(1, np.ceil(threshold * MATCH * length - 1e-9)).astype(np.int64)
        self.matches = -(-self.least // MATCH)
        self.span = length + np.maximum(0, MATCH * length - self.least) // min(-MISMATCH, -GAP)

        self.need = np.minimum(SEEDS, self.matches)
        #: Items by width, the power of two that their span fits into: ``(width, seeds, begin, item, often)``, the
        #: postings ``(item, how often)`` of seed ``k`` at ``begin[k]:begin[k + 1]``.
        self.classes = []
        vocabulary, held = np.unique(np.concatenate([w for w, _ in self.bag]), return_counts=True) if self.bag else (None, None)
        width = 1 << np.ceil(np.log2(np.maximum(1, self.span))).astype(np.int64)
        for size in np.unique(width[length > 0]).tolist():
            word, item, often = [], [], []
            for i in np.flatnonzero((width == size) & (length > 0)):
                w, n = self.bag[i]
                order = np.lexsort((w, held[np.searchsorted(vocabulary, w)]))
                w, n = w[order], n[order]
                # the rarest words, counted as often as they occur, up to those that may be missing and `need` more
                taken = np.clip(length[i] - self.matches[i] + self.need[i] - (np.cumsum(n) - n), 0, n)
                word.append(w[taken > 0])
                often.append(taken[taken > 0])
                item.append(np.full(len(often[-1]), i))
            word, item, often = np.concatenate(word), np.concatenate(item), np.concatenate(often)
            order = np.lexsort((item, word))
            seeds, begin = np.unique(word[order], return_index=True)
            self.classes.append((size, seeds, np.append(begin, len(word)), item[order], often[order]))

    def windows(self, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """``(text, item, begin, end)`` of every window of a text, in words, that has as many of an item's seeds as it
        needs. Windows are two widths long and begin at every width, so that each stretch of a width lies in one."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place = np.arange(len(word)) - first[text]
        for width, seeds, begin, item, often in self.classes:
            seed = np.minimum(np.searchsorted(seeds, word), len(seeds) - 1)
            at = np.flatnonzero(seeds[seed] == word)
            cells = int(place[at].max(initial=0)) // width + 1
            cell = text[at] * cells + place[at] // width
            inner = place[at] >= width  # the first cell of a text ends no window
            key = np.concatenate([cell, cell[inner] - 1]) * len(seeds) + np.concatenate([seed[at], seed[at][inner]])
            key, count = np.unique(key, return_counts=True)
            cell, seed = key // len(seeds), key % len(seeds)
            low, n = begin[seed], begin[seed + 1] - begin[seed]
            entry = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pair, back = np.unique(np.repeat(cell, n) * len(self.words) + item[entry], return_inverse=True)
            found = np.bincount(back, weights=np.minimum(np.repeat(count, n), often[entry]), minlength=len(pair))
            pair = pair[found >= self.need[pair % len(self.words)]]
            cell, which = pair // len(self.words), pair % len(self.words)
            start = cell % cells * width
            yield from zip((cell // cells).tolist(), which.tolist(), start.tolist(), (start + 2 * width).tolist())

    def stretches(self, item: int, text: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of the text that hold every alignment with the item of at least the threshold: those of ``span``
        words with at least ``matches`` of the item's, each word as often as the item has it at most."""
        bag, often = self.bag[item]
        at = np.minimum(np.searchsorted(bag, text), len(bag) - 1)
        pos = np.flatnonzero(bag[at] == text)
        need, span = int(self.matches[item]), int(self.span[item])
        if len(pos) < need:
            return []
        kind = at[pos]
        order = np.argsort(kind, kind="stable")
        pos, kind = pos[order], kind[order]
        # a word counts in a stretch that does not have it as often as the item before this place
        back = np.arange(len(pos)) - often[kind]
        full = (back >= 0) & (kind[back] == kind)
        since = np.maximum(pos - span + 1, np.where(full, pos[back] + 1, 0))
        n = len(text)
        change = np.bincount(np.maximum(since, 0), minlength=n + 1) - np.bincount(pos + 1, minlength=n + 1)
        begin = np.flatnonzero(np.cumsum(change)[:n] >= need)
        if not len(begin):
            return []
        new = np.flatnonzero(np.diff(begin) > span) + 1
        return list(zip(begin[np.concatenate([[0], new])].tolist(), (begin[np.append(new, len(begin)) - 1] + span).tolist()))

    def score(self, item: int, text: np.ndarray) -> float:
        """Best score of the item in the text if it reaches the threshold, else 0."""
        best = max((alignment(self.words[item], text[a:b]) for a, b in self.stretches(item, text)), default=0)
        return best / (MATCH * len(self.words[item])) if best >= self.least[item] else 0.0


def alignment(item: np.ndarray, text: np.ndarray) -> int:
    """Best local alignment score of two rows of words."""
    ramp = -GAP * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    best = 0
    for w in item:
        here = np.zeros(len(text) + 1, np.int64)
        np.maximum(above[:-1] + np.where(text == w, MATCH, MISMATCH), above[1:] + GAP, out=here[1:])
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + ramp) - ramp  # gaps along the text
        best = max(best, int(here.max()))
        above = here
    return best


def _scores(items: Items, column: pa.Array) -> dict[tuple[int, int], float]:
    """Best score by row and item, of those that reach the threshold."""
    best: dict[tuple[int, int], float] = {}
    for at, _, data, offsets in text_slices(column):
        word, _, _, first = words_of(data, offsets, marks=False)
        for r, i, a, b in items.windows(word, first):
            score = items.score(i, word[first[r] : first[r + 1]][a:b])
            if score > best.get((at + r, i), 0.0):
                best[at + r, i] = score
    return best


def _finder(block, threshold: float):
    """Scores of the texts and items of a block that reach the threshold."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block.value, threshold)
        for batch in batches:
            best = _scores(items, batch.column(1))
            if best:
                rows, which = zip(*best)
                columns = [batch.column(0).take(pa.array(rows)), pa.array(which, pa.int32()), pa.array(best.values(), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "item", "score"])

    return find


def _keeper(block, threshold: float, text_col: str):
    """The rows, all columns, that hold no item of a block."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block.value, threshold)
        for batch in batches:
            clean = np.ones(len(batch), bool)
            clean[[r for r, _ in _scores(items, batch.column(text_col))]] = False
            yield batch.filter(pa.array(clean))

    return keep


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """``(item ids, word hashes)`` of blocks of at most BLOCK_WORDS words (or one item)."""
    ids, words, total = [], [], 0
    for r in items.toLocalIterator():
        (w,) = words_in([r["text"]])
        if ids and total + len(w) > BLOCK_WORDS:
            yield ids, words
            ids, words, total = [], [], 0
        ids.append(r["item"])
        words.append(w)
        total += len(w)
    if ids:
        yield ids, words


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(id, item, score)``: pairs of a text and a test item that it holds, with the best score of the pair."""
    spark = docs.sparkSession
    own = named(docs, id=id_col, text=text_col)
    items = named(benchmark, item=item_col, text=item_text_col)
    kind, item_kind = dict(own.dtypes)["id"], dict(items.dtypes)["item"]
    parts = []
    for ids, words in _blocks(items):
        block = spark.sparkContext.broadcast(words)
        hits = own.mapInArrow(_finder(block, threshold), f"id {kind}, item int, score double").where(F.col("score") >= threshold)
        hits = written(hits.groupBy("id", "item").agg(F.max("score").alias("score")), "contaminated")
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_name {item_kind}")
        parts.append(hits.join(F.broadcast(names), "item").select(F.col("id").alias(id_col), F.col("item_name").alias(item_col), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{id_col}` {kind}, `{item_col}` {item_kind}, score double")
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that hold a test item, whatever their ids."""
    items = named(benchmark, item=item_text_col, text=item_text_col)
    for _, words in _blocks(items):
        docs = docs.mapInArrow(_keeper(docs.sparkSession.sparkContext.broadcast(words), threshold, text_col), docs.schema)
    return docs


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold items of the benchmark, exactly or edited."""
    return contaminated(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
