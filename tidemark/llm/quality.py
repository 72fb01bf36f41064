"""Quality classifier: hashed subword embeddings, averaged per document, with a softmax output.

Features are a document's words, its runs of three and four bytes, hashed into buckets, and whether words
repeat the one before; each bucket
has a learned vector, a document is the mean of its vectors, and a linear softmax layer gives the label.
Plain numpy stochastic gradient descent fits vectors and layer on a bounded sample of labelled rows
(``TRAIN_ROWS``, those with the smallest hash of their id); every document is scored on its whole text.

Defined results: NULL and empty texts get the score of the bias alone; NULL ids are not held out and
have no label; a label given twice counts as its larger value; without labels of both kinds the score is
the share of label 1 (0.5 without any); other input columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, text_slices, words_of

BUCKETS = 1 << 16  # half for words, half for runs of bytes
REPEATS = BUCKETS - 2  # and the one after it
DIM = 16
TRAIN_ROWS = 3000
#: Documents seen by the descent, however few there are to learn from.
STEPS = 30_000
RATE = 2.0
ACCEPT = 0.7


def features_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, text)`` of all features of a slice, one kind after the other."""
    half = np.uint64(BUCKETS // 2 - 1)
    word, _, _, first = words_of(data, offsets, lower=False)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    yield (word & half).astype(np.int32), text
    # pairs of words by their shape alone: does a word repeat the one before?
    yield np.where(word[1:] == word[:-1], REPEATS, REPEATS + 1)[text[1:] == text[:-1]].astype(np.int32), text[1:][text[1:] == text[:-1]]
    at = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for size in (3, 4):
        m = len(data) - size + 1
        if m <= 0:
            continue
        run = data[:m].astype(np.uint32)
        for k in range(1, size):
            run = (run << np.uint32(8)) | data[k : m + k]
        whole = at[:m] == at[size - 1 :]
        run = run[whole] * np.uint32(0x9E3779B1) + np.uint32(size)
        run ^= run >> np.uint32(15)
        run *= np.uint32(0x85EBCA77)
        yield ((run >> np.uint32(17)) + np.uint32(BUCKETS // 2)).astype(np.int32), at[:m][whole]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training rows: label, distinct buckets and their shares of the document's features."""
    for batch in batches:
        for at, to, data, offsets in text_slices(batch.column(1)):
            found = list(features_of(data, offsets))
            bucket, row = np.concatenate([b for b, _ in found]), np.concatenate([r for _, r in found])
            for i in range(to - at):
                ids, n = np.unique(bucket[row == i], return_counts=True) if to - at > 1 else np.unique(bucket, return_counts=True)
                share = (n / max(1, n.sum())).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at + i, 1), pa.array([ids.astype(np.int32).tobytes()]), pa.array([share.tobytes()])],
                    names=["label", "ids", "share"],
                )


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on ``(label, buckets, shares)``. Returns what a bucket adds to the logit of
    label 1 against label 0, and the bias: with the layer fixed, a mean of vectors is a mean of these."""
    labels = np.array([y for y, _, _ in rows])
    if len(set(labels.tolist())) < 2:
        share = min(max(labels.mean(), 1e-6), 1 - 1e-6) if len(rows) else 0.5
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(5, -(-STEPS // len(rows)))
    total, seen = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, ids, share = rows[i]
            rate = RATE * (1 - seen / total)
            seen += 1
            mean = share @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            vectors[ids] -= (rate * len(ids) ** 0.5) * share[:, None] * back[None, :]
    side = layer[:, 1] - layer[:, 0]
    return (vectors @ side).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most ``rows`` labelled documents: ``docs (id, text)``, ``labels (id, label)``."""
    sample = labels.where("id IS NOT NULL AND label IS NOT NULL").groupBy("id").agg(F.max("label").cast("int").alias("label"))
    sample = sample.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.join(F.broadcast(sample), "id")  # `rows` rows of two numbers
    # one text per id, combined before the shuffle: however many rows share an id, `rows` are collected
    one = F.min(F.struct(F.xxhash64("text").alias("mark"), "text"))["text"].alias("text")
    texts = texts.groupBy("id", "label").agg(one).select("label", "text")
    found = texts.mapInArrow(_counted, "label int, ids binary, share binary").toPandas()
    found = sorted(zip(found["label"], found["ids"], found["share"]), key=lambda r: (r[0], r[1]))
    return fit([(int(y), np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for y, i, s in found])


def _scores(model, column: pa.Array) -> np.ndarray:
    weight, bias = model.value
    scores = np.empty(len(column))
    for at, to, data, offsets in text_slices(column):
        total, n = np.zeros(to - at), np.zeros(to - at)
        for bucket, row in features_of(data, offsets):
            total += np.bincount(row, weights=weight[bucket], minlength=to - at)
            n += np.bincount(row, minlength=to - at)
        z = bias + total / np.maximum(n, 1)
        scores[at:to] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return scores


def _scorer(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1)))], names=["id", "score"])

    return score


def _chooser(model, text_col: str):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(text_col)) >= ACCEPT))

    return choose


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _model(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    known = named(labels, id=id_col, label=label_col).where(~held_out(F.col("id")))
    fitted = train(named(docs, id=id_col, text=text_col), known)
    return docs.sparkSession.sparkContext.broadcast(fitted)  # BUCKETS numbers and a bias


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``(id, held_out, score, predicted)`` per row of ``docs``; ``labels`` has the ids and labels."""
    own = named(docs, id=id_col, text=text_col)
    scored = own.mapInArrow(_scorer(_model(docs, labels, id_col, text_col, label_col)), f"id {dict(own.dtypes)['id']}, score double")
    return scored.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier accepts."""
    return docs.mapInArrow(_chooser(_model(docs, labels, id_col, text_col, label_col), text_col), docs.schema)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
