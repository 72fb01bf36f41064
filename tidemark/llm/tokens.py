"""Token counts through a digest cache.

Texts are normalised without changing their count, addressed by digest and looked up in a table of
counts keyed by ``(digest, tokenizer version)``. Only digests that the table lacks are encoded, each
once, and appended to it.

Defined results: a NULL text counts as empty (0 tokens); repeated rows each get their row; ids may be
NULL or repeated; other columns of the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .common import first_rows, named, one_text_per_digest

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def normalised(text: Column, drops_white_space: bool) -> Column:
    """The form that is digested. A tokenizer that drops white space counts a run of it like one space."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if drops_white_space else text


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


#: Code points of the stretches whose counts a task remembers; the memory starts anew when it is full. Stretches
#: longer than LONG are counted each time.
REMEMBERED, LONG = 1 << 22, 64
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def _counter(path: str, drops_white_space: bool, step: int = 64):
    held = 0

    def lengths(tokenizer, texts: list[str]) -> list[int]:
        return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def by_stretch(tokenizer, texts: list[str], memory: dict[str, int]) -> list[int]:
        """No token reaches over white space, so a text's count is the sum over its stretches between it."""
        nonlocal held
        rows = [_SPACES.split(t) for t in texts]
        if held > REMEMBERED:
            memory.clear()
            held = 0
        new = list({w for row in rows for w in row}.difference(memory))
        memory.update(zip(new, lengths(tokenizer, new)))
        counts = [sum(map(memory.__getitem__, row)) for row in rows]
        for w in new:
            if len(w) > LONG:
                del memory[w]
            else:
                held += len(w)
        return counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        tokenizer, memory = _tokenizer(path), {}
        for batch in batches:
            counts: list[int] = []
            for at in range(0, len(batch), step):  # few texts at a time: their encodings are large
                texts = batch.column(1).slice(at, step).to_pylist()
                counts += by_stretch(tokenizer, texts, memory) if drops_white_space else lengths(tokenizer, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"]
            )

    return count


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; an absent or empty folder is an empty cache."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    drops_white_space: bool = True,
) -> DataFrame:
    """``(id, n_bytes, n_tokens)`` per row of ``docs``; missing counts are added to ``cache_path``.

    ``drops_white_space`` says that the tokenizer ignores white space and forms no token over it.
    ``tokenizer_path`` is a path that every executor can read.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    own = named(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = own.select(
        "id",
        F.unhex(F.sha2(normalised(F.col("text"), drops_white_space), 256)).alias("digest"),
        F.xxhash64("text").alias("mark"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )
    keyed = written(keyed, "digests")
    stored = read_cache(spark, cache_path).where(F.col("version") == version)
    wanted = first_rows(keyed).join(stored, "digest", "left_anti")
    # white space that changes no count needs no removing before the count
    counted = one_text_per_digest(own, wanted).mapInArrow(_counter(tokenizer_path, drops_white_space), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    # a row that a repeated id wrote twice, or that two runs added, counts once
    known = read_cache(spark, cache_path).where(F.col("version") == version)
    # a table of its own, so that rows of a text which very many have are split by the join
    known = written(known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known-counts")
    return keyed.join(known, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens"
    )


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document under the 49k word tokenizer, through a cache that starts empty."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
