"""Fill-in-the-middle texts: a text is cut into prefix, middle and suffix at two of its units.

One ``fullmatch`` of ``(unit)*`` keeps every repetition of the group, so ``ends(1)`` holds the number of
units and the offset behind each of them. Where the two cuts lie, and which form a text takes, follows
from a digest of its id alone; a rerun on any partitioning gives the same rows.

Defined results: a NULL text is an empty one; an empty text, and one that holds a mark, stays plain; a NULL
id draws like an empty one; repeated rows each get their row, rows of one id draw alike; other columns are
ignored; an empty table gives an empty result. A text is matched by portions of ``SPAN`` code points that
end where a unit ends, so memory beside a very long text is its offsets at four bytes a unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a portion.
SPAN = 1 << 16
# possessive, so that no way back is remembered: a unit that was taken is never given up
_UNITS = regex.compile("([A-Za-z]++|[^A-Za-z])*+")
_LETTERS = re.compile("[A-Za-z]*")


def unit_ends(text: str) -> np.ndarray:
    """Offsets behind the units of ``text``, in code points, after a 0: entry ``k`` is where ``k`` units end."""
    parts, at = [np.zeros(1, np.int32)], 0
    while at < len(text):
        to = _LETTERS.match(text, min(len(text), at + SPAN)).end()  # letters that go on belong to the portion
        parts.append(np.array(_UNITS.fullmatch(text, at, to).ends(1), np.int32))
        at = to
    return np.concatenate(parts)


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits per id, from the digest of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _cutter(percent: int, suffix_first: int):
    def rearranged(text: str, h: tuple[int, int, int, int]) -> tuple:
        ends = unit_ends(text)
        n = len(ends) - 1
        if not text or h[2] % 100 >= percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
            return n, "plain", None, None, text
        a, b = (int(ends[k]) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        before, middle, after = text[:a], text[a:b], text[b:]
        if h[3] % 100 < suffix_first:
            return n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"

    def cut(batches: Iterator[pa.RecordBatch], step: int = 64) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), step):  # few texts at a time are Python strings
                part = batch.slice(at, step)
                numbers = zip(*(part.column(k).to_pylist() for k in range(2, 6)))
                rows = list(zip(*map(rearranged, part.column(1).to_pylist(), numbers)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, rows, kinds)],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return cut


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, suffix_first: int = 20, seed: int = 1
) -> DataFrame:
    """``(id, n, form, prefix_chars, middle_chars, output)`` per row of ``docs``.

    Of the texts, ``percent`` in a hundred are rearranged, and of those ``suffix_first`` in a hundred have
    the suffix before the prefix (form ``spm``, else ``psm``); the others are ``plain`` and unchanged.
    ``n`` counts the units: runs of ASCII letters, and every other code point.
    """
    own = named(docs, id=id_col, text=text_col)
    drawn = own.select("id", F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("id"), seed))
    kind = dict(own.dtypes)["id"]
    cut = drawn.mapInArrow(
        _cutter(percent, suffix_first),
        f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )
    return cut.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. A rearranged text holds each mark once, and no other can arise
    where parts meet, as no mark begins with the end of another."""

    def between(start: str, stop: str | None) -> Column:
        rest = F.substring_index(output, start, -1)
        return F.substring_index(rest, stop, 1) if stop else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document rearranged, with digests of the result and of the text that is rebuilt from it."""
    cut = fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS k2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
  FROM units
), cut AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(u[1:least(k1, k2)], ''), '') AS a,
         coalesce(array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], ''), '') AS b,
         coalesce(array_to_string(u[greatest(k1, k2) + 1:], ''), '') AS c
  FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
