"""Token sequences of one length, packed by best-fit decreasing.

Every text is encoded and closed by an end id. What is longer than a sequence is first cut into full
sequences; the rest of each text, the longest first, goes into the fullest sequence that still has room,
which a segment tree over remaining room finds.

Only lengths decide where a piece goes, so pieces of one length are placed together: a sequence with room
``r`` takes ``r // length`` of them in turn, exactly as one at a time would. The input of the search is a
count per length (a window's worth of numbers, whatever the corpus), its result a *plan* that says for
each length which ranks go to which sequences at which offset. The plan is small: a sequence holds at most
``sqrt(2 * window)`` different lengths, and a length opens at most two groups of sequences and splits one,
so 1,024 ids need less than 150,000 rows at any number of documents. Pieces find their place by their rank
among pieces of the same length: a task numbers its own while it writes them, and each (task, length) starts
where the tasks before it end.

Defined results: a NULL text is an empty one and has its end id alone; NULL and repeated ids are kept, each
row is packed for itself; other columns are ignored; an empty table gives an empty result. Texts are encoded
by portions; a stretch without white space, and without a letter beside a digit, is encoded in one.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .common import named
from .stretches import WHITE_CHARS, Memory, portions, stretch_starts

#: Ids of a sequence.
WINDOW = 1024
#: New stretches that are encoded as one text: longer texts take the library more time for each.
TOGETHER = 100
#: The setting of how many rows Spark hands to Python at once: of whole texts, fewer than usual.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


# --- texts to pieces ---------------------------------------------------------


@lru_cache(maxsize=2)
def _memory(path: str) -> Memory:
    """Ids of stretches, as bytes of little-endian unsigned 32-bit numbers. No token reaches from a stretch
    into the white space after it, so the ids of a text are those of its stretches in turn."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    n_bytes = np.array([len(t.id_to_token(i) or "") for i in range(t.get_vocab_size())])  # a letter is a byte

    def ids(new: list[bytes]) -> list[bytes]:
        # stretches from white space to white space are encoded as texts of some each, and their ids told apart by bytes
        stretches = [s.decode() for s in new]
        inner = [s[0] in WHITE_CHARS and s[-1] not in WHITE_CHARS for s in stretches]
        among = [s for s, some in zip(stretches, inner) if some]
        joined = ["".join(among[at : at + TOGETHER]) for at in range(0, len(among), TOGETHER)]
        alone = [s for s, some in zip(stretches, inner) if not some]
        encodings = t.encode_batch_fast([*joined, *alone], add_special_tokens=False)
        together, others = encodings[: len(joined)], encodings[len(joined) :]
        own = np.fromiter(chain.from_iterable(e.ids for e in together), "<u4")
        stops = np.cumsum([len(s) for s, some in zip(new, inner) if some])
        cuts = [0, *(4 * (np.searchsorted(np.cumsum(n_bytes[own]), stops) + 1)).tolist()]
        raw = own.tobytes()
        of_inner, of_others = (raw[a:b] for a, b in zip(cuts, cuts[1:])), (np.array(e.ids, "<u4").tobytes() for e in others)
        return [next(of_inner if some else of_others) for some in inner]

    return Memory(ids)


def _ids_of(rows: list[bytes], memory: Memory) -> list[memoryview]:
    """The ids of each row of UTF-8: of its different stretches, put where these are."""
    ends = np.cumsum([len(r) for r in rows])
    begins = np.append(0, ends[:-1])
    data = b"".join(rows)
    if not data:
        return [memoryview(b"")] * len(rows)
    starts = stretch_starts(np.frombuffer(data, np.uint8), begins)
    offsets = pa.array(np.append(starts, len(data)), pa.int32()).buffers()[1]
    met = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
    (found,) = memory.each([met.dictionary.to_pylist()])
    ids = pa.array(found, pa.large_binary()).take(met.indices)
    _, where, raw = ids.buffers()
    where = np.frombuffer(where, np.int64, len(ids) + 1)
    low, high = where[np.searchsorted(starts, begins)].tolist(), where[np.searchsorted(starts, ends)].tolist()
    view = memoryview(raw)
    return [view[a:b] for a, b in zip(low, high)]


def encoded(texts: list[str | None], path: str, end_id: int, size: int = 1 << 21) -> list[bytes]:
    """The ids of each text with the end id, four bytes an id. About ``size`` code points are encoded together."""
    memory, parts = _memory(path), [[] for _ in texts]
    owners, rows, held = [], [], 0

    def flush() -> None:
        for owner, ids in zip(owners, _ids_of(rows, memory)):
            parts[owner].append(bytes(ids))
        owners.clear()
        rows.clear()

    for i, text in enumerate(texts):
        for portion in portions(text or ""):
            owners.append(i)
            rows.append(portion.encode())
            held += len(portion)
            if held > size:
                flush()
                held = 0
    flush()
    end = np.array([end_id], "<u4").tobytes()
    return [b"".join([*p, end]) for p in parts]


def _parts(batch: pa.RecordBatch, rows: int = 1 << 10, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of text."""
    n_bytes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = n_bytes[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(n_bytes, before + size))))
        yield batch.slice(at, to - at)
        at = to


def _cutter(path: str, window: int, end_id: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)  # pieces of each length that this task has written
        for batch in batches:
            for part in _parts(batch):
                ids = encoded(part.column(1).to_pylist(), path, end_id)
                tokens = np.array([len(x) // 4 for x in ids], np.int64)
                many = -(-tokens // window)
                row = np.repeat(np.arange(len(ids)), many)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * window
                length = np.minimum(window, tokens[row] - start)
                order = np.argsort(length, kind="stable")
                first = np.searchsorted(length[order], length[order])
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - first
                rank += seen[length]
                seen += np.bincount(length, minlength=window + 1)
                crc = [zlib.crc32(memoryview(ids[r])[4 * s : 4 * (s + n)]) for r, s, n in zip(row, start, length)]
                columns = {
                    "id": part.column(0).take(pa.array(row)),
                    "start": start,
                    "length": length,
                    "ids_crc32": crc,
                    "doc_tokens": tokens[row],
                    "task": np.full(len(row), task, np.int32),
                    "rank": rank,
                }
                if keep_ids:
                    own = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                    columns["ids"] = pa.ListArray.from_arrays(np.append(0, np.cumsum(length)).astype(np.int32), own)
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    return pieces


# --- the plan ----------------------------------------------------------------


class OpenSequences:
    """Groups of sequences ``(first, how many)`` by the room they have left, under a segment tree that finds the
    least room that suffices."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.some = [False] * (2 * self.size)  # whether there is a sequence under a node
        self.groups = [deque() for _ in range(window + 1)]

    def _mark(self, room: int) -> None:
        node = room + self.size
        self.some[node] = bool(self.groups[room])
        while node > 1:
            node //= 2
            self.some[node] = self.some[2 * node] or self.some[2 * node + 1]

    def add(self, room: int, first: int, many: int) -> None:
        if room and many:
            self.groups[room].append((first, many))
            self._mark(room)

    def take(self, need: int) -> tuple[int, int, int] | None:
        """``(room, first, many)`` of a group with the least room of at least ``need``, which leaves; None if there is none."""
        node = need + self.size
        if not self.some[node]:
            while node > 1 and (node % 2 or not self.some[node + 1]):  # up, until a right neighbour has some
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.some[2 * node])
        room = node - self.size
        group = self.groups[room].popleft()
        self._mark(room)
        return room, *group


#: A row of the plan: pieces of ``length`` with ranks from ``rank`` on go, ``each`` to a sequence, to the
#: sequences from ``sequence`` on, the first of them at ``offset``.
PLAN = ("length", "rank", "each", "sequence", "offset")


def best_fit(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """The plan, ordered by length and rank, that best-fit decreasing makes of ``counts`` pieces per length."""
    rows, open_, used = [], OpenSequences(window), 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def place(first: int, many: int, room: int, length: int = length) -> int:
            """Fill up to ``many`` sequences with ``room``; the number of sequences that got a piece."""
            nonlocal rank, left
            each = room // length
            full, rest = min(many, left // each), 0
            if full:
                rows.append((length, rank, each, first, window - room))
                open_.add(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < many:
                rest = 1
                rows.append((length, rank, left, first + full, window - room))
                open_.add(room - left * length, first + full, 1)
                rank, left = rank + left, 0
            return full + rest

        while left:
            found = open_.take(length)
            if found:
                room, first, many = found
                got = place(first, many, room)
                open_.add(room, first + got, many - got)
            else:
                used += place(used, left, window)
    return np.array(sorted(rows), np.int64).reshape(-1, len(PLAN))


def places(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, given by length and rank."""
    # rows of a length lie together, and ranks are searched among them
    low, high = np.searchsorted(plan[:, 0], length), np.searchsorted(plan[:, 0], length, "right")
    while (wide := high - low > 1).any():
        mid = (low + high) // 2
        right = wide & (plan[np.minimum(mid, len(plan) - 1), 1] <= rank)
        low, high = np.where(right, mid, low), np.where(wide & ~right, mid, high)
    _, first, each, sequence, offset = plan[low].T
    return sequence + (rank - first) // each, offset + (rank - first) % each * length


# --- the operator ------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    window: int = WINDOW,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """A row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` and, with ``keep_ids``,
    its ``ids``. ``tokenizer_path`` is a path that every executor can read, of a byte-level tokenizer without
    prefix space, whose tokens do not reach over white space into what follows it."""
    own = named(docs, id=id_col, text=text_col)
    schema = f"id {dict(own.dtypes)['id']}, start long, length long, ids_crc32 long, doc_tokens long, task int, rank long"
    cut = own.mapInArrow(_cutter(tokenizer_path, window, end_id, keep_ids), schema + (", ids array<int>" if keep_ids else ""))
    spark = docs.sparkSession
    rows = spark.conf.get(BATCH)
    spark.conf.set(BATCH, min(int(rows), 1024) if int(rows) > 0 else 1024)
    try:
        pieces = written(cut, "pieces")
    finally:
        spark.conf.set(BATCH, rows)
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    base = written(per_task.select("task", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-counts")
    counts = {r.length: r.n for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    plan = best_fit(counts, window)

    @F.pandas_udf("sequence_id long, offset long")
    def spot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("sequence_id", "offset"), places(plan, length.to_numpy(np.int64), rank.to_numpy(np.int64)))))

    at = pieces.join(base.drop("n"), ["task", "length"]).withColumn("spot", spot("length", F.col("rank") + F.col("base")))
    kept = [F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "spot.sequence_id", "spot.offset"]
    return at.select(*kept, *(["ids"] if keep_ids else []))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n_ids, ids)`` of pieces with their ``ids``: at most ``window`` pieces are put together, and
    padded to ``window`` unless their number of ids is a power of two."""
    together = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = together.select("sequence_id", F.flatten("p.ids").alias("ids")).withColumn("n_ids", F.size("ids"))
    whole = F.expr("n_ids & (n_ids - 1)") == 0
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.when(whole, 0).otherwise(window - F.col("n_ids"))))
    return joined.select("sequence_id", "n_ids", padded.alias("ids"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document packed into sequences of 1,024 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
