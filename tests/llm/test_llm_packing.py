"""Packing against one piece at a time, and against the library's own ids."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tidemark.llm import packing
from tidemark.llm.stretches import STRETCH, Memory, portions, stretch_starts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [*"ab Z1 9\n\t  .,'s!?é日本  \x85\x1c\x1f\x0b​<|>", "<|endoftext|>", "'re", " the", "\n\n", "á"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def one_at_a_time(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if not fit:
            fit = [(window, len(rooms))]
            rooms.append(window)
        rooms[min(fit)[1]] -= n
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 50, 64])
    choice = range(1, window + 1) if seed % 3 else [1, 2, window // 2, window // 3 + 1]
    lengths = [rng.choice(choice) for _ in range(rng.randint(0, 200))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit(counts, window)
    inside = {}
    for n, many in counts.items():
        for sequence, offset in zip(*packing.places(plan, np.full(many, n), np.arange(many))):
            inside.setdefault(int(sequence), []).append((int(offset), n))
    rooms = []
    for pieces in inside.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at  # no gap and no overlap
            at += n
        rooms.append(window - at)
    assert sorted(rooms) == one_at_a_time(lengths, window)
    assert sorted(inside) == list(range(len(inside)))


def test_plan_does_not_grow_with_the_number_of_pieces():
    rng = random.Random(3)
    few = {n: rng.randint(1, 50) for n in range(1, 1025)}
    many = {n: k * 10**9 + rng.randint(0, 99) for n, k in few.items()}
    assert len(packing.best_fit(many)) < 150_000
    assert packing.best_fit({}).shape == (0, 5)


def test_ids_are_the_library_s(library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [None, "", "x1y2" * 50_000 + " z" * 90_000 + "<|endoftext|>", "a" * 3000]
    got = packing.encoded(texts, PATH, 0)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library(t) for t in texts]


def test_memory_forgets():
    asked = []
    memory = Memory(lambda new: asked.extend(new) or [s.upper().encode() for s in new], limit=50)
    for i in range(100):
        assert memory.recall([[f"w{i}", "x" * 100], [], ["x" * 100, "y", "y"]]) == [f"W{i}".encode() + b"X" * 100, b"", b"X" * 100 + b"YY"]
        assert "x" * 100 not in memory and memory.held <= 60
    assert asked.count("x" * 100) == 100 and asked.count("y") < 20
    assert list(portions("ab cd ef", 3)) == ["ab cd", " ef"] and "".join(portions("a" * 50, 3)) == "a" * 50
    assert STRETCH.findall(" a\n\nb c  ") == [" a", "\n\nb", " c", "  "]


def test_memory_keeps_frequent_stretches_and_few_others():
    asked = []
    memory = Memory(lambda new: asked.extend(new) or [b"1234"] * len(new), limit=800)
    for i in range(1000):
        assert memory.recall([["often", f"w{i}"]]) == [b"12341234"]
        assert len(memory) + len(memory.old) <= 210
    assert asked.count("often") == 1 and len(asked) == 1001
    memory = Memory(lambda new: [b"1234"] * len(new))
    for i in range(0, 1_200_000, 10_000):
        memory.recall([[f" {j:x}" for j in range(i, i + 10_000)]])
    assert len(memory) + len(memory.old) < 600_000


def test_stretches_end_before_white_space_only():
    rng = random.Random(4)
    texts = ["".join(rng.choice([*ODD, "\u1680", "\u2000", "\u200a\u2028", "\u3000", "\xa0", "à", "\u2085"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    begins = np.cumsum([0, *map(len, raw[:-1])])
    data = b"".join(raw)
    starts = stretch_starts(np.frombuffer(data, np.uint8), begins).tolist()
    finest = {b + len(t[: m.start()].encode()) for b, t in zip(begins.tolist(), texts) for m in STRETCH.finditer(t)}
    assert set(starts) <= finest | {b for b, r in zip(begins.tolist(), raw) if r}
    assert finest - set(starts) <= {x for x in finest if data[x : x + 1] not in b" \t\n\r\x0b\x0c"}


def rows_of(packed):
    return [r.asDict() for r in packed.collect()]


def test_pack(spark, library):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "x9", "é"]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(120)]
    texts += [None, "", texts[0], texts[0], "word " * 5000]
    rows = [(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)] + [(1, texts[1], "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, sequence_id int").repartition(5)
    got = rows_of(packing.pack(docs, PATH, window=64))
    by_doc = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) <= 64
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        pieces = sorted(by_doc[i if i != 3 else None], key=lambda r: (r["start"], r["sequence_id"]))
        ids = [x for r in pieces for x in r["ids"]]
        want = library(text)
        assert ids == want if i != 1 else sorted(ids) == sorted(want * 2)
        assert all(r["doc_tokens"] == len(want) for r in pieces)
    inside = {}
    for r in got:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    assert sorted(inside) == list(range(len(inside)))
    for pieces in inside.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(p[1] for p in x) for x in inside.values()) == one_at_a_time([r["length"] for r in got], 64)
    whole = {r.sequence_id: r for r in packing.sequences(packing.pack(docs, PATH, window=64), 64).collect()}
    assert len(whole) == len(inside)
    for r in whole.values():
        n = r.n_ids
        assert len(r.ids) == (n if n & (n - 1) == 0 else 64) and not any(r.ids[n:])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    packed = packing.pack(docs, PATH)
    assert packed.count() == 0 and packing.sequences(packed).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = rows_of(packing.op11_packing(spark, folder))
    assert {r["doc_id"] for r in got} == set(texts)
    for r in got:
        ids = library(texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    used = {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    padding = sum(1024 - n for n in used.values() if n & (n - 1))
    assert padding < 0.02 * sum(used.values())
