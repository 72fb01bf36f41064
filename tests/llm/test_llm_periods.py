"""Periodic runs against a scan of every period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words):
    """Every run as (start, stop, period)."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def collapsed(words):
    gone = {k for s, e, q in plain(words) for k in range(s + q, e)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def planted(rng):
    words = []
    for _ in range(rng.randint(0, 8)):
        words += [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9)
        if rng.random() < 0.3:
            words += [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.2:
            words = words * rng.randint(1, 3)
    return words[:400]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_several_texts(seed):
    rng = random.Random(seed)
    texts = [planted(rng) for _ in range(rng.randint(0, 6))]
    first = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    got = [[] for _ in texts]
    for t, s, e, q in zip(*(x.tolist() for x in periods.find_runs(np.array(sum(texts, []), np.int64), first))):
        got[t].append((s - first[t], e - first[t], q))
    assert got == [plain(t) for t in texts]


@pytest.mark.parametrize("step", [1, 7, 1 << 18])
def test_long_texts(monkeypatch, step):
    monkeypatch.setattr(periods, "STEP", max(step, 3000))
    for words, n in (([1] * 20_000, 1), ([i % 7000 for i in range(30_000)], 1), (list(range(20_000)), 0), ([i % 3001 for i in range(12_003)], 0)):
        found = periods.find_runs(np.array(words), np.array([0, len(words)]))
        assert len(found[0]) == n
        if n:
            assert (found[1][0], found[2][0], found[3][0]) == (0, len(words), len(set(words)))
    fibonacci = "a", "b"
    while len(fibonacci[1]) < 5000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    words = np.frombuffer(fibonacci[1].encode(), np.uint8).astype(np.int64)
    assert len(periods.find_runs(words, np.array([0, len(words)]))[0]) == 0  # no fourth power


def test_a_rule_s_boundary_is_searched_once():
    words = np.tile(np.arange(64), 512)
    nodes = periods.repair(words, np.array([0, len(words)]))
    assert nodes.count < 200 and len(nodes.arrays()[4]) > 2000  # few rules, many places


def test_operator(spark):
    rng = random.Random(9)
    texts = ["", None, " \t\n", "a a a a a a", "A a a a a a a", "x " * 5000, "é ü b " * 9, "one two\x0bone two one\r\ntwo one two"]
    texts += [" ".join(map(str, planted(rng))) for _ in range(60)] + ["a b c d " * 2000 + "end"]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, texts[3], "y", 1), (3, texts[3], "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id int").repartition(4)
    got = [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in periods.periodic_runs(docs).collect()]
    want = []
    for i, text, _, _ in rows:
        words = WORD.findall(text or "")
        want.append((i, len(words), [(s, e - s, q) for s, e, q in plain(words)], collapsed(words)))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periods.periodic_runs(docs).count() == 0 and periods.with_planted_runs(docs).count() == 0


def test_planted_words(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 37))) for i in range(400)] + [(None, "a b"), (7, None)]
    got = periods.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    changed = 0
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.text)
    for i, text in rows:
        if i is not None and text is not None:
            words, h = text.split(), zlib.crc32(str(i).encode())
            n, g = len(words), h // 10
            if h % 10 == 0 and n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
                changed += 1
            assert " ".join(words) in by_id[i]
    assert changed > 20 and by_id[None] == ["a b"] and None in by_id[7]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r) for r in periods.op13_periodic_runs(spark, folder).collect()}
    found = 0
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain(words)
        found += len(runs)
        best = min(((s - e, s, q) for s, e, q in runs), default=None)
        shown = (None,) * 4 if best is None else (best[1], -best[0], best[2], -1000 * best[0] // best[2])
        lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
        assert got[r.doc_id] == (r.doc_id, len(runs), *shown, sha(lines), sha(collapsed(words)))
    assert found > 10
