"""Near duplicates against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import neardup
from tidemark.llm.components import join_components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                comp[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + r.choice("ÄBéxyz") + str(r.randint(0, 40))
    common = [word() for _ in range(40)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d e", "a b c d  E", "a b c d"]
    bases = [[word() for _ in range(r.choice([6, 15, 40, 120]))] for _ in range(n // 12)]
    while len(texts) < n:
        base = list(r.choice(bases))
        kind = r.random()
        if kind < 0.5:  # edited copies, chains of them
            for _ in range(r.randint(0, 4)):
                base[r.randrange(len(base))] = word()
        elif kind < 0.75:  # own text with the passage that many share
            base = [word() for _ in range(r.randint(5, 50))] + common
        elif kind < 0.85:
            base = base[: r.randint(1, len(base))]
        texts.append((" " if r.random() < 0.8 else "\n").join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in base))
    ids = r.sample(range(-1000, 10**6), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed, n, page", [(1, 250, 16), (2, 500, 2)])
def test_components(spark, monkeypatch, seed, n, page):
    monkeypatch.setattr(neardup, "PAGE", page)
    rows = corpus(seed, n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS token", "0 AS comp").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_pages_alone_find_every_link(spark, monkeypatch):
    """Without the rounds of hubs, the pages have to find all links by themselves."""
    monkeypatch.setattr(neardup, "candidates_of_hubs", lambda lists: lists.selectExpr("id AS a", "id AS b").where("false"))
    rows = corpus(5, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, None), (4, None), (9, "a b c d e f")]
    got = sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (9, 2, 5), (3, 0, 3), (4, 0, 4)], key=str)


def test_long_chain(spark):
    labels = spark.range(40).select("id", F.col("id").alias("comp"))
    links = spark.createDataFrame([(i, i + 1) for i in range(29)] + [(35, 33), (33, 35)], "a long, b long")
    got = {r["id"]: r["comp"] for r in join_components(labels, links).collect()}
    assert all(got[i] == 0 for i in range(30)) and got[35] == 33 and got[39] == 39


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    from tidemark.llm.common import text_slices, words_of

    texts = ["Ab cd", None, "", " x  ab", "é\tCD", "y" * 5000 + " ab"]
    seen = {}
    for budget in (1, 8, 1 << 20):
        for at, to, data, offsets in text_slices(pa.array(texts), budget):
            h, s, e, first = words_of(data, offsets)
            for i in range(to - at):
                want = re.findall(r"[^\x20\x09-\x0D]+", (texts[at + i] or ""))
                assert first[i + 1] - first[i] == len(want)
                for w, x in zip(want, h[first[i] : first[i + 1]]):
                    assert seen.setdefault(w.lower() if w.isascii() else w, x) == x
    assert len(set(map(int, seen.values()))) == len(seen)
