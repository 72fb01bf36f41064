"""Substring deduplication against brute force."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.llm import substrings


def pieces(text):
    """``(words, from, to)`` of the sentences; ``to`` is where the next one begins."""
    found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    groups = []
    for i, (w, a, b) in enumerate(found):
        if not i or found[i - 1][0][-1] in ".!?" or "\n" in text[found[i - 1][2] : a] or len(groups[-1]) == substrings.PIECE:
            groups.append([])
        groups[-1].append((w, a))
    low = lambda w: "".join(c.lower() if c.isascii() else c for c in w)
    starts = [g[0][1] for g in groups] + [len(text)]
    return [([low(w) for w, _ in g], starts[i], starts[i + 1]) for i, g in enumerate(groups)]


def brute(rows):
    spans = []
    for i, t in rows:
        p = pieces(t or "")
        for s in range(len(p)):
            e = s + substrings.RUN
            while e <= len(p) and sum(len(x[0]) for x in p[s:e]) < substrings.LEAST:
                e += 1
            if e <= len(p):
                spans.append((tuple(w for x in p[s:e] for w in x[0]), i, s, e))
    kept, gone = {}, {}
    for key, i, s, e in sorted(spans, key=lambda x: x[1:3]):
        if kept.setdefault(key, (i, s)) != (i, s):
            gone.setdefault(i, set()).update(range(s, e))
    out = {}
    for i, t in rows:
        if i in gone:
            p = pieces(t)
            out[i] = ("".join(t[a:b] for k, (_, a, b) in enumerate(p) if k not in gone[i]), len(gone[i]))
        else:
            out[i] = (t, 0)
    return out


def corpus(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéÄ") for _ in range(3))
    say = lambda k: " ".join(word() for _ in range(k)) + r.choice([".", "!", "?", ""])
    passages = [[say(r.randint(1, 12)) for _ in range(r.randint(4, 9))] for _ in range(8)] + [[say(70)]]
    rows = []
    for i in range(n):
        body = [say(r.choice([1, 3, 8, 20, 40])) for _ in range(r.randint(0, 9))]
        if r.random() < 0.6:
            at = r.randint(0, len(body))
            body[at:at] = r.choice(passages)
        rows.append((i * 7 - 50, r.choice([" ", "\n", "  "]).join(body)))
    return rows + [(9001, None), (9002, ""), (9003, " \n "), (9004, rows[0][1]), (9005, ("one two three four five. " * 40))]


@pytest.mark.parametrize("seed, n", [(1, 150), (2, 400)])
def test_against_brute_force(spark, seed, n):
    rows = corpus(seed, n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS run", "1 AS place", "2 AS mark").repartition(5)
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substrings.without_repeats(docs).collect()}
    assert got == brute(rows)


def test_passage_within_other_texts(spark):
    """A passage of over 50 words, even one long sentence, goes from all texts but the first; what stands around it stays."""
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    rows = [(i, f"Own beginning {i} here. {passage} Own end {i}.") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"Own beginning {i} here. Own end {i}." for i in range(1, 5))


@pytest.mark.parametrize("mean", [8, 15, 30, 1000])
def test_passage_in_the_middle_of_a_sentence(spark, tmp_path, mean):
    """60 words of an earlier document go wherever they begin, but for a few at their ends; other words stay."""
    r = random.Random(mean)
    number = iter(range(10**6))

    def say(n):
        return [f"w{next(number)}" + "." * (r.random() < 1 / mean) for _ in range(n)]

    rows, planted = [], []
    for i in range(0, 200, 2):
        first, other = say(160), say(100)
        passage = first[(at := r.randint(5, 95)) : at + 60]
        rows += [(i, " ".join(first)), (i + 1, " ".join(other[: (to := r.randint(5, 95))] + passage + other[to:]))]
        planted.append((i + 1, passage, other))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x["text"] for x in substrings.op2_substring_dedup(spark, str(tmp_path)).collect()}
    assert all(got[i] == t for i, t in rows[::2])
    left = []
    for i, passage, other in planted:
        words = got[i].split()
        assert [w for w in words if w not in set(passage)] == other
        left.append(sum(w in set(passage) for w in words))
    assert max(left) < 40 and sum(left) / len(left) < 15, left


def test_cuts_by_content_of_repeating_words(spark):
    """Words of a short period are cut alike from any place on, and the pieces are whole."""
    rows = [(1, "x " + "a b " * 60), (2, "x y z " + "b a " * 60), (3, "c " * 90), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs, by_content=True).collect()}
    assert got[2].startswith("x y z ") and len(got[2].split()) < 25 and got[4] is None and got[5] == ""


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    assert substrings.without_repeats(spark.createDataFrame([], schema)).collect() == []
    long = "a b c d e f. g h i j k l. m n o p q r."
    rows = [(None, long), (None, long), (1, long), (2, "short.")]
    got = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in substrings.without_repeats(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(0, 0), (0, 0), (1, 3), (2, 0)]
