"""Quality classifier (held-out accuracy) and decontamination (brute force)."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, quality

SF = "/root/testdata/sf0.01"


def texts(seed, n):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randint(3, 60))]
        good = r.random() < 0.7
        if not good:
            w = [x.upper() + "!!" for x in w] if r.random() < 0.5 else [w[0]] * len(w)
        out.append((i, " ".join(w), int(good)))
    return out


def test_quality_held_out(spark):
    rows = texts(1, 500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "some text")], "doc_id long, text string")
    docs = docs.selectExpr("*", "0 AS score", "1 AS quality")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 503 and all(0 <= r["score"] <= 1 for r in got.values())
    import zlib

    for k, r in got.items():
        assert r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2)
        assert r["predicted"] == (r["score"] >= 0.7)
    held = [(got[i]["predicted"], q) for i, _, q in rows if got[i]["held_out"]]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert got[900]["score"] == got[901]["score"]


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = texts(2, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs.repartition(7), turned.repartition(3)).collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_quality_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.quality_scores(docs, none).collect()] == [0.5, 0.5]
    ones = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert all(r["score"] > 0.99 for r in quality.quality_scores(docs, ones).collect())
    assert quality.quality_scores(docs.where("doc_id < 0"), ones).collect() == []


def test_training_rows_of_a_shared_id(spark, monkeypatch):
    """However many rows share a labelled id, one text of it is collected, the same whatever the order of rows."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda found: seen.append(found))
    rows = [(1, f"text number {i}") for i in range(400)] + [(i, f"word{i} other") for i in range(2, 12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)], "id long, label int")
    for shuffled in (rows, rows[::-1]):
        quality.train(spark.createDataFrame(shuffled, "id long, text string").repartition(4), labels)
    assert [len(x) for x in seen] == [11, 11]
    assert all(y == z and (i == j).all() for (y, i, _), (z, j, _) in zip(*seen))


# --- decontamination ---------------------------------------------------------


def words(t):
    return [w.lower() for w in re.findall(r"[^\x00-\x20!-/:-@\[-`{-~]+", t or "")]


def align(a, b):
    prev, best = [0] * (len(b) + 1), 0
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(max(0, prev[j] + (2 if x == y else -1), prev[j + 1] - 1, cur[j] - 1))
        best = max(best, max(cur))
        prev = cur
    return best


def case(seed):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)] + ["the", "of", "Ä"] * 30
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [say(r.randint(8, 40)) for _ in range(12)] + [["uniq", "pair"], items_same := say(15), items_same]
    docs = []
    for i in range(120):
        body = say(r.randint(0, 150))
        if r.random() < 0.5:
            item = list(r.choice(items))
            for _ in range(r.randint(0, len(item) // 3)):
                k = r.randrange(len(item))
                item[k : k + 1] = r.choice([[], [r.choice(vocab)], [item[k], r.choice(vocab)]]) or item[k : k + 1]
            at = r.randint(0, len(body))
            body = body[:at] + item + body[at:]
        docs.append((i, (" " if r.random() < 0.7 else ", ").join(w.upper() if r.random() < 0.1 and w.isascii() else w for w in body)))
    return docs, [(100 + i, " ".join(x)) for i, x in enumerate(items)] + [(200, None), (201, " ... ")]


@pytest.mark.parametrize("seed, block", [(1, 500_000), (2, 40)])
def test_decontamination(spark, monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    docs, items = case(seed)
    docs += [(500, None), (501, ""), (502, docs[3][1]), (None, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS score").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(d, b).collect()}
    want = {}
    for i, t in docs:
        for j, u in items:
            x, y = words(u), words(t)
            s = align(x, y) / (2 * len(x)) if x else 0
            if s >= 0.5:
                want[i, j] = s
    assert got == pytest.approx(want)


@pytest.mark.parametrize("seed", [3, 4])
def test_decontamination_of_heavy_edits(spark, seed):
    """Every pair at or above the threshold is found, also if no two words in a row survived the edits."""
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["the", "of", "and", "to"] * 25
    items = [[r.choice(vocab) for _ in range(r.choice([3, 16, 25, 40]))] for _ in range(15)]
    docs = [[r.choice(vocab) for _ in range(r.randint(0, 200))] for _ in range(300)]
    for i, body in enumerate(docs):
        copy = list(items[i % len(items)])
        if i % 7 == 0:  # a word after every second one
            copy = [x for k, w in enumerate(copy) for x in ([w, f"z{k}"] if k % 2 else [w])]
        elif i % 7 == 1:
            copy[2::3] = ["x%d" % k for k in range(len(copy[2::3]))]
        elif i % 3 == 0:
            copy[2::4] = ["x%d" % k for k in range(len(copy[2::4]))]  # every fourth word, from the third
        else:
            copy = [w if r.random() > 0.3 else "y%d" % r.randint(0, 99) for w in copy]
        at = r.randint(0, len(body))
        body[at:at] = copy
    want = {(i, 100 + j): s for i, t in enumerate(docs) for j, x in enumerate(items) if (s := align(x, t) / (2 * len(x))) >= 0.5}
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string").repartition(3)
    b = spark.createDataFrame([(100 + j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(d, b).collect()}
    assert len(want) > 100 and got == pytest.approx(want)


def test_decontamination_of_any_ids(spark):
    item = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"v{k % 5000}" for k in range(60_000))
    rows = [("k1", f"{long} {item} {long}", 1), (None, item, 2), (None, "clean", 3), ("k2", None, 4), ("k1", "clean too", 5)]
    d = spark.createDataFrame(rows, "doc_id string, text string, item int")
    b = spark.createDataFrame([("i", item)], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {("k1", "i", 1.0), (None, "i", 1.0)}
    assert sorted(r["item"] for r in decontaminate.drop_contaminated(d, b).collect()) == [3, 4, 5]


def test_decontamination_empty(spark):
    d = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert decontaminate.contaminated(d.where("doc_id > 1"), b).count() == 0
    assert decontaminate.contaminated(d, b.where("item_id > 1")).count() == 0
    assert decontaminate.contaminated(d, b).collect()[0]["score"] == 1.0
