"""The pipeline on a small corpus against plain Python, stage by stage and as a whole."""

from __future__ import annotations

import random
import re

import pytest
from test_llm_learned import align, words
from test_llm_neardup import brute
from test_llm_text_ops import goals, personal

import corpus_pipeline
from tidemark.session import written

KINDS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijk") for _ in range(r.randint(3, 8)))
    say = lambda n: [word() for _ in range(n)]
    items = [say(25) for _ in range(6)]
    docs, labels = [], []
    for i in range(360):
        w, good = say(r.randint(20, 70)), True
        kind = r.random()
        if kind < 0.2:
            w, good = ([x.upper() + "!!" for x in w] if r.random() < 0.5 else [w[0]] * len(w)), False
        elif kind < 0.4 and docs:
            w = list(r.choice([d for d, q in zip(docs, labels) if q[1]] or docs)[1].split(" "))
            if r.random() < 0.7:
                w[r.randrange(len(w))] = word()
        elif kind < 0.5:
            w[5:5] = r.choice(items)
        elif kind < 0.6:
            w[3:3] = r.choice([["a.b@c.org"], ["+1", "415", "555", "0100"], ["10.0.0.1"], ["4111", "1111", "1111", "1111"]])
        docs.append((i, " ".join(w), "en", r.choice(["s0", "s0", "s1", "s2", None]), 0))
        labels.append((i, int(good), 0))
    docs += [(900, None, "en", "s1", 0), (901, "", None, "s1", 0), (902, docs[0][1], "en", "s2", 0), (902, docs[0][1], "en", "s2", 0)]
    docs += [(None, " ".join(say(40)), "en", "s1", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, quality = docs.columns, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [words(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    steps = [rows_of(docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
            steps.append(rows_of(docs))
    raw, good, single, clean, safe = steps
    # quality: good documents stay, nearly all bad ones go
    kept = {r[0] for r in good}
    assert set(good) <= set(raw) and all(i in kept for i, q in quality.items() if q)
    assert sum(i in kept for i, q in quality.items() if not q) <= 0.05 * len(quality)
    # near duplicates: the smallest id of each component, once
    want = brute([(i, t) for i, t, _ in good if i is not None])
    assert [r[0] for r in single if r[0] is not None] == sorted((i for i, (_, c) in want.items() if i == c), key=lambda i: str((i,)))
    assert [r for r in good if r[0] is None] == [r for r in single if r[0] is None]
    # benchmark
    hit = {i for i, t, _ in single if i is not None for x in items if align(x, words(t)) >= len(x)}
    assert hit and clean == [r for r in single if r[0] not in hit]
    # personal data
    assert len(safe) == len(clean)
    for (i, t, s), (j, u, v) in zip(clean, safe):
        assert (i, s) == (j, v)
        assert (u == t) == (not personal(t or ""))
        assert t is None or sum(u.count(k) for k in KINDS) == len(personal(t))
    # mixing
    size, target = goals(safe)
    taken = dict.fromkeys(size, 0)
    result = docs.collect()
    assert sorted((r["doc_id"] for r in result), key=str) == sorted((r[0] for r in safe), key=str)
    for r in result:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    longest = max(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in safe)
    assert all(abs(taken[s] - target[s]) <= 1.5 * longest for s in size)
    # the whole run gives the same
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, whole), key=str) == sorted(map(tuple, result), key=str)


def test_empty(spark, folder, tmp_path):
    d = str(tmp_path / "none")
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
