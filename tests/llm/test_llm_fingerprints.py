"""Fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from tidemark.llm import fingerprints as fp


def pieces(text):
    out = set()
    for line in text.split("\n"):
        for p in re.split(r"(?<=[.!?]) ", line) if len(line) > fp.LONG else [line]:
            if p.strip(" "):
                out.add(p)
    return out


def alike(a, b):
    a, b = pieces(a), pieces(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for i, (k, t) in enumerate(order):
        n = order[(i + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        out[k] = (len(t), hashlib.sha256(e.encode()).hexdigest(), alike(t, e), alike(t, n))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    lines = ["Line %d é𝒳. And more! Yes?" % i for i in range(60)] + ["", " ", "long sentence here. " * 30]
    texts = ["\n".join(r.choice(lines) for _ in range(r.choice([0, 1, 2, 5, 12, 40]))) for _ in range(n)]
    texts[3:6] = [None, "", "\n".join(f"{i} own line" for i in range(700))]
    texts[9] = texts[8]
    ids = r.sample(range(-500, 5000), n)
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed, n", [(1, 120), (2, 300)])
def test_against_plain(spark, seed, n):
    rows = corpus(seed, n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS next", "1 AS range").repartition(4)
    got = {r["doc_id"]: r for r in fp.fingerprints(docs).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for k, (chars, sha, near_e, near_n) in want.items():
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (chars, sha)
        assert r["near_edited"] == pytest.approx(near_e) and r["near_next"] == pytest.approx(near_n)
    by_text = {}
    for k, t in rows:
        by_text.setdefault(t or "", set()).add(got[k]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fp.fingerprints(spark.createDataFrame([], schema)).collect() == []
    (one,) = fp.fingerprints(spark.createDataFrame([(7, "a\nb")], schema)).collect()
    assert one["near_next"] == 1.0 and one["n_chars"] == 3
    rows = [(None, "x"), (None, "x"), (1, "x"), (1, "x"), (2, None)]
    got = fp.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and len({r["fingerprint"] for r in got if r["n_chars"]}) == 1


def test_peeling_recovers_the_digests(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 2, 3, 9], [2, 3, 4])], "a array<bigint>, b array<bigint>")
    (r,) = df.select(fp.peeled(fp.minus(fp.sketch(F.col("a"), 48), fp.sketch(F.col("b"), 48)), 48)["found"].alias("f")).collect()
    assert {(x["s"], x["d"]) for x in r["f"]} == {(1, 1), (1, 9), (-1, 4)}
