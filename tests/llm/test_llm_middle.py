"""Fill-in-the-middle against plain Python and its SQL."""

from __future__ import annotations

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import middle

TEXTS = [
    "def f(x):\n    return x + 1\n", "", None, "a", " ", "one<P>two", "<S", "P> <P", "<M>", "é日本 x y\x00z", "<<S", "ab" * 40 + "<",
    "word " * 30_000, "L" * 200_000 + "9" * 10,
]


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, mid, last = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(first), len(mid), f"<S>{last}<P>{first}<M>{mid}"
    return n, "psm", len(first), len(mid), f"<P>{first}<S>{last}<M>{mid}"


def test_against_plain(spark):
    rows = [(i, t, "x", None) for k in range(20) for i, t in enumerate(TEXTS[:12], 100 * k)]
    rows += [(None, "some text", "y", 1), (5, TEXTS[12], "", 2), (6, TEXTS[13], "", 3), (0, TEXTS[0], "again", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, output int").repartition(3)
    cut = middle.fill_in_middle(docs).withColumn("restored", middle.restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, cut.collect()), key=repr)
    want = sorted(((i, *plain(i, t), t or "") for i, t, _, _ in rows), key=repr)
    assert got == want
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_portions_end_with_units(monkeypatch):
    monkeypatch.setattr(middle, "SPAN", 3)
    for text in ("", "abcdef gh", "1234567", "ab1cdefghi jkl", "é" * 7 + "abcdefg", "a\nb\n\nccc"):
        ends = middle.unit_ends(text).tolist()
        assert ends == [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text))]


def test_shares_and_seed(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"))
    counts = {r.form: r["count"] for r in middle.fill_in_middle(docs, percent=50, suffix_first=50).groupBy("form").count().collect()}
    assert all(abs(counts[k] - v) < 120 for k, v in (("plain", 1000), ("psm", 500), ("spm", 500)))
    one, two = (middle.fill_in_middle(docs, seed=s).orderBy("doc_id").collect() for s in (1, 2))
    assert one != two and one == middle.fill_in_middle(docs.repartition(7)).orderBy("doc_id").collect()


def test_empty_table_and_text_ids(spark):
    assert middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = middle.fill_in_middle(spark.createDataFrame([("k1", "ab cd")], "doc_id string, text string")).first()
    assert tuple(row) == ("k1", *plain("k1", "ab cd"))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_against_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(middle.OP12_SQL).fetchall()
    got = list(map(tuple, middle.op12_fill_in_middle(spark, folder).collect()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
