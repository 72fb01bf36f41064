"""Secret scans with an incremental ledger of scanned contents.

Every text is addressed by its SHA-256. The ledger holds which ``(blob, rules)`` pairs were scanned
and what was found; only pairs it lacks are scanned, once each, and appended. Findings are joined back
to every row (path, version) that has the content.

Spark expressions only. Defined results: NULL is an empty text; every row of the input has a row in
the result; ids may repeat or be NULL; other input columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, written
from .common import first_rows, named, one_text_per_digest
from .spans import Pattern, all_spans, listed

# The base rules of the scan; ``least`` is the length that the value must have.
BASE_RULES = (
    (Pattern("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2), 12),
    (Pattern("access", r"AKIA[A-Z0-9]+"), 18),
    (Pattern("hex", r"[0-9a-f]{16,}"), 16),  # runs are maximal, so short ones can be left out at once
)
# Further rules of this scan.
MORE_RULES = (
    (Pattern("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"), 1),
    (Pattern("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"), 1),
)
RULES = BASE_RULES + MORE_RULES

SCANNED = "blob string, version string"
FINDINGS = "blob string, version string, rank int, kind string, start long, end long"


def rules_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.schema(schema).parquet(path) if fs.exists(where) else spark.createDataFrame([], schema)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """``(blob, rank, kind, start, end)`` of the findings in ``blobs (blob, text)``."""
    least = F.array(*[F.lit(n) for _, n in rules])
    spans = F.filter(all_spans(F.col("text"), tuple(p for p, _ in rules)), lambda s: F.length(s["value"]) >= least[s["rank"]])
    return blobs.select("blob", F.explode(spans).alias("s")).select("blob", "s.rank", "s.kind", "s.start", "s.end")


def update_ledger(docs: DataFrame, ledger: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Scan what ``ledger`` lacks under these rules. Findings are written before the blobs are noted as scanned,
    so a scan that broke off is done again; :func:`findings` drops what is there twice. Returns the number of new blobs."""
    spark, version = docs.sparkSession, rules_version(rules)
    own = named(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    keyed = own.select("id", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("mark"))
    seen = _stored(spark, f"{ledger}/scanned", SCANNED).where(F.col("version") == version)
    unseen = first_rows(keyed).join(
        seen.select(F.col("blob").alias("digest")), "digest", "left_anti"
    )
    unseen_path = scratch_path(spark, "unseen-blobs")
    unseen.write.parquet(unseen_path)
    unseen = spark.read.parquet(unseen_path)
    new = unseen.count()
    if new:
        texts = one_text_per_digest(own, unseen).withColumnRenamed("digest", "blob")
        scan(texts, rules).select("blob", F.lit(version).alias("version"), "rank", "kind", "start", "end").write.mode(
            "append"
        ).parquet(f"{ledger}/findings")
        unseen.select(F.col("digest").alias("blob"), F.lit(version).alias("version")).write.mode("append").parquet(
            f"{ledger}/scanned"
        )
    return new


def findings(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """One row per blob with findings: ``spans`` (array of structs, by start, then kind as listed)."""
    found = _stored(spark, f"{ledger}/findings", FINDINGS).where(F.col("version") == rules_version(rules))
    return found.groupBy("blob").agg(
        F.array_sort(F.collect_set(F.struct("start", "rank", "kind", "end"))).alias("spans")
    )


def secret_findings(docs: DataFrame, ledger: str, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bring the ledger up to date and give every row of ``docs`` its findings: ``(id, blob, spans)``."""
    spark = docs.sparkSession
    update_ledger(docs, ledger, rules, id_col, text_col)
    own = named(docs, id=id_col, text=text_col)
    rows = own.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    # a table of its own, so that rows of a content which very many have are split by the join
    joined = rows.join(written(findings(spark, ledger, rules), "findings"), "blob", "left")
    return joined.select(F.col("id").alias(id_col), "blob", "spans")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document, through a ledger that starts empty."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = secret_findings(docs, scratch_path(spark, "blob-ledger"))
    spans = F.coalesce("spans", F.array().cast(rows.schema["spans"].dataType))
    base = F.filter(spans, lambda s: s["rank"] < len(BASE_RULES))

    def n(rank: int):
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")

    return rows.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        "blob",
    )
