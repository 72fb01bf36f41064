"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Spark expressions only. Positions are code points, ends exclusive. Defined results: NULL is an empty
text; every row of the input has its row in the result, repeated rows too; ids may be NULL; other
input columns are ignored (:func:`redact` keeps them as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import Pattern, all_spans, listed, replaced

# The patterns. Runs start where they can: at a run's first character or where the last
# match ended (\G), and are possessive where nothing after them could match less; so no text is read
# twice and long runs need no stack. The spans are those of the plain patterns.
BASE_PATTERNS = (
    Pattern("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Pattern("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Pattern("card", r"[0-9](?:[\x20-]?[0-9])++"),
    Pattern("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
MORE_PATTERNS = (Pattern("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),)
PATTERNS = BASE_PATTERNS + MORE_PATTERNS
#: Score before context, by kind: a checksum makes a span more certain than a shape alone.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.5, "iban": 0.95}
# Words that make a span of the kind likelier when they stand shortly before it.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|host|server|address)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank|transfer)\b",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc
        + F.when(
            (n - i) % 2 == 1,
            (lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d))(F.substring(digits, i, F.lit(1)).cast("int")),
        ).otherwise(F.substring(digits, i, F.lit(1)).cast("int")),
    )
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN (without spaces) leaves 1 on division by 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, i: (
            lambda c: F.when(c < 58, (acc * 10 + c - 48) % 97).otherwise((acc * 100 + c - 55) % 97)
        )(F.ascii(F.substring(turned, i, F.lit(1)))),
    )
    return rest == 1


def confirmed(kind: Column, match: Column) -> Column:
    """The validator of each kind."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    part = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", match.rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(kind == "card", F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)))
        .when(kind == "phone", F.length(digits).between(8, 15))
        .when(kind == "iban", mod97(F.regexp_replace(match, " ", "")))
    )


def score(kind: Column, before: Column) -> Column:
    """Between 0 and 1: the kind's prior, raised by half of what is missing where a context word stands before."""
    prior = F.create_map(*[F.lit(x) for k, v in PRIOR.items() for x in (k, v)])[kind]
    near = F.lit(False)
    for k, words in CONTEXT.items():
        near = F.when(kind == k, before.rlike(words)).otherwise(near)
    return F.when(near, prior + (1 - prior) / 2).otherwise(prior)


def pii_spans(text: Column) -> Column:
    """Array of ``(rank, start, kind, end, match, value, before, score)``, by kind, then start."""
    found = F.filter(all_spans(text, PATTERNS), lambda s: confirmed(s["kind"], s["match"]))
    return F.transform(found, lambda s: s.withField("score", score(s["kind"], s["before"])))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in the text replaced; all other columns and rows stay. NULL stays NULL."""
    for p in PATTERNS:  # a projection for each kind: the last text is computed once
        col = replaced(F.col(f"`{text_col}`"), p, lambda m, k=p.kind: confirmed(F.lit(k), m), F.lit(f"[{p.kind.upper()}]"))
        docs = docs.withColumn(text_col, col)
    return docs


def op5_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", pii_spans(F.coalesce("text", F.lit(""))).alias("found"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE_PATTERNS))

    def n(rank: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")

    return rows.select(
        "doc_id",
        n(0).alias("n_email"),
        n(1).alias("n_ip"),
        n(2).alias("n_card"),
        n(3).alias("n_phone"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
        F.transform("found", lambda s: s["score"]).alias("scores"),
    )
