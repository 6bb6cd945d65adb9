"""Quality figures: character errors, calibration, keys and values, grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.queries import squeeze

# Patterns of instructions that try to take over, and of credentials.
INJECTIONS = [
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior)\s+instructions",
    r"(?i)disregard\s+(?:all\s+)?(?:system|safety)\s+rules",
    r"(?i)you\s+are\s+now\s+in\s+developer\s+mode",
    r"(?i)bypass\s+(?:all\s+)?(?:security|refinery)\s+protocols",
    r"(?i)reveal\s+(?:your\s+)?(?:system\s+prompt|secret\s+key)",
]
CREDENTIALS = [
    (r"(?i)(?:api[_-]?key|secret[_-]?key)\s*[:=]\s*['\"]?[A-Za-z0-9_\-]{16,}['\"]?", "[REDACTED_API_KEY]"),
    (r"(?s)-----BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY-----.*?-----END\s+(?:RSA\s+)?PRIVATE\s+KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"(?i)(?:password|passwd|pwd)\s*[:=]\s*['\"]?[^\s'\"]{6,}['\"]?", "[REDACTED_PASSWORD]"),
]
BUCKETS = [(0.0, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.01)]


def injection_flags(t: Column) -> Column:
    """How many of the patterns a text matches."""
    return sum((t.rlike(p).cast("int") for p in INJECTIONS), F.lit(0))


def redact(t: Column) -> Column:
    for pattern, put in CREDENTIALS:
        t = F.regexp_replace(t, pattern, put)
    return t


def character_errors(reference: Column, hypothesis: Column) -> Column:
    a, b = squeeze(reference), squeeze(hypothesis)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a))


def bucket(c: Column) -> Column:
    """Number of the half-open confidence bucket, null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(BUCKETS):
        out = F.when((c >= lo) & (c < hi), i).otherwise(out)
    return out


def calibration(rows: DataFrame) -> DataFrame:
    exact = (squeeze(F.col("reference")) == squeeze(F.col("hypothesis"))).cast("int")
    return rows.withColumn("bucket", bucket(F.col("confidence"))).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(exact).alias("accuracy"))


def confidence(retrieval: Column, citation: Column, grounding: Column) -> Column:
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return F.round(unit(0.35 * unit(retrieval) + 0.35 * unit(citation) + 0.30 * unit(grounding)), 4)


def key_value_scores(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of exact (doc, key, value) matches, in one row."""
    norm = lambda c: F.lower(squeeze(F.col(c)))
    t, p = (d.select("doc_id", norm("key").alias("key"), norm("value").alias("value")).distinct() for d in (truth, found))
    both = t.withColumn("t", F.lit(1)).join(p.withColumn("p", F.lit(1)), ["doc_id", "key", "value"], "full_outer")
    hit, n_t, n_p = F.sum(F.col("t") * F.col("p")), F.sum("t"), F.sum("p")
    c = both.agg(F.coalesce(hit, F.lit(0)).alias("matched"), F.coalesce(n_t, F.lit(0)).alias("truth"), F.coalesce(n_p, F.lit(0)).alias("found"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    c = c.withColumns({"precision": ratio("matched", "found"), "recall": ratio("matched", "truth")})
    total = F.col("precision") + F.col("recall")
    return c.withColumn("f1", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0))


def conflicts(claims: DataFrame) -> DataFrame:
    """Fields of an entity that have more than one value, case apart."""
    return claims.groupBy("entity", "field").agg(F.countDistinct(F.lower(F.trim("value"))).alias("n_values"), F.count("*").alias("n_claims")).where("n_values > 1")


def anchors(answer: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"(\[\d+\])"), 1))


def wall_thickness(p: Column, r: Column, s: Column, e: Column) -> Column:
    """(P * R) / (S * E - 0.6 * P), null where P is missing or the divisor is not positive."""
    d = s * e - 0.6 * p
    return F.when(d > 0, p * r / d)
