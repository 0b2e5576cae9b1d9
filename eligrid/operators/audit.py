"""Audits over vectors, dates, fund data and source texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; an empty or zero vector gives 0."""
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    x, y = wide(a), wide(b)
    # zip_with pads the shorter side with NULL; only common positions count.
    dot = total(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))))
    norms = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda p: p * p)))
    raw = F.when(norms > 0, dot / norms).otherwise(0.0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))


def anchor_status(similarity: Column, verified: float = 0.90, review: float = 0.70) -> Column:
    return (
        F.when(similarity >= verified, "VERIFIED").when(similarity >= review, "NEEDS_REVIEW").otherwise("DISPUTED")
    )


def is_stale(notified: Column, as_of: str, days: int = 90) -> Column:
    """Older than the cutoff; a date that cannot be read is stale."""
    day = F.try_to_date(notified, "yyyy-MM-dd")
    return F.coalesce(day < F.date_sub(F.lit(as_of).cast("date"), days), F.lit(True))


def dormancy(has_data: Column, status: Column, released: Column, beneficiaries: Column, as_of: str) -> Column:
    day = F.try_to_date(released, "yyyy-MM-dd")
    age = F.datediff(F.lit(as_of).cast("date"), day)
    return (
        F.when(~has_data, "unverified")
        .when(status == "discontinued", "discontinued")
        .when(day.isNull(), "error")
        .when((age <= 365) & (beneficiaries > 0), "active")
        .otherwise("dormant")
    )


def words(text: Column) -> Column:
    """Distinct lower-cased words of a whole text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def divergence(a: Column, b: Column) -> Column:
    """Jaccard distance of two word sets; two empty texts do not diverge."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(1.0 - both / either)


def choose_tier(joined: DataFrame) -> DataFrame:
    """Authoritative text per scheme from an outer join of both tiers."""
    one = F.coalesce("tier1", F.lit("")) != ""
    two = F.coalesce("tier2", F.lit("")) != ""
    measured = joined.withColumn(
        "divergence", F.when(one & two, divergence(words(F.col("tier1")), words(F.col("tier2"))))
    )
    return measured.withColumn(
        "chosen",
        F.when(one & two, F.when(F.col("divergence") > 0.10, 2).otherwise(1)).when(two, 2).when(one, 1).otherwise(0),
    )


def run_manifest(results: DataFrame) -> DataFrame:
    """Counts per run; a disputed result without rules counts as one."""
    disputed = F.col("triage") == "DISPUTED"
    n = F.col("n_rules")
    return results.groupBy("run_id").agg(
        F.count("*").alias("schemes_processed"),
        F.sum(F.when(F.col("triage") == "VERIFIED", n).otherwise(0)).alias("rules_verified"),
        F.sum(F.when(F.col("triage") == "NEEDS_REVIEW", n).otherwise(0)).alias("rules_needs_review"),
        F.sum(F.when(disputed, F.greatest(n, F.lit(1))).otherwise(0)).alias("rules_disputed"),
        F.sum(F.when(disputed, F.greatest(n, F.lit(1))).otherwise(n)).alias("rules_generated"),
        F.sum("n_flags").alias("ambiguity_flags_raised"),
    )
