"""Quality gates, batch validation and rule statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligrid import model

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def schema_failures(rules: DataFrame) -> DataFrame:
    """Empty ids, repeated ids (second occurrence on) and unknown operators, counted.

    Ids are pre-aggregated, so a much repeated id costs one row after the shuffle.
    """
    per_id = rules.groupBy("rule_id").agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("operator").isin(*model.OPERATORS)).alias("bad_operator"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(
                F.coalesce(F.col("rule_id"), F.lit("")) == "",
                F.struct(F.lit("empty_id").alias("reason"), F.col("n").alias("failures")),
            ),
            F.when(F.col("n") > 1, F.struct(F.lit("duplicate_id").alias("reason"), (F.col("n") - 1).alias("failures"))),
            F.when(
                F.col("bad_operator") > 0,
                F.struct(F.lit("invalid_operator").alias("reason"), F.col("bad_operator").alias("failures")),
            ),
        )
    )
    return per_id.select("rule_id", F.inline(reasons))


def ungrounded(rules: DataFrame) -> DataFrame:
    return rules.where(F.coalesce(F.col("source_quote"), F.lit("")) == "")


def silent_passes(rules: DataFrame) -> DataFrame:
    """Rules that are not VERIFIED or lack a quote, with the reasons joined."""
    no_quote = F.coalesce(F.col("source_quote"), F.lit("")) == ""
    reason = F.concat_ws(
        "; ",
        F.when(
            F.col("audit_status") != "VERIFIED",
            F.concat(F.lit("audit_status is "), F.col("audit_status"), F.lit(" (expected VERIFIED)")),
        ),
        F.when(no_quote, F.lit("source_quote is null or empty")),
    )
    return rules.withColumn("reason", reason).where(F.col("reason") != "")


def two_cycles(edges: DataFrame) -> DataFrame:
    """Pairs of schemes that require each other, each pair once."""
    e = edges.select("src", "dst").distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return (
        e.join(back, ["src", "dst"])
        .select(F.least("src", "dst").alias("scheme_a"), F.greatest("src", "dst").alias("scheme_b"))
        .distinct()
    )


def unknown_fields(rules: DataFrame) -> DataFrame:
    return rules.where(~F.col("field").isin(*model.FIELD_NAMESPACE))


def unrelated_references(rules: DataFrame, schemes: DataFrame, edges: DataFrame) -> DataFrame:
    """Disqualifying or NOT_MEMBER rules naming a scheme without a relationship row."""
    named = rules.where("rule_type = 'disqualifying' OR operator = 'NOT_MEMBER'").select(
        "scheme_id", "rule_id", F.explode(F.split("values_text", r"\|")).alias("referenced")
    )
    known = schemes.select(F.col("scheme_id").alias("referenced"))
    pairs = edges.select(F.col("scheme_a").alias("scheme_id"), F.col("scheme_b").alias("referenced")).union(
        edges.select("scheme_b", "scheme_a")
    )
    return named.join(known, "referenced", "left_semi").join(pairs, ["scheme_id", "referenced"], "left_anti").select(
        "scheme_id", "rule_id", "referenced"
    )


def missing_types(flags: DataFrame) -> DataFrame:
    """Taxonomy codes without a single flag."""
    codes = F.array(
        *[F.struct(F.lit(c).alias("type_code"), F.lit(n).alias("type_name")) for c, n in model.AMBIGUITY_TAXONOMY.items()]
    )
    spark = flags.sparkSession
    taxonomy = spark.range(1).select(F.inline(codes))
    return taxonomy.join(flags.select("type_code").distinct(), "type_code", "left_anti")


def risk_segments(rules: DataFrame) -> DataFrame:
    """Rules that touch each of four risk segments."""
    field = F.col("field")
    has = lambda *ws: F.coalesce(F.regexp_like(field, F.lit("|".join(ws))), F.lit(False))
    segments = F.array_compact(
        F.array(
            F.when(
                F.contains(F.lower(F.coalesce("value_text", F.lit(""))), F.lit("widow")) | has("marital"),
                F.lit("widow_who_remarried"),
            ),
            F.when(has("state", "domicile", "residence"), F.lit("interstate_migrant")),
            F.when(has("bank", "dbt", "aadhaar"), F.lit("tribal_no_bank")),
            F.when(has("land_ownership", "land_acres"), F.lit("farmer_leases_land")),
        )
    )
    return rules.select("scheme_id", "rule_id", F.explode(segments).alias("segment"))


def distribution(rules: DataFrame) -> DataFrame:
    """Counts by audit status and by type in one grouping-sets pass."""
    return (
        rules.groupingSets([["audit_status"], ["rule_type"], []], "audit_status", "rule_type")
        .agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    )


def batch_issues(rules: DataFrame) -> Column:
    """Structural issues of a mined rule."""
    return F.array_compact(
        F.array(
            F.when(~F.col("operator").isin(*model.BATCH_OPERATORS), F.lit("invalid_operator")),
            F.when(~F.col("confidence").between(0.0, 1.0), F.lit("invalid_confidence")),
            F.when(F.col("audit_status") != "PENDING", F.lit("non_pending_audit")),
        )
    )


BATCH_COUNTERS = {
    "high_confidence": "confidence >= 0.80",
    "low_confidence": "confidence < 0.65",
    "disqualifying_rules": "rule_type = 'disqualifying'",
    "prerequisite_rules": "rule_type = 'prerequisite'",
    "eligibility_rules": "rule_type = 'eligibility'",
    "with_ambiguities": "size(flags) > 0",
}


def validate_batches(rules: DataFrame, batches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Counters per batch: rules are folded to their scheme first, then to the batch."""
    per_scheme = rules.withColumn("issues", F.size(batch_issues(rules))).groupBy("slug").agg(
        F.count("*").alias("total_rules"),
        F.sum("issues").alias("issues"),
        *[F.count_if(F.expr(test)).alias(name) for name, test in BATCH_COUNTERS.items()],
    )
    joined = per_scheme.join(batches, "slug").join(reviews.select("slug", "flagged"), "slug")
    return joined.groupBy("batch").agg(
        F.count("*").alias("total_schemes"),
        F.sum("total_rules").alias("total_rules"),
        F.sum("issues").alias("issues"),
        F.count_if("flagged").alias("flagged_for_review"),
        *[F.sum(name).alias(name) for name in BATCH_COUNTERS],
    )


def flagged_top(reviews: DataFrame, per_severity: int = 5) -> DataFrame:
    """First flagged schemes per severity in file order."""
    w = Window.partitionBy("severity").orderBy("position")
    return (
        reviews.where("flagged")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= per_severity)
    )


def band() -> Column:
    c = F.col("confidence")
    return (
        F.when(c >= 0.90, "0.90-1.00").when(c >= 0.80, "0.80-0.89").when(c >= 0.70, "0.70-0.79")
        .when(c >= 0.60, "0.60-0.69").otherwise("<0.60")
    )


def rule_statistics(rules: DataFrame) -> DataFrame:
    """Counts by type, condition, operator and confidence band in one pass."""
    dims = ["rule_type", "condition_type", "operator", "band"]
    grouped = (
        rules.withColumn("band", band())
        .groupingSets([[d] for d in dims], *dims)
        .agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))
    )
    kind = F.lit(None).cast("string")
    for d in dims:
        kind = F.coalesce(kind, F.when(F.col(d).isNotNull(), F.lit(d)))
    return grouped.select(
        kind.alias("dimension"), F.coalesce(*dims).alias("bucket"), "n", F.round("avg_confidence", 6).alias("avg_confidence")
    )


def top_shares(counts: DataFrame, k: int) -> DataFrame:
    """Top-k buckets of a count table with their share of the total."""
    total = Window.partitionBy()
    w = Window.orderBy(F.desc("n"), "bucket")
    return (
        counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(total), 4))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
    )
