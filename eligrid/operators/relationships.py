"""Relationship mining between schemes from shared fields and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid.functions.grams import grams
from eligrid.session import broadcast_if_small

MIN_CONFIDENCE, DISPLAY_CONFIDENCE = 0.30, 0.60


def profiles_of(rules: DataFrame) -> DataFrame:
    """Field set and condition-type set per scheme."""
    return rules.groupBy("scheme_id").agg(
        F.array_sort(F.collect_set("field")).alias("fields"),
        F.array_sort(F.collect_set("condition_type")).alias("types"),
    )


def shared_pairs(sets: DataFrame) -> DataFrame:
    """Scheme pairs with at least one common field, with overlap measures.

    Schemes are first folded to distinct (fields, types) signatures; an inverted
    index over fields joins signatures, and only then are schemes listed again, so
    look-alike schemes do not multiply the work of comparing.
    """
    signature = F.sha2(F.concat_ws("|", F.array_join("fields", ","), F.array_join("types", ",")), 256)
    signed = sets.withColumn("sig", signature)
    sigs = signed.dropDuplicates(["sig"]).select("sig", "fields", "types")
    index = sigs.select("sig", F.explode("fields").alias("field"))
    left = index.select(F.col("sig").alias("sig_a"), "field")
    right = index.select(F.col("sig").alias("sig_b"), "field")
    # Measures are the same both ways, so each pair of signatures is compared once.
    hits = left.join(right, "field").where("sig_a <= sig_b").groupBy("sig_a", "sig_b").agg(F.count("*").alias("shared"))
    a = sigs.select(F.col("sig").alias("sig_a"), F.col("fields").alias("fa"), F.col("types").alias("ta"))
    b = sigs.select(F.col("sig").alias("sig_b"), F.col("fields").alias("fb"), F.col("types").alias("tb"))
    measured = hits.join(a, "sig_a").join(b, "sig_b").select(
        "sig_a", "sig_b",
        F.least(F.lit(1.0), 1.2 * F.col("shared") / (F.size("fa") + F.size("fb") - F.col("shared"))).alias("jaccard"),
        (F.col("shared") / F.greatest(F.size("fa"), F.size("fb"))).alias("overlap"),
        F.arrays_overlap("ta", "tb").alias("same_benefit"),
        (F.array_contains("ta", "dwelling_ownership") & F.array_contains("tb", "dwelling_ownership")).alias("dwelling"),
    )
    left_ids = signed.select(F.col("sig").alias("sig_a"), F.col("scheme_id").alias("id_a"))
    right_ids = signed.select(F.col("sig").alias("sig_b"), F.col("scheme_id").alias("id_b"))
    # Two signatures list a pair once, in either order; within one signature only the ordered half.
    listed = measured.join(left_ids, "sig_a").join(right_ids, "sig_b").where("sig_a <> sig_b OR id_a < id_b")
    return listed.select(
        F.least("id_a", "id_b").alias("scheme_a"), F.greatest("id_a", "id_b").alias("scheme_b"), "jaccard", "overlap", "same_benefit", "dwelling"
    )


# Lengths of anchors; an id has one of the largest size that it can hold.
ANCHORS = (1, 2, 4, 8)


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of one length; no more than the text is long."""
    return F.array_distinct(grams(text, size))


def anchors(ids: DataFrame, key: str) -> DataFrame:
    """Every id with its anchor: of its substrings of the anchor length, the one that fewest ids hold."""
    low = F.lower(F.col(key))
    size, parts = F.lit(ANCHORS[0]), _grams(low, ANCHORS[0])
    for n in ANCHORS[1:]:
        size, parts = F.when(F.length(low) >= n, n).otherwise(size), F.when(F.length(low) >= n, _grams(low, n)).otherwise(parts)
    each = ids.where(F.length(key) > 0).select(F.col(key), size.alias("size"), F.explode(parts).alias("gram"))
    held = each.groupBy("gram").agg(F.count("*").alias("holders"))
    return each.join(held, "gram").groupBy(key).agg(F.min(F.struct("holders", "gram")).alias("rarest"), F.first("size").alias("size")).select(
        key, F.col("rarest.gram").alias("gram"), "size"
    )


def mentions(texts: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """Rows of `texts` whose text contains an id, ignoring case, without comparing every text with every id.

    Each id is looked for by its anchor only, a substring of one of four fixed lengths, and compared in place where the
    anchor occurs. A text makes at most four substrings per character, however many lengths the ids have.
    """
    anchored = broadcast_if_small(anchors(ids, key))
    sizes = sorted(r[0] for r in anchored.select("size").distinct().collect())  # at most four
    low = F.lower(F.col(text))
    parts = F.concat(F.array().cast("array<string>"), *[_grams(low, n) for n in sizes])
    return texts.withColumn("gram", F.explode(parts)).join(anchored, "gram").where(F.contains(low, F.lower(F.col(key)))).drop("gram", "size")


def exclusions(rules: DataFrame, schemes: DataFrame) -> DataFrame:
    """Unordered scheme pairs where a disqualifying rule of one mentions the other."""
    texts = F.filter(
        F.concat(F.split("values_text", r"\|"), F.array(F.coalesce("value_text", F.lit("")))), lambda x: x != ""
    )
    named = rules.where("rule_type = 'disqualifying'").select("scheme_id", F.explode(texts).alias("text")).distinct()
    ids = schemes.select(F.col("scheme_id").alias("other"))
    hits = mentions(named, ids, "text", "other").where("scheme_id <> other")
    return hits.select(
        F.least("scheme_id", "other").alias("scheme_a"), F.greatest("scheme_id", "other").alias("scheme_b")
    ).distinct()


def prerequisites(rules: DataFrame, schemes: DataFrame) -> DataFrame:
    """Unordered scheme pairs where one lists the other as a prerequisite."""
    known = schemes.select(F.col("scheme_id").alias("prerequisite_scheme_id"))
    named = rules.where("prerequisite_scheme_id IS NOT NULL AND prerequisite_scheme_id <> scheme_id")
    return named.join(known, "prerequisite_scheme_id", "left_semi").select(
        F.least("scheme_id", "prerequisite_scheme_id").alias("scheme_a"),
        F.greatest("scheme_id", "prerequisite_scheme_id").alias("scheme_b"),
    ).distinct()


def detect(pairs: DataFrame, excluded: DataFrame, required: DataFrame, similarity: DataFrame) -> DataFrame:
    """Relationship per pair by priority: exclusion, prerequisite, overlap measures, similarity.

    Pairs with neither a shared field nor a reference can only score through the
    similarity fallback, so `similarity` rows join in fully.
    """
    keys = ["scheme_a", "scheme_b"]
    joined = (
        pairs.join(excluded.withColumn("excl", F.lit(True)), keys, "full_outer")
        .join(required.withColumn("req", F.lit(True)), keys, "full_outer")
        .join(similarity, keys, "full_outer")
    )
    sim = F.coalesce("sim", F.lit(0.0))
    overlap, same = F.coalesce("overlap", F.lit(0.0)), F.coalesce("same_benefit", F.lit(False))
    jaccard = F.coalesce("jaccard", F.lit(0.0))

    def made(kind: str, confidence: Column) -> Column:
        return F.struct(F.lit(kind).alias("relationship_type"), confidence.cast("double").alias("confidence"))

    verdict = (
        F.when(F.col("excl"), made("MUTUAL_EXCLUSION", F.greatest(F.lit(0.85), sim)))
        .when(F.col("req"), made("PREREQUISITE", F.lit(0.80)))
        .when(F.col("dwelling"), made("MUTUAL_EXCLUSION", F.greatest(jaccard, F.lit(0.85))))
        .when((overlap >= 0.70) & same, made("OVERLAP", jaccard))
        .when((overlap >= 0.50) & ~same, made("COMPLEMENTARY", jaccard))
        .otherwise(made("OVERLAP", F.when(overlap > 0, sim * overlap).otherwise(sim * 0.3)))
    )
    return (
        joined.withColumn("v", verdict)
        .select(*keys, "v.relationship_type", "v.confidence")
        .where(F.col("confidence") >= MIN_CONFIDENCE)
        .withColumn("display_to_user", F.col("confidence") >= DISPLAY_CONFIDENCE)
    )
