"""Joining external classifications and detections into mined rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid.functions.patterns import OTHER_FIELD
from eligrid.session import broadcast_if_small

MIN_CONFIDENCE = 0.60

# ---- fixed values: field to condition type of classified rules ---------------
CONDITION_TYPES = {
    "applicant.age": "age_range",
    "applicant.gender": "gender",
    "applicant.caste_category": "caste_category",
    "applicant.education_level": "education_level",
    "applicant.marital_status": "marital_status",
    "applicant.disability_status": "disability_status",
    "applicant.nationality": "nationality",
    "applicant.religion": "religion",
    "employment.occupation": "occupation",
    "employment.employment_status": "employment_status",
    "employment.is_income_tax_payer": "employment:income_tax_status",
    "household.income_annual": "income_ceiling",
    "household.bpl_status": "bpl_status",
    "household.family_size": "family_size",
    "household.is_ration_card_holder": "ration_card_status",
    "location.state": "domicile",
    "location.district": "district",
    "location.is_urban": "urban_rural",
    "assets.cultivable_land": "land_ownership",
    "assets.house_ownership": "house_ownership",
    "documents.aadhaar": "document:aadhaar",
    "documents.bank_account": "document:bank_account",
    "eligibility.other": "other",
}
# ---- end of fixed values ------------------------------------------------------


def cache_key(text: Column) -> Column:
    return F.md5(F.trim(text))


def sanitise(classified: DataFrame) -> DataFrame:
    """A field outside the vocabulary becomes `other` with confidence at most one half."""
    known = F.col("c_field").isin(*CONDITION_TYPES)
    return classified.withColumns(
        {
            "c_confidence": F.when(known, F.col("c_confidence")).otherwise(F.least("c_confidence", F.lit(0.5))),
            "c_field": F.when(known, F.col("c_field")).otherwise(OTHER_FIELD),
        }
    )


def classify(rules: DataFrame, classified: DataFrame) -> DataFrame:
    """Apply a classification where the field is still open and confidence suffices."""
    types = F.create_map(*[F.lit(x) for kv in CONDITION_TYPES.items() for x in kv])
    joined = rules.withColumn("key", cache_key(F.col("sentence"))).join(broadcast_if_small(sanitise(classified)), "key", "left")
    open_rule = (F.col("field") == OTHER_FIELD) & F.col("c_confidence").isNotNull()
    enough = F.col("c_confidence") >= MIN_CONFIDENCE
    kept_other = (F.col("c_field") == OTHER_FIELD) & ~F.col("c_procedural")
    applies = F.coalesce(open_rule & enough & ~kept_other, F.lit(False))
    # A confident "still other" only refreshes the wording.
    reworded = F.coalesce(open_rule & enough, F.lit(False)) & F.col("c_condition").isNotNull()
    op = F.coalesce("c_operator", "operator")
    ranged, listed = op == "BETWEEN", op.isin("IN", "NOT_IN")
    return joined.withColumns(
        {
            "outcome": F.when(applies, "classified")
            .when(open_rule & ~enough, "low_confidence")
            .when(open_rule, "kept_other")
            .otherwise("already_classified"),
            "condition": F.when(reworded, F.col("c_condition")).otherwise(F.col("condition")),
            "display_text": F.when(reworded, F.col("c_condition")).otherwise(F.col("display_text")),
            "value": F.when(applies, F.when(~ranged & ~listed, F.col("c_value"))).otherwise(F.col("value")),
            "value_min": F.when(applies, F.when(ranged, F.col("c_min"))).otherwise(F.col("value_min")),
            "value_max": F.when(applies, F.when(ranged, F.col("c_max"))).otherwise(F.col("value_max")),
            "values": F.when(applies & listed, F.col("c_values"))
            .when(applies & ~ranged, F.array().cast("array<string>"))
            .otherwise(F.col("values")),
            "condition_type": F.when(applies, F.coalesce(F.try_element_at(types, F.col("c_field")), F.lit("other"))).otherwise(
                F.col("condition_type")
            ),
            "confidence": F.when(applies, F.round("c_confidence", 3)).otherwise(F.col("confidence")),
            "notes": F.when(applies, F.lit("[enhanced]")).otherwise(F.col("notes")),
            "operator": F.when(applies, op).otherwise(F.col("operator")),
            "field": F.when(applies, F.col("c_field")).otherwise(F.col("field")),
        }
    )


def add_codes(own: Column, detected: Column) -> Column:
    """Own codes plus valid detected ones not yet present."""
    valid = F.filter(detected, lambda c: c.between(1, 30))
    return F.concat(own, F.array_except(valid, own))
