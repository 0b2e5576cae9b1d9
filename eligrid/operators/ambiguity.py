"""Ambiguity detection against the thirty-type taxonomy, severities and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import patterns as P
from eligrid.operators.mining import analysed, found

# ---- fixed values: severity to impact sentence -------------------------------
IMPACT = {
    "CRITICAL": "This rule's outcome may be determined differently by different district offices — a partial determination is provided.",
    "HIGH": "This ambiguity may affect the confidence score. The local office may interpret this rule differently.",
    "MEDIUM": "Minor wording ambiguity noted. Outcome is likely unchanged but documented for audit.",
    "LOW": "Low-impact wording issue. No action required.",
}
# ---- end of fixed values ------------------------------------------------------


def impact(level: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])
    return F.coalesce(F.try_element_at(texts, level), F.lit(""))


def names() -> Column:
    return F.create_map(*[F.lit(x) for kv in model.AMBIGUITY_TAXONOMY.items() for x in kv])


def severity(code: Column, field: Column | None = None) -> Column:
    """Severity of a type; a HIGH one on a core field becomes CRITICAL."""
    high = F.lit("HIGH")
    if field is not None:
        core = F.lit(False)
        for word in model.UPGRADE_WORDS:
            core = core | F.contains(F.coalesce(field, F.lit("")), F.lit(word))
        high = F.when(core, "CRITICAL").otherwise("HIGH")
    return (
        F.when(code.isin(*model.CRITICAL_TYPES), "CRITICAL")
        .when(code.isin(*model.HIGH_TYPES), high)
        .when(code.isin(*model.MEDIUM_TYPES), "MEDIUM")
        .otherwise("LOW")
    )


def detect(text: Column) -> Column:
    """Codes whose pattern occurs in the text, in checking order, each once."""
    return F.array_compact(
        F.array(*[F.when(found(text, p, ignore_case=True), F.lit(code)) for code, p in P.TAXONOMY_CHECKS])
    )


def detected(rows: DataFrame, text: str = "sentence") -> DataFrame:
    """Add `detected`, the codes found in each row's text."""
    return analysed(rows, {"detected": detect(F.col(text))}, text)


def describe(code: Column, text: Column) -> Column:
    name = names()[code]
    snippet = F.translate(F.substring(text, 1, 200), "\n", " ")
    return F.concat(
        name, F.lit(" detected in: '"),
        F.when(F.length(text) > 200, F.concat(snippet, F.lit("..."))).otherwise(text), F.lit("'"),
    )


def flags(rules: DataFrame, text: str = "sentence") -> DataFrame:
    """One row per detected flag of a rule's text; the id is a digest, so replays agree."""
    return (
        detected(rules.select("scheme_id", "rule_id", "field", F.col(text).alias("text")), "text")
        .select("scheme_id", "rule_id", "field", "text", F.explode("detected").alias("code"))
        .withColumns(
            {
                "ambiguity_id": F.concat(
                    F.lit("AMB-"),
                    F.upper(F.sha2(F.concat_ws("|", "rule_id", F.col("code").cast("string")), 256)),
                ),
                "type_name": names()[F.col("code")],
                "severity": severity(F.col("code")),
                "description": describe(F.col("code"), F.col("text")),
                "resolution_status": F.lit("OPEN"),
            }
        )
    )


def merge_codes(own: Column, detected: Column) -> Column:
    """A rule's own codes followed by detected ones not yet present."""
    return F.concat(own, F.array_except(detected, own))


def export_markdown(flag_rows: DataFrame) -> DataFrame:
    columns = ("ambiguity_id", "scheme_id", "type_name", "severity", "resolution_status")
    return flag_rows.select(
        F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |")).alias("value")
    )
