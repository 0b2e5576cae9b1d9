"""Gap analysis: why a profile misses a scheme and what would close the gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import cells
from eligrid.operators import decision, predicate_index, profiles
from eligrid.session import broadcast_if_small

# Statuses without a gap.
MET = ("ELIGIBLE", "ELIGIBLE_WITH_CAVEATS")


def required_text(r: Column) -> Column:
    """Display form of what a rule asks for: list, range or value."""
    listed = cells.list_text(F.split(r["values_text"], r"\|"))
    ranged = F.concat(
        F.lit("["), F.coalesce(r["value_min"].cast("string"), F.lit("None")), F.lit(", "),
        F.coalesce(r["value_max"].cast("string"), F.lit("None")), F.lit("]"),
    )
    return (
        F.when(F.length(r["values_text"]) > 0, listed)
        .when(r["value_min"].isNotNull() | r["value_max"].isNotNull(), ranged)
        .otherwise(F.coalesce(r["v"]["s"], F.lit("None")))
    )


def _is_range(r: Column) -> Column:
    return (F.length(r["values_text"]) > 0) | r["value_min"].isNotNull() | r["value_max"].isNotNull()


def classify(r: Column, u: Column, outcome: Column) -> Column:
    """struct(gap_type, magnitude) of a failed or undetermined rule."""
    none = F.lit(None).cast("double")

    def gap(kind: str, size: Column = none) -> Column:
        return F.struct(F.lit(kind).alias("gap_type"), size.cast("double").alias("magnitude"))

    rule_bool = (r["v"]["kind"] == "bool") & ~_is_range(r)
    user_bool = u["kind"] == "bool"
    below, above = r["v"]["f"] - u["f"], u["f"] - r["v"]["f"]
    lo, hi = r["value_min"], r["value_max"]
    op = r["operator"]
    return (
        F.when((outcome == "UNDETERMINED") & (F.size(r["notes"]) > 0), gap("AMBIGUITY_BLOCK"))
        .when((u["kind"] == "null") | (outcome == "UNDETERMINED"), gap("MISSING_DATA"))
        .when(
            r["field"].isin(*model.DOCUMENT_FIELDS),
            F.when(user_bool & rule_bool, gap("MISSING_DOCUMENT")).otherwise(gap("BOOLEAN_MISMATCH")),
        )
        .when(user_bool | rule_bool, gap("BOOLEAN_MISMATCH"))
        .when(
            op.isin("GTE", "GT"),
            F.when(below > 0, gap("NUMERIC_UNDERSHOOT", below)).otherwise(gap("NUMERIC_OVERSHOOT", F.abs(below))),
        )
        .when(
            op.isin("LTE", "LT"),
            F.when(above > 0, gap("NUMERIC_OVERSHOOT", above)).otherwise(gap("NUMERIC_UNDERSHOOT", F.abs(above))),
        )
        .when(
            op == "BETWEEN",
            F.when(u["f"] < lo, gap("NUMERIC_UNDERSHOOT", lo - u["f"]))
            .when(u["f"] > hi, gap("NUMERIC_OVERSHOOT", u["f"] - hi))
            .otherwise(gap("NUMERIC_UNDERSHOOT")),
        )
        .otherwise(gap("CATEGORICAL_MISMATCH"))
    )


def with_gaps(dets: DataFrame) -> DataFrame:
    """Add `gap_rows` (failed and undetermined rules, in order) to non-eligible rows."""
    missed = dets.where(~F.col("status").isin("ELIGIBLE", "ELIGIBLE_WITH_CAVEATS"))
    open_items = F.transform(
        F.filter("evals", lambda e: e["outcome"].isin("FAIL", "UNDETERMINED")),
        lambda e: F.struct(
            decision.rule_at(e).alias("r"),
            profiles.lookup(
                F.col("cells"), F.col("extras"), decision.rule_at(e)["slot"], decision.rule_at(e)["field"]
            ).alias("u"),
            e["outcome"].alias("outcome"),
        ),
    )
    rows = F.transform(
        open_items,
        lambda g: F.struct(
            g["r"]["rule_id"].alias("rule_id"),
            g["r"]["phase"].alias("phase"),
            g["r"]["field"].alias("field"),
            g["r"]["operator"].alias("operator"),
            g["outcome"].alias("outcome"),
            F.coalesce(g["r"]["display_text"], F.lit("")).alias("display_text"),
            F.coalesce(g["u"]["s"], F.lit("None")).alias("user_text"),
            required_text(g["r"]).alias("required_text"),
            classify(g["r"], g["u"], g["outcome"]).alias("gap"),
        ),
    )
    return missed.withColumn("gap_rows", rows)


def failed_rules(gapped: DataFrame) -> DataFrame:
    return gapped.select("profile_id", "scheme_id", F.inline("gap_rows")).select(
        "profile_id", "scheme_id", "rule_id", "field", "operator", "display_text", "user_text",
        "required_text", F.col("gap.gap_type").alias("gap_type"), F.col("gap.magnitude").alias("magnitude"),
    )


def coded_failed_rules(coded: DataFrame, nested: DataFrame) -> DataFrame:
    """The rows of `failed_rules` from codes; coded: with cells and extras. What a rule asks for is put in words once per rule."""
    rule = F.transform("rules", lambda r: F.struct(r.alias("r"), required_text(r).alias("required_text")))
    worded = nested.select("state", "scheme_id", rule.alias("worded"))
    missed = coded.where(~F.col("status").isin(*MET)).select("profile_id", "state", "scheme_id", "codes", "cells", "extras")
    left = F.filter(F.transform("worded", lambda w, i: F.struct(w.alias("w"), F.get("codes", i).alias("code"))), lambda e: e["code"].isin(predicate_index.FAILED_CODE, predicate_index.OPEN_CODE))
    rows = missed.join(F.broadcast(worded), ["state", "scheme_id"]).select("profile_id", "scheme_id", "cells", "extras", F.inline(left))
    seen = rows.select(
        "profile_id", "scheme_id", "w", F.when(F.col("code") == predicate_index.OPEN_CODE, "UNDETERMINED").otherwise("FAIL").alias("outcome"),
        profiles.lookup(F.col("cells"), F.col("extras"), F.col("w.r.slot"), F.col("w.r.field")).alias("u"),
    )
    return seen.select(
        "profile_id", "scheme_id", "w.r.rule_id", "w.r.field", "w.r.operator", F.coalesce("w.r.display_text", F.lit("")).alias("display_text"),
        F.coalesce("u.s", F.lit("None")).alias("user_text"), "w.required_text", classify(F.col("w.r"), F.col("u"), F.col("outcome")).alias("gap"),
    ).select(
        "profile_id", "scheme_id", "rule_id", "field", "operator", "display_text", "user_text", "required_text", "gap.gap_type", "gap.magnitude"
    )


def unmet_prerequisites(dets: DataFrame) -> DataFrame:
    unmet = F.filter("evals", lambda e: (e["phase"] == "B") & ~decision.passed(e["outcome"]))
    return dets.select(
        "profile_id", "scheme_id", "rules", F.explode(unmet).alias("e")
    ).select("profile_id", "scheme_id", decision.rule_at(F.col("e"))["rule_id"].alias("prerequisite_id"))


def ambiguity_notes(dets: DataFrame) -> DataFrame:
    """First rule that carries each note, per profile and scheme."""
    pairs = F.flatten(
        F.transform(
            "evals",
            lambda e: F.transform(
                decision.rule_at(e)["notes"],
                lambda n: F.struct(n.alias("ambiguity_id"), decision.rule_at(e)["rule_id"].alias("rule_id")),
            ),
        )
    )
    missed = dets.where(~F.col("status").isin("ELIGIBLE", "ELIGIBLE_WITH_CAVEATS"))
    ids = F.transform("pairs", lambda p: p["ambiguity_id"])
    first = F.filter(
        "pairs", lambda p, i: F.array_position(ids, p["ambiguity_id"]) == i + 1
    )
    return (
        missed.withColumn("pairs", pairs)
        .select("profile_id", "scheme_id", F.inline(first))
        .withColumnRenamed("rule_id", "affects_rule")
        .withColumn("severity", F.lit("UNKNOWN"))
    )


def coded_notes(coded: DataFrame, nested: DataFrame) -> DataFrame:
    """The rows of `ambiguity_notes` from codes: the rules that carry a note are listed once per scheme and note."""
    rules = nested.select("state", "scheme_id", F.posexplode("rules").alias("idx", "r"))
    carried = rules.select("state", "scheme_id", F.struct("idx", "r.rule_id").alias("rule"), F.explode("r.notes").alias("ambiguity_id"))
    listed = carried.groupBy("state", "scheme_id", "ambiguity_id").agg(F.array_sort(F.collect_set("rule")).alias("carriers"))
    notes = listed.groupBy("state", "scheme_id").agg(F.collect_list(F.struct("ambiguity_id", "carriers")).alias("noted"))
    missed = coded.where(~F.col("status").isin(*MET)).select("profile_id", "state", "scheme_id", "codes")
    first = F.transform(
        "noted",
        lambda n: F.struct(
            n["ambiguity_id"].alias("ambiguity_id"),
            F.get(F.filter(n["carriers"], lambda c: F.get("codes", c["idx"]) >= predicate_index.COUNTED), F.lit(0))["rule_id"].alias("affects_rule"),
        ),
    )
    return (
        missed.join(broadcast_if_small(notes), ["state", "scheme_id"])
        .select("profile_id", "scheme_id", F.inline(first))
        .where("affects_rule IS NOT NULL")
        .withColumn("severity", F.lit("UNKNOWN"))
    )


ACTION = "struct<prefix:string,description:string,urgency:string,document:string,effort:string>"


def remediation(gapped: DataFrame) -> DataFrame:
    """Actions with one running counter per scheme: prerequisites first, then rule order."""

    def action(prefix: str, text: Column, urgency: str, document, effort) -> Column:
        return F.struct(
            F.lit(prefix).alias("prefix"), text.alias("description"), F.lit(urgency).alias("urgency"),
            (document if isinstance(document, Column) else F.lit(document)).cast("string").alias("document"),
            F.lit(effort).cast("string").alias("effort"),
        )

    documents = F.create_map(*[F.lit(x) for kv in model.DOCUMENT_FIELDS.items() for x in kv])
    enroll = F.transform(
        F.filter("gap_rows", lambda g: (g["phase"] == "B") & F.col("fired").isNull()),
        lambda g: action(
            "PREREQ",
            F.concat(
                F.lit("Enroll in "), g["rule_id"], F.lit(" ("), g["rule_id"],
                F.lit(") as a prerequisite. This scheme is required before you can apply."),
            ),
            "IMMEDIATE", None, "1-2 weeks",
        ),
    )

    def remedy(g: Column) -> Column:
        kind = g["gap"]["gap_type"]
        doc = documents[g["field"]]
        return (
            F.when(
                kind == "MISSING_DOCUMENT",
                action(
                    "DOC", F.concat(F.lit("Obtain a "), doc, F.lit(" to meet document requirement.")),
                    "IMMEDIATE", doc, "1-4 weeks",
                ),
            )
            .when(
                (kind == "BOOLEAN_MISMATCH") & (g["field"] == "documents.bank_account"),
                action(
                    "DOC",
                    F.lit(
                        "Open a bank account (Jan Dhan Yojana is free and available at all "
                        "nationalised banks) to receive Direct Benefit Transfer payments."
                    ),
                    "IMMEDIATE", "Bank account", "1-2 weeks",
                ),
            )
            .when(
                kind == "MISSING_DATA",
                action(
                    "DATA",
                    F.concat(F.lit("Provide information for field '"), g["field"], F.lit("' to enable evaluation.")),
                    "SHORT_TERM", None, "Immediate",
                ),
            )
            .when(
                kind.isin("NUMERIC_UNDERSHOOT", "NUMERIC_OVERSHOOT"),
                action(
                    "CONDITION",
                    F.concat(
                        F.lit("Condition not met for '"), g["display_text"], F.lit("'. Current value: "),
                        g["user_text"], F.lit(", required: "), g["required_text"], F.lit("."),
                    ),
                    "LONG_TERM", None, None,
                ),
            )
        )

    actions = F.concat(enroll, F.array_compact(F.transform("gap_rows", remedy)))
    numbered = F.transform(
        "actions",
        lambda a, i: F.struct(
            F.concat(a["prefix"], F.lit("-"), F.lpad((i + 1).cast("string"), 3, "0")).alias("action_id"),
            a["description"].alias("description"), a["urgency"].alias("urgency"),
            a["document"].alias("document_needed"), a["effort"].alias("estimated_effort"),
        ),
    )
    return gapped.withColumn("actions", actions).withColumn("remediations", numbered).drop("actions")


def near_miss_score() -> Column:
    """Passed share of all evaluated rules; only near misses and ineligible ones have it."""
    total = F.col("rules_passed") + F.col("rules_failed") + F.col("rules_undetermined")
    return F.when(
        F.col("status").isin("NEAR_MISS", "INELIGIBLE"),
        F.when(total == 0, 0.0).otherwise(F.col("rules_passed") / total),
    )
