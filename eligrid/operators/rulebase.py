"""Rule base preparation: aliases, filters, state overrides, nesting per scheme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import cells, predicates

NO_STATE = "*"


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def alias_operators(rules: DataFrame) -> DataFrame:
    """Map operator aliases; NOT_BETWEEN has no counterpart and is dropped."""
    upper = F.upper("operator")
    mapped = F.coalesce(F.try_element_at(_map(model.OPERATOR_ALIASES), upper), F.col("operator"))
    return rules.where(upper != "NOT_BETWEEN").withColumn("operator", mapped)


def drop_bad_between(rules: DataFrame) -> DataFrame:
    """A BETWEEN rule without two numeric bounds is unusable."""
    unusable = (F.col("operator") == "BETWEEN") & (
        F.col("value_min").cast("string").try_cast("double").isNull()
        | F.col("value_max").cast("string").try_cast("double").isNull()
    )
    return rules.where(~unusable)


def phase(rule_type: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(rule_type, F.lit("eligibility"))))
    return F.coalesce(F.try_element_at(_map(model.PHASES), key), F.lit("C"))


def audit_cents(status: Column) -> Column:
    return F.coalesce(
        F.try_element_at(_map(model.AUDIT_CENTS), status), F.lit(model.AUDIT_CENTS_DEFAULT)
    )


def with_condition_type(rules: DataFrame) -> DataFrame:
    """Condition type from the last segment of the field path."""
    segment = F.element_at(F.split("field", r"\."), -1)
    known = F.try_element_at(_map(model.CONDITION_TYPE_BY_SEGMENT), segment)
    return rules.withColumn("condition_type", F.coalesce(known, segment))


def load_ready(rules: DataFrame) -> DataFrame:
    """Rules that survive reading: aliased and with usable bounds."""
    return drop_bad_between(alias_operators(rules))


def exclusions(rules: DataFrame, queue: DataFrame) -> DataFrame:
    """Excluded-rule count per scheme: disputed ones, then queued ones."""
    return (
        mark_excluded(rules, queue)
        .groupBy("scheme_id")
        .agg(F.count_if("excluded").cast("int").alias("excluded_count"))
    )


def mark_excluded(rules: DataFrame, queue: DataFrame) -> DataFrame:
    queued = queue.select("rule_id", F.lit(True).alias("queued")).distinct()
    return rules.join(queued, "rule_id", "left").withColumn(
        "excluded",
        (F.col("audit_status") == "DISPUTED") | F.coalesce("queued", F.lit(False)),
    )


def active_rules(rules: DataFrame, schemes: DataFrame, queue: DataFrame) -> DataFrame:
    """Rules of active schemes without disputed and queued ones."""
    active = schemes.where("status = 'active'").select("scheme_id")
    return (
        rules.join(active, "scheme_id", "left_semi")
        .where("audit_status <> 'DISPUTED'")
        .join(queue.select("rule_id"), "rule_id", "left_anti")
    )


def broken_supersession(rules: DataFrame) -> DataFrame:
    """State rules that supersede a central rule which is not there."""
    central = rules.where("state_scope = 'central'").select(
        F.col("scheme_id"), F.col("rule_id").alias("supersedes_rule_id")
    )
    return rules.where("state_scope <> 'central' AND supersedes_rule_id IS NOT NULL").join(
        central, ["scheme_id", "supersedes_rule_id"], "left_anti"
    )


def effective_rules(rules: DataFrame, states: tuple[str, ...] = model.STATE_CODES) -> DataFrame:
    """Per state: central rules it does not supersede, plus the state's own rules.

    The state list is a fixed vocabulary, so central rules are replicated over it
    by an explode and overrides removed by an equi anti-join. The key "*" stands
    for profiles without a state and holds central rules only.
    """
    keys = F.array(*[F.lit(s) for s in (NO_STATE, *states)])
    central = rules.where("state_scope = 'central'").withColumn("state", F.explode(keys))
    local = rules.where("state_scope <> 'central'").withColumn("state", F.col("state_scope"))
    gone = local.where("supersedes_rule_id IS NOT NULL").select(
        "state", "scheme_id", F.col("supersedes_rule_id").alias("rule_id")
    )
    kept = central.join(gone, ["state", "scheme_id", "rule_id"], "left_anti")
    return kept.unionByName(local)


def listed_rules(rules: DataFrame, states: tuple[str, ...] = model.STATE_CODES) -> DataFrame:
    """The rules of `effective_rules` without a copy per state: a scheme's central rules once, with a null state, and
    again only for each state with rules of its own for that scheme."""
    central = rules.where("state_scope = 'central'")
    local = rules.where("state_scope <> 'central'").where(F.col("state_scope").isin(NO_STATE, *states)).withColumn("state", F.col("state_scope"))
    gone = local.where("supersedes_rule_id IS NOT NULL").select("state", "scheme_id", F.col("supersedes_rule_id").alias("rule_id"))
    again = central.join(local.select("state", "scheme_id").distinct(), "scheme_id").join(gone, ["state", "scheme_id", "rule_id"], "left_anti")
    return central.withColumn("state", F.lit(None).cast("string")).unionByName(again).unionByName(local)


def flag_severity(flags: DataFrame) -> DataFrame:
    """Severity per flag id; the last flag in catalogue order wins on duplicates."""
    order = F.struct("scheme_id", "ord", "pos")
    return flags.groupBy("ambiguity_id").agg(F.max_by("severity", order).alias("severity"))


def rule_notes(flags: DataFrame) -> DataFrame:
    """Per rule: its note ids in order and how many resolve to each severity."""
    resolved = flags.alias("f").join(
        flag_severity(flags).withColumnRenamed("severity", "global_severity"), "ambiguity_id", "left"
    )
    return resolved.groupBy("rule_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "ambiguity_id"))), lambda x: x["ambiguity_id"]
        ).alias("notes"),
        F.bool_or(F.col("severity") == "CRITICAL").alias("own_critical"),
        F.count_if(F.col("global_severity") == "CRITICAL").cast("int").alias("critical_notes"),
        F.count_if(F.col("global_severity") == "HIGH").cast("int").alias("high_notes"),
        F.count_if(F.col("global_severity") == "MEDIUM").cast("int").alias("medium_notes"),
    )


def bind(rules: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Resolve everything about a rule that does not depend on a profile."""
    slots = _map(model.FIELD_SLOT)
    if "items" in rules.columns:
        # Typed elements as read from files: no text form in between.
        items = F.col("items")
    else:
        items = F.when(
            F.coalesce(F.length("values_text"), F.lit(0)) > 0,
            F.transform(
                F.split("values_text", r"\|"),
                lambda x: cells.cell_from_text(F.col("values_kind"), x),
            ),
        )
    bound = rules.withColumns(
        {
            "phase": phase(F.col("rule_type")),
            "opcode": F.try_element_at(_map(predicates.OPCODE), F.col("operator")),
            "slot": F.try_element_at(slots, F.col("field")),
            "v": cells.cell_from_text(F.col("value_kind"), F.col("value_text")),
            "items": F.coalesce(items, F.array().cast(f"array<{cells.CELL}>")),
            "pattern_ok": (F.col("operator") != "MATCHES")
            | predicates.pattern_is_valid(F.col("value_text")),
            "audit_cents": audit_cents(F.col("audit_status")),
            "numeric_op": F.col("operator").isin(*model.NUMERIC_OPERATORS),
        }
    )
    if flags is None:
        return bound.withColumns(
            {
                "notes": F.array().cast("array<string>"),
                "own_critical": F.lit(False),
                "critical_notes": F.lit(0),
                "high_notes": F.lit(0),
                "medium_notes": F.lit(0),
            }
        )
    return bound.join(rule_notes(flags), "rule_id", "left").withColumns(
        {
            "notes": F.coalesce("notes", F.array().cast("array<string>")),
            "own_critical": F.coalesce("own_critical", F.lit(False)),
            "critical_notes": F.coalesce("critical_notes", F.lit(0)),
            "high_notes": F.coalesce("high_notes", F.lit(0)),
            "medium_notes": F.coalesce("medium_notes", F.lit(0)),
        }
    )


RULE_COLUMNS = (
    "phase", "ord", "rule_id", "field", "slot", "operator", "opcode", "v", "value_min", "value_max",
    "items", "values_text", "pattern_ok", "audit_status", "audit_cents", "numeric_op", "notes",
    "own_critical", "critical_notes", "high_notes", "medium_notes", "display_text",
    "source_quote", "source_url", "logic_group", "logic_operator",
)


def nest(schemes: DataFrame, bound: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row per (state, scheme): rules in evaluation order, required fields, counts.

    A scheme whose rules are all excluded keeps a row with no rules.
    """
    rules = effective_rules(bound)
    nested = rules.groupBy("state", "scheme_id").agg(
        F.array_sort(F.collect_list(F.struct(*RULE_COLUMNS))).alias("rules"),
        F.array_sort(F.collect_set("field")).alias("required"),
        F.collect_set("slot").alias("required_slots"),
    )
    keys = F.array(*[F.lit(s) for s in (NO_STATE, *model.STATE_CODES)])
    grid = schemes.where("status = 'active'").select(
        "scheme_id", "scheme_name", "ministry", "position", F.explode(keys).alias("state")
    )
    rule_type = rules.select(F.array(F.struct(*RULE_COLUMNS))).schema[0].dataType.simpleString()
    return (
        grid.join(nested, ["state", "scheme_id"], "left")
        .join(excluded, "scheme_id", "left")
        .withColumns(
            {
                "rules": F.coalesce("rules", F.array().cast(rule_type)),
                "required": F.coalesce("required", F.array().cast("array<string>")),
                "required_slots": F.coalesce("required_slots", F.array().cast("array<int>")),
                "excluded_count": F.coalesce("excluded_count", F.lit(0)),
            }
        )
    )


def validation_errors() -> Column:
    """Constraint violations of a rule row: confidence, bounds, required fields, flag code."""
    missing = [
        F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing {c}"))
        for c in ("rule_id", "scheme_id", "field", "operator", "display_text")
    ]
    return F.array_compact(
        F.array(
            F.when(~F.col("confidence").between(0.0, 1.0), F.lit("confidence out of range")),
            F.when(
                (F.col("operator") == "BETWEEN") & (F.col("value_min").isNull() | F.col("value_max").isNull()),
                F.lit("between without bounds"),
            ),
            F.when(~F.col("operator").isin(*model.OPERATORS), F.lit("unknown operator")),
            F.when(~F.col("flag_code").between(1, 30), F.lit("flag code out of range")),
            *missing,
        )
    )


def build(rules: DataFrame) -> DataFrame:
    """Fill a rule's defaults and name what is wrong with it."""
    typed = with_condition_type(rules)
    return typed.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(0.90)),
            "rule_type": F.coalesce("rule_type", F.lit("eligibility")),
            "label": F.try_element_at(_map(model.FIELD_NAMESPACE), F.col("field")),
            "error": F.when(~F.col("operator").isin(*model.OPERATORS), "invalid operator").when(
                ~F.col("field").isin(*model.FIELD_NAMESPACE), "unknown field"
            ),
        }
    )


def _listed() -> Column:
    shown = F.when(F.length("values_text") > 0, F.col("values_text")).otherwise(F.coalesce("value_text", F.lit("None")))
    return F.replace(shown, F.lit("|"), F.lit(", "))


def display_text() -> Column:
    """Generated sentence per operator."""
    label = F.coalesce(F.try_element_at(_map(model.FIELD_NAMESPACE), F.col("field")), F.col("field"))
    value = F.coalesce("value_text", F.lit("None"))
    lo, hi = (F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("value_min", "value_max"))
    op = F.col("operator")
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    chain = F.when(
        op == "BETWEEN",
        F.when(F.contains("field", F.lit("age")), join("Applicant age must be between ", lo, " and ", hi, " years")).otherwise(
            join(label, " must be between ", lo, " and ", hi)
        ),
    )
    plain = {
        "EQ": (" must equal ", value), "NEQ": (" must not equal ", value), "LT": (" < ", value), "LTE": (" ≤ ", value),
        "GT": (" > ", value), "GTE": (" ≥ ", value), "IN": (" must be one of: ", _listed()),
        "NOT_MEMBER": (" must not be a member of: ", _listed()), "NOT_IN": (" must not be: ", _listed()),
        "IS_NULL": (" must be absent",), "IS_NOT_NULL": (" must be present",),
        "CONTAINS": (" must contain '", value, "'"), "MATCHES": (" must match pattern '", value, "'"),
    }
    for name, parts in plain.items():
        chain = chain.when(op == name, join(label, *parts))
    return chain.otherwise(join(label, " ", op, " ", value))


def condition_text() -> Column:
    """`field OP value` form of a rule."""
    op, field = F.col("operator"), F.col("field")
    value = F.coalesce("value_text", F.lit("None"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return (
        F.when(op == "BETWEEN", F.concat(field, F.lit(" BETWEEN "), text("value_min"), F.lit(" AND "), text("value_max")))
        .when(op.isin("IN", "NOT_IN", "NOT_MEMBER"), F.concat(field, F.lit(" "), op, F.lit(" ("), _listed(), F.lit(")")))
        .when(op.isin("IS_NULL", "IS_NOT_NULL"), F.concat(field, F.lit(" "), op))
        .otherwise(F.concat_ws(" ", field, op, value))
    )


def decision_table(rules: DataFrame) -> DataFrame:
    """Thirteen-column decision-table rows; a rule without display text has an error instead."""
    typed = with_condition_type(rules)
    return typed.select(
        F.col("rule_id").alias("Rule_ID"), F.col("scheme_id").alias("Scheme_ID"), F.col("rule_type").alias("Rule_Type"),
        F.col("condition_type").alias("Condition_Type"), F.col("field").alias("Field"), F.col("operator").alias("Operator"),
        condition_text().alias("Condition"), F.col("source_quote").alias("Source_Quote"), F.col("source_url").alias("Source_URL"),
        F.col("confidence").alias("Confidence"), F.col("audit_status").alias("Audit_Status"),
        F.col("display_text").alias("Display_Text"), F.lit("1.0.0").alias("Version"),
        F.when(F.coalesce("display_text", F.lit("")) == "", "empty display_text").alias("error"),
    )


def groups(rules: DataFrame) -> DataFrame:
    """Rule groups with their ALL/ANY text; an invalid logic word is an error."""
    words = {"AND": "ALL", "OR": "ANY", "AND_OR_AMBIGUOUS": "ALL OR ANY (ambiguous)"}
    logic = F.coalesce("logic_operator", F.lit("AND"))
    grouped = rules.where("logic_group IS NOT NULL").groupBy("scheme_id", "logic_group").agg(
        F.max_by(logic, "ord").alias("logic"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "rule_id"))), lambda x: x["rule_id"]).alias("rule_ids"),
    )
    word = F.try_element_at(_map(words), F.col("logic"))
    return grouped.withColumns(
        {
            "display_text": F.concat(F.lit("Applicant must satisfy "), word, F.lit(" of the following rules")),
            "error": F.when(word.isNull(), F.concat(F.lit("invalid logic "), F.col("logic"))),
        }
    )
