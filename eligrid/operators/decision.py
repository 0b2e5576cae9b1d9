"""The phased decision procedure over profiles x schemes, as one narrow pass.

Each profile row meets the scheme rows of its state through an equi-join on the
state against the (small, measured) rule base; rules travel nested inside the
scheme row, so evaluation, short-circuits, counts and scores are expressions on
that row. The fact side is never shuffled, sorted or widened to profile x rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import predicates
from eligrid.operators import profiles as prof
from eligrid.session import BROADCAST_BYTES, within_limit

SALTS = 64
# Key of the rows that hold for any state: central rules only.
NO_STATE = "*"


def placed(profile_cells: DataFrame, states: DataFrame) -> DataFrame:
    """Profiles of a state that the rule base does not know go to the central rules."""
    known = F.broadcast(states.withColumn("_known", F.lit(True)))  # a row per state
    return profile_cells.join(known, "state", "left").withColumn("state", F.when(F.col("_known"), F.col("state")).otherwise(F.lit(NO_STATE))).drop("_known")


def meet(profile_cells: DataFrame, nested: DataFrame, limit: int = BROADCAST_BYTES, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """Join profiles to the schemes of their state.

    A profile of a state that the rule base does not know meets the central rules. A
    rule base within the limit is broadcast. A larger one is joined on (state, salt):
    profiles spread over the salts and the rule base is replicated per salt, so one
    crowded state does not land in one task.
    """
    found = placed(profile_cells, nested.select("state").distinct())
    if within_limit(nested, limit):
        return found.join(F.broadcast(nested), list(keys))
    salted = found.withColumn("salt", F.pmod(F.xxhash64("profile_id"), F.lit(SALTS)))
    spread = nested.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, [*keys, "salt"]).drop("salt")


def outcome(result: Column, audit_status: Column) -> Column:
    return (
        F.when(result.isNull(), "UNDETERMINED")
        .when(~result, "FAIL")
        .when(audit_status == "PENDING", "UNVERIFIED_PASS")
        .otherwise("PASS")
    )


def passed(o: Column) -> Column:
    return o.isin("PASS", "UNVERIFIED_PASS")


def outcome_cents(o: Column) -> Column:
    return (
        F.when(o == "PASS", model.PASS_CENTS)
        .when(o == "UNVERIFIED_PASS", model.UNVERIFIED_PASS_CENTS)
        .when(o == "FAIL", 0)
    )


def entry(r: Column, idx: Column, result: Column) -> Column:
    """Evaluation entry of a rule: its place, its outcome and what the counters read of it."""
    return F.struct(
        idx.alias("idx"),
        r["phase"].alias("phase"),
        r["ord"].alias("ord"),
        result.alias("outcome"),
        r["numeric_op"].alias("numeric_op"),
        r["own_critical"].alias("own_critical"),
        r["audit_cents"].alias("audit_cents"),
        (
            r["high_notes"] * model.HIGH_PENALTY_CENTS
            + r["medium_notes"] * model.MEDIUM_PENALTY_CENTS
        ).alias("penalty_cents"),
        r["critical_notes"].alias("critical_notes"),
    )


def judge(joined: DataFrame) -> DataFrame:
    """Outcome of every rule of every scheme, as the array `all_evals`.

    The inner transform lifts what the predicates touch out of the nested rule once;
    the outer one evaluates on those flat fields. An entry keeps the rule's index
    rather than the rule, so that the row stays narrow; details are looked up later.
    """
    seen = F.transform(
        F.transform(
            "rules",
            lambda r, i: F.struct(
                r.alias("r"), i.alias("idx"),
                prof.lookup(F.col("cells"), F.col("extras"), r["slot"], r["field"]).alias("u"),
            ),
        ),
        lambda e: F.struct(
            e["r"].alias("r"), e["r"]["opcode"].alias("op"),
            e["idx"].alias("idx"), e["u"]["kind"].alias("uk"), e["u"]["s"].alias("us"), e["u"]["f"].alias("uf"), e["u"]["a"].alias("ua"),
            e["r"]["v"]["kind"].alias("vk"), e["r"]["v"]["s"].alias("vs"), e["r"]["v"]["f"].alias("vf"),
            e["r"]["v"]["a"].alias("va"), e["r"]["audit_status"].alias("audit"),
        ),
    )

    def outcome_of(e: Column) -> Column:
        u = predicates.Cell(e["uk"], e["us"], e["uf"], e["ua"])
        v = predicates.Cell(e["vk"], e["vs"], e["vf"], e["va"])
        r = e["r"]
        result = predicates.evaluate(
            e["op"], u, v, r["value_min"], r["value_max"], r["items"], r["pattern_ok"]
        )
        return outcome(result, e["audit"])

    evals = F.transform(
        seen,
        lambda e: entry(e["r"], e["idx"], outcome_of(e)),
    )
    return settled(joined, {"all_evals": evals})


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns so that they are computed once per row.

    They come out of a generator over a single struct: a later filter on them stays
    above it, where a plain projection would be copied into the filter as well.
    """
    made = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(made))


def _sums(array: str, values: dict) -> Column:
    """Several sums over an array in one fold: a struct of longs, one per named value."""
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in values])
    return F.aggregate(
        array, zero, lambda acc, e: F.struct(*[(acc[n] + value(e).cast("long")).alias(n) for n, value in values.items()])
    )


def _one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def in_phase_c(e: Column) -> Column:
    """Eligibility rules plus numeric disqualifiers that failed."""
    return (e["phase"] == "C") | (
        (e["phase"] == "A") & (e["outcome"] == "FAIL") & e["numeric_op"]
    )


def decide(judged: DataFrame) -> DataFrame:
    """Short-circuits, evaluated rows, status and the three scores."""
    fired = F.array_min(
        F.transform(
            F.filter("all_evals", lambda e: (e["phase"] == "A") & (e["outcome"] == "PASS")),
            lambda e: F.struct(e["ord"].alias("ord"), e["idx"].alias("idx")),
        )
    )
    kept = F.filter(
        "all_evals",
        lambda e: F.when(
            F.col("fired").isNotNull(),
            (e["phase"] == "A") & (e["ord"] <= F.col("fired")["ord"]),
        )
        .when(F.col("prereq_unmet") > 0, e["phase"].isin("A", "B"))
        .otherwise(True),
    )
    required = F.size("required")
    present = F.size(F.array_intersect("required_slots", "populated"))
    scored = F.col("rules_passed") + F.col("rules_failed")
    audit_mean = F.when(F.col("n_evals") == 0, 0.0).otherwise(F.col("audit_sum") / (F.col("n_evals") * 100))
    after = F.greatest(F.lit(0.0), audit_mean - F.col("penalty_sum") / 100)

    ok = lambda e: passed(e["outcome"])
    failed = lambda e: e["outcome"] == "FAIL"
    phases = _sums(
        "all_evals",
        {
            "c_pass": lambda e: _one(in_phase_c(e) & ok(e)),
            "c_fail": lambda e: _one(in_phase_c(e) & failed(e)),
            "b_unmet": lambda e: _one((e["phase"] == "B") & ~in_phase_c(e) & ~ok(e)),
            "c_critical": lambda e: _one(in_phase_c(e) & ok(e) & e["own_critical"]),
        },
    )
    totals = _sums(
        "evals",
        {
            "n": lambda e: F.lit(1),
            "passed": lambda e: _one(ok(e)),
            "failed": lambda e: _one(failed(e)),
            "critical": lambda e: _one(e["critical_notes"] > 0),
            "match": lambda e: F.coalesce(outcome_cents(e["outcome"]), F.lit(0)),
            "audit": lambda e: e["audit_cents"],
            "penalty": lambda e: e["penalty_cents"],
        },
    )

    status = (
        F.when(F.col("fired").isNotNull(), "DISQUALIFIED")
        .when(F.col("prereq_unmet") > 0, "REQUIRES_PREREQUISITE")
        .when(
            (F.col("c_fail") == 0) & (F.col("c_pass") == 0),
            F.when(
                (required > 0)
                & (F.col("n_present") / required < model.PROFILE_COMPLETE_THRESHOLD),
                "INSUFFICIENT_DATA",
            ).otherwise("PARTIAL"),
        )
        .when(
            F.col("c_fail") == 0,
            F.when(F.col("c_critical"), "ELIGIBLE_WITH_CAVEATS").otherwise("ELIGIBLE"),
        )
        .when(F.col("c_fail") < model.NEAR_MISS_MAX_FAILED, "NEAR_MISS")
        .otherwise("INELIGIBLE")
    )
    return (
        judged.withColumn("fired", fired)
        .transform(settled, {"_phases": phases})
        .withColumn("prereq_unmet", F.col("_phases.b_unmet").cast("int"))
        .withColumn("evals", kept)
        .transform(settled, {"evals": F.col("evals"), "_totals": totals})
        .withColumns(
            {
                "c_pass": F.col("_phases.c_pass").cast("int"),
                "c_fail": F.col("_phases.c_fail").cast("int"),
                "c_critical": F.col("_phases.c_critical") > 0,
                "n_required": required,
                "n_present": present,
                "n_evals": F.col("_totals.n").cast("int"),
                "rules_passed": F.col("_totals.passed").cast("int"),
                "rules_failed": F.col("_totals.failed").cast("int"),
                "_critical": F.col("_totals.critical") > 0,
                "_match": F.col("_totals.match"),
                "audit_sum": F.col("_totals.audit"),
                "penalty_sum": F.col("_totals.penalty"),
            }
        )
        .transform(
            settled,
            {
                "status": status,
                "rules_undetermined": F.col("n_evals") - scored,
                "rule_match": F.when(scored == 0, 0.0).otherwise(F.col("_match") / (scored * 100)),
                "data_confidence": F.least(
                    F.lit(1.0),
                    F.when(F.col("_critical"), F.least(after, F.lit(model.CRITICAL_CAP))).otherwise(after),
                ),
                "completeness": F.when(required == 0, 0.0).otherwise(F.col("n_present") / required),
            },
        )
        .drop("populated", "required_slots", "_phases", "_totals", "_match", "_critical", "audit_sum", "penalty_sum", "n_evals")
    )


def label(score: Column, bands: tuple = model.LABEL_BANDS, last: str = "UNLIKELY") -> Column:
    chain = F.when(score >= bands[0][0], bands[0][1])
    for floor, name in bands[1:]:
        chain = chain.when(score >= floor, name)
    return chain.otherwise(last)


def with_confidence(decided: DataFrame) -> DataFrame:
    """Composite (minimum of three), label, bottleneck and improvement actions."""
    rms, dc, pc = F.col("rule_match"), F.col("data_confidence"), F.col("completeness")
    weakest = F.array_min(
        F.array(
            F.struct(rms.alias("v"), F.lit(0).alias("i"), F.lit("rule_match").alias("name")),
            F.struct(dc.alias("v"), F.lit(1).alias("i"), F.lit("data_confidence").alias("name")),
            F.struct(pc.alias("v"), F.lit(2).alias("i"), F.lit("profile_completeness").alias("name")),
        )
    )
    return decided.withColumns(
        {"composite": F.least(rms, dc, pc), "bottleneck": weakest["name"]}
    ).withColumn("label", label(F.col("composite")))


def improvement_actions() -> Column:
    missing = (F.col("n_required") - F.col("n_present")).cast("string")
    return F.array_compact(
        F.array(
            F.when(F.col("rule_match") < model.ACTION_THRESHOLD, F.lit("check_rules")),
            F.when(F.col("data_confidence") < model.ACTION_THRESHOLD, F.lit("verify_sources")),
            F.when(
                F.col("completeness") < model.ACTION_THRESHOLD,
                F.concat(F.lit("provide_fields:"), missing),
            ),
        )
    )


def bottleneck_explanation() -> Column:
    """Sentence for the lowest dimension."""
    shown = lambda c: F.format_string("%.2f", F.col(c))
    return (
        F.when(
            F.col("bottleneck") == "rule_match",
            F.concat(F.lit("Rule match score ("), shown("rule_match"), F.lit(") is the lowest dimension.")),
        )
        .when(
            F.col("bottleneck") == "data_confidence",
            F.concat(F.lit("Data confidence ("), shown("data_confidence"), F.lit(") is the lowest dimension.")),
        )
        .otherwise(
            F.concat(F.lit("Profile completeness ("), shown("completeness"), F.lit(") is the lowest dimension."))
        )
    )


def determinations(profile_cells: DataFrame, nested: DataFrame, keys: tuple[str, ...] = ("state",)) -> DataFrame:
    """The bulk evaluation: one row per profile and scheme."""
    return with_confidence(decide(judge(meet(profile_cells, nested, keys=keys))))


def rule_at(e: Column) -> Column:
    """The rule behind an evaluation entry."""
    return F.element_at("rules", e["idx"] + 1)


def evaluation_rows(dets: DataFrame, column: str = "evals") -> DataFrame:
    """One row per evaluated rule, in evaluation order within its scheme."""
    rows = dets.select(
        "profile_id", "state", "scheme_id", "status", "rules", "cells", "extras",
        F.posexplode(column).alias("eval_pos", "e"),
    )
    return rows.select(
        "profile_id", "state", "scheme_id", "status", "eval_pos", "cells", "extras",
        rule_at(F.col("e")).alias("r"), F.col("e.outcome").alias("outcome"), F.col("e.phase").alias("phase"),
        F.col("e.ord").alias("ord"),
    ).select(
        "profile_id", "state", "scheme_id", "status", "eval_pos", "phase", "ord", "outcome", "r",
        prof.lookup(F.col("cells"), F.col("extras"), F.col("r.slot"), F.col("r.field")).alias("u"),
        F.col("r.rule_id").alias("rule_id"), F.col("r.field").alias("field"),
        F.col("r.operator").alias("operator"), F.col("r.audit_status").alias("audit_status"),
    )


def group_outcomes(dets: DataFrame) -> DataFrame:
    """AND/OR outcome of each logic group; reported, never part of the status."""
    full = dets.where("fired IS NULL AND prereq_unmet = 0")
    members = F.filter("all_evals", in_phase_c)
    rows = full.select(
        "profile_id", "scheme_id", "rules", F.posexplode(members).alias("pos", "e")
    ).select(
        "profile_id", "scheme_id", "pos", rule_at(F.col("e")).alias("r"), F.col("e.outcome").alias("outcome")
    ).where("r.logic_group IS NOT NULL").select(
        "profile_id", "scheme_id", "pos", "outcome", F.col("r.logic_group").alias("logic_group"),
        F.upper(F.coalesce("r.logic_operator", F.lit("AND"))).alias("logic_operator"),
    )
    grouped = rows.groupBy("profile_id", "scheme_id", "logic_group").agg(
        F.max_by("logic_operator", "pos").alias("logic_operator"),
        F.count("*").alias("members"),
        F.count_if(passed(F.col("outcome"))).alias("n_pass"),
        F.count_if(F.col("outcome") == "FAIL").alias("n_fail"),
    )
    everything, some = F.col("n_pass") == F.col("members"), F.col("n_pass") > 0
    any_fail, all_fail = F.col("n_fail") > 0, F.col("n_fail") == F.col("members")
    return grouped.withColumn(
        "group_outcome",
        F.when(
            F.col("logic_operator") == "OR",
            F.when(some, "PASS").when(all_fail, "FAIL").otherwise("UNDETERMINED"),
        ).otherwise(F.when(everything, "PASS").when(any_fail, "FAIL").otherwise("UNDETERMINED")),
    )


def group_aware_status(dets: DataFrame) -> DataFrame:
    """Alternative status in which a satisfied OR group forgives its failed members."""
    forgiven = F.filter(
        "all_evals",
        lambda e: in_phase_c(e)
        & (e["outcome"] == "FAIL")
        & ~(
            (F.upper(F.coalesce(rule_at(e)["logic_operator"], F.lit("AND"))) == "OR")
            & F.coalesce(
                F.exists(
                    F.col("all_evals"),
                    lambda o: in_phase_c(o)
                    & (rule_at(o)["logic_group"] == rule_at(e)["logic_group"])
                    & passed(o["outcome"]),
                ),
                F.lit(False),
            )
        ),
    )
    failed = F.size(forgiven)
    return dets.withColumn(
        "group_status",
        F.when(~F.col("status").isin("NEAR_MISS", "INELIGIBLE"), F.col("status"))
        .when(failed == 0, F.when(F.col("c_critical"), "ELIGIBLE_WITH_CAVEATS").otherwise("ELIGIBLE"))
        .when(failed < model.NEAR_MISS_MAX_FAILED, "NEAR_MISS")
        .otherwise("INELIGIBLE"),
    )


def rule_trace(dets: DataFrame) -> DataFrame:
    """Audit row per active rule, plus numbered rows for the excluded ones."""
    ran = lambda e: F.when(
        F.col("fired").isNotNull(), (e["phase"] == "A") & (e["ord"] <= F.col("fired")["ord"])
    ).when(F.col("prereq_unmet") > 0, e["phase"].isin("A", "B")).otherwise(True)
    names = F.create_map(*[F.lit(x) for kv in model.PHASE_NAMES.items() for x in kv])
    live = F.transform(
        "all_evals",
        lambda e: F.struct(
            rule_at(e)["rule_id"].alias("rule_id"),
            names[e["phase"]].alias("phase"),
            F.when(ran(e), e["outcome"]).alias("outcome"),
            F.lit(False).alias("excluded"),
        ),
    )
    gone = F.transform(
        F.filter(F.sequence(F.lit(0), "excluded_count"), lambda i: i > 0),
        lambda i: F.struct(
            F.concat(F.lit("EXCLUDED-"), F.col("scheme_id"), F.lit("-"), F.lpad(i.cast("string"), 3, "0")).alias("rule_id"),
            F.lit("C_ELIGIBILITY").alias("phase"),
            F.lit(None).cast("string").alias("outcome"),
            F.lit(True).alias("excluded"),
        ),
    )
    return dets.select("profile_id", "scheme_id", F.inline(F.concat(live, gone)))
