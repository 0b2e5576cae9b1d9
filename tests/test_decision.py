"""Hand-written schemes with expected statuses, shaped after the boundary cases."""

import pytest
from pyspark.sql import functions as F

from eligrid import model
from eligrid.operators import decision, predicate_index, profiles, rulebase

RULE = (
    "scheme_id string, rule_id string, ord int, rule_type string, field string, operator string, value_kind string, "
    "value_text string, value_min double, value_max double, values_kind string, values_text string, audit_status string, "
    "state_scope string, supersedes_rule_id string, logic_group string, logic_operator string, source_quote string, "
    "source_url string, display_text string"
)


def rule(scheme, n, rule_type, field, op, kind="null", text=None, lo=None, hi=None, items="", audit="VERIFIED", scope="central", over=None):
    return (scheme, f"{scheme}-{n}", n, rule_type, field, op, kind, text, lo, hi, "str", items, audit, scope, over, None, None, "q", "u", "d")


def people(spark):
    kinds = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "list": "array<string>"}
    schema = "profile_id bigint, " + ", ".join(f"{model.column_of(p)} {kinds[k]}" for p, k in model.PROFILE_FIELDS)
    names = [model.column_of(p) for p, _ in model.PROFILE_FIELDS]

    def person(i, **known):
        return (i, *[known.get(n, [] if n == "schemes_active_enrollments" else None) for n in names])

    rows = [
        person(1, applicant_age=40, location_state="UP", household_income_annual=100000, documents_bank_account=True),
        person(2, applicant_age=17, location_state="UP", household_income_annual=900000, documents_bank_account=False),
        person(3),
    ]
    return profiles.with_cells(spark.createDataFrame(rows, schema))


def decide(spark, rules, flags=()):
    rules = spark.createDataFrame(rules, RULE)
    schemes = rules.groupBy("scheme_id").agg(F.first("scheme_id").alias("scheme_name")).selectExpr(
        "scheme_id", "scheme_name", "'m' AS ministry", "'active' AS status", "1 AS position"
    )
    queue = spark.createDataFrame([], "rule_id string")
    flag_rows = spark.createDataFrame(list(flags), "scheme_id string, rule_id string, ord int, pos int, severity string, ambiguity_id string")
    bound = rulebase.bind(rulebase.active_rules(rulebase.load_ready(rules), schemes, queue), flag_rows)
    nested = rulebase.nest(schemes, bound, rulebase.exclusions(rules, queue))
    got = decision.determinations(people(spark), nested).collect()
    return {(r.profile_id, r.scheme_id): r for r in got}


AGE = ("eligibility", "applicant.age", "BETWEEN", "null", None, 18.0, 40.0)
INCOME = ("eligibility", "household.income_annual", "LTE", "num", "200000")


def test_inclusive_range_and_near_miss_and_insufficient(spark):
    got = decide(spark, [rule("A", 1, *AGE), rule("A", 2, *INCOME), rule("A", 3, "eligibility", "documents.bank_account", "EQ", "bool", "True")])
    assert got[1, "A"].status == "ELIGIBLE" and got[1, "A"].composite == 1.0
    assert got[2, "A"].status == "INELIGIBLE" and got[2, "A"].c_fail == 3
    assert got[3, "A"].status == "INSUFFICIENT_DATA"


def test_only_exact_pass_disqualifies(spark):
    bar = ("disqualifying", "documents.bank_account", "EQ", "bool", "True")
    fired = decide(spark, [rule("A", 1, *bar), rule("A", 2, *AGE)])
    assert fired[1, "A"].status == "DISQUALIFIED" and len(fired[1, "A"].evals) == 1
    pending = decide(spark, [rule("A", 1, *bar, audit="PENDING"), rule("A", 2, *AGE)])
    assert pending[1, "A"].status == "ELIGIBLE"


def test_failed_numeric_disqualifier_counts_as_a_fail(spark):
    got = decide(spark, [rule("A", 1, "disqualifying", "household.income_annual", "GT", "num", "500000"), rule("A", 2, *AGE)])
    assert got[1, "A"].status == "NEAR_MISS" and got[2, "A"].status == "DISQUALIFIED"


def test_prerequisite_stops_later_phases(spark):
    got = decide(spark, [rule("A", 1, "Prerequisite ", "documents.bank_account", "EQ", "bool", "True"), rule("A", 2, *AGE)])
    assert got[2, "A"].status == "REQUIRES_PREREQUISITE" and len(got[2, "A"].evals) == 1
    assert got[3, "A"].status == "REQUIRES_PREREQUISITE"


def test_critical_flag_and_last_flag_wins(spark):
    flags = [("A", "A-1", 1, 0, "CRITICAL", "AMB-001"), ("B", "B-1", 1, 0, "LOW", "AMB-001")]
    got = decide(spark, [rule("A", 1, *AGE), rule("B", 1, *AGE)], flags)
    # The rule's own flag decides the status, the last flag of the id the penalty.
    assert got[1, "A"].status == "ELIGIBLE_WITH_CAVEATS" and got[1, "A"].data_confidence == 1.0


def test_state_rule_replaces_the_central_one(spark):
    got = decide(spark, [rule("A", 1, *AGE), rule("A", 2, "eligibility", "applicant.age", "GTE", "num", "10", scope="UP", over="A-1")])
    assert got[2, "A"].status == "ELIGIBLE" and got[3, "A"].rules_undetermined == 1


def test_scheme_without_rules_is_partial_and_counts_exclusions(spark):
    got = decide(spark, [rule("A", 1, *AGE, audit="DISPUTED")])
    assert got[1, "A"].status == "PARTIAL" and got[1, "A"].excluded_count == 1 and got[1, "A"].completeness == 0.0


@pytest.mark.parametrize("limit", [1 << 28, 0])
def test_meeting_by_broadcast_and_by_salted_join_agree(spark, folder, limit):
    from eligrid.plans.views import views

    v = views(spark, folder)
    met = decision.meet(v.profile_cells(), v.nested_rules(), limit)
    assert met.count() == v.table("customer").count() * v.schemes().where("status = 'active'").count()
    assert met.select("profile_id", "scheme_id").distinct().count() == met.count()


def test_evaluation_does_not_shuffle_after_the_profiles(spark, folder):
    from eligrid.operators import results
    from eligrid.plans.views import views

    plan = results.bucket_counts(views(spark, folder).determinations())._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("REPARTITION_BY_NUM")]
    assert "Exchange hashpartitioning" not in above.replace("Exchange hashpartitioning(profile_id", "", 1)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def both(spark, rules, people_rows=None):
    """Rows of the index and of the nested evaluation of the same rule base."""
    frame = spark.createDataFrame(rules, RULE)
    schemes = frame.groupBy("scheme_id").agg(F.first("scheme_id").alias("scheme_name")).selectExpr(
        "scheme_id", "scheme_name", "'m' AS ministry", "'active' AS status", "1 AS position"
    ).union(spark.createDataFrame([("EMPTY", "e", "m", "active", 2)], "scheme_id string, scheme_name string, ministry string, status string, position int"))
    queue = spark.createDataFrame([], "rule_id string")
    flags = [("A", "A-1", 1, 0, "CRITICAL", "AMB-001"), ("B", "B-1", 1, 0, "HIGH", "AMB-002"), ("B", "B-2", 2, 0, "MEDIUM", "AMB-003")]
    bound = rulebase.bind(
        rulebase.active_rules(rulebase.load_ready(frame), schemes, queue),
        spark.createDataFrame(flags, "scheme_id string, rule_id string, ord int, pos int, severity string, ambiguity_id string"),
    )
    nested = rulebase.nest(schemes, bound, rulebase.exclusions(frame, queue)).where("state IN ('*', 'UP', 'BR')")
    cells = people_rows if people_rows is not None else people(spark)
    columns = list(predicate_index.COLUMNS)
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    slow = decision.determinations(cells, nested).select(*[F.col(c).cast(dict(t.split(" ") for t in predicate_index.RESULT.split(", "))[c]) for c in columns])
    return rows(predicate_index.determinations(cells, nested)), rows(slow), rows(predicate_index.determinations(cells, nested, limit=0))


def test_index_decides_like_the_nested_rules(spark):
    ages = [("LT", "17"), ("LTE", "17"), ("GT", "17"), ("GTE", "17"), ("LT", "40"), ("GTE", "40"), ("GTE", "NaN"), ("LTE", "x"), ("EQ", "40"), ("NEQ", "17")]
    rules = [rule("A", i + 1, ("eligibility", "disqualifying", "prerequisite", "administrative_discretion")[i % 4], "applicant.age", op, "num", t) for i, (op, t) in enumerate(ages)]
    rules += [rule("B", i + 1, "eligibility", "household.income_annual", op, "num", t, audit="PENDING" if i % 2 else "VERIFIED") for i, (op, t) in enumerate(ages)]
    rules += [
        rule("C", 1, *AGE), rule("C", 2, "eligibility", "applicant.age", "BETWEEN", lo=40.0, hi=17.0), rule("C", 3, "eligibility", "applicant.age", "BETWEEN", lo=float("nan"), hi=99.0),
        rule("C", 4, "eligibility", "no.such_field", "GT", "num", "1"), rule("C", 5, "eligibility", "applicant.age", "ODD", "num", "1"),
        rule("D", 1, "eligibility", "location.state", "IN", items="UP|BR"), rule("D", 2, "eligibility", "location.state", "MATCHES", "str", "^U"),
        rule("D", 3, "eligibility", "location.state", "MATCHES", "str", "(["), rule("D", 4, "eligibility", "location.state", "CONTAINS", "str", "P"),
        rule("D", 5, "eligibility", "documents.bank_account", "EQ", "bool", "True"), rule("D", 6, "eligibility", "applicant.age", "IS_NULL"), rule("D", 7, "eligibility", "schemes.active_enrollments", "NOT_MEMBER", items="A"),
        rule("E", 1, "eligibility", "applicant.age", "GTE", "num", "18"), rule("E", 2, "eligibility", "applicant.age", "GTE", "num", "60", scope="UP", over="E-1"),
    ]
    fast, slow, beyond = both(spark, rules)
    assert len(fast) == 3 * 6 and fast == slow and beyond == slow


def test_index_over_derived_rule_bases(spark, folder):
    from eligrid.plans.views import views

    for v in (views(spark, folder), views(spark, folder).grown()):
        columns = ["profile_id", "scheme_id", "status", "c_pass", "c_fail", "rules_passed", "rules_failed", "rules_undetermined", "composite"]
        slow = v.determinations().select(*columns).selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in columns])
        fast = v.decided().select(*columns).selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in columns])
        assert fast.count() == slow.count() and fast.exceptAll(slow).count() == 0
