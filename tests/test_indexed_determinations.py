"""Determinations over the predicate index: the same rows as the nested rules give, and no window over wide rows."""

from pyspark.sql import functions as F

from eligrid.operators import decision, gaps, results
from eligrid.plans import catalogue
from eligrid.plans import views as views_module
from eligrid.plans.views import views

COLUMNS = (
    "profile_id", "state", "scheme_id", "status", "fired", "prereq_unmet", "c_pass", "c_fail", "c_critical", "n_required", "n_present",
    "rules_passed", "rules_failed", "rules_undetermined", "rule_match", "data_confidence", "completeness", "composite", "label",
    "bottleneck", "all_evals", "evals",
)


def test_same_rows_as_the_nested_rules(spark, folder):
    v = views(spark, folder)
    cells = v.profile_cells()
    nested = decision.determinations(cells, v.nested_rules()).select(*COLUMNS).collect()
    indexed = v.determinations().select(*COLUMNS).collect()
    assert len(nested) > 0 and sorted(map(tuple, indexed), key=lambda r: (r[0], r[2])) == sorted(map(tuple, nested), key=lambda r: (r[0], r[2]))
    assert len({(r.profile_id, r.scheme_id) for r in indexed}) == len(indexed)


def test_schemes_are_ranked_without_a_window(spark, folder):
    plan = results.trace_sample(views(spark, folder).determinations())._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_tasks_follow_profiles(spark, folder, monkeypatch):
    """Few bytes per profile must not mean few tasks: ten profiles a task here, for the decision and for the steps after it."""
    monkeypatch.setattr(views_module, "TASK_PROFILES", 10)
    v = views_module.Views(spark, folder)
    wanted = -(-v.table("customer").count() // 10) + 1
    assert v.profile_cells().rdd.getNumPartitions() == wanted > 4
    stepped = catalogue.QUERIES["seq_parallel"](v)
    assert stepped.count() > 0
    assert stepped.rdd.getNumPartitions() == wanted


def test_codes_give_the_rows_of_the_evaluations(spark, folder):
    v = views(spark, folder)
    dets, nested = v.determinations(), v.nested_rules()
    rows = lambda df, *by: sorted(map(tuple, df.select(*by).collect()), key=str)
    gap = ("profile_id", "scheme_id", "rule_id", "field", "operator", "display_text", "user_text", "required_text", "gap_type", "magnitude")
    failed = rows(gaps.failed_rules(gaps.with_gaps(dets)), *gap)
    assert failed and rows(gaps.coded_failed_rules(v.coded("cells", "extras"), nested), *gap) == failed
    note = ("profile_id", "scheme_id", "ambiguity_id", "affects_rule", "severity")
    noted = rows(gaps.ambiguity_notes(dets), *note)
    assert noted and rows(gaps.coded_notes(v.coded(), nested), *note) == noted
    warned = rows(dets.select("profile_id", "scheme_id", F.explode(results.discretion_warnings()).alias("warning")), "profile_id", "scheme_id", "warning")
    assert warned and rows(results.coded_warnings(v.coded(), nested), "profile_id", "scheme_id", "warning") == warned
    for name in ("gap_failed_rules", "gap_ambiguity_notes", "discretion_warnings", "near_miss_score"):
        assert "all_evals" not in catalogue.QUERIES[name](v)._jdf.queryExecution().optimizedPlan().toString()
