"""Totals per scheme and status: counted per combination, with the figures that a row per pair gives."""

import pyarrow as pa
from pyspark.sql import functions as F

from eligrid.operators import decision, rulebase, scheme_totals
from eligrid.plans import catalogue, derive
from eligrid.plans.views import GrownViews, views

SUMMED = ("c_pass", "c_fail", "rules_passed", "rules_failed", "rules_undetermined")


def by_pairs(determinations):
    return determinations.groupBy("scheme_id", "status").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in SUMMED], F.min("composite").alias("low"), F.max("composite").alias("high")
    )


def rows(df):
    return sorted(tuple(r) for r in df.select("scheme_id", "status", "n", *SUMMED, F.round("low", 6), F.round("high", 6)).collect())


def test_totals_of_the_grown_rule_base(spark, folder):
    grown = views(spark, folder).grown()
    expected = rows(by_pairs(decision.determinations(grown.profile_cells(), grown.nested_rules())))
    assert len(expected) > 30 and rows(grown.totals()) == expected


def test_totals_in_small_blocks_and_with_many_combinations(spark, folder, monkeypatch):
    """Six rules a scheme and more: profiles in blocks of a few, classes first seen in a later block, combinations beyond the limit."""
    v = views(spark, folder)
    expected = rows(by_pairs(decision.determinations(v.profile_cells(), v.nested_rules())))
    for cells, combinations in ((1 << 11, 1 << 14), (1 << 12, 8), (1 << 24, 1 << 10)):
        monkeypatch.setattr(scheme_totals, "BLOCK_CELLS", cells)
        monkeypatch.setattr(scheme_totals, "COMBINATIONS", combinations)
        assert rows(scheme_totals.totals(v.profile_cells(), v.schemes(), v.bound_rules())) == expected


def test_no_row_per_pair_and_no_rule_base_per_state(spark, folder):
    v = views(spark, folder)
    plan = catalogue.QUERIES["evaluate_all_grown"](v)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan.split("MapInArrow")[0] and "salt" not in plan
    bound = v.bound_rules()
    listed = rulebase.listed_rules(bound)
    assert 0 < listed.count() < rulebase.effective_rules(bound).count() / 5


class Repeated(GrownViews):
    """The grown rule base over the parts repeated under further keys."""

    def parts(self):
        keys = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("copy")
        repeated = self.table("part").select("*", keys).withColumn("p_partkey", F.col("p_partkey") + 1002 * F.col("copy"))
        return repeated.selectExpr(*derive.GROWN_PART)


def test_profiles_are_counted_per_group_of_schemes(spark, folder, monkeypatch):
    """Schemes that read the same fields share one pass over the profiles; before, each list of rules had its own."""
    v = Repeated(spark, folder)
    rows_, held = scheme_totals.prepared(v.profile_cells(), v.schemes(), v.bound_rules())
    passes, count = [], scheme_totals._Group.count
    monkeypatch.setattr(scheme_totals._Group, "count", lambda self, columns, n: (passes.append(n), count(self, columns, n)))
    found = list(scheme_totals._counted(iter(rows_.toArrow().to_batches()), held.value, scheme_totals.BLOCK_CELLS, scheme_totals.COMBINATIONS))
    schemes = v.schemes().where("status = 'active'").count()
    assert schemes > 500 and len(passes) < schemes / 10
    expected = rows(by_pairs(decision.determinations(v.profile_cells(), v.nested_rules())))
    assert rows(spark.createDataFrame(pa.Table.from_batches(found))) == expected


def test_totals_of_predicates_over_a_table_and_of_no_rules(spark, folder, monkeypatch):
    v = views(spark, folder)
    expected = rows(by_pairs(decision.determinations(v.profile_cells(), v.nested_rules())))
    monkeypatch.setattr(scheme_totals, "EXPRESSIONS", 0)
    assert rows(scheme_totals.totals(v.profile_cells(), v.schemes(), v.bound_rules())) == expected
    nothing = scheme_totals.totals(v.profile_cells(), v.schemes(), v.bound_rules().limit(0))
    profiles, schemes = v.table("customer").count(), v.schemes().where("status = 'active'").count()
    assert nothing.agg(F.sum("n"), F.count("*"), F.sum("rules_passed")).first() == (profiles * schemes, schemes, 0)
