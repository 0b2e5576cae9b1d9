"""Queries of the decision procedure: predicates, rule base, phases, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import predicates
from eligrid.operators import decision, profiles
from eligrid.plans import derive
from eligrid.plans import oracle_core as oc
from eligrid.plans.registry import query
from eligrid.plans.views import Views


def six(column: str):
    return F.round(F.col(column), 6).alias(column)


def _operator_query(name: str):
    """Every rule's field and values of the whole rule base under one operator."""

    def run(v: Views) -> DataFrame:
        rows = decision.meet(v.profile_cells(), v.nested_rules())
        judged = F.transform(
            "rules",
            lambda r: F.struct(
                r["rule_id"].alias("rule_id"),
                predicates.evaluate_as(
                    name,
                    predicates.cell_of(profiles.lookup(F.col("cells"), F.col("extras"), r["slot"], r["field"])),
                    predicates.cell_of(r["v"]), r["value_min"], r["value_max"], r["items"],
                    (r["operator"] != "MATCHES") | r["pattern_ok"],
                ).alias("result"),
            ),
        )
        return (
            rows.select("state", F.inline(judged))
            .groupBy("rule_id", "state")
            .agg(
                F.count_if("result").alias("n_true"),
                F.count_if(~F.col("result")).alias("n_false"),
                F.count_if(F.col("result").isNull()).alias("n_null"),
            )
        )

    return run


for _name in model.OPERATORS:
    query(
        "op_" + _name.lower(),
        oc.sql(
            f"""SELECT rule_id, state, count(*) FILTER (result) AS n_true, count(*) FILTER (NOT result) AS n_false,
                count(*) FILTER (result IS NULL) AS n_null
            FROM (SELECT rule_id, state, {oc.OPERATOR_SQL[_name]} AS result FROM results)
            GROUP BY 1, 2"""
        ),
    )(_operator_query(_name))


@query(
    "join_profile_rule",
    oc.sql(
        """SELECT rule_id, state, outcome, count(*) AS n FROM outcomes GROUP BY 1, 2, 3"""
    ),
)
def join_profile_rule(v: Views) -> DataFrame:
    return (
        decision.evaluation_rows(v.determinations(), "all_evals")
        .groupBy("rule_id", "state", "outcome")
        .agg(F.count("*").alias("n"))
    )


EVALUATED = oc.sql(
    """SELECT profile_id, scheme_id, status, c_pass, c_fail, rules_passed, rules_failed, rules_undetermined,
       round(composite, 6) AS composite FROM dets"""
)


@query("evaluate_all", EVALUATED)
def evaluate_all(v: Views) -> DataFrame:
    return evaluated(v.decided())


_GROWN = f"(SELECT {', '.join(derive.GROWN_PART)} FROM part)"


@query(
    "evaluate_all_grown",
    oc.sql(
        """SELECT scheme_id, status, count(*) AS n, CAST(sum(c_pass) AS BIGINT) AS c_pass, CAST(sum(c_fail) AS BIGINT) AS c_fail,
           CAST(sum(rules_passed) AS BIGINT) AS rules_passed, CAST(sum(rules_failed) AS BIGINT) AS rules_failed,
           CAST(sum(rules_undetermined) AS BIGINT) AS rules_undetermined, round(min(composite), 6) AS low, round(max(composite), 6) AS high
        FROM dets GROUP BY 1, 2""",
        schemes=derive.SCHEMES_SQL.format(part=_GROWN), rules_raw=derive.RULES_RAW_SQL.format(part=_GROWN),
    ),
)
def evaluate_all_grown(v: Views) -> DataFrame:
    """Every profile against a rule base that grows with the part table, summed per scheme and status."""
    grown = v.grown()
    found = grown.totals()
    if found is not None:
        return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})
    counters = ("c_pass", "c_fail", "rules_passed", "rules_failed", "rules_undetermined")
    return grown.decided().groupBy("scheme_id", "status").agg(
        F.count("*").alias("n"), *[F.sum(c).alias(c) for c in counters],
        F.round(F.min("composite"), 6).alias("low"), F.round(F.max("composite"), 6).alias("high"),
    )


def evaluated(determinations: DataFrame) -> DataFrame:
    return determinations.select(
        "profile_id", "scheme_id", "status",
        *[F.col(c).cast("long").alias(c) for c in ("c_pass", "c_fail", "rules_passed", "rules_failed", "rules_undetermined")],
        six("composite"),
    )
