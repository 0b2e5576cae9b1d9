"""Queries of phases, scores, gaps and result assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.operators import decision, gaps, results
from eligrid.plans import oracle_core as oc
from eligrid.plans.oracle_core import bands, case_map, quoted
from eligrid.plans.queries_core import six
from eligrid.plans.registry import query
from eligrid.plans.views import Views

MISSED = "status NOT IN ('ELIGIBLE', 'ELIGIBLE_WITH_CAVEATS')"


def longs(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


# ---- phases -----------------------------------------------------------------


@query("phase_assign", oc.sql("SELECT scheme_id, phase, count(*) AS n FROM active GROUP BY 1, 2"))
def phase_assign(v: Views) -> DataFrame:
    return v.bound_rules().groupBy("scheme_id", "phase").agg(F.count("*").alias("n"))


@query("rule_outcome", oc.sql("SELECT scheme_id, outcome, count(*) AS n FROM outcomes GROUP BY 1, 2"))
def rule_outcome(v: Views) -> DataFrame:
    rows = v.determinations().select("scheme_id", F.inline(F.transform("all_evals", lambda e: F.struct(e["outcome"].alias("outcome")))))
    return rows.groupBy("scheme_id", "outcome").agg(F.count("*").alias("n"))


@query(
    "phase_a_shortcircuit",
    oc.sql(
        """SELECT e.profile_id, e.scheme_id, min(rule_id) FILTER (ord = fired_ord AND phase = 'A') AS fired_rule,
           count(*) FILTER (counted) AS evaluated
        FROM evaluated e WHERE fired_ord IS NOT NULL GROUP BY 1, 2"""
    ),
)
def phase_a_shortcircuit(v: Views) -> DataFrame:
    return v.determinations().where("fired IS NOT NULL").select(
        "profile_id", "scheme_id", decision.rule_at(F.col("fired"))["rule_id"].alias("fired_rule"),
        F.size("evals").cast("long").alias("evaluated"),
    )


@query(
    "phase_a_reinject",
    oc.sql(
        """SELECT rule_id, count(*) AS n FROM phased
        WHERE phase = 'A' AND outcome = 'FAIL' AND numeric_op AND fired_ord IS NULL AND prereq_unmet = 0 GROUP BY 1"""
    ),
)
def phase_a_reinject(v: Views) -> DataFrame:
    rows = v.determinations().where("fired IS NULL AND prereq_unmet = 0")
    back = F.filter("all_evals", lambda e: (e["phase"] == "A") & decision.in_phase_c(e))
    return (
        rows.select(F.explode(F.transform(back, lambda e: decision.rule_at(e)["rule_id"])).alias("rule_id"))
        .groupBy("rule_id")
        .agg(F.count("*").alias("n"))
    )


@query(
    "phase_b_prereq",
    oc.sql(
        """SELECT profile_id, scheme_id,
           coalesce(string_agg(rule_id, ',' ORDER BY ord) FILTER (outcome IN ('FAIL', 'UNDETERMINED')), '') AS unmet,
           coalesce(string_agg(rule_id, ',' ORDER BY ord) FILTER (outcome NOT IN ('FAIL', 'UNDETERMINED')), '') AS met
        FROM phased WHERE phase = 'B' AND fired_ord IS NULL GROUP BY 1, 2"""
    ),
)
def phase_b_prereq(v: Views) -> DataFrame:
    def ids(ok: bool):
        chosen = F.filter(
            "all_evals",
            lambda e: (e["phase"] == "B") & (decision.passed(e["outcome"]) if ok else ~decision.passed(e["outcome"])),
        )
        return F.array_join(F.transform(chosen, lambda e: decision.rule_at(e)["rule_id"]), ",")

    return (
        v.determinations()
        .where(F.col("fired").isNull() & F.exists("all_evals", lambda e: e["phase"] == "B"))
        .select("profile_id", "scheme_id", ids(False).alias("unmet"), ids(True).alias("met"))
    )


_GROUPS = """
  SELECT profile_id, scheme_id, logic_group, arg_max(upper(coalesce(logic_operator, 'AND')), eval_pos) AS logic_operator,
         count(*) AS members, count(*) FILTER (outcome IN ('PASS', 'UNVERIFIED_PASS')) AS n_pass,
         count(*) FILTER (outcome = 'FAIL') AS n_fail
  FROM evaluated WHERE in_c AND logic_group IS NOT NULL AND fired_ord IS NULL AND prereq_unmet = 0 GROUP BY 1, 2, 3"""


@query(
    "group_outcome",
    oc.sql(
        """SELECT *, CASE WHEN logic_operator = 'OR' THEN
             CASE WHEN n_pass > 0 THEN 'PASS' WHEN n_fail = members THEN 'FAIL' ELSE 'UNDETERMINED' END
           ELSE CASE WHEN n_pass = members THEN 'PASS' WHEN n_fail > 0 THEN 'FAIL' ELSE 'UNDETERMINED' END END AS group_outcome
        FROM groups""",
        groups=_GROUPS,
    ),
)
def group_outcome(v: Views) -> DataFrame:
    return decision.group_outcomes(v.determinations())


@query(
    "group_aware_status",
    oc.sql(
        """SELECT d.profile_id, d.scheme_id, status,
           CASE WHEN status NOT IN ('NEAR_MISS', 'INELIGIBLE') THEN status
                WHEN open_fails = 0 THEN CASE WHEN c_critical THEN 'ELIGIBLE_WITH_CAVEATS' ELSE 'ELIGIBLE' END
                WHEN open_fails < 2 THEN 'NEAR_MISS' ELSE 'INELIGIBLE' END AS group_status
        FROM dets d LEFT JOIN (
          SELECT e.profile_id, e.scheme_id, count(*) AS open_fails FROM evaluated e
          WHERE e.in_c AND e.outcome = 'FAIL' AND NOT (upper(coalesce(e.logic_operator, 'AND')) = 'OR' AND e.logic_group IS NOT NULL
            AND EXISTS (SELECT 1 FROM evaluated o WHERE o.profile_id = e.profile_id AND o.scheme_id = e.scheme_id
                        AND o.in_c AND o.logic_group = e.logic_group AND o.outcome IN ('PASS', 'UNVERIFIED_PASS')))
          GROUP BY 1, 2) f USING (profile_id, scheme_id)
        WHERE true""".replace("open_fails = 0", "coalesce(open_fails, 0) = 0").replace("open_fails < 2", "coalesce(open_fails, 0) < 2")
    ),
)
def group_aware_status(v: Views) -> DataFrame:
    return decision.group_aware_status(v.determinations()).select("profile_id", "scheme_id", "status", "group_status")


@query("scheme_status", oc.sql("SELECT scheme_id, status, count(*) AS n FROM dets GROUP BY 1, 2"))
def scheme_status(v: Views) -> DataFrame:
    return v.determinations().groupBy("scheme_id", "status").agg(F.count("*").alias("n"))


_WARN = """'Administrative discretion: ' || coalesce(nullif(display_text, ''), rule_id)
           || ' — condition not met (field: ' || field || ')'"""


@query(
    "discretion_warnings",
    oc.sql(
        f"""SELECT profile_id, scheme_id, {_WARN} AS warning FROM evaluated
        WHERE counted AND phase = 'D' AND outcome = 'FAIL'"""
    ),
)
def discretion_warnings(v: Views) -> DataFrame:
    coded = v.coded()
    if coded is not None:
        return results.coded_warnings(coded, v.nested_rules())
    return v.determinations().select(
        "profile_id", "scheme_id", F.explode(results.discretion_warnings()).alias("warning")
    )


@query(
    "rule_trace",
    oc.sql(
        """SELECT profile_id, scheme_id, rule_id,
           CASE phase WHEN 'A' THEN 'A_DISQUALIFYING' WHEN 'B' THEN 'B_PREREQUISITE' WHEN 'C' THEN 'C_ELIGIBILITY' ELSE 'D_DISCRETION' END AS phase,
           CASE WHEN counted THEN outcome END AS outcome, false AS excluded FROM evaluated
        UNION ALL
        SELECT profile_id, scheme_id, 'EXCLUDED-' || scheme_id || '-' || lpad(CAST(i AS STRING), 3, '0'), 'C_ELIGIBILITY', NULL, true
        FROM (SELECT profile_id, scheme_id, unnest(range(1, excluded_count + 1)) AS i FROM dets)"""
    ),
)
def rule_trace(v: Views) -> DataFrame:
    return decision.rule_trace(v.determinations())


@query(
    "partial_determination",
    oc.sql(
        """SELECT r.scheme_id, count(*) FILTER (c.rule_id IS NULL) AS determined, count(c.rule_id) AS undetermined,
           CASE WHEN count(c.rule_id) > 0 THEN 'PARTIAL' ELSE 'FULL' END AS status, count(c.rule_id) > 0 AS human_review
        FROM rules r LEFT JOIN (SELECT DISTINCT rule_id FROM flags WHERE severity = 'CRITICAL') c USING (rule_id) GROUP BY 1"""
    ),
)
def partial_determination(v: Views) -> DataFrame:
    blocked = v.flags().where("severity = 'CRITICAL'").select("rule_id", F.lit(True).alias("blocked")).distinct()
    return (
        v.rules().join(blocked, "rule_id", "left").groupBy("scheme_id").agg(
            F.count_if(F.col("blocked").isNull()).alias("determined"),
            F.count("blocked").alias("undetermined"),
        )
        .withColumn("status", F.when(F.col("undetermined") > 0, "PARTIAL").otherwise("FULL"))
        .withColumn("human_review", F.col("undetermined") > 0)
    )


# ---- scores -----------------------------------------------------------------


def _score(name: str, column: str):
    @query(name, oc.sql(f"SELECT profile_id, scheme_id, round({column}, 6) AS {column} FROM dets"))
    def run(v: Views) -> DataFrame:
        return v.determinations().select("profile_id", "scheme_id", six(column))


_score("score_rule_match", "rule_match")
_score("score_data_confidence", "data_confidence")
_score("score_completeness", "completeness")

_BOTTLENECK = """CASE WHEN rule_match <= data_confidence AND rule_match <= completeness THEN 'rule_match'
   WHEN data_confidence <= completeness THEN 'data_confidence' ELSE 'profile_completeness' END"""


@query(
    "score_composite",
    oc.sql(
        f"""SELECT profile_id, scheme_id, round(composite, 6) AS composite,
        {bands('composite', model.LABEL_BANDS, 'UNLIKELY')} AS label, {_BOTTLENECK} AS bottleneck FROM dets"""
    ),
)
def score_composite(v: Views) -> DataFrame:
    return v.determinations().select("profile_id", "scheme_id", six("composite"), "label", "bottleneck")


@query(
    "improvement_actions",
    oc.sql(
        """SELECT profile_id, scheme_id, array_to_string(list_filter([
             CASE WHEN rule_match < 0.8 THEN 'check_rules' END, CASE WHEN data_confidence < 0.8 THEN 'verify_sources' END,
             CASE WHEN completeness < 0.8 THEN 'provide_fields:' || CAST(n_required - n_present AS STRING) END], lambda x: x IS NOT NULL), ',') AS actions
        FROM dets"""
    ),
)
def improvement_actions(v: Views) -> DataFrame:
    return v.determinations().select(
        "profile_id", "scheme_id", F.array_join(decision.improvement_actions(), ",").alias("actions")
    )


@query(
    "confidence_label_ui",
    oc.sql(
        f"""SELECT scheme_id, {bands('composite', model.UI_LABEL_BANDS, 'VERY_LOW')} AS ui_label, count(*) AS n
        FROM dets GROUP BY 1, 2"""
    ),
)
def confidence_label_ui(v: Views) -> DataFrame:
    ui = decision.label(F.col("composite"), model.UI_LABEL_BANDS, "VERY_LOW")
    return v.determinations().groupBy("scheme_id", ui.alias("ui_label")).agg(F.count("*").alias("n"))


# ---- gaps -------------------------------------------------------------------

_DOCS = quoted(model.DOCUMENT_FIELDS)
_REQUIRED = """CASE WHEN values_text <> '' THEN '[''' || replace(values_text, '|', ''', ''') || ''']'
   WHEN value_min IS NOT NULL OR value_max IS NOT NULL
     THEN '[' || coalesce(CAST(value_min AS STRING), 'None') || ', ' || coalesce(CAST(value_max AS STRING), 'None') || ']'
   ELSE coalesce(vs, 'None') END"""
_GAP_TYPE = f"""CASE WHEN outcome = 'UNDETERMINED' AND note_ids IS NOT NULL THEN 'AMBIGUITY_BLOCK'
   WHEN uk = 'null' OR outcome = 'UNDETERMINED' THEN 'MISSING_DATA'
   WHEN field IN ({_DOCS}) THEN CASE WHEN uk = 'bool' AND vk = 'bool' THEN 'MISSING_DOCUMENT' ELSE 'BOOLEAN_MISMATCH' END
   WHEN uk = 'bool' OR vk = 'bool' THEN 'BOOLEAN_MISMATCH'
   WHEN operator IN ('GTE', 'GT') THEN CASE WHEN vf - uf > 0 THEN 'NUMERIC_UNDERSHOOT' ELSE 'NUMERIC_OVERSHOOT' END
   WHEN operator IN ('LTE', 'LT') THEN CASE WHEN uf - vf > 0 THEN 'NUMERIC_OVERSHOOT' ELSE 'NUMERIC_UNDERSHOOT' END
   WHEN operator = 'BETWEEN' THEN CASE WHEN uf < value_min THEN 'NUMERIC_UNDERSHOOT' WHEN uf > value_max THEN 'NUMERIC_OVERSHOOT' ELSE 'NUMERIC_UNDERSHOOT' END
   ELSE 'CATEGORICAL_MISMATCH' END"""
GAP_CTES = {
    "gaps": f"""
      SELECT *, CASE WHEN gap_type IN ('NUMERIC_UNDERSHOOT', 'NUMERIC_OVERSHOOT') THEN
               CASE WHEN operator = 'BETWEEN' THEN CASE WHEN uf < value_min THEN value_min - uf WHEN uf > value_max THEN uf - value_max END
                    ELSE abs(vf - uf) END END AS magnitude
      FROM (SELECT e.*, d.status, coalesce(display_text, '') AS shown, coalesce(us, 'None') AS user_text, {_REQUIRED} AS required_text,
                   {_GAP_TYPE} AS gap_type
            FROM evaluated e JOIN dets d USING (profile_id, scheme_id)
            WHERE counted AND outcome IN ('FAIL', 'UNDETERMINED') AND d.{MISSED})""",
}


@query(
    "gap_classify",
    oc.sql(
        "SELECT rule_id, gap_type, count(*) AS n, round(coalesce(sum(magnitude), 0), 2) AS magnitude FROM gaps GROUP BY 1, 2",
        **GAP_CTES,
    ),
)
def gap_classify(v: Views) -> DataFrame:
    return (
        gaps.failed_rules(gaps.with_gaps(v.determinations()))
        .groupBy("rule_id", "gap_type")
        .agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("magnitude"), F.lit(0.0)), 2).alias("magnitude"))
    )


@query(
    "gap_failed_rules",
    oc.sql(
        """SELECT profile_id, scheme_id, rule_id, field, operator, shown AS display_text, user_text, required_text, gap_type,
           round(magnitude, 4) AS magnitude FROM gaps""",
        **GAP_CTES,
    ),
)
def gap_failed_rules(v: Views) -> DataFrame:
    coded = v.coded("cells", "extras")
    rows = gaps.failed_rules(gaps.with_gaps(v.determinations())) if coded is None else gaps.coded_failed_rules(coded, v.nested_rules())
    return rows.withColumn("magnitude", F.round("magnitude", 4))


@query(
    "gap_prereq",
    oc.sql(
        """SELECT profile_id, scheme_id, rule_id AS prerequisite_id FROM evaluated
        WHERE counted AND phase = 'B' AND outcome IN ('FAIL', 'UNDETERMINED') AND fired_ord IS NULL"""
    ),
)
def gap_prereq(v: Views) -> DataFrame:
    return gaps.unmet_prerequisites(v.determinations())


@query(
    "gap_ambiguity_notes",
    oc.sql(
        f"""SELECT profile_id, scheme_id, ambiguity_id, rule_id AS affects_rule, 'UNKNOWN' AS severity FROM (
          SELECT *, row_number() OVER (PARTITION BY profile_id, scheme_id, ambiguity_id ORDER BY eval_pos, note_pos) AS rn FROM (
            SELECT e.profile_id, e.scheme_id, e.rule_id, e.eval_pos, unnest(note_ids) AS ambiguity_id,
                   unnest(range(len(note_ids))) AS note_pos
            FROM evaluated e JOIN dets d USING (profile_id, scheme_id) WHERE counted AND d.{MISSED}))
        WHERE rn = 1"""
    ),
)
def gap_ambiguity_notes(v: Views) -> DataFrame:
    coded = v.coded()
    return gaps.ambiguity_notes(v.determinations()) if coded is None else gaps.coded_notes(coded, v.nested_rules())


_DOC_NAME = case_map("field", model.DOCUMENT_FIELDS)
_OPEN_BANK = (
    "Open a bank account (Jan Dhan Yojana is free and available at all "
    "nationalised banks) to receive Direct Benefit Transfer payments."
)
ACTION_CTES = {
    **GAP_CTES,
    "actions": f"""
      SELECT profile_id, scheme_id, 0 AS grp, eval_pos, 'PREREQ' AS prefix,
             'Enroll in ' || rule_id || ' (' || rule_id || ') as a prerequisite. This scheme is required before you can apply.' AS description,
             'IMMEDIATE' AS urgency, NULL AS document_needed, '1-2 weeks' AS estimated_effort
      FROM gaps WHERE phase = 'B' AND fired_ord IS NULL
      UNION ALL
      SELECT profile_id, scheme_id, 1, eval_pos, 'DOC', 'Obtain a ' || ({_DOC_NAME}) || ' to meet document requirement.', 'IMMEDIATE', {_DOC_NAME}, '1-4 weeks'
      FROM gaps WHERE gap_type = 'MISSING_DOCUMENT'
      UNION ALL
      SELECT profile_id, scheme_id, 1, eval_pos, 'DOC', '{_OPEN_BANK}', 'IMMEDIATE', 'Bank account', '1-2 weeks'
      FROM gaps WHERE gap_type = 'BOOLEAN_MISMATCH' AND field = 'documents.bank_account'
      UNION ALL
      SELECT profile_id, scheme_id, 1, eval_pos, 'DATA', 'Provide information for field ''' || field || ''' to enable evaluation.', 'SHORT_TERM', NULL, 'Immediate'
      FROM gaps WHERE gap_type = 'MISSING_DATA'
      UNION ALL
      SELECT profile_id, scheme_id, 1, eval_pos, 'CONDITION', 'Condition not met for ''' || shown || '''. Current value: ' || user_text || ', required: ' || required_text || '.', 'LONG_TERM', NULL, NULL
      FROM gaps WHERE gap_type IN ('NUMERIC_UNDERSHOOT', 'NUMERIC_OVERSHOOT')""",
}


@query(
    "remediation_actions",
    oc.sql(
        """SELECT profile_id, scheme_id, prefix || '-' || lpad(CAST(row_number() OVER (PARTITION BY profile_id, scheme_id ORDER BY grp, eval_pos) AS STRING), 3, '0') AS action_id,
           description, urgency, document_needed, estimated_effort FROM actions""",
        **ACTION_CTES,
    ),
)
def remediation_actions(v: Views) -> DataFrame:
    made = gaps.remediation(gaps.with_gaps(v.determinations()))
    return made.select("profile_id", "scheme_id", F.inline("remediations"))


_NEAR = """CASE WHEN status IN ('NEAR_MISS', 'INELIGIBLE') THEN
   CASE WHEN rules_passed + rules_failed + rules_undetermined = 0 THEN 0.0
        ELSE round(rules_passed / (rules_passed + rules_failed + rules_undetermined), 6) END END"""


@query("near_miss_score", oc.sql(f"SELECT profile_id, scheme_id, {_NEAR} AS near_miss FROM dets WHERE {MISSED}"))
def near_miss_score(v: Views) -> DataFrame:
    # Counters are enough; no rule is looked at again.
    return v.decided().where(MISSED).select(
        "profile_id", "scheme_id", F.round(gaps.near_miss_score(), 6).alias("near_miss")
    )


@query(
    "gap_report",
    oc.sql(
        f"""SELECT d.profile_id, d.scheme_id, status, rules_passed, rules_failed, rules_undetermined,
           coalesce(g.n, 0) AS gaps, coalesce(a.n, 0) AS actions, coalesce(p.n, 0) AS prerequisites, {_NEAR} AS near_miss
        FROM dets d
        LEFT JOIN (SELECT profile_id, scheme_id, count(*) AS n FROM gaps GROUP BY 1, 2) g USING (profile_id, scheme_id)
        LEFT JOIN (SELECT profile_id, scheme_id, count(*) AS n FROM actions GROUP BY 1, 2) a USING (profile_id, scheme_id)
        LEFT JOIN (SELECT profile_id, scheme_id, count(*) AS n FROM actions WHERE grp = 0 GROUP BY 1, 2) p USING (profile_id, scheme_id)
        WHERE {MISSED}""",
        **ACTION_CTES,
    ),
)
def gap_report(v: Views) -> DataFrame:
    made = gaps.remediation(gaps.with_gaps(v.determinations()))
    return made.select(
        "profile_id", "scheme_id", "status", *longs("rules_passed", "rules_failed", "rules_undetermined"),
        F.size("gap_rows").cast("long").alias("gaps"),
        F.size("remediations").cast("long").alias("actions"),
        F.size(F.filter("remediations", lambda a: a["action_id"].startswith("PREREQ"))).cast("long").alias("prerequisites"),
        F.round(gaps.near_miss_score(), 6).alias("near_miss"),
    )


# ---- results ----------------------------------------------------------------

_BUCKET = case_map("status", model.STATUS_BUCKETS, "'ineligible'")
_COUNTS = ", ".join(f"count(*) FILTER ({_BUCKET} = '{b}') AS {b}" for b in results.BUCKETS)


@query("bucket_results", oc.sql(f"SELECT profile_id, {_COUNTS}, count(*) AS total FROM dets GROUP BY 1"))
def bucket_results(v: Views) -> DataFrame:
    return results.bucket_counts(v.determinations())


@query(
    "result_summary",
    oc.sql(
        f"""SELECT profile_id, {', '.join(f"count(*) FILTER ({_BUCKET} = '{b}') AS {b}_count" for b in results.BUCKETS)},
           count(*) AS total_schemes_evaluated,
           min(scheme_id) FILTER (rn = 1 AND {_BUCKET} = 'eligible') AS top_recommendation,
           CASE WHEN max(composite) FILTER ({_BUCKET} = 'eligible') >= 0.8 THEN 'HIGH'
                WHEN count(*) FILTER ({_BUCKET} IN ('eligible', 'near_miss')) > 0 THEN 'MEDIUM' ELSE 'LOW' END AS overall_data_quality
        FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, {_BUCKET} = 'eligible' ORDER BY composite DESC, position) AS rn FROM dets)
        GROUP BY 1"""
    ),
)
def result_summary(v: Views) -> DataFrame:
    return results.summary(v.determinations())


_TEMPLATE = "CASE status " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in results.SUMMARY_TEMPLATES.items()) + " END"
_TEXT = (
    f"replace(replace(replace({_TEMPLATE}, '{{scheme_name}}', scheme_name), '{{rules_passed}}', CAST(rules_passed AS STRING)), "
    "'{rules_failed}', CAST(rules_failed AS STRING))"
)


@query("summary_text", oc.sql(f"SELECT profile_id, scheme_id, {_TEXT} AS summary FROM dets"))
def summary_text(v: Views) -> DataFrame:
    return v.determinations().select("profile_id", "scheme_id", results.summary_text().alias("summary"))


_CAVEATS = f"""
  SELECT profile_id, scheme_id,
         coalesce(string_agg(array_to_string(note_ids, '|'), '|' ORDER BY eval_pos) FILTER (note_ids IS NOT NULL), '') AS note_text,
         coalesce(string_agg({_WARN}, '|' ORDER BY eval_pos) FILTER (phase = 'D' AND outcome = 'FAIL'), '') AS warning_text
  FROM evaluated WHERE counted GROUP BY 1, 2"""


@query(
    "scheme_result_rows",
    oc.sql(
        """SELECT d.profile_id, d.scheme_id, scheme_name, status, ministry, rules_passed, rules_failed, rules_undetermined,
           excluded_count, CASE WHEN coalesce(note_text, '') <> '' AND coalesce(warning_text, '') <> '' THEN note_text || '|' || warning_text
                                ELSE coalesce(note_text, '') || coalesce(warning_text, '') END AS caveats
        FROM dets d LEFT JOIN cav USING (profile_id, scheme_id)""",
        cav=_CAVEATS,
    ),
)
def scheme_result_rows(v: Views) -> DataFrame:
    return v.determinations().select(
        "profile_id", "scheme_id", "scheme_name", "status", "ministry",
        *longs("rules_passed", "rules_failed", "rules_undetermined", "excluded_count"),
        F.array_join(results.caveats(), "|").alias("caveats"),
    )


@query(
    "document_checklist",
    oc.sql(
        """SELECT profile_id, document_field, document_name, required_by FROM (
             SELECT profile_id, string_agg(scheme_id, ',' ORDER BY status = 'NEAR_MISS', position) AS required_by
             FROM dets WHERE status IN ('ELIGIBLE', 'ELIGIBLE_WITH_CAVEATS', 'NEAR_MISS') GROUP BY 1)
        CROSS JOIN (VALUES ('documents.aadhaar', 'Aadhaar Card'),
                           ('documents.bank_account', 'Bank Account (Jan Dhan or nationalised bank)')) t(document_field, document_name)"""
    ),
)
def document_checklist(v: Views) -> DataFrame:
    return results.document_checklist(v.determinations()).withColumn("required_by", F.array_join("required_by", ","))


@query(
    "document_rank",
    oc.sql(
        f"""SELECT * FROM (SELECT profile_id, document_field, schemes,
             row_number() OVER (PARTITION BY profile_id ORDER BY schemes DESC, document_field) AS rank
           FROM (SELECT d.profile_id, e.field AS document_field, count(DISTINCT d.scheme_id) AS schemes
                 FROM dets d JOIN effective e ON e.state = d.state AND e.scheme_id = d.scheme_id
                 WHERE e.field IN ({_DOCS}) AND status IN ('ELIGIBLE', 'ELIGIBLE_WITH_CAVEATS', 'NEAR_MISS') GROUP BY 1, 2))
        WHERE rank <= 6"""
    ),
)
def document_rank(v: Views) -> DataFrame:
    return results.document_rank(v.determinations()).withColumn("rank", F.col("rank").cast("long"))


@query(
    "next_steps",
    oc.sql(
        f"""SELECT profile_id, kind, scheme_id, scheme_name, status, rules_failed, step FROM (
          SELECT *, row_number() OVER (PARTITION BY profile_id, kind ORDER BY position) AS step FROM (
            SELECT *, CASE WHEN {_BUCKET} = 'eligible' THEN 'apply' WHEN status = 'NEAR_MISS' THEN 'unlock' END AS kind FROM dets)
          WHERE kind IS NOT NULL) WHERE step <= 3"""
    ),
)
def next_steps(v: Views) -> DataFrame:
    return results.next_steps(v.determinations()).select(
        "profile_id", "kind", "scheme_id", "scheme_name", "status", *longs("rules_failed", "step")
    )


_ACTION = case_map("status", results.ACTION_LINES, "''")


@query(
    "result_trace_report",
    oc.sql(
        f"""SELECT d.profile_id, d.scheme_id, d.status, round(composite, 6) AS composite,
           CAST(floor(composite * 100 + 1e-9) AS BIGINT) AS composite_pct, {_ACTION} AS action, coalesce(t.trace, '') AS trace
        FROM dets d LEFT JOIN (
          SELECT profile_id, scheme_id, string_agg(concat_ws(':', rule_id, operator, outcome, {_REQUIRED}, audit_status, source_quote), ';' ORDER BY eval_pos) AS trace
          FROM evaluated WHERE counted GROUP BY 1, 2) t USING (profile_id, scheme_id)"""
    ),
)
def result_trace_report(v: Views) -> DataFrame:
    flat = F.transform(
        "trace",
        lambda t: F.concat_ws(
            ":", t["rule_id"], t["operator"], t["outcome"], t["required"], t["audit_status"], t["source_quote"]
        ),
    )
    return results.trace_report(v.determinations()).select(
        "profile_id", "scheme_id", "status", six("composite"), "composite_pct", "action",
        F.array_join(flat, ";").alias("trace"),
    )


_ORDER = case_map(_BUCKET, {k: v for k, v in results.BUCKET_ORDER.items()})


@query(
    "trace_sample",
    oc.sql(
        f"""SELECT e.profile_id, e.scheme_id, scheme_rank, e.status, e.rule_rank, rule_id, outcome = 'PASS' AS passed FROM (
          SELECT d.status, d.scheme_rank, e.*, row_number() OVER (PARTITION BY e.profile_id, e.scheme_id ORDER BY eval_pos) AS rule_rank
          FROM evaluated e JOIN (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY {_ORDER}, position) AS scheme_rank FROM dets) d
            USING (profile_id, scheme_id)
          WHERE counted AND scheme_rank <= 8) e
        WHERE rule_rank <= 6"""
    ),
)
def trace_sample(v: Views) -> DataFrame:
    rows = results.trace_sample(v.determinations())
    return rows.withColumns({c: F.col(c).cast("long") for c in ("scheme_rank", "rule_rank")})
