"""Oracle CTEs: the decision procedure written a second time, as flat SQL.

Rules are joined to profiles row by row here and aggregated with windows, unlike
the nested evaluation on the Spark side, so the two check each other.
"""

from __future__ import annotations

from eligrid import model
from eligrid.plans import derive


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case_map(column: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CASE {column} {arms} ELSE {default} END"


def _cell_select(path: str, kind: str) -> str:
    col = model.column_of(path)
    if kind in ("int", "float"):
        parts = ("'num'", f"CAST({col} AS STRING)", f"CAST({col} AS DOUBLE)", "NULL")
    elif kind == "bool":
        parts = ("'bool'", f"CASE WHEN {col} THEN 'True' ELSE 'False' END", f"CAST(CAST({col} AS INT) AS DOUBLE)", "NULL")
    elif kind == "list":
        parts = (
            "'list'",
            f"'[' || array_to_string(list_transform({col}, lambda x: '''' || x || ''''), ', ') || ']'",
            "NULL",
            col,
        )
    else:
        parts = ("'str'", col, f"TRY_CAST(CASE WHEN regexp_matches(trim({col}), '^[+-]?[0-9.]+$') THEN trim({col}) END AS DOUBLE)", "NULL")
    k, s, f, a = parts
    return (
        f"SELECT profile_id, '{path}' AS field, true AS mapped, "
        f"CASE WHEN {col} IS NULL THEN 'null' ELSE {k} END AS uk, "
        f"CASE WHEN {col} IS NULL THEN NULL ELSE {s} END AS us, "
        f"CASE WHEN {col} IS NULL THEN NULL ELSE {f} END AS uf, "
        f"CAST({a} AS STRING[]) AS ua FROM profiles"
    )


def _extra_select(path: str) -> str:
    return (
        f"SELECT profile_id, '{path}' AS field, false AS mapped, "
        f"CASE WHEN \"{path}\" IS NULL THEN 'null' ELSE 'str' END AS uk, \"{path}\" AS us, "
        f"TRY_CAST(CASE WHEN regexp_matches(trim(\"{path}\"), '^[+-]?[0-9.]+$') THEN trim(\"{path}\") END AS DOUBLE) AS uf, "
        f"CAST(NULL AS STRING[]) AS ua FROM profiles"
    )


_profile_cols = ", ".join(f"{e} AS {c}" for c, e in derive.PROFILE_EXPRESSIONS.items())
_extra_cols = ", ".join(f'{e} AS "{c}"' for c, e in derive.EXTRA_EXPRESSIONS.items())
_long = " UNION ALL ".join(
    [_cell_select(p, k) for p, k in model.PROFILE_FIELDS] + [_extra_select(p) for p in derive.EXTRA_EXPRESSIONS]
)
_num = "uk IN ('num', 'bool') AND vk IN ('num', 'bool')"
_eq = (
    f"CASE WHEN uk = 'null' THEN NULL WHEN {_num} THEN uf = vf "
    "WHEN uk = 'bool' OR vk = 'bool' THEN NULL WHEN (uk = 'str') <> (vk = 'str') THEN NULL "
    "WHEN uk = 'str' THEN us = vs ELSE uk = vk END"
)
_member = (
    "CASE WHEN values_kind = 'num' AND uk IN ('num', 'bool') "
    "THEN list_contains(list_transform(items, lambda x: CAST(x AS DOUBLE)), uf) "
    "WHEN values_kind = 'str' AND uk = 'str' THEN list_contains(items, us) ELSE false END"
)


def _ordered(sign: str) -> str:
    return f"CASE WHEN uf IS NULL OR vf IS NULL THEN NULL ELSE uf {sign} vf END"


OPERATOR_SQL = {
    "EQ": _eq,
    "NEQ": f"NOT ({_eq})",
    "LT": _ordered("<"),
    "LTE": _ordered("<="),
    "GT": _ordered(">"),
    "GTE": _ordered(">="),
    "BETWEEN": "CASE WHEN uf IS NULL OR value_min IS NULL OR value_max IS NULL THEN NULL "
    "ELSE uf >= value_min AND uf <= value_max END",
    "IN": f"CASE WHEN uk = 'null' THEN NULL WHEN len(items) = 0 THEN false ELSE {_member} END",
    "NOT_IN": f"CASE WHEN uk = 'null' THEN NULL WHEN len(items) = 0 THEN true ELSE NOT ({_member}) END",
    "NOT_MEMBER": "CASE WHEN uk = 'null' THEN NULL WHEN len(items) = 0 THEN true WHEN uk <> 'list' THEN NULL "
    "WHEN values_kind <> 'str' THEN true ELSE len(list_intersect(ua, items)) = 0 END",
    "IS_NULL": "uk = 'null'",
    "IS_NOT_NULL": "uk <> 'null'",
    "CONTAINS": "CASE WHEN uk = 'null' THEN NULL WHEN uk = 'list' THEN vk = 'str' AND list_contains(ua, vs) "
    "WHEN vk <> 'str' THEN NULL ELSE contains(us, vs) END",
    # The only broken pattern of the derived rules is named; RE2 would raise on it.
    "MATCHES": "CASE WHEN uk = 'null' OR value_text = '([' THEN NULL "
    "ELSE regexp_matches(us, CASE WHEN value_text = '([' THEN '' ELSE coalesce(vs, 'None') END) END",
}
_result = "CASE operator " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in OPERATOR_SQL.items()) + " END"

_aliases = case_map("upper(operator)", model.OPERATOR_ALIASES, "operator")
_caste = case_map("trim(upper(applicant_caste_category))", model.CASTE_ALIASES, "trim(upper(applicant_caste_category))")

CTES: dict[str, str] = {
    "raw_profiles": f"""
      SELECT c.*, coalesce(e.enrolled, CAST([] AS STRING[])) AS schemes_active_enrollments
      FROM (SELECT c_custkey AS profile_id, {_profile_cols}, {_extra_cols} FROM customer) c
      LEFT JOIN (SELECT o_custkey AS profile_id, list_sort(list(DISTINCT {derive.ENROLLMENT_SCHEME})) AS enrolled
                 FROM orders WHERE {derive.ENROLLMENT_FILTER} GROUP BY 1) e USING (profile_id)""",
    "profiles": f"""
      SELECT * REPLACE (upper(location_state) AS location_state, lower(applicant_gender) AS applicant_gender,
             {_caste} AS applicant_caste_category,
             coalesce(household_income_annual, household_income_monthly * 12) AS household_income_annual),
             household_income_annual IS NULL AND household_income_monthly IS NOT NULL AS income_derived
      FROM raw_profiles""",
    "profile_fields": _long,
    "schemes": derive.SCHEMES_SQL.format(part="part"),
    "rules_raw": derive.RULES_RAW_SQL.format(part="part"),
    "rules": f"""
      SELECT * FROM (SELECT * REPLACE ({_aliases} AS operator) FROM rules_raw WHERE upper(operator) <> 'NOT_BETWEEN')
      WHERE NOT (operator = 'BETWEEN' AND (value_min IS NULL OR value_max IS NULL))""",
    "queue": "SELECT rule_id FROM rules_raw WHERE in_review_queue",
    "flags": """
      SELECT scheme_id, rule_id, field, ord, 0 AS pos, flag_code AS type_code, flag_severity AS severity,
             'AMB-' || lpad(CAST(flag_code AS STRING), 3, '0') AS ambiguity_id
      FROM rules_raw WHERE flag_severity IS NOT NULL
      UNION ALL
      SELECT scheme_id, rule_id, field, ord, 1, flag2_code, flag2_severity,
             'AMB-' || lpad(CAST(flag2_code AS STRING), 3, '0')
      FROM rules_raw WHERE flag2_severity IS NOT NULL""",
    "flag_sev": """
      SELECT ambiguity_id, severity FROM (
        SELECT ambiguity_id, severity,
               row_number() OVER (PARTITION BY ambiguity_id ORDER BY scheme_id DESC, ord DESC, pos DESC) AS rn
        FROM flags) WHERE rn = 1""",
    "notes": """
      SELECT f.rule_id, list(f.ambiguity_id ORDER BY f.pos) AS note_ids,
             bool_or(f.severity = 'CRITICAL') AS own_critical,
             count(*) FILTER (g.severity = 'CRITICAL') AS critical_notes,
             count(*) FILTER (g.severity = 'HIGH') AS high_notes,
             count(*) FILTER (g.severity = 'MEDIUM') AS medium_notes
      FROM flags f JOIN flag_sev g USING (ambiguity_id) GROUP BY f.rule_id""",
    "active": f"""
      SELECT r.*, CASE lower(trim(rule_type)) WHEN 'disqualifying' THEN 'A' WHEN 'prerequisite' THEN 'B'
                  WHEN 'admin_discretion' THEN 'D' WHEN 'administrative_discretion' THEN 'D'
                  WHEN 'discretion' THEN 'D' ELSE 'C' END AS phase,
             operator IN ({quoted(model.NUMERIC_OPERATORS)}) AS numeric_op,
             {case_map('audit_status', model.AUDIT_CENTS, str(model.AUDIT_CENTS_DEFAULT))} AS audit_cents,
             CASE WHEN value_text IS NULL THEN 'null' ELSE value_kind END AS vk, value_text AS vs,
             CASE value_kind WHEN 'num' THEN TRY_CAST(value_text AS DOUBLE)
                  WHEN 'bool' THEN CASE WHEN value_text = 'True' THEN 1.0 ELSE 0.0 END
                  ELSE TRY_CAST(CASE WHEN regexp_matches(trim(value_text), '^[+-]?[0-9.]+$') THEN value_text END AS DOUBLE) END AS vf,
             CASE WHEN values_text = '' THEN CAST([] AS STRING[]) ELSE string_split(values_text, '|') END AS items,
             n.note_ids, coalesce(n.own_critical, false) AS own_critical, coalesce(n.critical_notes, 0) AS critical_notes,
             coalesce(n.high_notes, 0) AS high_notes, coalesce(n.medium_notes, 0) AS medium_notes
      FROM rules r LEFT JOIN notes n USING (rule_id)
      WHERE audit_status <> 'DISPUTED' AND rule_id NOT IN (SELECT rule_id FROM queue)
        AND scheme_id IN (SELECT scheme_id FROM schemes WHERE status = 'active')""",
    "excluded": """
      SELECT scheme_id, count(*) FILTER (audit_status = 'DISPUTED' OR rule_id IN (SELECT rule_id FROM queue)) AS excluded_count
      FROM rules GROUP BY 1""",
    "states": "SELECT unnest(string_split('*," + ",".join(model.STATE_CODES) + "', ',')) AS state",
    "effective": """
      SELECT s.state, r.* FROM states s CROSS JOIN active r
      WHERE (r.state_scope = 'central' AND NOT EXISTS (
               SELECT 1 FROM active o WHERE o.state_scope = s.state AND o.state_scope <> 'central'
                 AND o.scheme_id = r.scheme_id AND o.supersedes_rule_id = r.rule_id))
         OR r.state_scope = s.state""",
    "results": f"""
      SELECT *, {_result} AS result FROM (
        SELECT p.profile_id, p.location_state, e.*, f.uk, f.us, f.uf, f.ua,
               f.mapped AND f.uk <> 'null' AND NOT (f.uk = 'list' AND len(f.ua) = 0) AS is_populated
        FROM profiles p JOIN effective e ON e.state = coalesce(p.location_state, '*')
        JOIN profile_fields f ON f.profile_id = p.profile_id AND f.field = e.field)""",
    "outcomes": """
      SELECT *, CASE WHEN result IS NULL THEN 'UNDETERMINED' WHEN NOT result THEN 'FAIL'
                     WHEN audit_status = 'PENDING' THEN 'UNVERIFIED_PASS' ELSE 'PASS' END AS outcome
      FROM results""",
    "phased": """
      SELECT *, min(CASE WHEN phase = 'A' AND outcome = 'PASS' THEN ord END) OVER w AS fired_ord,
             count(*) FILTER (phase = 'B' AND outcome IN ('FAIL', 'UNDETERMINED')) OVER w AS prereq_unmet,
             phase = 'C' OR (phase = 'A' AND outcome = 'FAIL' AND numeric_op) AS in_c
      FROM outcomes WINDOW w AS (PARTITION BY profile_id, scheme_id)""",
    "evaluated": """
      SELECT *, CASE WHEN fired_ord IS NOT NULL THEN phase = 'A' AND ord <= fired_ord
                     WHEN prereq_unmet > 0 THEN phase IN ('A', 'B') ELSE true END AS counted,
             row_number() OVER (PARTITION BY profile_id, scheme_id ORDER BY phase, ord) - 1 AS eval_pos
      FROM phased""",
    "sums": """
      SELECT profile_id, scheme_id, min(fired_ord) AS fired_ord, max(prereq_unmet) AS prereq_unmet,
             count(*) FILTER (in_c AND outcome IN ('PASS', 'UNVERIFIED_PASS')) AS c_pass,
             count(*) FILTER (in_c AND outcome = 'FAIL') AS c_fail,
             coalesce(bool_or(in_c AND outcome IN ('PASS', 'UNVERIFIED_PASS') AND own_critical), false) AS c_critical,
             count(*) FILTER (counted AND outcome IN ('PASS', 'UNVERIFIED_PASS')) AS rules_passed,
             count(*) FILTER (counted AND outcome = 'FAIL') AS rules_failed,
             count(*) FILTER (counted AND outcome = 'UNDETERMINED') AS rules_undetermined,
             sum(CASE WHEN NOT counted THEN NULL WHEN outcome = 'PASS' THEN 100 WHEN outcome = 'UNVERIFIED_PASS' THEN 70
                      WHEN outcome = 'FAIL' THEN 0 END) AS match_cents,
             count(*) FILTER (counted) AS n_eval,
             sum(audit_cents) FILTER (counted) AS audit_sum,
             coalesce(sum(high_notes * 15 + medium_notes * 5) FILTER (counted), 0) AS penalty,
             coalesce(sum(critical_notes) FILTER (counted), 0) AS criticals,
             count(DISTINCT field) AS n_required,
             count(DISTINCT field) FILTER (is_populated) AS n_present
      FROM evaluated GROUP BY 1, 2""",
    "dets": """
      SELECT *, least(rule_match, data_confidence, completeness) AS composite FROM (
        SELECT p.profile_id, coalesce(p.location_state, '*') AS state, s.scheme_id, s.scheme_name, s.ministry, s.position,
               coalesce(x.excluded_count, 0) AS excluded_count, fired_ord, coalesce(prereq_unmet, 0) AS prereq_unmet,
               coalesce(c_pass, 0) AS c_pass, coalesce(c_fail, 0) AS c_fail, coalesce(c_critical, false) AS c_critical,
               coalesce(rules_passed, 0) AS rules_passed, coalesce(rules_failed, 0) AS rules_failed,
               coalesce(rules_undetermined, 0) AS rules_undetermined,
               coalesce(n_required, 0) AS n_required, coalesce(n_present, 0) AS n_present,
               CASE WHEN fired_ord IS NOT NULL THEN 'DISQUALIFIED'
                    WHEN coalesce(prereq_unmet, 0) > 0 THEN 'REQUIRES_PREREQUISITE'
                    WHEN coalesce(c_fail, 0) = 0 AND coalesce(c_pass, 0) = 0 THEN
                      CASE WHEN coalesce(n_required, 0) > 0 AND n_present / n_required < 0.6 THEN 'INSUFFICIENT_DATA' ELSE 'PARTIAL' END
                    WHEN c_fail = 0 THEN CASE WHEN c_critical THEN 'ELIGIBLE_WITH_CAVEATS' ELSE 'ELIGIBLE' END
                    WHEN c_fail < 2 THEN 'NEAR_MISS' ELSE 'INELIGIBLE' END AS status,
               CASE WHEN coalesce(rules_passed + rules_failed, 0) = 0 THEN 0.0
                    ELSE match_cents / ((rules_passed + rules_failed) * 100) END AS rule_match,
               CASE WHEN coalesce(n_eval, 0) = 0 THEN 0.0 ELSE
                 least(1.0, CASE WHEN criticals > 0
                   THEN least(0.3, greatest(0.0, audit_sum / (n_eval * 100) - penalty / 100))
                   ELSE greatest(0.0, audit_sum / (n_eval * 100) - penalty / 100) END) END AS data_confidence,
               CASE WHEN coalesce(n_required, 0) = 0 THEN 0.0 ELSE n_present / n_required END AS completeness
        FROM profiles p CROSS JOIN (SELECT * FROM schemes WHERE status = 'active') s
        LEFT JOIN sums u ON u.profile_id = p.profile_id AND u.scheme_id = s.scheme_id
        LEFT JOIN excluded x ON x.scheme_id = s.scheme_id)""",
}


def bands(column: str, cut: tuple, last: str) -> str:
    arms = " ".join(f"WHEN {column} >= {floor} THEN '{name}'" for floor, name in cut)
    return f"CASE {arms} ELSE '{last}' END"


def sql(final: str, **more: str) -> str:
    """Final SELECT over the shared CTEs and any further ones, in order."""
    stack = {**CTES, **more}
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in stack.items()) + "\n" + final
