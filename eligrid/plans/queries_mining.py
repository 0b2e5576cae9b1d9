"""Queries of rule mining, ambiguity detection and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import patterns as P
from eligrid.operators import ambiguity, enrich, mining
from eligrid.plans import derive
from eligrid.plans.oracle_core import case_map, quoted
from eligrid.plans.registry import query
from eligrid.plans.views import Views


def hit(column: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({column}, '{pattern}'" + (f", '{flags}')" if flags else ")")


def _any(column: str, pats) -> str:
    return "(" + " OR ".join(hit(column, p) for p in pats) + ")"


def _num(pattern: str, n: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract(t, '{pattern}', {n}), '') AS BIGINT)"


def _scaled(pattern: str, by: int) -> str:
    return f"CAST(trunc(TRY_CAST(replace(nullif(regexp_extract(t, '{pattern}', 1), ''), ',', '') AS DOUBLE) * {by}) AS BIGINT)"


CURRENCY = (
    f"coalesce({_scaled(P.LAKH_MARKED, 100000)}, {_scaled(P.LAKH, 100000)}, {_scaled(P.CRORE, 10000000)}, "
    f"TRY_CAST(replace(nullif(regexp_extract(t, '{P.RUPEES}', 1), ''), ',', '') AS BIGINT))"
)
FIELD = "CASE " + " ".join(f"WHEN {hit('t', p)} THEN '{f}'" for p, f in P.FIELD_PATTERNS) + f" ELSE '{P.OTHER_FIELD}' END"
RULE_TYPE = (
    f"CASE WHEN {_any('t', P.DISQUALIFYING)} THEN 'disqualifying' "
    f"WHEN {_any('t', P.PREREQUISITE)} AND NOT {hit('t', P.STANDARD_CONDITION)} THEN 'prerequisite' ELSE 'eligibility' END"
)
_steps = [("LTE", f"{hit('t', P.LTE_MONEY)} AND money IS NOT NULL", "money", "NULL"),
          ("GTE", f"{hit('t', P.GTE_MONEY)} AND money IS NOT NULL", "money", "NULL")]
_steps += [("BETWEEN", hit("t", p), _num(p), _num(p, 2)) for p in P.BETWEEN_PATTERNS]
_steps += [(op, hit("t", p), _num(p), "NULL") for op, p in P.NUMBER_PATTERNS]
_steps += [("IN", _any("t", P.IN_PATTERNS), "NULL", "NULL")]
STEP = "CASE " + " ".join(f"WHEN {cond} THEN {i}" for i, (_, cond, _, _) in enumerate(_steps)) + " ELSE 99 END"
OP = "CASE step " + " ".join(f"WHEN {i} THEN '{op}'" for i, (op, _, _, _) in enumerate(_steps)) + " ELSE 'EQ' END"
VAL = "CASE step " + " ".join(f"WHEN {i} THEN {v}" for i, (_, _, v, _) in enumerate(_steps)) + " END"
VALMAX = "CASE step " + " ".join(f"WHEN {i} THEN {h}" for i, (_, _, _, h) in enumerate(_steps) if h != "NULL") + " END"
CONDITION_TYPE = """CASE WHEN contains(field, 'age') THEN 'age_range'
  WHEN contains(field, 'employment') THEN CASE WHEN contains(field, 'income_tax') THEN 'employment:income_tax_status'
    WHEN contains(field, 'epfo') OR contains(field, 'esic') OR contains(field, 'nps') THEN 'employment:social_security_status' ELSE 'occupation' END
  WHEN contains(field, 'income') THEN 'income_ceiling' WHEN contains(field, 'gender') THEN 'gender' WHEN contains(field, 'caste') THEN 'caste_category'
  WHEN contains(field, 'location') AND contains(field, 'state') THEN 'domicile' WHEN contains(field, 'bpl') THEN 'poverty_status'
  WHEN contains(field, 'documents') THEN 'document:' || split_part(field, '.', 2)
  WHEN contains(field, 'disability') THEN 'disability' WHEN contains(field, 'marital') THEN 'marital_status'
  WHEN contains(field, 'education') THEN 'education_level' WHEN contains(field, 'land') OR contains(field, 'assets') THEN 'land_ownership'
  WHEN contains(field, 'family') THEN 'family_size' ELSE 'other' END"""


def _list(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


_castes = _list([f"CASE WHEN contains(t, '{c.lower()}') OR contains(sentence, '{c}') THEN '{c}' END" for c in P.CASTE_VALUES])
_genders = _list([f"CASE WHEN {hit('t', p)} THEN '{g}' END" for p, g in P.GENDER_VALUES])
_words = lambda ws: _list([f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in ws])
_jobs = f"list_sort(list_distinct(regexp_extract_all(t, '{P.OCCUPATIONS}')))"
IN_VALUES = f"""CASE WHEN contains(field, 'caste') THEN {_castes} WHEN contains(field, 'gender') THEN {_genders}
  WHEN contains(field, 'occupation') THEN {_jobs} WHEN contains(field, 'education') THEN {_words(P.EDUCATION_VALUES)}
  WHEN contains(field, 'marital') THEN {_words(P.MARITAL_VALUES)} ELSE CAST([] AS STRING[]) END"""
CONFIDENCE = f"""CASE WHEN op IN ({quoted(model.NUMERIC_OPERATORS)}) AND val IS NOT NULL THEN
    CASE WHEN {hit('sentence', P.MONEY_WORDS, 'i')} THEN 0.92 ELSE 0.95 END
  WHEN contains(t, 'must') OR contains(t, 'should') THEN 0.85 WHEN contains(t, 'may') OR contains(t, 'can') THEN 0.72
  WHEN contains(t, 'or') AND contains(t, 'and') THEN 0.65
  WHEN contains(t, 'some') OR contains(t, 'any') OR contains(t, 'subject') THEN 0.55 ELSE 0.70 END"""
SHORT = "replace(split_part(field, '.', 2), '_', ' ')"
CONDITION = f"""CASE WHEN op = 'BETWEEN' AND val IS NOT NULL AND val_max IS NOT NULL THEN {SHORT} || ' between ' || val || ' and ' || val_max
  WHEN op = 'GTE' AND val IS NOT NULL THEN {SHORT} || ' ≥ ' || val WHEN op = 'LTE' AND val IS NOT NULL THEN {SHORT} || ' ≤ ' || val
  WHEN op = 'GT' AND val IS NOT NULL THEN {SHORT} || ' > ' || val WHEN op = 'LT' AND val IS NOT NULL THEN {SHORT} || ' < ' || val
  WHEN op = 'IN' THEN {SHORT} || ' in eligible categories' WHEN len(sentence) <= 120 THEN sentence ELSE substring(sentence, 1, 117) || '...' END"""
_checks = []
for _code, _name, _sev, _p, _also, _unless in P.PARSER_CHECKS:
    _cond = hit("t", _p) + (f" AND {hit('t', _also)}" if _also else "") + (f" AND NOT {hit('sentence', _unless)}" if _unless else "")
    _checks.append(f"CASE WHEN {_cond} THEN {_code} END")
PARSER_CODES = _list(_checks)
PARSER_NAME = case_map("CAST(code AS STRING)", {c[0]: c[1] for c in P.PARSER_CHECKS})
PARSER_SEVERITY = case_map("CAST(code AS STRING)", {c[0]: c[2] for c in P.PARSER_CHECKS})

# RE2 has no look-ahead, so two types state their condition differently here.
_REWRITTEN = {
    10: r"\bbelow (?:the )?poverty line\b[^\d₹\n]*(?:\n|$)",
    23: r"\bresident of the state|permanent resident|domicile\b[^\d\n]*(?:\n|$)",
}
TAXONOMY_CODES = _list(
    [f"CASE WHEN {hit('sentence', _REWRITTEN.get(c, p), 'i')} THEN {c} END" for c, p in P.TAXONOMY_CHECKS]
)

CTES = {
    "clauses": derive.CLAUSES_SQL.format(part="part"),
    "sents": r"""
      SELECT * EXCLUDE (l), unnest(l) AS sentence, unnest(range(1, len(l) + 1)) AS counter FROM (
        SELECT *, list_filter(list_transform(string_split_regex(eligibility, '[.!?]\s+'),
                    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: len(x) >= 10) AS l
        FROM clauses WHERE trim(eligibility) <> '')""",
    "stepped": f"SELECT *, {STEP} AS step FROM (SELECT *, {CURRENCY} AS money FROM (SELECT *, lower(sentence) AS t FROM sents))",
    "parsed": f"SELECT *, {OP} AS op, {VAL} AS val, {VALMAX} AS val_max, {FIELD} AS field, {RULE_TYPE} AS rule_type FROM stepped",
    "mined": f"""
      SELECT position, slug, counter, rule_type, {CONDITION_TYPE} AS condition_type, field, op AS operator,
             CASE WHEN op <> 'BETWEEN' THEN val END AS value, CASE WHEN op = 'BETWEEN' THEN val END AS value_min,
             CASE WHEN op = 'BETWEEN' THEN val_max END AS value_max,
             CASE WHEN op = 'IN' THEN {IN_VALUES} ELSE CAST([] AS STRING[]) END AS "values", {CONDITION} AS condition,
             sentence, substring(sentence, 1, 200) AS source_quote, substring(sentence, 1, 100) AS display_text,
             CAST({CONFIDENCE} AS DOUBLE) AS confidence, {PARSER_CODES} AS codes, NULL AS notes,
             slug || '-K-R' || lpad(CAST(counter AS STRING), 3, '0') AS rule_id, slug || '-KAGGLE' AS scheme_id
      FROM parsed
      UNION ALL
      SELECT position, slug, 1, 'eligibility', 'other', 'eligibility.other', 'EQ', NULL, NULL, NULL, CAST([] AS STRING[]),
             'No eligibility criteria extracted', '', '', 'Empty eligibility text', 0.0, CAST([] AS INT[]), 'Empty eligibility text',
             slug || '-K-R001', slug || '-KAGGLE' FROM clauses WHERE trim(eligibility) = ''""",
    "tax": f"SELECT rule_id, scheme_id, field, sentence, {TAXONOMY_CODES} AS codes FROM mined",
    "tax_rows": "SELECT rule_id, scheme_id, field, sentence, unnest(codes) AS code FROM tax",
}


def sql(final: str, **more: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({b})" for k, b in {**CTES, **more}.items()) + "\n" + final


@query("txt_sentences", sql("SELECT slug, counter, sentence FROM sents"))
def txt_sentences(v: Views) -> DataFrame:
    texts = v.clauses()
    return mining.sentences(texts.where(F.trim("eligibility") != "")).select("slug", F.col("counter").cast("long").alias("counter"), "sentence")


@query("txt_empty_rule", sql("SELECT slug, rule_id, display_text, confidence FROM mined WHERE notes IS NOT NULL"))
def txt_empty_rule(v: Views) -> DataFrame:
    return v.mined().where("notes IS NOT NULL").select("slug", "rule_id", "display_text", "confidence")


def _expr(name: str, sql_expr: str, column: str, build):
    @query(name, sql(f"SELECT slug, counter, {sql_expr} AS {column} FROM parsed"))
    def run(v: Views) -> DataFrame:
        rows = mining.sentences(v.clauses().where(F.trim("eligibility") != ""))
        made = mining.analysed(rows, {column: build(F.col("sentence"))})
        return made.select("slug", F.col("counter").cast("long").alias("counter"), column)


_expr("txt_rule_type", "rule_type", "rule_type", mining.rule_type)
_expr("txt_field", "field", "field", mining.canonical_field)
_expr("txt_condition_type", CONDITION_TYPE, "condition_type", lambda s: F.transform(F.array(mining.canonical_field(s)), mining.condition_type)[0])
_expr("txt_currency", "money", "amount", mining.currency)


@query("txt_operator", sql("SELECT slug, counter, op, val, val_max FROM parsed"))
def txt_operator(v: Views) -> DataFrame:
    rows = mining.sentences(v.clauses().where(F.trim("eligibility") != ""))
    found = mining.analysed(rows, {"o": mining.operator(F.col("sentence"))})
    return found.select("slug", F.col("counter").cast("long").alias("counter"), "o.op", "o.val", "o.val_max")


_NUMS = f"list_transform(regexp_extract_all(sentence, '{P.NUMBER}'), lambda x: replace(x, ',', ''))"


@query(
    "txt_numeric_range",
    sql(
        f"""SELECT slug, counter,
           CASE WHEN len(raw) > 0 AND NOT contains(array_to_string(raw, ' '), '.') THEN list_min(list_transform(raw, lambda x: TRY_CAST(x AS BIGINT))) END AS lo,
           CASE WHEN len(raw) > 1 AND NOT contains(array_to_string(raw, ' '), '.') THEN list_max(list_transform(raw, lambda x: TRY_CAST(x AS BIGINT))) END AS hi
        FROM (SELECT slug, counter, {_NUMS} AS raw FROM sents)"""
    ),
)
def txt_numeric_range(v: Views) -> DataFrame:
    rows = mining.sentences(v.clauses().where(F.trim("eligibility") != ""))
    got = mining.analysed(rows, {"r": mining.numeric_range(F.col("sentence"))})
    return got.select("slug", F.col("counter").cast("long").alias("counter"), "r.lo", "r.hi")


@query("txt_in_values", sql("SELECT rule_id, array_to_string(\"values\", ',') AS items FROM mined WHERE operator = 'IN'"))
def txt_in_values(v: Views) -> DataFrame:
    return v.mined().where("operator = 'IN'").select("rule_id", F.array_join("values", ",").alias("items"))


@query("txt_confidence", sql("SELECT rule_id, confidence FROM mined"))
def txt_confidence(v: Views) -> DataFrame:
    return v.mined().select("rule_id", "confidence")


@query("txt_condition_text", sql("SELECT rule_id, condition FROM mined"))
def txt_condition_text(v: Views) -> DataFrame:
    return v.mined().select("rule_id", "condition")


@query(
    "txt_extract_rules",
    sql(
        """SELECT rule_id, scheme_id, rule_type, condition_type, field, operator, value, value_min, value_max,
           array_to_string("values", ',') AS items, condition, source_quote, display_text, confidence,
           array_to_string(list_transform(range(len(codes)), lambda i: 'AMB-' || slug || '-' || lpad(CAST(i AS STRING), 3, '0')), ',') AS flag_ids
        FROM mined"""
    ),
)
def txt_extract_rules(v: Views) -> DataFrame:
    return v.mined().select(
        "rule_id", "scheme_id", "rule_type", "condition_type", "field", "operator", "value", "value_min", "value_max",
        F.array_join("values", ",").alias("items"), "condition", "source_quote", "display_text", "confidence",
        F.array_join("flag_ids", ",").alias("flag_ids"),
    )


_LEVEL = case_map("trim(lower(level))", mining.LEVEL_CODES, "substring(upper(level), 1, 2)")


@query(
    "txt_state_code",
    sql(f"SELECT slug, CASE WHEN level = '' OR lower(level) = 'central' THEN 'central' ELSE {_LEVEL} END AS state_scope FROM clauses"),
)
def txt_state_code(v: Views) -> DataFrame:
    return v.clauses().select("slug", mining.state_code(F.col("level")).alias("state_scope"))


REVIEW_CTES = {
    "flagged_codes": f"""
      SELECT slug, counter, pos, code, {PARSER_NAME} AS name, {PARSER_SEVERITY} AS severity FROM (
        SELECT slug, counter, unnest(codes) AS code, unnest(range(len(codes))) AS pos FROM mined)""",
    "review": """
      SELECT m.slug, count(*) AS rules, sum(len(codes)) AS n_flags,
             CASE WHEN max(l.name) IS NOT NULL THEN 'Ambiguity: ' || max(l.name)
                  WHEN arg_min(confidence, counter) FILTER (confidence < 0.65) IS NOT NULL
                    THEN 'Low confidence (' || printf('%.2f', arg_min(confidence, counter) FILTER (confidence < 0.65)) || ')'
                  WHEN sum(len(codes)) > 3 THEN 'Multiple ambiguities detected (' || CAST(sum(len(codes)) AS BIGINT) || ')'
                  WHEN bool_or(contains(lower(sentence), 'discretion') OR contains(lower(sentence), 'subject to')) THEN 'Contains discretionary language' END AS reason,
             max(l.severity) AS loud
      FROM mined m LEFT JOIN (SELECT slug, arg_min(name, counter * 100 + pos) AS name, arg_min(severity, counter * 100 + pos) AS severity
                              FROM flagged_codes WHERE severity = 'HIGH' GROUP BY 1) l USING (slug) GROUP BY 1""",
}


@query(
    "review_flag",
    sql(
        """SELECT slug, rules, CAST(n_flags AS BIGINT) AS n_flags, reason, coalesce(loud, CASE WHEN reason IS NOT NULL THEN 'MEDIUM' END) AS severity,
           reason IS NOT NULL AS flagged FROM review""",
        **REVIEW_CTES,
    ),
)
def review_flag(v: Views) -> DataFrame:
    return mining.review(v.mined())


@query(
    "amb_detect",
    sql(
        f"""SELECT rule_id, code, {case_map('CAST(code AS STRING)', model.AMBIGUITY_TAXONOMY)} AS type_name,
           {case_map('CAST(code AS STRING)', model.AMBIGUITY_TAXONOMY)} || ' detected in: ''' || CASE WHEN length(sentence) > 200 THEN substring(sentence, 1, 200) || '...' ELSE sentence END || '''' AS description
        FROM tax_rows"""
    ),
)
def amb_detect(v: Views) -> DataFrame:
    return ambiguity.flags(v.mined()).select("rule_id", "code", "type_name", "description")


@query(
    "amb_detect_parser",
    sql(
        f"""SELECT rule_id, 'AMB-' || slug || '-' || lpad(CAST(pos + 1 AS STRING), 3, '0') AS ambiguity_id, code, {PARSER_NAME} AS name, {PARSER_SEVERITY} AS severity
        FROM (SELECT rule_id, slug, unnest(codes) AS code, unnest(range(len(codes))) AS pos FROM mined)"""
    ),
)
def amb_detect_parser(v: Views) -> DataFrame:
    return v.mined().select("rule_id", "slug", F.posexplode("flags").alias("pos", "f")).select(
        "rule_id",
        F.concat(F.lit("AMB-"), F.col("slug"), F.lit("-"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")).alias("ambiguity_id"),
        "f.code", "f.name", "f.severity",
    )


_UPGRADE = " OR ".join(f"contains(field, '{w}')" for w in model.UPGRADE_WORDS)
_IN = lambda codes: ", ".join(str(c) for c in codes)
SEVERITY = (
    f"CASE WHEN code IN ({_IN(model.CRITICAL_TYPES)}) THEN 'CRITICAL' WHEN code IN ({_IN(model.HIGH_TYPES)}) THEN "
    f"CASE WHEN {_UPGRADE} THEN 'CRITICAL' ELSE 'HIGH' END WHEN code IN ({_IN(model.MEDIUM_TYPES)}) THEN 'MEDIUM' ELSE 'LOW' END"
)
PLAIN_SEVERITY = SEVERITY.replace(f"CASE WHEN {_UPGRADE} THEN 'CRITICAL' ELSE 'HIGH' END", "'HIGH'")


@query("amb_severity", sql(f"SELECT rule_id, code, {SEVERITY} AS severity FROM tax_rows"))
def amb_severity(v: Views) -> DataFrame:
    return ambiguity.flags(v.mined()).select("rule_id", "code", ambiguity.severity(F.col("code"), F.col("field")).alias("severity"))


_IMPACT = "CASE " + " ".join(
    "WHEN sev = '{}' THEN '{}'".format(k, t.replace("'", "''")) for k, t in ambiguity.IMPACT.items()
) + " END"


@query("amb_impact_text", sql(f"SELECT impact, count(*) AS n FROM (SELECT {_IMPACT} AS impact FROM (SELECT {PLAIN_SEVERITY} AS sev FROM tax_rows)) GROUP BY 1"))
def amb_impact_text(v: Views) -> DataFrame:
    return ambiguity.flags(v.mined()).groupBy(ambiguity.impact(F.col("severity")).alias("impact")).agg(F.count("*").alias("n"))


_TEXT_CODES = TAXONOMY_CODES.replace("(sentence,", "(eligibility,")


@query(
    "amb_dedupe",
    sql(
        f"""SELECT slug, code, bool_or(from_rule) AS from_rule FROM (
          SELECT m.slug, unnest(t.codes) AS code, true AS from_rule FROM tax t JOIN mined m USING (rule_id)
          UNION ALL SELECT slug, unnest({_TEXT_CODES}), false FROM clauses) GROUP BY 1, 2"""
    ),
)
def amb_dedupe(v: Views) -> DataFrame:
    """Rule-level codes plus codes only the whole text shows, per scheme."""
    of_rules = ambiguity.detected(v.mined()).select("slug", F.explode("detected").alias("code"), F.lit(True).alias("from_rule"))
    of_text = v.clauses().select("slug", F.explode(ambiguity.detect(F.col("eligibility"))).alias("code"), F.lit(False).alias("from_rule"))
    return of_rules.unionByName(of_text).groupBy("slug", "code").agg(F.bool_or("from_rule").alias("from_rule"))


# Classifications as an external service would have left them, keyed by text digest.
_FIELDS = "applicant.age,household.income_annual,location.state,eligibility.other,unknown.field,applicant.gender"
CLASSIFIED = f"""
  SELECT md5(trim(sentence)) AS key, split_part('{_FIELDS}', ',', CAST(1 + length(sentence) % 6 AS INT)) AS c_field,
         CAST(20 + (length(sentence) * 7) % 80 AS DOUBLE) / 100 AS c_confidence, length(sentence) % 2 = 0 AS c_procedural,
         CASE length(sentence) % 4 WHEN 0 THEN 'BETWEEN' WHEN 1 THEN 'IN' WHEN 2 THEN 'GTE' ELSE NULL END AS c_operator,
         CAST(length(sentence) AS BIGINT) AS c_value, CAST(1 AS BIGINT) AS c_min, CAST(99 AS BIGINT) AS c_max,
         CASE WHEN length(sentence) % 3 = 0 THEN NULL ELSE concat('reads: ', sentence) END AS c_condition
  FROM (SELECT DISTINCT sentence FROM {{mined}})"""


def _classified(v: Views) -> DataFrame:
    got = v.spark.sql(CLASSIFIED, mined=v.mined().select("sentence"))
    return got.withColumn("c_values", F.array(F.lit("a"), F.lit("b")))


_KNOWN = quoted(enrich.CONDITION_TYPES)
ENRICH_CTES = {
    "classified": f"""
      SELECT * REPLACE (CASE WHEN c_field IN ({_KNOWN}) THEN c_confidence ELSE least(c_confidence, 0.5) END AS c_confidence,
                        CASE WHEN c_field IN ({_KNOWN}) THEN c_field ELSE 'eligibility.other' END AS c_field)
      FROM ({CLASSIFIED.format(mined='mined')})""",
    "joined": """
      SELECT m.*, c.* EXCLUDE (key), CASE WHEN m.field <> 'eligibility.other' THEN 'already_classified' WHEN c_confidence < 0.6 THEN 'low_confidence'
             WHEN c_field = 'eligibility.other' AND NOT c_procedural THEN 'kept_other' ELSE 'classified' END AS outcome,
             coalesce(c_operator, operator) AS new_op
      FROM mined m LEFT JOIN classified c ON c.key = md5(trim(m.sentence))""",
}


@query(
    "enrich_classify",
    sql(
        f"""SELECT rule_id, outcome,
           CASE WHEN outcome = 'classified' THEN c_field ELSE field END AS field,
           CASE WHEN outcome = 'classified' THEN new_op ELSE operator END AS operator,
           CASE WHEN outcome = 'classified' THEN CASE WHEN new_op NOT IN ('BETWEEN', 'IN') THEN c_value END ELSE value END AS value,
           CASE WHEN outcome = 'classified' THEN CASE WHEN new_op = 'BETWEEN' THEN c_min END ELSE value_min END AS value_min,
           CASE WHEN outcome = 'classified' THEN CASE WHEN new_op = 'BETWEEN' THEN c_max END ELSE value_max END AS value_max,
           CASE WHEN outcome = 'classified' AND new_op = 'IN' THEN 'a,b' WHEN outcome = 'classified' AND new_op <> 'BETWEEN' THEN ''
                ELSE array_to_string("values", ',') END AS items,
           CASE WHEN outcome = 'classified' THEN {case_map('c_field', enrich.CONDITION_TYPES)} ELSE condition_type END AS condition_type,
           CASE WHEN outcome IN ('classified', 'kept_other') THEN coalesce(c_condition, condition) ELSE condition END AS condition,
           CASE WHEN outcome = 'classified' THEN round(c_confidence, 3) ELSE confidence END AS confidence
        FROM joined""",
        **ENRICH_CTES,
    ),
)
def enrich_classify(v: Views) -> DataFrame:
    return enrich.classify(v.mined(), _classified(v)).select(
        "rule_id", "outcome", "field", "operator", "value", "value_min", "value_max",
        F.array_join("values", ",").alias("items"), "condition_type", "condition", "confidence",
    )


@query(
    "join_enrichment_cache",
    sql(
        """SELECT c.key, count(*) AS rules, min(c_field) AS c_field FROM mined m JOIN classified c ON c.key = md5(trim(m.sentence)) GROUP BY 1""",
        **ENRICH_CTES,
    ),
)
def join_enrichment_cache(v: Views) -> DataFrame:
    rules = v.mined().select(enrich.cache_key(F.col("sentence")).alias("key"))
    # A popular sentence may be a third of all rules: count per key before the join.
    counted = rules.groupBy("key").agg(F.count("*").alias("rules"))
    return counted.join(enrich.sanitise(_classified(v)), "key").select("key", "rules", "c_field")


_OWN = "list_transform(codes, lambda c: c)"


@query(
    "enrich_flags",
    sql(
        """SELECT m.rule_id, array_to_string(list_concat(m.codes, list_filter(t.codes, lambda c: NOT list_contains(m.codes, c))), ',') AS codes,
           len(list_filter(t.codes, lambda c: NOT list_contains(m.codes, c))) AS added
        FROM mined m JOIN tax t USING (rule_id)"""
    ),
)
def enrich_flags(v: Views) -> DataFrame:
    own = F.transform("flags", lambda f: f["code"])
    merged = enrich.add_codes(own, F.col("detected"))
    return ambiguity.detected(v.mined()).select(
        "rule_id", F.array_join(merged.cast("array<string>"), ",").alias("codes"),
        (F.size(merged) - F.size("flags")).cast("long").alias("added"),
    )


BATCHED = {"batched": "SELECT slug, CAST(floor((row_number() OVER (ORDER BY position) - 1) / 50) + 1 AS BIGINT) AS batch FROM clauses"}


@query(
    "enrich_stats",
    sql(
        """SELECT batch, count(DISTINCT j.slug) AS schemes, count(*) AS rules_total, count(*) FILTER (outcome = 'classified') AS classified,
           count(*) FILTER (outcome = 'low_confidence') AS skipped_low,
           CAST(sum(len(list_filter(t.codes, lambda c: NOT list_contains(j.codes, c)))) AS BIGINT) AS flags_added
        FROM joined j JOIN batched b USING (slug) JOIN tax t USING (rule_id) GROUP BY 1""",
        **ENRICH_CTES,
        **BATCHED,
    ),
)
def enrich_stats(v: Views) -> DataFrame:
    own = F.transform("flags", lambda f: f["code"])
    added = F.size(F.array_except("detected", own))
    per_scheme = (
        enrich.classify(ambiguity.detected(v.mined()), _classified(v))
        .withColumn("added", added)
        .groupBy("slug")
        .agg(
            F.count("*").alias("rules_total"), F.count_if(F.col("outcome") == "classified").alias("classified"),
            F.count_if(F.col("outcome") == "low_confidence").alias("skipped_low"), F.sum("added").alias("flags_added"),
        )
    )
    batches = mining.with_batch(v.clauses().select("slug", "position")).select("slug", "batch")
    return per_scheme.join(batches, "slug").groupBy("batch").agg(
        F.count("*").alias("schemes"),
        *[F.sum(c).alias(c) for c in ("rules_total", "classified", "skipped_low", "flags_added")],
    )
