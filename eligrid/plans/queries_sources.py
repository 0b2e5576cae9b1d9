"""Queries of sources, sinks, rule building and profile preparation.

Source queries write the derived tables in the external format first and read them
back through the source under test; sink queries read back what was written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.operators import ambiguity, decision, mining, profiles, rulebase
from eligrid.plans import derive
from eligrid.plans import oracle_core as oc
from eligrid.plans import queries_mining as qm
from eligrid.plans.oracle_core import case_map, quoted
from eligrid.plans.queries_core import EVALUATED, evaluated
from eligrid.plans.queries_quality import FEED, RELS
from eligrid.plans.registry import query
from eligrid.plans.views import Views
from eligrid.session import broadcast_if_small, checkpoint
from eligrid.sources import feeds
from eligrid.sources import rules as files

# ---- rule-base files --------------------------------------------------------

_RULE_NAMES = {
    "rule_id": "Rule_ID", "rule_type": "Rule_Type", "field": "Field", "operator": "Operator", "value": "Value",
    "value_min": "Value_Min", "value_max": "Value_Max", "values": "Values", "audit_status": "Audit_Status",
    "confidence": "Confidence", "display_text": "Display_Text", "source_quote": "Source_Quote", "source_url": "Source_URL",
}


def _flag_struct(code: str, severity: str) -> F.Column:
    named = F.concat(F.lit("AMB-"), F.lpad(F.col(code).cast("string"), 3, "0"))
    return F.struct(F.col(code).alias("ambiguity_type_code"), F.col(severity).alias("severity"), named.alias("ambiguity_id"))


def _rule_struct(pascal: bool) -> F.Column:
    text = F.col("value_text")
    value = F.try_parse_json(
        F.when(F.col("value_kind") == "num", text).when(F.col("value_kind") == "bool", F.lower(text)).otherwise(
            F.concat(F.lit('"'), text, F.lit('"'))
        )
    )
    element = lambda x: F.try_parse_json(F.when(F.col("values_kind") == "num", x).otherwise(F.concat(F.lit('"'), x, F.lit('"'))))
    listed = F.when(F.length("values_text") > 0, F.transform(F.split("values_text", r"\|"), element)).otherwise(F.array().cast("array<variant>"))
    columns = {name: F.col(name) for name in _RULE_NAMES if name not in ("value", "values")}
    columns |= {"value": value, "values": listed}
    flag = _flag_struct("flag_code", "flag_severity")
    flags = F.filter(F.array(flag, F.when(F.col("flag2_severity").isNotNull(), _flag_struct("flag2_code", "flag2_severity"))), lambda f: f.isNotNull())
    if pascal:
        # Batch files mix structured flags with bare ids; only the former count.
        made = [c.alias(_RULE_NAMES[n]) for n, c in columns.items()]
        flags = F.concat(F.transform(flags, lambda f: F.parse_json(F.to_json(f))), F.array(F.parse_json(F.lit('"AMB-001"'))))
        return F.struct(*made, F.col("field").alias("Condition"), flags.alias("Ambiguity_Flags"), F.lit(3).alias("Data_Source_Tier"))
    anchor = F.struct(columns.pop("source_quote").alias("source_quote"), columns.pop("source_url").alias("source_url"))
    made = [c.alias(n) for n, c in columns.items()]
    return F.struct(*made, anchor.alias("source_anchor"), flags.alias("ambiguity_flags"), F.col("field").alias("condition_type"),
                    *["state_scope", "supersedes_rule_id", "logic_group", "logic_operator", "prerequisite_scheme_id"])


def _rule_files(v: Views, layouts: tuple[int, ...] = (0, 1, 2)) -> str:
    """Write the rule base as JSON files: batch list (0), nested (1) and flat schemes (2) by turns."""
    path = files.scratch(v.spark, "rulebase")
    base = v.rules_raw().join(v.schemes().select("scheme_id", "scheme_name", "status", "position"), "scheme_id")
    turn = F.array(*[F.lit(x) for x in layouts])[F.col("position") % len(layouts)]

    def per_scheme(rows: DataFrame, pascal: bool) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct("ord", F.to_json(_rule_struct(pascal)).alias("json"))))
        rules = F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["json"]), ","), F.lit("]"))
        head = F.to_json(F.struct("scheme_id", "scheme_name", "status"))
        return rows.groupBy("scheme_id", "scheme_name", "status", "position").agg(rules.alias("rules")).withColumn("head", head)

    flat = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"rules":'), F.col("rules"), F.lit("}"))
    nested = F.concat(F.lit('{"scheme":'), F.col("head"), F.lit(',"rules":'), F.col("rules"), F.lit("}"))
    batch = per_scheme(base.where(turn == 0), True).groupBy(F.floor(F.col("position") / 50)).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(flat), ","), F.lit("]")).alias("value")
    ).select("value")
    one = per_scheme(base.where(turn == 1), False).select(nested.alias("value"))
    two = per_scheme(base.where(turn == 2), False).select(flat.alias("value"))
    for i, part in enumerate((batch, one, two)):
        part.write.option("maxRecordsPerFile", 1).text(f"{path}/layout{i}")
    return path


_CODES = "CAST(flag_code AS STRING) || CASE WHEN flag2_severity IS NULL THEN '' ELSE ',' || flag2_code END"
_FILE_COLS = f"""r.scheme_id, scheme_name, r.rule_id, r.rule_type, r.operator, r.value_kind, r.value_text, r.value_min, r.value_max, r.values_text,
   r.audit_status, r.confidence, r.source_quote, r.source_url, r.display_text, r.field AS condition_type, {_CODES} AS flag_codes"""


@query(
    "src_rule_base",
    oc.sql(f"SELECT {_FILE_COLS}, CAST(r.ord AS BIGINT) AS ord FROM rules_raw r JOIN schemes s USING (scheme_id)"),
)
def src_rule_base(v: Views) -> DataFrame:
    return files.read_rule_base(v.spark, _rule_files(v)).select(
        "scheme_id", "scheme_name", "rule_id", "rule_type", "operator", "value_kind", "value_text", "value_min", "value_max",
        "values_text", "audit_status", "confidence", "source_quote", "source_url", "display_text", "condition_type",
        F.array_join(F.col("flag_codes").cast("array<string>"), ",").alias("flag_codes"), F.col("ord").cast("long").alias("ord"),
    )


@query(
    "norm_batch_rule",
    oc.sql(
        f"""SELECT rule_id, r.field AS condition_type, source_quote, source_url, '2024-01-01' AS notification_date, {_CODES} AS flag_codes
        FROM rules_raw r JOIN schemes s USING (scheme_id)"""
    ),
)
def norm_batch_rule(v: Views) -> DataFrame:
    """All schemes in the batch layout: Pascal-case keys, mixed flags, flat source fields."""
    path = _rule_files(v, (0,))
    return files.read_rule_base(v.spark, path).select(
        "rule_id", "condition_type", "source_quote", "source_url", "notification_date",
        F.array_join(F.col("flag_codes").cast("array<string>"), ",").alias("flag_codes"),
    )


@query("evaluate_files", EVALUATED)
def evaluate_files(v: Views) -> DataFrame:
    """All determinations from rule files alone: rules, typed values, flags and schemes as read."""
    rules = checkpoint(files.read_rule_base(v.spark, _rule_files(v, (1, 2))))
    schemes, made = files.schemes_of(rules), rulebase.load_ready(rules.where("rule_id IS NOT NULL"))
    bound = rulebase.bind(rulebase.active_rules(made, schemes, v.queue()), files.flags_of(rules))
    nested = checkpoint(rulebase.nest(schemes, bound, rulebase.exclusions(made, v.queue())))
    return evaluated(decision.determinations(v.profile_cells(), nested))


def _json_list(v: Views, rows: DataFrame, name: str, key: str | None = None) -> str:
    path = files.scratch(v.spark, name)
    files.write_lists(rows, path, key)
    return path


@query(
    "src_relationships",
    oc.sql("SELECT relationship_id, scheme_a, scheme_b, relationship_type, confidence, confidence >= 0.6 AS display_to_user FROM rels", **RELS),
)
def src_relationships(v: Views) -> DataFrame:
    rows = v.relationships().select("relationship_id", "scheme_a", "scheme_b", "relationship_type", "confidence", F.lit(True).alias("display_to_user"))
    bad = rows.limit(1).select("relationship_id", F.lit(None).cast("string").alias("scheme_a"), "scheme_b", "relationship_type", F.lit(2.0).alias("confidence"), "display_to_user")
    return files.read_relationships(v.spark, _json_list(v, rows.unionByName(bad), "relationships", "relationships"))


@query(
    "src_ambiguity_map",
    oc.sql("SELECT ambiguity_id, scheme_id, rule_id, severity, type_code FROM flags"),
)
def src_ambiguity_map(v: Views) -> DataFrame:
    rows = v.flags().select("ambiguity_id", "scheme_id", "rule_id", "severity", F.col("type_code").alias("ambiguity_type_code"))
    return files.read_flags(v.spark, _json_list(v, rows, "flags"))


@query("src_review_queue", oc.sql("SELECT rule_id FROM queue"))
def src_review_queue(v: Views) -> DataFrame:
    return files.read_queue(v.spark, _json_list(v, v.queue(), "queue"))


@query(
    "src_verdicts",
    oc.sql(
        """SELECT 'read' AS verdict, '' AS reason, count(*) AS entries FROM rels
        UNION ALL SELECT 'rejected', 'not valid JSON', 0 UNION ALL SELECT 'rejected', 'no list and no list under relationships', 0""",
        **RELS,
    ),
)
def src_verdicts(v: Views) -> DataFrame:
    """Reject table over the relationship files, a torn one and one of another layout among them."""
    path = _json_list(v, v.relationships(), "relationships", "relationships")
    whole = v.spark.read.text(path, wholetext=True).limit(1)
    torn = whole.select(F.expr("substring(value, 1, length(value) - 3)").alias("value"))
    other = whole.select(F.replace("value", F.lit('"relationships"'), F.lit('"edges"')).alias("value"))
    torn.unionByName(other).write.mode("append").option("maxRecordsPerFile", 1).text(path)
    found = files.verdicts(v.spark, path, "relationships")
    return found.groupBy("verdict", "reason").agg(F.sum("entries").alias("entries"))


# ---- raw schemes, HTML, feeds, profiles -------------------------------------


@query("src_raw_schemes_csv", qm.sql("SELECT scheme_name, slug, replace(eligibility, '! ', '!' || chr(10)) AS eligibility, level FROM clauses"))
def src_raw_schemes_csv(v: Views) -> DataFrame:
    path = files.scratch(v.spark, "csv")
    rows = v.clauses().select(
        F.col("scheme_name").alias("﻿scheme_name"), "slug",
        F.replace("eligibility", F.lit("! "), F.lit("!\n")).alias("eligibility"), "level",
    )
    rows.write.option("header", "true").option("quoteAll", "true").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", "false"
    ).option("ignoreTrailingWhiteSpace", "false").csv(path)
    read = feeds.read_raw_schemes(v.spark, path)
    return read.select("scheme_name", "slug", F.coalesce("eligibility", F.lit("")).alias("eligibility"), F.coalesce("level", F.lit("")).alias("level"))


@query(
    "src_kaggle_row",
    qm.sql(
        r"""SELECT slug, CASE WHEN trim(eligibility) = '' THEN 'blank eligibility' END AS error, 'kaggle_csv' AS input_type,
           regexp_replace(substring(regexp_replace(upper(scheme_name), '[^A-Z0-9]', '_', 'g'), 1, 32), '^_+|_+$', '', 'g') AS scheme_id FROM clauses"""
    ),
)
def src_kaggle_row(v: Views) -> DataFrame:
    return feeds.parse_inputs(v.clauses()).select("slug", "error", "input_type", "scheme_id")


@query(
    "src_html_eligibility",
    r"""SELECT page_id, text, CASE WHEN text = '' THEN 'empty section' END AS error FROM (
      SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages)""",
)
def src_html_eligibility(v: Views) -> DataFrame:
    return feeds.html_inputs(v.table("pages"), "article", None).select("page_id", "text", "error")


@query(
    "src_feed_entries",
    oc.sql("SELECT gazette_ref, title, summary, notification_date FROM feed", **FEED),
)
def src_feed_entries(v: Views) -> DataFrame:
    """Half of the entries travel as Atom, half as RSS."""
    path = files.scratch(v.spark, "feed")
    raw = v.spark.sql(derive.FEED_SQL, orders=v.table("orders"))

    def tag(name: str, value) -> F.Column:
        body = F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
        return F.coalesce(body, F.lit(""))

    atom = F.concat(
        F.lit("<entry>"), tag("id", F.col("gazette_ref")), tag("title", F.col("title")), tag("summary", F.col("summary_raw")),
        tag("updated", F.concat("notification_date", F.lit("T00:00:00Z"))), F.lit("</entry>"),
    )
    mail = F.date_format(F.to_date("notification_date"), "d MMM yyyy")
    rss = F.concat(
        F.lit("<item>"), tag("guid", F.col("gazette_ref")), tag("title", F.col("title")), tag("description", F.col("summary_raw")),
        tag("pubDate", F.concat(F.lit("Mon, "), mail, F.lit(" 10:00:00 +0530"))), F.lit("</item>"),
    )
    number = F.substring("gazette_ref", 3, 20).cast("long")
    is_atom = F.length("gazette_ref") % 2 == 0
    # A document holds at most a thousand entries.
    docs = raw.groupBy(F.floor(number / 1000).alias("doc"), is_atom.alias("atom")).agg(
        F.array_join(F.collect_list(F.when(is_atom, atom).otherwise(rss)), "").alias("body")
    )
    whole = F.when(F.col("atom"), F.concat(F.lit("<feed>"), "body", F.lit("</feed>"))).otherwise(
        F.concat(F.lit("<rss><channel>"), "body", F.lit("</channel></rss>"))
    )
    docs.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return feeds.read_feeds(v.spark, path)


_LONG = """SELECT profile_id, field, uk AS kind, CASE WHEN uk = 'num' THEN uf END AS number,
   CASE WHEN uk = 'list' THEN array_to_string(ua, ',') WHEN uk = 'bool' THEN lower(us) WHEN uk = 'str' THEN us END AS text
   FROM profile_fields WHERE uk <> 'null' AND mapped"""
_RAW_LONG = oc.sql(_LONG).replace("FROM profiles UNION ALL", "FROM raw_profiles UNION ALL").replace(
    "AS ua FROM profiles)", "AS ua FROM raw_profiles)"
)


@query("src_profiles_flat", _RAW_LONG)
def src_profiles_flat(v: Views) -> DataFrame:
    named = [F.col(model.column_of(p)).alias(p) for p, _ in model.PROFILE_FIELDS]
    path = files.scratch(v.spark, "flat")
    v.profiles_raw().select("profile_id", F.to_json(F.struct(*named)).alias("value")).write.parquet(path)
    return feeds.described(feeds.flat_profiles(v.spark.read.parquet(path)))


@query("src_profiles_nested", _RAW_LONG)
def src_profiles_nested(v: Views) -> DataFrame:
    heads: dict[str, list] = {}
    for p, _ in model.PROFILE_FIELDS:
        head, tail = p.split(".")
        heads.setdefault(head, []).append(F.col(model.column_of(p)).alias(tail))
    path = files.scratch(v.spark, "nested")
    nested = F.struct(*[F.struct(*cols).alias(h) for h, cols in heads.items()])
    v.profiles_raw().select("profile_id", F.to_json(nested).alias("value")).write.parquet(path)
    return feeds.described(feeds.nested_profiles(v.spark.read.parquet(path)))


# ---- sinks ------------------------------------------------------------------


@query("sink_batches_json", qm.sql("SELECT slug, batch, scheme_name, level FROM batched JOIN clauses USING (slug)", **qm.BATCHED))
def sink_batches_json(v: Views) -> DataFrame:
    path = files.scratch(v.spark, "batches")
    files.write_batches(mining.with_batch(v.clauses()).select("slug", "scheme_name", "level", "batch"), path)
    schema = "slug string, scheme_name string, level string, batch bigint"
    return v.spark.read.schema(schema).json(path).select("slug", "batch", "scheme_name", "level")


@query(
    "sink_batch_index",
    qm.sql("SELECT batch, count(*) AS schemes_count, string_agg(slug, ',' ORDER BY position) AS scheme_ids FROM batched JOIN clauses USING (slug) GROUP BY 1", **qm.BATCHED),
)
def sink_batch_index(v: Views) -> DataFrame:
    placed = mining.with_batch(v.clauses().select(F.col("slug").alias("scheme_id"), "position"))
    return files.batch_index(placed).withColumn("scheme_ids", F.array_join("scheme_ids", ","))


_FLAG_NAMES = case_map("CAST(code AS STRING)", model.AMBIGUITY_TAXONOMY)
_FLAG_ID = "'AMB-' || upper(sha256(rule_id || '|' || CAST(code AS STRING)))"


@query(
    "sink_ambiguity_export",
    qm.sql(
        f"""SELECT 'markdown' AS fmt, '| ' || {_FLAG_ID} || ' | ' || scheme_id || ' | ' || {_FLAG_NAMES} || ' | ' || {qm.PLAIN_SEVERITY} || ' | OPEN |' AS line FROM tax_rows
        UNION ALL SELECT 'csv', {_FLAG_ID} || ':' || rule_id FROM tax_rows UNION ALL SELECT 'json', {_FLAG_ID} || ':' || rule_id FROM tax_rows"""
    ),
)
def sink_ambiguity_export(v: Views) -> DataFrame:
    rows = ambiguity.flags(v.mined())
    base = files.scratch(v.spark, "ambiguity")
    slim = rows.select("ambiguity_id", "scheme_id", "rule_id", "code", "type_name", "severity", "resolution_status")
    files.export(slim, f"{base}-json", "json")
    files.export(slim, f"{base}-csv", "csv")
    files.export(ambiguity.export_markdown(rows), f"{base}-md", "markdown")
    pair = F.concat_ws(":", "ambiguity_id", "rule_id")
    md = v.spark.read.text(f"{base}-md").select(F.lit("markdown").alias("fmt"), F.col("value").alias("line"))
    csv = v.spark.read.csv(f"{base}-csv", header=True).select(F.lit("csv").alias("fmt"), pair.alias("line"))
    js = v.spark.read.schema(slim.schema).json(f"{base}-json").select(F.lit("json").alias("fmt"), pair.alias("line"))
    return md.unionByName(csv).unionByName(js)


@query("sink_relationship_export", oc.sql("SELECT relationship_id, scheme_a, scheme_b, confidence FROM rels UNION ALL SELECT relationship_id, scheme_a, scheme_b, confidence FROM rels", **RELS))
def sink_relationship_export(v: Views) -> DataFrame:
    rows = v.relationships().select("relationship_id", "scheme_a", "scheme_b", "confidence")
    base = files.scratch(v.spark, "relationships")
    files.export(rows, f"{base}-json", "json")
    files.export(rows, f"{base}-csv", "csv")
    return v.spark.read.schema(rows.schema).json(f"{base}-json").unionByName(v.spark.read.schema(rows.schema).csv(f"{base}-csv", header=True))


_LISTED = "replace(CASE WHEN values_text <> '' THEN values_text ELSE coalesce(value_text, 'None') END, '|', ', ')"
_CONDITION = f"""CASE WHEN operator = 'BETWEEN' THEN field || ' BETWEEN ' || coalesce(CAST(value_min AS STRING), 'None') || ' AND ' || coalesce(CAST(value_max AS STRING), 'None')
   WHEN operator IN ('IN', 'NOT_IN', 'NOT_MEMBER') THEN field || ' ' || operator || ' (' || {_LISTED} || ')'
   WHEN operator IN ('IS_NULL', 'IS_NOT_NULL') THEN field || ' ' || operator ELSE field || ' ' || operator || ' ' || coalesce(value_text, 'None') END"""
_COND_TYPE = case_map("split_part(field, '.', 2)", model.CONDITION_TYPE_BY_SEGMENT, "split_part(field, '.', 2)")


@query(
    "sink_decision_table",
    oc.sql(
        f"""SELECT '| ' || concat_ws(' | ', rule_id, scheme_id, rule_type, {_COND_TYPE}, field, operator, {_CONDITION}, source_quote, source_url,
             CAST(CAST(confidence * 100 AS INT) AS STRING), audit_status, display_text, '1.0.0') || ' |' AS line
        FROM rules WHERE coalesce(display_text, '') <> ''"""
    ),
)
def sink_decision_table(v: Views) -> DataFrame:
    rows = rulebase.decision_table(v.rules()).where("error IS NULL").drop("error").withColumn(
        "Confidence", F.round(F.col("Confidence") * 100).cast("int").cast("string")
    )
    path = files.scratch(v.spark, "table")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *rows.columns), F.lit(" |"))
    files.export(rows.select(line.alias("value")), path, "markdown")
    return v.spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "sink_result_json",
    oc.sql("SELECT profile_id, count(*) AS schemes, string_agg(scheme_id || '=' || status, ',' ORDER BY position) AS statuses FROM dets GROUP BY 1"),
)
def sink_result_json(v: Views) -> DataFrame:
    """One JSON document per profile, written and read back."""
    item = F.struct("position", "scheme_id", "status", F.round("composite", 6).alias("composite"), "rules_passed", "rules_failed")
    docs = v.determinations().groupBy("profile_id").agg(F.array_sort(F.collect_list(item)).alias("schemes"))
    path = files.scratch(v.spark, "results")
    docs.write.json(path)
    back = v.spark.read.schema(docs.schema).json(path)
    return back.select(
        "profile_id", F.size("schemes").cast("long").alias("schemes"),
        F.array_join(F.transform("schemes", lambda s: F.concat_ws("=", s["scheme_id"], s["status"])), ",").alias("statuses"),
    )


# ---- rule filters and building ----------------------------------------------

_ALIAS = case_map("upper(operator)", model.OPERATOR_ALIASES, "operator")


@query("norm_operator_alias", oc.sql(f"SELECT rule_id, {_ALIAS} AS operator FROM rules_raw WHERE upper(operator) <> 'NOT_BETWEEN'"))
def norm_operator_alias(v: Views) -> DataFrame:
    return rulebase.alias_operators(v.rules_raw()).select("rule_id", "operator")


@query("drop_bad_between", oc.sql("SELECT rule_id, operator FROM rules_raw WHERE NOT (operator = 'BETWEEN' AND (value_min IS NULL OR value_max IS NULL))"))
def drop_bad_between(v: Views) -> DataFrame:
    return rulebase.drop_bad_between(v.rules_raw()).select("rule_id", "operator")


@query("filter_active_schemes", oc.sql("SELECT scheme_id, scheme_name FROM schemes WHERE status = 'active'"))
def filter_active_schemes(v: Views) -> DataFrame:
    return v.schemes().where("status = 'active'").select("scheme_id", "scheme_name")


@query("filter_disputed", oc.sql("SELECT scheme_id, count(*) FILTER (audit_status <> 'DISPUTED') AS kept, count(*) FILTER (audit_status = 'DISPUTED') AS excluded FROM rules GROUP BY 1"))
def filter_disputed(v: Views) -> DataFrame:
    disputed = F.col("audit_status") == "DISPUTED"
    return v.rules().groupBy("scheme_id").agg(F.count_if(~disputed).alias("kept"), F.count_if(disputed).alias("excluded"))


@query("filter_review_queue", oc.sql("SELECT x.scheme_id, excluded_count FROM excluded x"))
def filter_review_queue(v: Views) -> DataFrame:
    return rulebase.exclusions(v.rules(), v.queue()).withColumn("excluded_count", F.col("excluded_count").cast("long"))


@query("state_override", oc.sql("SELECT state, scheme_id, rule_id, state_scope FROM effective"))
def state_override(v: Views) -> DataFrame:
    return rulebase.effective_rules(v.bound_rules()).select("state", "scheme_id", "rule_id", "state_scope")


@query(
    "check_supersession",
    oc.sql(
        """SELECT rule_id, supersedes_rule_id FROM active s WHERE state_scope <> 'central' AND supersedes_rule_id IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM active c WHERE c.state_scope = 'central' AND c.rule_id = s.supersedes_rule_id)"""
    ),
)
def check_supersession(v: Views) -> DataFrame:
    return rulebase.broken_supersession(v.bound_rules()).select("rule_id", "supersedes_rule_id")


@query(
    "validate_rule_schema",
    oc.sql(
        f"""SELECT rule_id, array_to_string(list_filter([CASE WHEN operator = 'BETWEEN' AND (value_min IS NULL OR value_max IS NULL) THEN 'between without bounds' END,
             CASE WHEN operator NOT IN ({quoted(model.OPERATORS)}) THEN 'unknown operator' END,
             CASE WHEN coalesce(display_text, '') = '' THEN 'missing display_text' END], lambda x: x IS NOT NULL), ';') AS errors FROM rules_raw"""
    ),
)
def validate_rule_schema(v: Views) -> DataFrame:
    return v.rules_raw().select("rule_id", F.array_join(rulebase.validation_errors(), ";").alias("errors"))


_LABEL = case_map("field", model.FIELD_NAMESPACE)
_NS = quoted(model.FIELD_NAMESPACE)


@query(
    "build_rule",
    oc.sql(
        f"""SELECT rule_id, {_COND_TYPE} AS condition_type, {_LABEL} AS label, CASE WHEN operator NOT IN ({quoted(model.OPERATORS)}) THEN 'invalid operator'
             WHEN field NOT IN ({_NS}) THEN 'unknown field' END AS error FROM rules_raw"""
    ),
)
def build_rule(v: Views) -> DataFrame:
    return rulebase.build(v.rules_raw()).select("rule_id", "condition_type", "label", "error")


_L = f"coalesce({_LABEL}, field)"
_V = "coalesce(value_text, 'None')"
_LO, _HI = "coalesce(CAST(value_min AS STRING), '?')", "coalesce(CAST(value_max AS STRING), '?')"


@query(
    "rule_display_text",
    oc.sql(
        f"""SELECT rule_id, CASE operator
          WHEN 'BETWEEN' THEN CASE WHEN contains(field, 'age') THEN 'Applicant age must be between ' || {_LO} || ' and ' || {_HI} || ' years' ELSE {_L} || ' must be between ' || {_LO} || ' and ' || {_HI} END
          WHEN 'EQ' THEN {_L} || ' must equal ' || {_V} WHEN 'NEQ' THEN {_L} || ' must not equal ' || {_V}
          WHEN 'LT' THEN {_L} || ' < ' || {_V} WHEN 'LTE' THEN {_L} || ' ≤ ' || {_V} WHEN 'GT' THEN {_L} || ' > ' || {_V} WHEN 'GTE' THEN {_L} || ' ≥ ' || {_V}
          WHEN 'IN' THEN {_L} || ' must be one of: ' || {_LISTED} WHEN 'NOT_MEMBER' THEN {_L} || ' must not be a member of: ' || {_LISTED}
          WHEN 'NOT_IN' THEN {_L} || ' must not be: ' || {_LISTED} WHEN 'IS_NULL' THEN {_L} || ' must be absent' WHEN 'IS_NOT_NULL' THEN {_L} || ' must be present'
          WHEN 'CONTAINS' THEN {_L} || ' must contain ''' || {_V} || '''' WHEN 'MATCHES' THEN {_L} || ' must match pattern ''' || {_V} || '''' END AS display_text FROM rules"""
    ),
)
def rule_display_text(v: Views) -> DataFrame:
    return v.rules().select("rule_id", rulebase.display_text().alias("display_text"))


@query("rule_condition_text", oc.sql(f"SELECT rule_id, {_CONDITION} AS condition FROM rules"))
def rule_condition_text(v: Views) -> DataFrame:
    return v.rules().select("rule_id", rulebase.condition_text().alias("condition"))


@query(
    "build_rule_groups",
    oc.sql(
        """SELECT scheme_id, logic_group, logic, rule_ids, 'Applicant must satisfy ' || CASE logic WHEN 'AND' THEN 'ALL' WHEN 'OR' THEN 'ANY' END || ' of the following rules' AS display_text,
           CASE WHEN logic NOT IN ('AND', 'OR') THEN 'invalid logic ' || logic END AS error
        FROM (SELECT scheme_id, logic_group, arg_max(coalesce(logic_operator, 'AND'), ord) AS logic, string_agg(rule_id, ',' ORDER BY ord) AS rule_ids
              FROM rules WHERE logic_group IS NOT NULL GROUP BY 1, 2)"""
    ),
)
def build_rule_groups(v: Views) -> DataFrame:
    return rulebase.groups(v.rules()).withColumn("rule_ids", F.array_join("rule_ids", ","))


@query("lookup_scheme", oc.sql("SELECT s.scheme_id, s.scheme_name, r.rule_id, r.field, r.operator FROM schemes s JOIN rules r USING (scheme_id) WHERE scheme_id = 'Brand#7'"))
def lookup_scheme(v: Views) -> DataFrame:
    return v.schemes().where("scheme_id = 'Brand#7'").join(v.rules(), "scheme_id").select("scheme_id", "scheme_name", "rule_id", "field", "operator")


@query(
    "list_schemes",
    qm.sql("SELECT slug, rules, reason IS NOT NULL AS flagged FROM review", **qm.REVIEW_CTES),
)
def list_schemes(v: Views) -> DataFrame:
    return mining.review(v.mined()).select("slug", "rules", "flagged")


@query(
    "semi_anti_gates",
    oc.sql(
        f"""SELECT 'unknown_field' AS gate, field AS item FROM rules WHERE field NOT IN ({_NS}) GROUP BY 2
        UNION ALL SELECT 'missing_prerequisite', prerequisite_scheme_id FROM rules WHERE prerequisite_scheme_id NOT IN (SELECT scheme_id FROM schemes WHERE status = 'active') GROUP BY 2
        UNION ALL SELECT 'unseen_code', CAST(code AS STRING) FROM (SELECT unnest(range(1, 31)) AS code) WHERE code NOT IN (SELECT type_code FROM flags)"""
    ),
)
def semi_anti_gates(v: Views) -> DataFrame:
    rules = v.rules()
    spark = v.spark
    namespace = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in model.FIELD_NAMESPACE])).alias("field"))
    fields = rules.select("field").distinct().join(namespace, "field", "left_anti").select(F.lit("unknown_field").alias("gate"), F.col("field").alias("item"))
    known = v.schemes().where("status = 'active'").select(F.col("scheme_id").alias("prerequisite_scheme_id"))
    pre = rules.where("prerequisite_scheme_id IS NOT NULL").select("prerequisite_scheme_id").distinct().join(known, "prerequisite_scheme_id", "left_anti")
    codes = spark.range(1, 31).select(F.col("id").cast("int").alias("type_code")).join(v.flags().select("type_code"), "type_code", "left_anti")
    return fields.unionByName(pre.select(F.lit("missing_prerequisite").alias("gate"), F.col("prerequisite_scheme_id").alias("item"))).unionByName(
        codes.select(F.lit("unseen_code").alias("gate"), F.col("type_code").cast("string").alias("item"))
    )


@query("join_rule_flag", oc.sql("SELECT f.rule_id, f.ambiguity_id, f.severity AS own, g.severity AS resolved FROM flags f JOIN flag_sev g USING (ambiguity_id)"))
def join_rule_flag(v: Views) -> DataFrame:
    resolved = rulebase.flag_severity(v.flags()).withColumnRenamed("severity", "resolved")
    return v.flags().join(broadcast_if_small(resolved), "ambiguity_id", "left").select("rule_id", "ambiguity_id", F.col("severity").alias("own"), "resolved")


# ---- profiles ---------------------------------------------------------------

# Raw spellings as forms and chats deliver them, over the customers.
_MESSY = """SELECT c_custkey AS profile_id, c_custkey % 130 - 4 AS applicant_age,
   CASE c_custkey % 6 WHEN 0 THEN 'FEMALE' WHEN 1 THEN 'Male' WHEN 2 THEN 'unknown' WHEN 3 THEN 'other' ELSE NULL END AS applicant_gender,
   CASE c_custkey % 5 WHEN 0 THEN 'up' WHEN 1 THEN 'Mh' WHEN 2 THEN 'xx' WHEN 3 THEN 'TN' ELSE NULL END AS location_state,
   CASE c_custkey % 8 WHEN 0 THEN ' dalit ' WHEN 1 THEN 'Scheduled Tribe' WHEN 2 THEN 'bc' WHEN 3 THEN 'Minority' WHEN 4 THEN 'open' WHEN 5 THEN 'EWS' ELSE NULL END
     AS applicant_caste_category FROM {customer}"""
_MESSY_SQL = _MESSY.format(customer="customer")


def _messy(v: Views) -> DataFrame:
    return profiles.normalise(v.spark.sql(_MESSY, customer=v.table("customer")))


_CASTE = oc._caste
_NORMAL = f"SELECT profile_id, applicant_age, lower(applicant_gender) AS applicant_gender, upper(location_state) AS location_state, {_CASTE} AS applicant_caste_category FROM ({_MESSY_SQL})"


@query("norm_profile_values", _NORMAL)
def norm_profile_values(v: Views) -> DataFrame:
    return _messy(v).select("profile_id", "applicant_age", "applicant_gender", "location_state", "applicant_caste_category")


@query(
    "validate_profiles",
    f"""SELECT profile_id, array_to_string(list_filter([CASE WHEN applicant_age NOT BETWEEN 0 AND 120 THEN 'age out of range' END,
         CASE WHEN applicant_gender NOT IN ({quoted(model.GENDERS)}) THEN 'unknown gender' END,
         CASE WHEN location_state NOT IN ({quoted(model.STATE_CODES)}) THEN 'unknown state' END], lambda x: x IS NOT NULL), ';') AS errors,
       coalesce(applicant_caste_category NOT IN ({quoted(model.CASTE_CATEGORIES)}), false) AS caste_warning FROM ({_NORMAL})""",
)
def validate_profiles(v: Views) -> DataFrame:
    return profiles.validate(_messy(v)).select("profile_id", F.array_join("errors", ";").alias("errors"), "caste_warning")


@query("derive_annual_income", oc.sql("SELECT profile_id, household_income_annual AS annual, income_derived FROM profiles"))
def derive_annual_income(v: Views) -> DataFrame:
    return v.profiles().select("profile_id", F.col("household_income_annual").alias("annual"), "income_derived")


@query(
    "profile_warnings",
    oc.sql(
        """SELECT profile_id, array_to_string(list_filter([CASE WHEN income_derived THEN 'income_auto_computed' END,
           CASE WHEN NOT income_derived AND household_income_annual > 0 AND abs(household_income_monthly * 12 - household_income_annual) / household_income_annual > 0.2 THEN 'income_inconsistent' END,
           CASE WHEN applicant_disability_status AND applicant_disability_percentage IS NULL THEN 'disability_percentage_missing' END,
           CASE WHEN NOT documents_bank_account AND documents_bank_account_type IS NOT NULL THEN 'bank_type_without_account' END,
           CASE WHEN employment_is_income_tax_payer AND household_income_annual < 250000 THEN 'taxpayer_below_threshold' END,
           CASE WHEN applicant_age < 18 THEN 'minor' END], lambda x: x IS NOT NULL), ';') AS warnings FROM profiles"""
    ),
)
def profile_warnings(v: Views) -> DataFrame:
    return v.profiles().select("profile_id", F.array_join(profiles.warnings(), ";").alias("warnings"))


@query("profile_long", oc.sql("SELECT profile_id, field, uk AS kind, CASE WHEN uk <> 'num' THEN us END AS text, uf AS number, mapped FROM profile_fields"))
def profile_long(v: Views) -> DataFrame:
    return profiles.long_fields(v.profile_cells()).select(
        "profile_id", "field", F.col("cell.kind").alias("kind"), F.when(F.col("cell.kind") != "num", F.col("cell.s")).alias("text"),
        F.col("cell.f").alias("number"), "mapped",
    )


@query("populated_fields", oc.sql("SELECT profile_id, field FROM profile_fields WHERE mapped AND uk <> 'null' AND NOT (uk = 'list' AND len(ua) = 0)"))
def populated_fields(v: Views) -> DataFrame:
    return profiles.populated_fields(v.profile_cells())


_NEED = ["applicant.age", "applicant.gender", "household.income_annual", "household.income_monthly", "schemes.active_enrollments", "health.child_count", "applicant.education_level"]


@query(
    "profile_completeness",
    oc.sql(
        f"""SELECT profile_id, CAST({len(_NEED)} AS BIGINT) AS total_relevant_fields, n AS populated_fields, missing AS missing_fields, round(n / {len(_NEED)}, 6) AS completeness_score,
           CASE WHEN n = {len(_NEED)} THEN 'complete' WHEN n / {len(_NEED)} >= 0.6 THEN 'partial' ELSE 'insufficient' END AS impact FROM (
          SELECT profile_id, count(*) FILTER (ok) AS n, coalesce(string_agg(field, ',' ORDER BY field) FILTER (NOT ok), '') AS missing FROM (
            SELECT profile_id, field, mapped AND uk <> 'null' AND NOT (uk = 'list' AND len(ua) = 0) AS ok FROM profile_fields WHERE field IN ({quoted(_NEED)})) GROUP BY 1)"""
    ),
)
def profile_completeness(v: Views) -> DataFrame:
    made = profiles.completeness(v.profile_cells(), _NEED)
    return made.select(
        "profile_id", F.col("total_relevant_fields").cast("long").alias("total_relevant_fields"),
        F.col("populated_fields").cast("long").alias("populated_fields"), F.array_join("missing_fields", ",").alias("missing_fields"),
        F.round("completeness_score", 6).alias("completeness_score"), "impact",
    )


_KIND = {model.column_of(p): k for p, k in model.PROFILE_FIELDS} | dict.fromkeys(derive.EXTRA_EXPRESSIONS, "str")
_HASHED = sorted(_KIND)


def _hash_sql(name: str) -> str:
    column, sized = f'"{name}"', lambda x: f"length({x}) || ':' || {x}"
    if _KIND[name] == "list":
        text = f"'l' || len({column}) || ':' || array_to_string(list_transform({column}, lambda x: {sized('x')}), '')"
    elif _KIND[name] == "float":
        text = "'s' || " + sized(f"CAST(CAST({column} AS DECIMAL(38,6)) AS STRING)")
    else:
        text = "'s' || " + sized(f"CAST({column} AS STRING)")
    return f"'{name}=' || CASE WHEN {column} IS NULL THEN 'n' ELSE {text} END"


@query("profile_id_hash", oc.sql(f"SELECT profile_id, sha256({' || '.join(map(_hash_sql, _HASHED))}) AS digest FROM profiles"))
def profile_id_hash(v: Views) -> DataFrame:
    return v.profiles().select("profile_id", profiles.profile_hash(v.profiles(), _HASHED).alias("digest"))
