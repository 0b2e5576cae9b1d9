"""Queries of quality gates, statistics, relationships, audits and sequencing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.operators import audit, mining, quality, relationships, sequence
from eligrid.plans import derive
from eligrid.plans import oracle_core as oc
from eligrid.plans import queries_mining as qm
from eligrid.plans.oracle_core import case_map, quoted
from eligrid.plans.queries_core import six
from eligrid.plans.registry import query
from eligrid.plans.views import Views
from eligrid.session import broadcast_if_small

# ---- gates ------------------------------------------------------------------

_GATE_INPUT = """SELECT CASE WHEN flag2_code % 7 = 0 THEN '' ELSE rule_id END AS rule_id, operator FROM {rules_raw}
  UNION ALL SELECT rule_id, operator FROM {rules_raw} WHERE flag_code % 5 = 0"""


@query(
    "gate_schema",
    oc.sql(
        f"""SELECT rule_id, reason, failures FROM (
          SELECT rule_id, 'empty_id' AS reason, count(*) AS failures FROM gate_input WHERE rule_id = '' GROUP BY 1
          UNION ALL SELECT rule_id, 'duplicate_id', count(*) - 1 FROM gate_input GROUP BY 1 HAVING count(*) > 1
          UNION ALL SELECT rule_id, 'invalid_operator', count(*) FROM gate_input WHERE operator NOT IN ({quoted(model.OPERATORS)}) GROUP BY 1)""",
        gate_input=_GATE_INPUT.format(rules_raw="rules_raw"),
    ),
)
def gate_schema(v: Views) -> DataFrame:
    return quality.schema_failures(v.spark.sql(_GATE_INPUT, rules_raw=v.rules_raw()))


@query("gate_grounding", oc.sql("SELECT scheme_id, rule_id FROM rules_raw WHERE coalesce(source_quote, '') = ''"))
def gate_grounding(v: Views) -> DataFrame:
    return quality.ungrounded(v.rules_raw()).select("scheme_id", "rule_id")


@query(
    "gate_audit",
    oc.sql(
        """SELECT scheme_id, count(*) FILTER (audit_status = 'VERIFIED') AS verified, count(*) FILTER (audit_status = 'NEEDS_REVIEW') AS needs_review,
           count(*) FILTER (audit_status NOT IN ('VERIFIED', 'NEEDS_REVIEW')) AS disputed FROM rules_raw GROUP BY 1"""
    ),
)
def gate_audit(v: Views) -> DataFrame:
    status = F.col("audit_status")
    return v.rules_raw().groupBy("scheme_id").agg(
        F.count_if(status == "VERIFIED").alias("verified"), F.count_if(status == "NEEDS_REVIEW").alias("needs_review"),
        F.count_if(~status.isin("VERIFIED", "NEEDS_REVIEW")).alias("disputed"),
    )


_NAMESPACE = quoted(model.FIELD_NAMESPACE)
_UNRELATED = """
  SELECT r.scheme_id, r.rule_id, r.referenced FROM (
    SELECT scheme_id, rule_id, unnest(string_split(values_text, '|')) AS referenced FROM rules
    WHERE rule_type = 'disqualifying' OR operator = 'NOT_MEMBER') r
  WHERE r.referenced IN (SELECT scheme_id FROM schemes) AND NOT EXISTS (
    SELECT 1 FROM rels e WHERE (e.scheme_a = r.scheme_id AND e.scheme_b = r.referenced) OR (e.scheme_b = r.scheme_id AND e.scheme_a = r.referenced))"""
_PRE = """SELECT DISTINCT scheme_id AS src, prerequisite_scheme_id AS dst FROM rules WHERE prerequisite_scheme_id IS NOT NULL"""
RELS = {"rels": derive.RELATIONSHIPS_SQL.format(part="part")}


@query(
    "gate_consistency",
    oc.sql(
        f"""SELECT 'namespace' AS reason, rule_id AS subject, field AS detail FROM rules WHERE field NOT IN ({_NAMESPACE})
        UNION ALL SELECT 'circular', least(a.src, a.dst), greatest(a.src, a.dst) FROM pre a JOIN pre b ON a.src = b.dst AND a.dst = b.src GROUP BY 2, 3
        UNION ALL SELECT 'unrelated', rule_id, referenced FROM ({_UNRELATED})""",
        pre=_PRE,
        **RELS,
    ),
)
def gate_consistency(v: Views) -> DataFrame:
    rules = v.rules()
    fields = quality.unknown_fields(rules).select(
        F.lit("namespace").alias("reason"), F.col("rule_id").alias("subject"), F.col("field").alias("detail")
    )
    edges = rules.where("prerequisite_scheme_id IS NOT NULL").select(
        F.col("scheme_id").alias("src"), F.col("prerequisite_scheme_id").alias("dst")
    )
    cycles = quality.two_cycles(edges).select(F.lit("circular").alias("reason"), F.col("scheme_a").alias("subject"), F.col("scheme_b").alias("detail"))
    loose = quality.unrelated_references(rules, v.schemes(), v.relationships()).select(
        F.lit("unrelated").alias("reason"), F.col("rule_id").alias("subject"), F.col("referenced").alias("detail")
    )
    return fields.unionByName(cycles).unionByName(loose)


_TAXONOMY = ", ".join(f"({c}, '{n}')" for c, n in model.AMBIGUITY_TAXONOMY.items())


@query(
    "gate_30_types",
    qm.sql(
        f"""SELECT t.type_code, t.type_name FROM (VALUES {_TAXONOMY}) t(type_code, type_name)
        WHERE t.type_code NOT IN (SELECT code FROM tax_rows)"""
    ),
)
def gate_30_types(v: Views) -> DataFrame:
    from eligrid.operators import ambiguity

    detected = ambiguity.flags(v.mined()).select(F.col("code").alias("type_code"))
    return quality.missing_types(detected)


@query(
    "gate_silent_pass",
    oc.sql(
        """SELECT rule_id, concat_ws('; ', CASE WHEN audit_status <> 'VERIFIED' THEN 'audit_status is ' || audit_status || ' (expected VERIFIED)' END,
             CASE WHEN coalesce(source_quote, '') = '' THEN 'source_quote is null or empty' END) AS reason
        FROM rules_raw WHERE audit_status <> 'VERIFIED' OR coalesce(source_quote, '') = ''"""
    ),
)
def gate_silent_pass(v: Views) -> DataFrame:
    return quality.silent_passes(v.rules_raw()).select("rule_id", "reason")


@query(
    "quality_report",
    oc.sql(
        """SELECT 'audit' AS kind, audit_status AS bucket, count(*) AS n FROM rules_raw GROUP BY 2
        UNION ALL SELECT 'severity', severity, count(*) FROM flags GROUP BY 2
        UNION ALL SELECT 'total', 'rules', count(*) FROM rules_raw
        UNION ALL SELECT 'total', 'schemes', count(DISTINCT scheme_id) FROM rules_raw
        UNION ALL SELECT 'gate', 'ungrounded', count(*) FROM rules_raw WHERE coalesce(source_quote, '') = ''"""
    ),
)
def quality_report(v: Views) -> DataFrame:
    rules = v.rules_raw()
    audits = rules.groupBy(F.col("audit_status").alias("bucket")).agg(F.count("*").alias("n")).select(F.lit("audit").alias("kind"), "bucket", "n")
    sev = v.flags().groupBy(F.col("severity").alias("bucket")).agg(F.count("*").alias("n")).select(F.lit("severity").alias("kind"), "bucket", "n")
    totals = rules.agg(
        F.count("*").alias("rules"), F.countDistinct("scheme_id").alias("schemes"),
        F.count_if(F.coalesce("source_quote", F.lit("")) == "").alias("ungrounded"),
    ).selectExpr("stack(3, 'total', 'rules', rules, 'total', 'schemes', schemes, 'gate', 'ungrounded', ungrounded) AS (kind, bucket, n)")
    return audits.unionByName(sev).unionByName(totals)


@query(
    "adversarial_tags",
    oc.sql(
        """SELECT scheme_id, segment, string_agg(rule_id, ',' ORDER BY ord) AS rule_ids FROM (
          SELECT *, unnest(list_filter([
            CASE WHEN contains(lower(coalesce(value_text, '')), 'widow') OR contains(field, 'marital') THEN 'widow_who_remarried' END,
            CASE WHEN contains(field, 'state') OR contains(field, 'domicile') OR contains(field, 'residence') THEN 'interstate_migrant' END,
            CASE WHEN contains(field, 'bank') OR contains(field, 'dbt') OR contains(field, 'aadhaar') THEN 'tribal_no_bank' END,
            CASE WHEN contains(field, 'land_ownership') OR contains(field, 'land_acres') THEN 'farmer_leases_land' END], lambda x: x IS NOT NULL)) AS segment
          FROM rules) GROUP BY 1, 2"""
    ),
)
def adversarial_tags(v: Views) -> DataFrame:
    tags = quality.risk_segments(v.rules()).join(v.rules().select("rule_id", "ord"), "rule_id")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "rule_id")))
    return tags.groupBy("scheme_id", "segment").agg(
        F.array_join(F.transform(ordered, lambda x: x["rule_id"]), ",").alias("rule_ids")
    )


# ---- batch validation and statistics over the mined rules -------------------

_BATCH_OPS = quoted(model.BATCH_OPERATORS)
VALIDATED = {
    **qm.REVIEW_CTES,
    **qm.BATCHED,
    "validated": f"""
      SELECT b.batch, count(DISTINCT m.slug) AS total_schemes, count(*) AS total_rules,
             count(*) FILTER (operator NOT IN ({_BATCH_OPS})) AS issues,
             count(*) FILTER (confidence >= 0.8) AS high_confidence, count(*) FILTER (confidence < 0.65) AS low_confidence,
             count(*) FILTER (rule_type = 'disqualifying') AS disqualifying_rules, count(*) FILTER (rule_type = 'prerequisite') AS prerequisite_rules,
             count(*) FILTER (rule_type = 'eligibility') AS eligibility_rules, count(*) FILTER (len(codes) > 0) AS with_ambiguities,
             count(DISTINCT m.slug) FILTER (r.reason IS NOT NULL) AS flagged_for_review
      FROM mined m JOIN batched b USING (slug) JOIN review r USING (slug) GROUP BY 1""",
}


def _batches(v: Views) -> DataFrame:
    return mining.with_batch(v.clauses().select("slug", "position")).select("slug", "batch")


@query("batch_validate", qm.sql("SELECT * FROM validated", **VALIDATED))
def batch_validate(v: Views) -> DataFrame:
    return quality.validate_batches(v.mined(), _batches(v), mining.review(v.mined()))


_VALIDATED_COLS = "total_schemes, total_rules, issues, flagged_for_review, high_confidence, low_confidence, disqualifying_rules, prerequisite_rules, eligibility_rules, with_ambiguities".split(", ")


@query(
    "validate_all",
    qm.sql(
        "SELECT count(*) AS batches, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _VALIDATED_COLS) + " FROM validated",
        **VALIDATED,
    ),
)
def validate_all(v: Views) -> DataFrame:
    per_batch = quality.validate_batches(v.mined(), _batches(v), mining.review(v.mined()))
    return per_batch.agg(F.count("*").alias("batches"), *[F.sum(c).alias(c) for c in _VALIDATED_COLS])


@query(
    "batch_summary",
    qm.sql(
        "SELECT batch, total_schemes, total_rules, round(total_rules / total_schemes, 4) AS avg_rules, flagged_for_review FROM validated",
        **VALIDATED,
    ),
)
def batch_summary(v: Views) -> DataFrame:
    per_batch = quality.validate_batches(v.mined(), _batches(v), mining.review(v.mined()))
    return per_batch.select(
        "batch", "total_schemes", "total_rules", F.round(F.col("total_rules") / F.col("total_schemes"), 4).alias("avg_rules"), "flagged_for_review"
    )


@query(
    "flagged_by_severity",
    qm.sql(
        """SELECT slug, severity, reason, rank FROM (
          SELECT r.slug, coalesce(loud, 'MEDIUM') AS severity, reason, row_number() OVER (PARTITION BY coalesce(loud, 'MEDIUM') ORDER BY position) AS rank
          FROM review r JOIN clauses c USING (slug) WHERE reason IS NOT NULL) WHERE rank <= 5""",
        **qm.REVIEW_CTES,
    ),
)
def flagged_by_severity(v: Views) -> DataFrame:
    placed = mining.review(v.mined()).join(v.clauses().select("slug", "position"), "slug")
    return quality.flagged_top(placed).select("slug", "severity", "reason", F.col("rank").cast("long").alias("rank"))


_BAND = """CASE WHEN confidence >= 0.9 THEN '0.90-1.00' WHEN confidence >= 0.8 THEN '0.80-0.89' WHEN confidence >= 0.7 THEN '0.70-0.79'
   WHEN confidence >= 0.6 THEN '0.60-0.69' ELSE '<0.60' END"""


@query(
    "stats_rules",
    qm.sql(
        " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {e} AS bucket, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM mined GROUP BY 2"
            for d, e in (("rule_type", "rule_type"), ("condition_type", "condition_type"), ("operator", "operator"), ("band", _BAND))
        )
    ),
)
def stats_rules(v: Views) -> DataFrame:
    return quality.rule_statistics(v.mined())


@query(
    "stats_top",
    qm.sql(
        """SELECT kind, bucket, n, pct, rank FROM (
          SELECT *, round(100 * n / sum(n) OVER (PARTITION BY kind), 4) AS pct, row_number() OVER (PARTITION BY kind ORDER BY n DESC, bucket) AS rank FROM (
            SELECT 'operator' AS kind, operator AS bucket, count(*) AS n FROM mined GROUP BY 2
            UNION ALL SELECT 'condition', condition_type, count(*) FROM mined GROUP BY 2))
        WHERE rank <= CASE kind WHEN 'operator' THEN 10 ELSE 15 END"""
    ),
)
def stats_top(v: Views) -> DataFrame:
    def top(kind: str, column: str, k: int) -> DataFrame:
        counts = v.mined().groupBy(F.col(column).alias("bucket")).agg(F.count("*").alias("n"))
        return quality.top_shares(counts, k).select(F.lit(kind).alias("kind"), "bucket", "n", "pct", F.col("rank").cast("long").alias("rank"))

    return top("operator", "operator", 10).unionByName(top("condition", "condition_type", 15))


@query(
    "stats_ambiguity",
    qm.sql(
        """SELECT code, occurrences, schemes, rank FROM (
          SELECT code, count(*) AS occurrences, count(DISTINCT slug) AS schemes, row_number() OVER (ORDER BY count(*) DESC, code) AS rank
          FROM (SELECT slug, unnest(codes) AS code FROM mined) GROUP BY 1) WHERE rank <= 20"""
    ),
)
def stats_ambiguity(v: Views) -> DataFrame:
    from pyspark.sql import Window

    # Folding to (code, scheme) first keeps the distinct count to one light shuffle.
    per_scheme = v.mined().select("slug", F.explode(F.transform("flags", lambda f: f["code"])).alias("code")).groupBy("code", "slug").agg(F.count("*").alias("n"))
    counts = per_scheme.groupBy("code").agg(F.sum("n").alias("occurrences"), F.count("*").alias("schemes"))
    w = Window.orderBy(F.desc("occurrences"), "code")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20")


# ---- relationships ----------------------------------------------------------

_TYPE = case_map("split_part(field, '.', 2)", model.CONDITION_TYPE_BY_SEGMENT, "split_part(field, '.', 2)")
REL_CTES = {
    **RELS,
    "typed": f"SELECT *, {_TYPE} AS condition_type FROM rules",
    "sets": "SELECT scheme_id, list(DISTINCT field) AS fields, list(DISTINCT condition_type) AS types FROM typed GROUP BY 1",
    "pairs": """
      SELECT a.scheme_id AS scheme_a, b.scheme_id AS scheme_b, len(list_intersect(a.fields, b.fields)) AS shared,
             least(1.0, 1.2 * len(list_intersect(a.fields, b.fields)) / (len(a.fields) + len(b.fields) - len(list_intersect(a.fields, b.fields)))) AS jaccard,
             len(list_intersect(a.fields, b.fields)) / greatest(len(a.fields), len(b.fields)) AS overlap,
             len(list_intersect(a.types, b.types)) > 0 AS same_benefit,
             list_contains(a.types, 'dwelling_ownership') AND list_contains(b.types, 'dwelling_ownership') AS dwelling
      FROM sets a JOIN sets b ON a.scheme_id < b.scheme_id""",
    "excl": """
      SELECT DISTINCT least(r.scheme_id, s.scheme_id) AS scheme_a, greatest(r.scheme_id, s.scheme_id) AS scheme_b
      FROM (SELECT scheme_id, unnest(list_append(string_split(values_text, '|'), coalesce(value_text, ''))) AS txt FROM rules WHERE rule_type = 'disqualifying') r
      JOIN schemes s ON s.scheme_id <> r.scheme_id AND contains(upper(r.txt), upper(s.scheme_id))""",
    "req": """
      SELECT DISTINCT least(scheme_id, prerequisite_scheme_id) AS scheme_a, greatest(scheme_id, prerequisite_scheme_id) AS scheme_b
      FROM rules WHERE prerequisite_scheme_id <> scheme_id AND prerequisite_scheme_id IN (SELECT scheme_id FROM schemes)""",
    "sims": "SELECT least(scheme_a, scheme_b) AS scheme_a, greatest(scheme_a, scheme_b) AS scheme_b, max(confidence) AS sim FROM rels GROUP BY 1, 2",
}


def _similarity(v: Views) -> DataFrame:
    """Similarities enter as a table; here the recorded edge confidences stand in."""
    return v.relationships().groupBy(
        F.least("scheme_a", "scheme_b").alias("scheme_a"), F.greatest("scheme_a", "scheme_b").alias("scheme_b")
    ).agg(F.max("confidence").alias("sim"))


def _pairs(v: Views) -> DataFrame:
    return relationships.shared_pairs(relationships.profiles_of(v.typed_rules()))


for _name, _col in (("rel_field_jaccard", "jaccard"), ("rel_pop_overlap", "overlap")):

    def _run(v: Views, col=_col) -> DataFrame:
        return _pairs(v).select("scheme_a", "scheme_b", six(col))

    query(_name, oc.sql(f"SELECT scheme_a, scheme_b, round({_col}, 6) AS {_col} FROM pairs WHERE shared > 0", **REL_CTES))(_run)


@query("join_scheme_pairs", oc.sql("SELECT scheme_a, count(*) AS partners FROM pairs WHERE shared > 0 GROUP BY 1", **REL_CTES))
def join_scheme_pairs(v: Views) -> DataFrame:
    return _pairs(v).groupBy("scheme_a").agg(F.count("*").alias("partners"))


@query("rel_same_benefit", oc.sql("SELECT scheme_a, scheme_b, same_benefit FROM pairs WHERE shared > 0", **REL_CTES))
def rel_same_benefit(v: Views) -> DataFrame:
    return _pairs(v).select("scheme_a", "scheme_b", "same_benefit")


@query("rel_exclusion", oc.sql("SELECT scheme_a, scheme_b FROM excl", **REL_CTES))
def rel_exclusion(v: Views) -> DataFrame:
    return relationships.exclusions(v.rules(), v.schemes())


@query("rel_prereq", oc.sql("SELECT scheme_a, scheme_b FROM req", **REL_CTES))
def rel_prereq(v: Views) -> DataFrame:
    return relationships.prerequisites(v.rules(), v.schemes())


# Dwelling ownership does not occur among the derived fields: residence stands in.
@query(
    "rel_dwelling",
    oc.sql(
        """SELECT a.scheme_id AS scheme_a, b.scheme_id AS scheme_b FROM sets2 a JOIN sets2 b ON a.scheme_id < b.scheme_id
        WHERE list_contains(a.types, 'dwelling_ownership') AND list_contains(b.types, 'dwelling_ownership') AND len(list_intersect(a.fields, b.fields)) > 0""",
        **REL_CTES,
        sets2="""SELECT scheme_id, list(DISTINCT field) AS fields,
          list(DISTINCT CASE WHEN condition_type = 'residence_type' THEN 'dwelling_ownership' ELSE condition_type END) AS types FROM typed GROUP BY 1""",
    ),
)
def rel_dwelling(v: Views) -> DataFrame:
    renamed = v.typed_rules().withColumn(
        "condition_type",
        F.when(F.col("condition_type") == "residence_type", "dwelling_ownership").otherwise(F.col("condition_type")),
    )
    return relationships.shared_pairs(relationships.profiles_of(renamed)).where("dwelling").select("scheme_a", "scheme_b")


@query(
    "rel_detect",
    oc.sql(
        """SELECT scheme_a, scheme_b, relationship_type, round(confidence, 6) AS confidence, confidence >= 0.6 AS display_to_user FROM (
          SELECT scheme_a, scheme_b,
            CASE WHEN x THEN 'MUTUAL_EXCLUSION' WHEN q THEN 'PREREQUISITE' WHEN dwelling THEN 'MUTUAL_EXCLUSION' WHEN overlap >= 0.7 AND same_benefit THEN 'OVERLAP'
                 WHEN overlap >= 0.5 AND NOT same_benefit THEN 'COMPLEMENTARY' ELSE 'OVERLAP' END AS relationship_type,
            CASE WHEN x THEN greatest(0.85, coalesce(sim, 0)) WHEN q THEN 0.8 WHEN dwelling THEN greatest(jaccard, 0.85)
                 WHEN (overlap >= 0.7 AND same_benefit) OR (overlap >= 0.5 AND NOT same_benefit) THEN jaccard
                 WHEN overlap > 0 THEN coalesce(sim, 0) * overlap ELSE coalesce(sim, 0) * 0.3 END AS confidence
          FROM (SELECT k.scheme_a, k.scheme_b, e.scheme_a IS NOT NULL AS x, r.scheme_a IS NOT NULL AS q, coalesce(p.overlap, 0) AS overlap,
                       coalesce(p.jaccard, 0) AS jaccard, coalesce(p.same_benefit, false) AS same_benefit, coalesce(p.dwelling, false) AS dwelling, s.sim
                FROM (SELECT scheme_a, scheme_b FROM pairs WHERE shared > 0 UNION SELECT scheme_a, scheme_b FROM excl UNION SELECT scheme_a, scheme_b FROM req
                      UNION SELECT scheme_a, scheme_b FROM sims) k
                LEFT JOIN pairs p USING (scheme_a, scheme_b) LEFT JOIN excl e USING (scheme_a, scheme_b)
                LEFT JOIN req r USING (scheme_a, scheme_b) LEFT JOIN sims s USING (scheme_a, scheme_b)))
        WHERE confidence >= 0.3""",
        **REL_CTES,
    ),
)
def rel_detect(v: Views) -> DataFrame:
    found = relationships.detect(
        _pairs(v), relationships.exclusions(v.rules(), v.schemes()),
        relationships.prerequisites(v.rules(), v.schemes()), _similarity(v),
    )
    return found.select("scheme_a", "scheme_b", "relationship_type", six("confidence"), "display_to_user")


@query(
    "join_mutual_prereq",
    oc.sql("SELECT least(a.src, a.dst) AS scheme_a, greatest(a.src, a.dst) AS scheme_b FROM pre a JOIN pre b ON a.src = b.dst AND a.dst = b.src GROUP BY 1, 2",
           **RELS, pre="SELECT DISTINCT scheme_a AS src, scheme_b AS dst FROM rels WHERE relationship_type = 'PREREQUISITE'"),
)
def join_mutual_prereq(v: Views) -> DataFrame:
    edges = v.relationships().where("relationship_type = 'PREREQUISITE'").select(F.col("scheme_a").alias("src"), F.col("scheme_b").alias("dst"))
    return quality.two_cycles(edges)


# ---- audits -----------------------------------------------------------------

_VEC = """
  SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS quote_vec,
         list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])),
                        lambda z: z[1] * (a.vec_id % 10) / 10.0 + z[2] * (1 - (a.vec_id % 10) / 10.0)) AS source_vec
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
_COS = """greatest(0.0, least(1.0, list_sum(list_transform(list_zip(quote_vec, source_vec), lambda z: z[1] * z[2]))
   / (sqrt(list_sum(list_transform(quote_vec, lambda x: x * x))) * sqrt(list_sum(list_transform(source_vec, lambda x: x * x))))))"""


def _anchored(v: Views) -> DataFrame:
    """Each vector beside a source vector that drifts from it by a tenth-step weight."""
    e = v.table("embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    share = (F.col("vec_id") % 10) / 10
    mixed = F.zip_with("embedding", "after", lambda a, b: a.cast("double") * share + b.cast("double") * (1 - share))
    return e.join(nxt, "vec_id").select("vec_id", F.col("embedding").alias("quote_vec"), mixed.alias("source_vec"))


@query("sim_cosine", f"SELECT vec_id, round({_COS}, 6) AS similarity FROM ({_VEC})")
def sim_cosine(v: Views) -> DataFrame:
    return _anchored(v).select("vec_id", F.round(audit.cosine(F.col("quote_vec"), F.col("source_vec")), 6).alias("similarity"))


@query(
    "audit_anchor",
    f"""SELECT vec_id, CASE WHEN s >= 0.9 THEN 'VERIFIED' WHEN s >= 0.7 THEN 'NEEDS_REVIEW' ELSE 'DISPUTED' END AS audit_status
    FROM (SELECT vec_id, round({_COS}, 6) AS s FROM ({_VEC}))""",
)
def audit_anchor(v: Views) -> DataFrame:
    score = F.round(audit.cosine(F.col("quote_vec"), F.col("source_vec")), 6)
    return _anchored(v).select("vec_id", audit.anchor_status(score).alias("audit_status"))


_FUND = derive.FUND_SQL.format(orders="orders")


@query(
    "staleness",
    f"""SELECT fund_id, coalesce(TRY_CAST(last_release AS DATE) < DATE '{derive.AS_OF}' - INTERVAL 90 DAY, true) AS stale FROM ({_FUND})""",
)
def staleness(v: Views) -> DataFrame:
    fund = v.spark.sql(derive.FUND_SQL, orders=v.table("orders"))
    return fund.select("fund_id", audit.is_stale(F.col("last_release"), derive.AS_OF).alias("stale"))


@query(
    "dormancy",
    f"""SELECT fund_id, CASE WHEN NOT has_data THEN 'unverified' WHEN status = 'discontinued' THEN 'discontinued'
      WHEN TRY_CAST(last_release AS DATE) IS NULL THEN 'error'
      WHEN date_diff('day', CAST(TRY_CAST(last_release AS DATE) AS DATE), DATE '{derive.AS_OF}') <= 365 AND beneficiaries > 0 THEN 'active' ELSE 'dormant' END AS lifecycle
    FROM ({_FUND})""",
)
def dormancy(v: Views) -> DataFrame:
    fund = v.spark.sql(derive.FUND_SQL, orders=v.table("orders"))
    state = audit.dormancy(
        F.col("has_data"), F.col("status"), F.col("last_release"), F.col("beneficiaries"), derive.AS_OF
    )
    return fund.select("fund_id", state.alias("lifecycle"))


_WORDS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))"
TIERS = {
    "tiers": """
      SELECT coalesce(a.k, b.k) AS scheme_no, a.text AS tier1, b.text AS tier2
      FROM (SELECT CAST(floor(doc_id / 2) AS BIGINT) AS k, text FROM documents WHERE doc_id % 2 = 0) a
      FULL OUTER JOIN (SELECT CAST(floor(doc_id / 2) + (CASE lang WHEN 'en' THEN 0 WHEN 'es' THEN 1000000000000 ELSE 1 END) AS BIGINT) AS k, text FROM documents WHERE doc_id % 2 = 1) b ON a.k = b.k""",
}


def _tiers(v: Views) -> DataFrame:
    """Two crawls of the document table, joined on their scheme number."""
    d = v.table("documents")
    half = F.floor(F.col("doc_id") / 2)
    one = d.where("doc_id % 2 = 0").select(half.alias("scheme_no"), F.col("text").alias("tier1"))
    # One language is shifted out of the other crawl's numbers, so that schemes of one tier only exist.
    shift = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "es", 10**12).otherwise(1)
    two = d.where("doc_id % 2 = 1").select((half + shift).alias("scheme_no"), F.col("text").alias("tier2"))
    return one.join(two, "scheme_no", "full_outer")


_DIV = f"""CASE WHEN len({_WORDS('tier1')}) + len({_WORDS('tier2')}) = 0 THEN 0.0 ELSE 1.0 - len(list_intersect({_WORDS('tier1')}, {_WORDS('tier2')}))
   / (len({_WORDS('tier1')}) + len({_WORDS('tier2')}) - len(list_intersect({_WORDS('tier1')}, {_WORDS('tier2')}))) END"""


def _with(ctes: dict, final: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({b})" for k, b in ctes.items()) + " " + final


@query("join_source_tiers", _with(TIERS, "SELECT scheme_no, tier1 IS NOT NULL AS has1, tier2 IS NOT NULL AS has2, count(*) AS n FROM tiers GROUP BY 1, 2, 3"))
def join_source_tiers(v: Views) -> DataFrame:
    return _tiers(v).groupBy(
        "scheme_no", F.col("tier1").isNotNull().alias("has1"), F.col("tier2").isNotNull().alias("has2")
    ).agg(F.count("*").alias("n"))


@query(
    "text_divergence",
    _with(TIERS, f"SELECT scheme_no, md5(tier2) AS other, round({_DIV}, 6) AS divergence FROM tiers WHERE tier1 IS NOT NULL AND tier2 IS NOT NULL"),
)
def text_divergence(v: Views) -> DataFrame:
    measured = audit.divergence(audit.words(F.col("tier1")), audit.words(F.col("tier2")))
    return _tiers(v).where("tier1 IS NOT NULL AND tier2 IS NOT NULL").select(
        "scheme_no", F.md5("tier2").alias("other"), F.round(measured, 6).alias("divergence")
    )


@query(
    "tier_select",
    _with(
        TIERS,
        f"""SELECT scheme_no, chosen, count(*) AS n FROM (SELECT scheme_no, CASE WHEN coalesce(tier1, '') <> '' AND coalesce(tier2, '') <> '' THEN CASE WHEN {_DIV} > 0.1 THEN 2 ELSE 1 END
          WHEN coalesce(tier2, '') <> '' THEN 2 WHEN coalesce(tier1, '') <> '' THEN 1 ELSE 0 END AS chosen FROM tiers) GROUP BY 1, 2""",
    ),
)
def tier_select(v: Views) -> DataFrame:
    return audit.choose_tier(_tiers(v)).groupBy("scheme_no", "chosen").agg(F.count("*").alias("n"))


_RUNS = """SELECT concat('RUN-', p_type) AS run_id, p_brand AS scheme,
   CASE p_size % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'NEEDS_REVIEW' ELSE 'DISPUTED' END AS triage, p_partkey % 6 AS n_rules, p_size % 4 AS n_flags FROM {part}"""


@query(
    "run_manifest",
    f"""SELECT run_id, count(*) AS schemes_processed, CAST(sum(CASE WHEN triage = 'VERIFIED' THEN n_rules ELSE 0 END) AS BIGINT) AS rules_verified,
      CAST(sum(CASE WHEN triage = 'NEEDS_REVIEW' THEN n_rules ELSE 0 END) AS BIGINT) AS rules_needs_review,
      CAST(sum(CASE WHEN triage = 'DISPUTED' THEN CASE WHEN n_rules = 0 THEN 1 ELSE n_rules END ELSE 0 END) AS BIGINT) AS rules_disputed,
      CAST(sum(CASE WHEN triage = 'DISPUTED' AND n_rules = 0 THEN 1 ELSE n_rules END) AS BIGINT) AS rules_generated,
      CAST(sum(n_flags) AS BIGINT) AS ambiguity_flags_raised FROM ({_RUNS.format(part='part')}) GROUP BY 1""",
)
def run_manifest(v: Views) -> DataFrame:
    return audit.run_manifest(v.spark.sql(_RUNS, part=v.table("part")))


# ---- feed joins -------------------------------------------------------------

FEED = {
    "feed": f"SELECT gazette_ref, title, coalesce(summary_raw, title) AS summary, notification_date FROM ({derive.FEED_SQL.format(orders='orders')})",
}


def _updates(v: Views) -> DataFrame:
    text = v.feed().withColumn("text", F.concat_ws("\n", "title", "summary"))
    return relationships.mentions(text, v.schemes().select("scheme_id"), "text", "scheme_id")


@query(
    "join_feed_scheme",
    oc.sql(
        """SELECT gazette_ref, scheme_id, notification_date, summary FROM feed f JOIN schemes s
        ON contains(lower(f.title), lower(s.scheme_id)) OR contains(lower(f.summary), lower(s.scheme_id))""",
        **FEED,
    ),
)
def join_feed_scheme(v: Views) -> DataFrame:
    return _updates(v).select("gazette_ref", "scheme_id", "notification_date", "summary")


@query(
    "reparse_jobs",
    oc.sql(
        """SELECT sha256(gazette_ref || '|' || scheme_id) AS job_id, scheme_id, 'gazette_monitor' AS trigger_source FROM feed f JOIN schemes s
        ON contains(lower(f.title), lower(s.scheme_id)) OR contains(lower(f.summary), lower(s.scheme_id))""",
        **FEED,
    ),
)
def reparse_jobs(v: Views) -> DataFrame:
    return _updates(v).select(
        F.sha2(F.concat_ws("|", "gazette_ref", "scheme_id"), 256).alias("job_id"), "scheme_id",
        F.lit("gazette_monitor").alias("trigger_source"),
    )


# ---- sequencing -------------------------------------------------------------

SEQ_BASE = """
  SELECT scheme_a AS src, scheme_b AS dst, confidence, position,
         row_number() OVER (ORDER BY confidence, position) AS rank
  FROM rels WHERE relationship_type = 'PREREQUISITE' AND scheme_a IN (SELECT scheme_id FROM schemes WHERE status = 'active')
    AND scheme_b IN (SELECT scheme_id FROM schemes WHERE status = 'active')"""
SEQ_CTES = {
    **RELS,
    "pre": SEQ_BASE,
    "reach": "SELECT src, dst, rank AS w FROM pre UNION SELECT r.src, p.dst, least(r.w, p.rank) FROM reach r JOIN pre p ON r.dst = p.src",
    "cut": "SELECT coalesce(max(w), 0) AS k FROM reach WHERE src = dst",
    "arcs": "SELECT DISTINCT src, dst FROM pre WHERE rank > (SELECT k FROM cut)",
    "paths": """SELECT scheme_id AS node, 0 AS depth FROM schemes WHERE status = 'active'
      UNION SELECT a.dst, p.depth + 1 FROM paths p JOIN arcs a ON a.src = p.node""",
    "lv": "SELECT node AS scheme_id, max(depth) AS level FROM paths GROUP BY 1",
}


def _recursive(final: str) -> str:
    return oc.sql(final, **SEQ_CTES).replace("WITH ", "WITH RECURSIVE ", 1)


class _Graph:
    """Cut graph and levels of a folder's catalogue, computed once per session."""

    @staticmethod
    def of(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
        if "graph" not in v._plans:
            known = v.schemes().where("status = 'active'").select("scheme_id")
            edges = (
                v.relationships().where("relationship_type = 'PREREQUISITE'")
                .join(known.withColumnRenamed("scheme_id", "scheme_a"), "scheme_a", "left_semi")
                .join(known.withColumnRenamed("scheme_id", "scheme_b"), "scheme_b", "left_semi")
                .select(F.col("scheme_a").alias("src"), F.col("scheme_b").alias("dst"), "confidence", "position")
            )
            cut = sequence.break_cycles(edges)
            arcs = cut.where("NOT removed").select("src", "dst")
            v._plans["graph"] = (cut, arcs, sequence.levels(known, arcs))
        return v._plans["graph"]


@query("seq_break_cycles", _recursive("SELECT src, dst, confidence, rank, rank <= k AS removed FROM pre, cut"))
def seq_break_cycles(v: Views) -> DataFrame:
    cut, _, _ = _Graph.of(v)
    return cut.select("src", "dst", "confidence", F.col("rank").cast("long").alias("rank"), "removed")


_STEPS = """
  SELECT d.profile_id, d.scheme_id, d.status, CASE WHEN composite = 0 THEN 1.0 ELSE composite END AS confidence,
         row_number() OVER (PARTITION BY d.profile_id ORDER BY level, d.scheme_id) AS step
  FROM dets d JOIN lv USING (scheme_id) WHERE d.status NOT IN ('INELIGIBLE', 'DISQUALIFIED')"""


@query(
    "seq_steps",
    oc.sql(
        """SELECT s.profile_id, s.step, s.scheme_id, s.status, round(s.confidence, 6) AS confidence, coalesce(d.depends_on, '') AS depends_on FROM steps s
        LEFT JOIN (SELECT s.profile_id, s.scheme_id, string_agg(o.scheme_id, ',' ORDER BY o.scheme_id) AS depends_on
                   FROM steps s JOIN arcs a ON a.dst = s.scheme_id JOIN steps o ON o.profile_id = s.profile_id AND o.scheme_id = a.src GROUP BY 1, 2) d
          USING (profile_id, scheme_id)""",
        **SEQ_CTES,
        steps=_STEPS,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def seq_steps(v: Views) -> DataFrame:
    _, arcs, level = _Graph.of(v)
    return sequence.steps(v.determinations(), level, arcs, v.profile_tasks()).select(
        "profile_id", F.col("step").cast("long").alias("step"), "scheme_id", "status", six("confidence"),
        F.array_join("depends_on", ",").alias("depends_on"),
    )


# The pairwise merge, step by step: a step joins all later steps that it has no arc with to its first group.
_PARALLEL = {
    "pairs": """SELECT a.profile_id, a.step AS i, list(b.step ORDER BY b.step) AS later FROM steps a
      JOIN steps b ON b.profile_id = a.profile_id AND b.step > a.step
      LEFT JOIN arcs f ON f.src = a.scheme_id AND f.dst = b.scheme_id LEFT JOIN arcs t ON t.src = b.scheme_id AND t.dst = a.scheme_id
      WHERE f.src IS NULL AND t.src IS NULL GROUP BY 1, 2""",
    "ends": "SELECT profile_id, max(step) AS n FROM steps GROUP BY 1",
    "walk": """SELECT profile_id, CAST(0 AS BIGINT) AS i, n, CAST([] AS BIGINT[][]) AS groups FROM ends
      UNION ALL
      SELECT w.profile_id, w.i + 1, n, CASE WHEN later IS NULL THEN groups
        WHEN list_position(list_transform(groups, lambda g: list_contains(g, w.i + 1)), true) IS NULL THEN list_append(groups, list_concat([w.i + 1], later))
        ELSE list_transform(groups, lambda g, k: CASE WHEN k = list_position(list_transform(groups, lambda h: list_contains(h, w.i + 1)), true)
          THEN list_distinct(list_concat(g, later)) ELSE g END) END
      FROM walk w LEFT JOIN pairs p ON p.profile_id = w.profile_id AND p.i = w.i + 1 WHERE w.i < n""",
    "members": """SELECT profile_id, CAST(group_no - 1 AS INT) AS group_no, unnest(g) AS step FROM (
      SELECT profile_id, unnest(groups) AS g, unnest(range(1, len(groups) + 1)) AS group_no FROM walk WHERE i = n)""",
}


@query(
    "seq_parallel",
    oc.sql(
        "SELECT profile_id, CAST(step - 1 AS INT) AS pos, scheme_id, group_no FROM members JOIN steps USING (profile_id, step)",
        **SEQ_CTES, steps=_STEPS, **_PARALLEL,
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def seq_parallel(v: Views) -> DataFrame:
    _, arcs, level = _Graph.of(v)
    return sequence.parallel_groups(sequence.steps(v.determinations(), level, arcs, v.profile_tasks()), arcs)


@query(
    "seq_choice_sets",
    oc.sql(
        """SELECT 'CS-' || lpad(CAST(n AS STRING), 3, '0') AS choice_set_id, scheme_a, scheme_b FROM (
          SELECT *, row_number() OVER (PARTITION BY least(scheme_a, scheme_b), greatest(scheme_a, scheme_b) ORDER BY n) AS rn FROM (
            SELECT scheme_a, scheme_b, row_number() OVER (ORDER BY position) AS n FROM rels WHERE relationship_type = 'MUTUAL_EXCLUSION'
              AND scheme_a IN (SELECT scheme_id FROM schemes WHERE status = 'active') AND scheme_b IN (SELECT scheme_id FROM schemes WHERE status = 'active')))
        WHERE rn = 1""",
        **RELS,
    ),
)
def seq_choice_sets(v: Views) -> DataFrame:
    return sequence.choice_sets(v.relationships(), v.schemes().where("status = 'active'"))


@query(
    "seq_complementary",
    oc.sql(
        """SELECT DISTINCT r.scheme_a, r.scheme_b, 'If you are applying for ' || coalesce(a.scheme_name, r.scheme_a) || ', also consider ' || coalesce(b.scheme_name, r.scheme_b)
             || ' — these schemes complement each other and can be held simultaneously.' AS rationale
        FROM rels r LEFT JOIN (SELECT * FROM schemes WHERE status = 'active') a ON a.scheme_id = r.scheme_a LEFT JOIN (SELECT * FROM schemes WHERE status = 'active') b ON b.scheme_id = r.scheme_b
        WHERE relationship_type = 'COMPLEMENTARY'""",
        **RELS,
    ),
)
def seq_complementary(v: Views) -> DataFrame:
    return sequence.complementary(v.relationships(), v.schemes().where("status = 'active'"))


@query(
    "join_rel_to_dets",
    oc.sql(
        """SELECT a.profile_id, r.relationship_type, count(*) AS n FROM rels r
        JOIN dets a ON a.scheme_id = r.scheme_a JOIN dets b ON b.profile_id = a.profile_id AND b.scheme_id = r.scheme_b
        WHERE a.status NOT IN ('INELIGIBLE', 'DISQUALIFIED') AND b.status NOT IN ('INELIGIBLE', 'DISQUALIFIED') GROUP BY 1, 2""",
        **RELS,
    ),
)
def join_rel_to_dets(v: Views) -> DataFrame:
    """Edges with both ends in a profile's result set, tested on the profile's own id set."""
    inside = v.determinations().where(~F.col("status").isin(*sequence.EXCLUDED)).groupBy("profile_id").agg(
        F.collect_set("scheme_id").alias("ids")
    )
    edges = v.relationships().select(F.col("scheme_a").alias("a"), "scheme_b", "relationship_type")
    return (
        inside.select("profile_id", "ids", F.explode("ids").alias("a"))
        .join(broadcast_if_small(edges), "a")
        .where(F.array_contains("ids", F.col("scheme_b")))
        .groupBy("profile_id", "relationship_type")
        .agg(F.count("*").alias("n"))
    )
