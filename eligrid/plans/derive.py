"""Domain tables derived from the driver tables, as portable SQL expressions.

The same derivation text feeds the Spark views and the DuckDB oracle: it only
makes input rows; the operators themselves are written separately on each side.
"""

from __future__ import annotations

# The 25 nations map onto 25 state codes.
NATION_STATES = "AN,AP,AR,AS,BR,CG,CH,DL,GA,GJ,HP,HR,JH,KA,KL,MH,MP,OD,PB,RJ,TN,TS,UK,UP,WB"

# Raw profile columns over `customer`; order follows model.PROFILE_FIELDS.
PROFILE_EXPRESSIONS = {
    "applicant_age": "CASE WHEN c_custkey % 19 = 3 THEN NULL ELSE c_custkey % 121 END",
    "applicant_gender": (
        "CASE WHEN c_custkey % 23 = 5 THEN NULL WHEN c_custkey % 2 = 0 THEN 'female' "
        "WHEN c_custkey % 9 = 1 THEN 'transgender' ELSE 'male' END"
    ),
    "applicant_caste_category": (
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'SC' WHEN 'AUTOMOBILE' THEN 'ST' "
        "WHEN 'MACHINERY' THEN 'OBC' WHEN 'HOUSEHOLD' THEN 'GENERAL' ELSE 'EWS' END"
    ),
    "applicant_marital_status": (
        "CASE c_custkey % 5 WHEN 0 THEN 'married' WHEN 1 THEN 'widowed' WHEN 2 THEN 'single' "
        "WHEN 3 THEN 'divorced' ELSE NULL END"
    ),
    "applicant_disability_status": (
        "CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_custkey % 8 = 1 END"
    ),
    "applicant_disability_percentage": (
        "CASE WHEN c_custkey % 16 = 1 THEN 20 + c_custkey % 61 ELSE NULL END"
    ),
    "applicant_land_ownership_status": "c_acctbal > 5000",
    "location_state": f"split_part('{NATION_STATES}', ',', CAST(c_nationkey + 1 AS INT))",
    "household_income_annual": (
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(floor(abs(c_acctbal) * 100) AS BIGINT) END"
    ),
    "household_income_monthly": (
        "CASE WHEN c_custkey % 5 = 0 THEN CAST(floor(abs(c_acctbal) * 8) AS BIGINT) "
        "WHEN c_custkey % 5 = 1 THEN CAST(floor(abs(c_acctbal) * 5) AS BIGINT) ELSE NULL END"
    ),
    "household_size": "1 + c_custkey % 9",
    "household_bpl_status": "c_acctbal < 1000",
    "household_ration_card_type": (
        "CASE c_custkey % 6 WHEN 0 THEN 'BPL' WHEN 1 THEN 'APL' WHEN 2 THEN 'AAY' ELSE NULL END"
    ),
    "household_residence_type": "CASE WHEN c_custkey % 3 = 0 THEN 'urban' ELSE 'rural' END",
    "household_land_acres": (
        "CASE WHEN c_acctbal > 5000 THEN floor((c_acctbal - 5000) / 10) / 100.0E0 ELSE NULL END"
    ),
    "employment_type": (
        "CASE c_custkey % 7 WHEN 0 THEN 'farmer' WHEN 1 THEN 'street_vendor' WHEN 2 THEN 'salaried' "
        "WHEN 3 THEN 'self_employed' WHEN 4 THEN 'gig_worker' WHEN 5 THEN 'unemployed' ELSE NULL END"
    ),
    "employment_is_epfo_member": "c_custkey % 6 = 0",
    "employment_is_esic_member": "c_custkey % 10 = 3",
    "employment_is_nps_subscriber": "CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE c_custkey % 12 = 5 END",
    "employment_is_income_tax_payer": "c_acctbal > 8000",
    "documents_aadhaar": "c_custkey % 11 <> 0",
    "documents_bank_account": "c_acctbal >= 0",
    "documents_bank_account_type": (
        "CASE c_custkey % 4 WHEN 0 THEN 'savings' WHEN 1 THEN 'jan_dhan' ELSE NULL END"
    ),
    "documents_mgnrega_job_card": "c_custkey % 3 = 0",
    "documents_caste_certificate": "CASE WHEN c_custkey % 13 = 7 THEN NULL ELSE c_custkey % 5 <> 2 END",
    "documents_income_certificate": "c_custkey % 2 = 1",
    "health_pregnancy_status": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 20 = 4 ELSE NULL END",
    "health_child_count": "CASE WHEN c_custkey % 9 = 8 THEN NULL ELSE c_custkey % 6 END",
}
# Fields outside the mapped vocabulary travel as extras and never count as populated.
EXTRA_EXPRESSIONS = {
    "applicant.education_level": (
        "CASE c_custkey % 4 WHEN 0 THEN '10th' WHEN 1 THEN '12' WHEN 2 THEN 'graduate' ELSE NULL END"
    ),
    "household.has_pucca_house": "CASE WHEN c_acctbal > 6000 THEN 'yes' ELSE 'no' END",
}

# Active enrolments: the open orders of a customer, each naming a scheme.
ENROLLMENT_SCHEME = "concat('Brand#', CAST(1 + o_orderkey % 25 AS STRING))"
ENROLLMENT_FILTER = "o_orderstatus = 'O'"

# Rule shapes: operator, field, value kind, base, span, values; one per residue.
RULE_SHAPES = [
    ("EQ", "applicant.caste_category", "str", 0, 0, "SC"),
    ("NEQ", "applicant.caste_category", "str", 0, 0, "GENERAL"),
    ("LT", "applicant.age", "num", 18, 80, ""),
    ("LTE", "household.income_annual", "num", 100000, 900000, ""),
    ("GT", "household.size", "num", 0, 6, ""),
    ("GTE", "applicant.age", "num", 5, 60, ""),
    ("BETWEEN", "applicant.age", "range", 5, 60, ""),
    ("IN", "applicant.caste_category", "strs", 0, 0, "SC|ST|OBC"),
    ("NOT_IN", "location.state", "strs", 0, 0, "UP|BR|MP"),
    ("NOT_MEMBER", "schemes.active_enrollments", "strs", 0, 0, "Brand#3|Brand#7|Brand#12"),
    ("IS_NULL", "household.income_monthly", "null", 0, 0, ""),
    ("IS_NOT_NULL", "documents.bank_account_type", "null", 0, 0, ""),
    ("CONTAINS", "employment.type", "str", 0, 0, "er"),
    ("MATCHES", "location.state", "str", 0, 0, "^[A-M]"),
    ("EQ", "documents.bank_account", "bool", 1, 0, "True"),
    ("NEQ", "employment.is_income_tax_payer", "bool", 1, 0, "True"),
    ("LT", "household.land_acres", "num", 1, 8, ""),
    ("LTE", "applicant.education_level", "num", 8, 8, ""),
    ("GT", "household.income_annual", "num", 10000, 400000, ""),
    ("GTE", "applicant.disability_percentage", "num", 20, 50, ""),
    ("BETWEEN", "household.income_annual", "range", 10000, 400000, ""),
    ("IN", "applicant.gender", "strs", 0, 0, ""),
    ("NOT_IN", "household.size", "nums", 0, 0, "1|2"),
    ("NOT_MEMBER", "schemes.active_enrollments", "strs", 0, 0, ""),
    ("IS_NULL", "schemes.active_enrollments", "null", 0, 0, ""),
    ("IS_NOT_NULL", "health.pregnancy_status", "null", 0, 0, ""),
    ("CONTAINS", "schemes.active_enrollments", "str", 0, 0, "Brand#4"),
    ("MATCHES", "employment.type", "str", 0, 0, "(["),
    ("EQ", "household.residence_type", "str", 0, 0, "rural"),
    ("EQ", "household.income_annual", "null", 0, 0, ""),
    ("EQ", "employment.is_epfo_member", "bool", 0, 0, "False"),
    ("EQ", "household.bpl_status", "num", 1, 0, ""),
    ("LTE", "applicant.gender", "num", 5, 5, ""),
    ("EQ", "documents.aadhaar", "bool", 1, 0, "True"),
    ("BETWEEN", "household.size", "half_range", 2, 4, ""),
    ("NOT_BETWEEN", "applicant.age", "range", 5, 60, ""),
    ("EXISTS", "documents.caste_certificate", "null", 0, 0, ""),
]


def _shape_rows() -> str:
    return ", ".join(
        f"({i}, '{op}', '{field}', '{kind}', {base}, {span}, '{text}')"
        for i, (op, field, kind, base, span, text) in enumerate(RULE_SHAPES)
    )


# One rule per (brand, type) of the whole part table; its attributes come from
# the group's aggregates, so the rule base is bounded by the part vocabulary
# while the work of deriving it grows with the table.
RULES_RAW_SQL = f"""
WITH grouped AS (
  SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS kmin, max(p_partkey) AS kmax,
         sum(p_size) AS ssum, sum(p_partkey) AS ksum
  FROM {{part}} GROUP BY p_brand, p_type
), shaped AS (
  SELECT g.*, t.op, t.field, t.shape, t.base, t.span, t.txt,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_type) AS ord,
         CAST(floor(t.base + t.span * ((CAST(ssum AS DOUBLE) / n) / 50.0E0)) AS DOUBLE) AS threshold
  FROM grouped g JOIN (VALUES {_shape_rows()}) AS t(i, op, field, shape, base, span, txt)
    ON g.ksum % {len(RULE_SHAPES)} = t.i
)
SELECT p_brand AS scheme_id,
       concat(p_brand, '-', p_type) AS rule_id,
       CAST(ord AS INT) AS ord,
       CASE WHEN ssum % 9 = 0 THEN 'disqualifying' WHEN ssum % 9 = 1 THEN 'Prerequisite '
            WHEN ssum % 9 = 2 THEN 'administrative_discretion' WHEN ssum % 9 = 3 THEN 'disqualifying'
            WHEN ssum % 9 = 4 THEN 'other' ELSE 'eligibility' END AS rule_type,
       field, op AS operator,
       CASE WHEN shape IN ('str', 'num', 'bool') THEN shape ELSE 'null' END AS value_kind,
       CASE WHEN shape = 'num' THEN CAST(CAST(threshold AS BIGINT) AS STRING)
            WHEN shape IN ('str', 'bool') THEN txt ELSE NULL END AS value_text,
       CASE WHEN shape IN ('range', 'half_range') THEN threshold ELSE NULL END AS value_min,
       CASE WHEN shape = 'range' THEN threshold * 1.5E0 + 10 ELSE NULL END AS value_max,
       CASE WHEN shape = 'nums' THEN 'num' ELSE 'str' END AS values_kind,
       CASE WHEN shape IN ('strs', 'nums') THEN txt ELSE '' END AS values_text,
       CASE WHEN (kmin + kmax) % 5 = 0 THEN 'VERIFIED' WHEN (kmin + kmax) % 5 = 1 THEN 'NEEDS_REVIEW'
            WHEN (kmin + kmax) % 5 = 2 THEN 'PENDING' WHEN (kmin + kmax) % 5 = 3 THEN 'OVERRIDDEN'
            ELSE CASE WHEN n % 2 = 0 THEN 'DISPUTED' ELSE 'VERIFIED' END END AS audit_status,
       CASE WHEN kmax % 11 = 0 THEN split_part('{NATION_STATES}', ',', CAST(1 + ksum % 25 AS INT))
            ELSE 'central' END AS state_scope,
       CASE WHEN kmax % 11 = 0
            THEN lag(concat(p_brand, '-', p_type)) OVER (PARTITION BY p_brand ORDER BY p_type)
            ELSE NULL END AS supersedes_rule_id,
       CASE WHEN n % 3 = 0 THEN NULL ELSE concat('G', CAST(kmin % 2 AS STRING)) END AS logic_group,
       CASE kmin % 4 WHEN 0 THEN 'OR' WHEN 1 THEN 'AND' WHEN 2 THEN NULL ELSE 'or' END AS logic_operator,
       CASE WHEN ssum % 9 = 1 THEN concat('Brand#', CAST(1 + kmax % 25 AS STRING)) ELSE NULL END
         AS prerequisite_scheme_id,
       CASE WHEN kmax % 7 = 0 THEN '' ELSE concat('Clause on ', field, ' in ', p_type, ' annex') END
         AS source_quote,
       concat('https://schemes.example/', p_brand) AS source_url,
       CAST(50 + ksum % 51 AS DOUBLE) / 100 AS confidence,
       CASE WHEN ksum % 29 = 0 THEN NULL ELSE concat(field, ' per ', p_type) END AS display_text,
       CASE WHEN kmax % 6 = 0 THEN 'CRITICAL' WHEN kmax % 6 = 1 THEN 'HIGH'
            WHEN kmax % 6 = 2 THEN 'MEDIUM' ELSE NULL END AS flag_severity,
       CAST(1 + kmax % 30 AS INT) AS flag_code,
       CASE WHEN ssum % 7 = 0 THEN 'HIGH' WHEN ssum % 7 = 1 THEN 'MEDIUM' ELSE NULL END AS flag2_severity,
       CAST(1 + ksum % 30 AS INT) AS flag2_code,
       CASE WHEN ksum % 31 = 0 THEN true ELSE false END AS in_review_queue
FROM shaped
"""

# The part table with a brand for every six parts, so that schemes and rules grow with it.
GROWN_PART = (
    "p_partkey", "concat('Brand#', CAST(CAST(floor(p_partkey / 6.0E0) AS BIGINT) AS STRING)) AS p_brand", "p_type", "p_size",
)

# One scheme per brand.
SCHEMES_SQL = """
SELECT p_brand AS scheme_id, concat('Scheme ', p_brand) AS scheme_name,
       concat('Ministry of ', min(p_type)) AS ministry,
       CASE WHEN sum(p_partkey) % 23 = 0 THEN 'inactive' ELSE 'active' END AS status,
       CASE WHEN sum(p_size) % 3 = 0 THEN 'central'
            ELSE split_part('{states}', ',', CAST(1 + sum(p_size) % 25 AS INT)) END AS state_scope,
       CAST(substring(p_brand, 7) AS INT) AS position
FROM {{part}} GROUP BY p_brand
""".format(states=NATION_STATES)

# Eligibility prose over `part`: three sentences per part, numbers from its columns.
SENTENCES = [
    "Applicant age must be between {a} and {b} years",
    "Annual income should not exceed Rs. {n}.5 lakh",
    "The benefit is at the discretion of the district officer",
    "Applicant must be a resident of the state of Bihar",
    "Women and men belonging to SC, ST or OBC may apply",
    "A bank account is mandatory for direct benefit transfer",
    "The applicant must have a ration card",
    "Income must be at least Rs. 1,{a},000 per annum",
    "Widow or divorced women of the weaker section",
    "Families already receiving benefit from another scheme cannot apply",
    "Farmer or fisherman with land up to {n} acre",
    "Must not be a member of EPFO and not eligible if member of ESIC",
    "Applicant passed 10th or 12th class or is a graduate",
    "Age {a} years and above",
    "Age {b} years or below",
    "Family members more than {n}",
    "Fewer dependents, less than {n}",
    "Applicants aged {a}-{b} years of the general category",
    "Aadhaar is not mandatory for the needy",
    "Documents such as caste certificate of the state varies by state",
    "Amount of ₹{a} lakh or {n} crore maximum",
    "The applicant should be a taxpayer with income tax returns",
    "Applied within {a} days of notification, subject to availability",
    "Self-declaration of BPL status required",
    "Not disqualified persons below poverty line",
    "Persons with disability certificate of {a} percentage disability",
    "Married daughter may be part of a separate household",
    "Minimum {a} months since registration",
    "From {a} to {b} units of cultivation",
    "Some persons, any category, may vary",
    "Land records or patta khata in the revenue record",
    "Family income includes member income excluded earlier",
    "Must enroll before 31 date and hold an existing beneficiary card",
    "The Hindi notice says otherwise than the English one",
    "Prerequisite scheme is a prerequisite of this circular order",
    "Appeal to the appellate authority within {a} days",
    "Call the toll free helpline of the ombudsman",
    "Implementation pending in the pilot first phase",
    "Joint family or nuclear family alike",
    "No bar on worker, driver and mason with savings account",
    "Gram panchayat at block level decides",
    "Caste boundary of other backward class",
    "This contradicts the validity period of the application window",
    "Household definition differs, double counting of benefit",
    "Age as on date of application, completed {a} years",
    "Income between {a} and {b} thousand, borderline income",
    "Short one",
    "Every household that has lived in the area and keeps the papers of the local office in good order, so that they can be shown to a visiting officer on any working day of the season, "
    "with copies for all members of the house, may be helped at the discretion of the collector, subject to availability, within {a} days of notification",
]
_sentence_text = "|".join(s.replace("'", "''") for s in SENTENCES)


def _sentence(index: str) -> str:
    picked = f"split_part('{_sentence_text}', '|', CAST(1 + ({index}) % {len(SENTENCES)} AS INT))"
    for mark, value in (("{a}", "p_size"), ("{b}", "p_size + 20"), ("{n}", "1 + p_size % 9")):
        picked = f"replace({picked}, '{mark}', CAST({value} AS STRING))"
    return picked


CLAUSES_SQL = f"""
SELECT p_partkey AS position, concat('sch-', CAST(p_partkey AS STRING)) AS slug,
       concat('Scheme for ', p_name, ' no. ', CAST(p_partkey AS STRING)) AS scheme_name,
       CASE p_size % 5 WHEN 0 THEN 'Central' WHEN 1 THEN 'State' WHEN 2 THEN 'Uttar Pradesh'
            WHEN 3 THEN ' West Bengal ' ELSE '' END AS level,
       CASE WHEN p_partkey % 53 = 0 THEN '  '
            ELSE concat({_sentence('p_partkey')}, '. ', {_sentence('p_partkey * 7 + p_size')}, '! ',
                        {_sentence('CAST(floor(p_retailprice) AS BIGINT) * 3 + p_size')}, '?') END AS eligibility
FROM {{part}}
""".replace("{a}", "{{a}}").replace("{b}", "{{b}}").replace("{n}", "{{n}}")

# Relationship edges between schemes: three per brand, some to unknown schemes.
RELATIONSHIPS_SQL = """
WITH b AS (
  SELECT p_brand, CAST(substring(p_brand, 7) AS INT) AS k, sum(p_size) AS ssum, sum(p_partkey) AS ksum
  FROM {part} GROUP BY p_brand
), e AS (
  SELECT p_brand AS scheme_a, concat('Brand#', CAST(1 + (k * 7) % 25 AS STRING)) AS scheme_b, k * 3 AS position, ssum AS m, ksum FROM b
  UNION ALL
  SELECT p_brand, concat('Brand#', CAST(1 + (k + 1) % 25 AS STRING)), k * 3 + 1, ssum + 1, ksum * 3 FROM b
  UNION ALL
  SELECT concat('Brand#', CAST(1 + (k + 1) % 27 AS STRING)), p_brand, k * 3 + 2, ssum + 1, ksum * 5 FROM b
)
SELECT concat('REL-', scheme_a, '-', scheme_b) AS relationship_id, scheme_a, scheme_b, position,
       CASE m % 4 WHEN 0 THEN 'PREREQUISITE' WHEN 1 THEN 'MUTUAL_EXCLUSION' WHEN 2 THEN 'COMPLEMENTARY' ELSE 'PREREQUISITE' END
         AS relationship_type,
       CAST(20 + ksum % 81 AS DOUBLE) / 100 AS confidence
FROM e WHERE scheme_a <> scheme_b
"""

# Gazette feed entries over orders; the title or summary names a scheme.
FEED_SQL = """
SELECT concat('G-', CAST(o_orderkey AS STRING)) AS gazette_ref,
       concat('Order on BRAND#', CAST(1 + o_orderkey % 60 AS STRING)) AS title,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('amends brand#', CAST(1 + o_custkey % 40 AS STRING), ' rules') ELSE NULL END AS summary_raw,
       substring(CAST(o_orderdate AS STRING), 1, 10) AS notification_date
FROM {orders}
"""

# Fund data per order, with gaps: no data, discontinued, bad or missing dates.
FUND_SQL = """
SELECT o_orderkey AS fund_id, o_orderkey % 13 <> 0 AS has_data,
       CASE o_orderstatus WHEN 'P' THEN 'discontinued' ELSE 'running' END AS status,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'soon'
            ELSE substring(CAST(o_orderdate AS STRING), 1, 10) END AS last_release,
       o_custkey % 4 AS beneficiaries
FROM {orders}
"""
AS_OF = "2001-08-01"

# Field values said in conversations, over events; a turn is a day of a user.
SPARK_DAY = "datediff(CAST(ts AS DATE), DATE '2024-01-01')"
DUCK_DAY = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))"
EXTRACTIONS_SQL = """
SELECT user_id AS conv_id, CAST({day} AS INT) AS turn, event_id AS seq, ts,
  CASE event_id % 15 WHEN 0 THEN 'applicant.age' WHEN 1 THEN 'applicant.birth_year' WHEN 2 THEN 'household.income_annual'
    WHEN 3 THEN 'household.income_monthly' WHEN 4 THEN 'employment.is_income_tax_payer' WHEN 5 THEN 'applicant.disability_status'
    WHEN 6 THEN 'applicant.disability_percentage' WHEN 7 THEN 'documents.bank_account' WHEN 8 THEN 'documents.bank_account_type'
    WHEN 9 THEN 'employment.type' WHEN 10 THEN 'applicant.land_ownership_status' WHEN 11 THEN 'household.land_acres'
    WHEN 12 THEN 'location.state' WHEN 13 THEN 'applicant.caste_category' ELSE 'applicant.gender' END AS field,
  CASE event_id % 15 WHEN 0 THEN CAST(floor(value) AS DOUBLE) WHEN 1 THEN 1890 + floor(value * 2) % 140 WHEN 2 THEN CAST(floor(value * 3000) AS DOUBLE)
    WHEN 3 THEN CAST(floor(value * 250) AS DOUBLE) WHEN 6 THEN CAST(floor(value) AS DOUBLE)
    WHEN 11 THEN CASE WHEN floor(value) % 3 = 0 THEN 0.0E0 ELSE floor(value) / 10.0E0 END ELSE NULL END AS num,
  CASE event_id % 15 WHEN 4 THEN CASE WHEN event_type IN ('purchase', 'click') THEN 'True' ELSE 'False' END
    WHEN 5 THEN CASE WHEN event_type <> 'view' THEN 'True' ELSE 'False' END WHEN 7 THEN CASE WHEN event_type = 'error' THEN 'False' ELSE 'True' END
    WHEN 8 THEN CASE event_type WHEN 'view' THEN 'savings' ELSE 'jan_dhan' END
    WHEN 9 THEN CASE event_type WHEN 'view' THEN 'student' WHEN 'click' THEN 'agriculture' WHEN 'error' THEN 'astronaut' ELSE 'salaried' END
    WHEN 10 THEN CASE WHEN event_type = 'signup' THEN 'True' ELSE 'False' END
    WHEN 12 THEN CASE event_type WHEN 'view' THEN 'UP' WHEN 'click' THEN 'bihar' ELSE 'TN' END
    WHEN 13 THEN CASE event_type WHEN 'view' THEN 'SC' WHEN 'click' THEN 'obc' ELSE 'minority' END
    WHEN 14 THEN CASE WHEN event_type IN ('view', 'click') THEN 'female' ELSE 'male' END ELSE NULL END AS text,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'no figure' ELSE concat('about ', CAST(CAST(floor(value) AS BIGINT) AS STRING)) END AS span
FROM {events}
"""

MESSAGES = [
    "I am {v} years old",
    "actually I am a widow from the village",
    "my husband is a farmer, kisan",
    "what if I open a bank account",
    "am i eligible for anything",
    "Hello!",
    "skip this, no idea",
    "thanks",
    "tell me about the pension scheme",
    "{v}",
    "yes",
    "I am a man and no longer a housewife",
    "pachaas saal ka hu aur do lakh kamata hu",
    "income is 2.5 lakh or Rs 3,00,{v}",
    "born in 1985, about 40 thousand a month",
    "{v}.5 bigha of land",
    "3 hectare and 1.2 crore",
    "मैं महिला हूँ, पता नहीं",
    "check again",
    "how do i apply",
    "ek  Hazar rupaye, DAS mahine, teen members",
    "",
]
_message_text = "|".join(MESSAGES)
MESSAGES_SQL = f"""
SELECT user_id AS conv_id, CAST({{day}} AS INT) AS turn, event_id AS seq,
       replace(split_part('{_message_text}', '|', CAST(1 + event_id % {len(MESSAGES)} AS INT)), '{{{{v}}}}', CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS message,
       event_type IN ('view', 'click') AS gathering, event_type = 'purchase' AS has_results
FROM {{events}}
""".replace("{v}", "{{v}}").replace("{{{v}}}", "{{v}}")

LANGUAGE_TEXTS_SQL = """
SELECT conv_id, turn, role, text FROM {conversations}
UNION ALL
SELECT conv_id, turn + 1000000 AS turn, role, CASE turn % 5 WHEN 0 THEN 'my name is ' WHEN 1 THEN 'मेरी उम्र पैंतीस साल है।' WHEN 2 THEN concat('मेरा नाम ', role, ' है')
   WHEN 3 THEN concat('mera naam ', role) ELSE ' ' END AS text FROM {conversations}
"""

RAW_VALUES_SQL = """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' Uttar Pradesh ' WHEN 1 THEN 'बिहार' WHEN 2 THEN 'tn' WHEN 3 THEN 'Atlantis' WHEN 4 THEN 'PONDICHERRY' WHEN 5 THEN 'OR'
         WHEN 6 THEN 'wb ' WHEN 7 THEN 'दिल्ली' ELSE event_type END AS state_raw,
  CASE event_id % 7 WHEN 0 THEN 'Dalit' WHEN 1 THEN ' obc' WHEN 2 THEN 'ews ' WHEN 3 THEN 'आदिवासी' WHEN 4 THEN 'Economically Weaker' WHEN 5 THEN 'General' ELSE 'minority' END AS caste_raw,
  CASE event_id % 8 WHEN 0 THEN concat(CAST(CAST(floor(value) AS BIGINT) AS STRING), '.5 lakh') WHEN 1 THEN '₹2,50,000' WHEN 2 THEN '1.2 Crore' WHEN 3 THEN concat(CAST(CAST(floor(value) AS BIGINT) AS STRING), ' hazar')
    WHEN 4 THEN 'nothing' WHEN 5 THEN '3 लाख' WHEN 6 THEN concat('Rs ', CAST(CAST(floor(value) AS BIGINT) AS STRING), ' pm') ELSE '12 thousand' END AS money_raw,
  CASE event_id % 6 WHEN 0 THEN concat(CAST(CAST(floor(value) AS BIGINT) AS STRING), ' bigha') WHEN 1 THEN '2.5 Hectare' WHEN 2 THEN concat(CAST(CAST(floor(value) AS BIGINT) AS STRING), '.25 acres')
    WHEN 3 THEN '4 बीघा' WHEN 4 THEN 'none' ELSE '7' END AS land_raw,
  CASE event_id % 5 WHEN 0 THEN concat('born in ', CAST(1950 + event_id % 60 AS STRING)) WHEN 1 THEN 'age 42 now' WHEN 2 THEN 'about 12345' WHEN 3 THEN 'unknown'
    ELSE concat(CAST(CAST(floor(value) AS BIGINT) AS STRING), ' years') END AS age_raw
FROM {events}
"""

# Name queries over orders.
NAME_QUERIES_SQL = """
SELECT o_orderkey AS query_id, concat('Tell me about the ', split_part('red,blue,small,hot,big,cold,new,old', ',', CAST(1 + o_orderkey % 8 AS INT)), ' ',
   split_part('widget,bolt,ring,anvil,gear,unicorn', ',', CAST(1 + o_custkey % 6 AS INT)), ' scheme') AS text FROM {orders}
"""
NAMES_SQL = """SELECT p_name AS scheme_id, min(p_partkey) AS position, concat('Yojana for ', p_name) AS scheme_name, replace(p_name, ' ', '') AS short_name FROM {part} GROUP BY p_name"""
