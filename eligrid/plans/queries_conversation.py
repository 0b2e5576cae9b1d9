"""Queries of conversation analytics, retrieval and what-if scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import vocab as V
from eligrid.operators import conversation as conv
from eligrid.operators import retrieval, whatif
from eligrid.plans import derive
from eligrid.plans import oracle_core as oc
from eligrid.plans.oracle_core import case_map, quoted
from eligrid.plans.registry import query
from eligrid.plans.views import Views
from eligrid.session import broadcast_if_small, checkpoint

YEAR = 2026

_EXT = derive.EXTRACTIONS_SQL.format(day=derive.DUCK_DAY, events="events")
_MSG = derive.MESSAGES_SQL.format(day=derive.DUCK_DAY, events="events")
_RAW = derive.RAW_VALUES_SQL.format(events="events")


def extractions(v: Views) -> DataFrame:
    return v.spark.sql(derive.EXTRACTIONS_SQL.replace("{day}", derive.SPARK_DAY), events=v.table("events"))


def messages(v: Views) -> DataFrame:
    return v.spark.sql(derive.MESSAGES_SQL.replace("{day}", derive.SPARK_DAY), events=v.table("events"))


def _collapsed(v: Views) -> DataFrame:
    return conv.collapse(extractions(v))


def lists(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _any(text: str, items) -> str:
    return f"len(list_filter({lists(items)}, lambda m: contains({text}, m))) > 0"


COLLAPSED = {
    "ext": _EXT,
    "col": "SELECT conv_id, turn, field, arg_max(struct_pack(num := num, text := text, span := span), seq) AS l FROM ext GROUP BY 1, 2, 3",
    "said": "SELECT conv_id, turn, field, l.num AS num, l.text AS text, l.span AS span FROM col",
}


def _with(final: str, **more: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({b})" for k, b in {**COLLAPSED, **more}.items()) + " " + final


# ---- labels -----------------------------------------------------------------

_LANG = derive.LANGUAGE_TEXTS_SQL.format(conversations="conversations")
_CNT = lambda p: f"len(regexp_extract_all(t, '{p}'))"


@query(
    "conv_language",
    rf"""SELECT conv_id, turn, CASE WHEN t = '' THEN 'en' WHEN d >= 0.8 THEN 'hi' WHEN d >= 0.2 AND l >= 0.2 THEN 'hinglish' WHEN l >= 0.8 THEN CASE WHEN marked THEN 'hinglish' ELSE 'en' END ELSE 'en' END AS language,
      CASE WHEN t = '' THEN 1.0 WHEN d >= 0.8 THEN 0.95 WHEN d >= 0.2 AND l >= 0.2 THEN 0.85 WHEN l >= 0.8 THEN CASE WHEN marked THEN 0.75 ELSE 0.9 END ELSE 0.5 END::DOUBLE AS confidence,
      CASE WHEN t = '' THEN 'latin' WHEN d >= 0.8 THEN 'devanagari' WHEN d >= 0.2 AND l >= 0.2 THEN 'mixed' ELSE 'latin' END AS script
    FROM (SELECT *, deva / (latin + deva + greatest(other, 1)) AS d, latin / (latin + deva + greatest(other, 1)) AS l,
            len(list_intersect(words, {lists(V.HINGLISH_MARKERS)})) >= CASE WHEN len(words) <= 6 THEN 1 ELSE 2 END AS marked
          FROM (SELECT *, length(t) - sp - pu - latin - deva AS other FROM (
            SELECT conv_id, turn, t, {_CNT('[A-Za-z]')} AS latin, {_CNT('[\\x{0900}-\\x{0963}\\x{0966}-\\x{096F}\\x{0971}-\\x{097F}]')} AS deva, {_CNT('\\s')} AS sp, {_CNT('\\p{P}')} AS pu,
                   regexp_extract_all(lower(t), '[a-zA-Z]+') AS words
            FROM (SELECT conv_id, turn, trim(text) AS t FROM ({_LANG})))))""",
)
def conv_language(v: Views) -> DataFrame:
    texts = v.spark.sql(derive.LANGUAGE_TEXTS_SQL, conversations=v.table("conversations"))
    return texts.withColumn("d", conv.language(F.col("text"))).select("conv_id", "turn", "d.language", "d.confidence", "d.script")


_T = "lower(trim(message))"
INTENT = f"""CASE WHEN t = '' THEN 'confirm' WHEN t IN ({quoted(V.CONFIRM_EXACT)}) THEN CASE WHEN gathering THEN 'provide_info' ELSE 'confirm' END
  WHEN regexp_replace(t, '[!.?,]+$', '') IN ({quoted(V.GREETINGS)}) THEN 'greeting' WHEN {_any('t', V.SKIPS)} THEN 'skip_field'
  WHEN regexp_replace(t, '[!.?]+$', '') IN ({quoted(V.EXITS_WORD)}) OR len(list_filter({lists(V.EXITS_PHRASE)}, lambda m: starts_with(t, m))) > 0 THEN 'exit'
  WHEN {_any('t', V.CORRECTION_INTENT)} THEN 'correct_info' WHEN {_any('t', V.MATCH_TRIGGERS)} OR t IN ({quoted(V.MATCH_EXACT)}) THEN 'trigger_matching'
  WHEN {_any('t', V.WHAT_IFS)} THEN 'what_if' WHEN len(list_filter({lists(V.QUESTIONS)}, lambda m: t = m OR starts_with(t, m || ' '))) > 0 THEN 'ask_question'
  WHEN regexp_matches(t, '^[0-9]+$') THEN CASE WHEN has_results AND NOT gathering THEN 'request_detail' ELSE 'provide_info' END ELSE 'provide_info' END"""


@query("conv_intent", f"SELECT seq, {INTENT} AS intent FROM (SELECT *, {_T} AS t FROM ({_MSG}))")
def conv_intent(v: Views) -> DataFrame:
    return messages(v).select("seq", conv.intent(F.col("message"), F.col("gathering"), F.col("has_results")).alias("intent"))


_CORR = f"({_any('lower(message)', V.CORRECTIONS_EN)} OR {_any('message', V.CORRECTIONS_HI)})"


@query("conv_correction", f"SELECT seq, {_CORR} AS correction FROM ({_MSG})")
def conv_correction(v: Views) -> DataFrame:
    return messages(v).select("seq", conv.is_correction(F.col("message")).alias("correction"))


_INF_ROWS = ", ".join("({}, '{}', '{}', '{}')".format(i, w.replace("'", "''"), f, val) for i, (w, f, val) in enumerate(V.INFERENCES))
INFERRED = {
    "msg": _MSG,
    "inf": f"""SELECT conv_id, turn, seq, field, value, trigger FROM (
      SELECT m.conv_id, m.turn, m.seq, t.field, t.value, t.trigger, row_number() OVER (PARTITION BY m.seq, t.field ORDER BY t.i) AS rn
      FROM msg m JOIN (VALUES {_INF_ROWS}) t(i, trigger, field, value) ON contains(lower(m.message), t.trigger)) WHERE rn = 1""",
}


def _inferred(v: Views) -> DataFrame:
    return messages(v).select("conv_id", "turn", "seq", F.inline(conv.inferences(F.col("message")))).drop("i")


@query("conv_inference", _with("SELECT seq, field, value, trigger FROM inf", **INFERRED))
def conv_inference(v: Views) -> DataFrame:
    return _inferred(v).select("seq", "field", "value", "trigger")


@query("join_inference", _with("SELECT field, value, trigger, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM inf GROUP BY 1, 2, 3", **INFERRED))
def join_inference(v: Views) -> DataFrame:
    per_conv = _inferred(v).groupBy("field", "value", "trigger", "conv_id").agg(F.count("*").alias("n"))
    return per_conv.groupBy("field", "value", "trigger").agg(F.sum("n").alias("n"), F.count("*").alias("conversations"))


# ---- normalisers ------------------------------------------------------------


def _raw(v: Views) -> DataFrame:
    return v.spark.sql(derive.RAW_VALUES_SQL, events=v.table("events"))


_STATES = ", ".join(f"('{k}', '{c}')" for k, c in V.STATE_ALIASES.items())
_CASTES = ", ".join(f"('{k}', '{c}')" for k, c in V.CASTE_ALIASES.items())


@query(
    "norm_state_caste",
    f"""SELECT event_id, coalesce(s.code, CASE WHEN length(trim(state_raw)) = 2 AND upper(trim(state_raw)) IN ({quoted(V.STATE_CODES_KNOWN)}) THEN upper(trim(state_raw)) END, state_raw) AS state,
      coalesce(c.code, CASE WHEN upper(trim(caste_raw)) IN ('SC', 'ST', 'OBC', 'GENERAL', 'EWS') THEN upper(trim(caste_raw)) END, caste_raw) AS caste
    FROM ({_RAW}) r LEFT JOIN (VALUES {_STATES}) s(alias, code) ON s.alias = lower(trim(state_raw)) LEFT JOIN (VALUES {_CASTES}) c(alias, code) ON c.alias = lower(trim(caste_raw))""",
)
def norm_state_caste(v: Views) -> DataFrame:
    return _raw(v).select("event_id", conv.state_code(F.col("state_raw")).alias("state"), conv.caste_code(F.col("caste_raw")).alias("caste"))


_M = "lower(replace(replace(money_raw, ',', ''), '₹', ''))"
_X = lambda t, p: f"TRY_CAST(nullif(regexp_extract({t}, '{p}', 1), '') AS DOUBLE)"
_MONEY = "coalesce(" + ", ".join(f"CAST(trunc({_X(_M, chr(40) + '[0-9.]+)' + chr(92) + 's*' + u)} * {by}) AS BIGINT)" for u, by in V.MONEY_UNITS) + f", CAST(trunc({_X(_M, '([0-9.]+)')}) AS BIGINT), 0)"


@query("norm_currency", f"SELECT event_id, {_MONEY} AS amount FROM ({_RAW})")
def norm_currency(v: Views) -> DataFrame:
    return _raw(v).select("event_id", conv.money(F.col("money_raw")).alias("amount"))


_LAND = "coalesce(" + ", ".join(f"round({_X('lower(land_raw)', '([0-9.]+)' + chr(92) + 's*' + u)} * {by}, 2)" for u, by in V.LAND_UNITS) + f", {_X('land_raw', '([0-9.]+)')}, 0.0)"


@query("norm_land", f"SELECT event_id, {_LAND} AS acres FROM ({_RAW})")
def norm_land(v: Views) -> DataFrame:
    return _raw(v).select("event_id", conv.land(F.col("land_raw")).alias("acres"))


@query(
    "norm_age",
    rf"""SELECT event_id, coalesce({YEAR} - TRY_CAST(nullif(regexp_extract(age_raw, '\b((?:19|20)[0-9][0-9])\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(age_raw, '([0-9]+)', 1), '') AS INT), 0) AS age FROM ({_RAW})""",
)
def norm_age(v: Views) -> DataFrame:
    return _raw(v).select("event_id", conv.age(F.col("age_raw"), YEAR).alias("age"))


_NP = r"(?i)\b(" + "|".join(V.NUMBER_WORDS) + r")\s+" + V.NUMBER_UNITS
_NW = case_map("lower(w)", {k: n for k, n in V.NUMBER_WORDS.items()})


@query(
    "norm_hinglish_numbers",
    f"""SELECT seq, string_agg(gap || coalesce(CASE WHEN lower(u) IN ('hazar', 'hazaar') THEN CAST(({_NW}) * 1000 AS STRING) WHEN lower(u) IN ('lakh', 'lac') THEN CAST(({_NW}) * 100000 AS STRING)
        ELSE CAST(({_NW}) AS STRING) || ' ' || lower(u) END, ''), '' ORDER BY i) AS message FROM (
      SELECT seq, unnest(range(len(gaps))) AS i, unnest(gaps) AS gap, unnest(list_resize(ws, len(gaps))) AS w, unnest(list_resize(us, len(gaps))) AS u FROM (
        SELECT seq, string_split_regex(message, '{_NP}') AS gaps, regexp_extract_all(message, '{_NP}', 1) AS ws, regexp_extract_all(message, '{_NP}', 2) AS us FROM ({_MSG}))) GROUP BY 1""",
)
def norm_hinglish_numbers(v: Views) -> DataFrame:
    return messages(v).select("seq", conv.number_words(F.col("message")).alias("message"))


# ---- guard ------------------------------------------------------------------

_B = {**V.BOUNDS, "applicant.birth_year": (V.BIRTH_YEAR_FLOOR, YEAR)}
_LO, _HI = case_map("field", {k: float(b[0]) for k, b in _B.items()}), case_map("field", {k: float(b[1]) for k, b in _B.items()})
_RANGE = f"(num < {_LO} OR num > {_HI})"
_VOCAB = "CASE field " + " ".join(f"WHEN '{f}' THEN lower(text) NOT IN ({quoted(ws)})" for f, ws in V.ALLOWED.items()) + " END"
_ANCHOR = f"(field IN ({quoted(V.NUMERIC_FIELDS)}) AND (coalesce(span, '') IN ('', 'null', 'None') OR NOT regexp_matches(span, '[0-9,.]')))"


def _guard(name: str, check: str, cond: str, status: str):
    @query(name, _with(f"SELECT conv_id, turn, field, '{status}' AS status FROM said WHERE coalesce({cond}, false)"))
    def run(v: Views) -> DataFrame:
        issues = _collapsed(v).select("conv_id", "turn", "field", F.inline(conv.guard_issues(YEAR)))
        return issues.where(F.col("check") == check).drop("check")


_guard("ner_range", "range", _RANGE, "REJECT")
_guard("ner_vocab", "vocab", _VOCAB, "WARN")
_guard("ner_anchor", "anchor", _ANCHOR, "WARN")

_PIVOT = "max(num) FILTER (field = 'applicant.age') AS age, max(num) FILTER (field = 'applicant.birth_year') AS born, max(num) FILTER (field = 'household.income_monthly') AS monthly, max(num) FILTER (field = 'household.income_annual') AS annual"
GUARD = {
    "ok": f"SELECT * FROM said WHERE NOT coalesce({_RANGE}, false)",
    "wide": f"SELECT conv_id, turn, {_PIVOT} FROM ok GROUP BY 1, 2",
    "crossed": f"""SELECT conv_id, turn, 'applicant.age' AS field FROM wide WHERE abs(({YEAR} - floor(born)) - floor(age)) > 2
      UNION ALL SELECT conv_id, turn, 'household.income_monthly' FROM wide WHERE annual > 0 AND abs(monthly * 12 - annual) / annual > 0.25""",
}


@query("ner_cross", _with("SELECT * FROM crossed", **GUARD))
def ner_cross(v: Views) -> DataFrame:
    rows = _collapsed(v).withColumn("issues", conv.guard_issues(YEAR))
    return conv.guard_cross(rows.where(~F.exists("issues", lambda i: i["status"] == "REJECT")), YEAR)


@query(
    "ner_report",
    _with(
        f"""SELECT s.conv_id, s.turn, s.field, CASE WHEN coalesce({_RANGE}, false) THEN 'rejected' WHEN coalesce({_VOCAB}, false) OR {_ANCHOR} OR c.field IS NOT NULL THEN 'warned' ELSE 'passed' END AS verdict,
             CAST(coalesce({_RANGE}, false) AS BIGINT) + CAST(coalesce({_VOCAB}, false) AS BIGINT) + CAST({_ANCHOR} AS BIGINT) AS n_issues
        FROM said s LEFT JOIN crossed c USING (conv_id, turn, field)""".replace("CASE field", "CASE s.field").replace("(field IN", "(s.field IN"),
        **GUARD,
    ),
)
def ner_report(v: Views) -> DataFrame:
    return conv.guard_report(_collapsed(v), YEAR).withColumn("n_issues", F.col("n_issues").cast("long"))


# ---- contradictions ---------------------------------------------------------

_CRIT = quoted(V.CRITICAL_FIELDS)
DIRECT = {
    "lagged": """SELECT *, lag(num) OVER w AS old_num, lag(text) OVER w AS old_text, lag(turn) OVER w AS old_turn FROM said WINDOW w AS (PARTITION BY conv_id, field ORDER BY turn)""",
    "direct": f"""SELECT conv_id, turn, field, old_turn, CASE WHEN field IN ({_CRIT}) THEN CASE WHEN old_num <> 0 AND abs(num - old_num) / abs(old_num) <= 0.1 THEN 'warning' ELSE 'blocking' END ELSE 'warning' END AS severity
      FROM lagged WHERE old_turn IS NOT NULL AND (num <> old_num OR text <> old_text)""",
}


@query("contra_direct", _with("SELECT * FROM direct", **DIRECT))
def contra_direct(v: Views) -> DataFrame:
    return conv.direct(_collapsed(v)).select("conv_id", "turn", "field", "old_turn", "severity")


@query("join_extraction_profile", _with("SELECT conv_id, field, turn, num, text, old_num, old_text FROM lagged WHERE old_turn IS NOT NULL", **DIRECT))
def join_extraction_profile(v: Views) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id", "field").orderBy("turn")
    rows = _collapsed(v).withColumns({"old_num": F.lag("num").over(w), "old_text": F.lag("text").over(w), "old_turn": F.lag("turn").over(w)})
    return rows.where("old_turn IS NOT NULL").select("conv_id", "field", "turn", "num", "text", "old_num", "old_text")


@query(
    "contra_intra",
    _with(
        f"""SELECT conv_id, turn, 'age_birth' AS pair, 'blocking' AS severity FROM w WHERE abs(floor(age) - ({YEAR} - floor(born))) > 1
        UNION ALL SELECT conv_id, turn, 'income', 'warning' FROM w WHERE abs(floor(monthly) * 12 - floor(annual)) / greatest(floor(annual), 1) > 0.2""",
        w=f"SELECT conv_id, turn, {_PIVOT} FROM said GROUP BY 1, 2",
    ),
)
def contra_intra(v: Views) -> DataFrame:
    return conv.within_message(_collapsed(v), YEAR)


@query(
    "contra_implicit",
    _with(
        """SELECT s.conv_id, s.turn, s.field, s.text, arg_max(i.value, CAST(i.turn AS BIGINT) * 1000000000 + i.seq) AS assumed
        FROM said s JOIN inf i ON i.conv_id = s.conv_id AND i.field = s.field AND i.turn < s.turn WHERE s.text IS NOT NULL GROUP BY 1, 2, 3, 4
        HAVING arg_max(i.value, CAST(i.turn AS BIGINT) * 1000000000 + i.seq) <> s.text""",
        **INFERRED,
    ),
)
def contra_implicit(v: Views) -> DataFrame:
    return conv.implicit(_collapsed(v), _inferred(v))


_CROSS_COLS = ", ".join(f"max({kind}) FILTER (field = '{f}') AS {name}" for name, (f, kind) in conv.CROSS_FIELDS.items())
_CARRY = ", ".join(f"last_value({n} IGNORE NULLS) OVER w AS {n}" for n in conv.CROSS_FIELDS)
_CROSS_RULES = (
    ("income_monthly_annual_consistency", "warning", "abs(monthly * 12 - annual) / greatest(annual, 1) > 0.2"),
    ("tax_payer_income_threshold", "warning", "tax = 'True' AND annual < 250000"),
    ("disability_percentage_without_status", "warning", "disabled = 'False' AND pct > 0"),
    ("age_birth_year_consistency", "blocking", f"abs(age - ({YEAR} - born)) > 1"),
    ("bank_account_type_without_account", "warning", "account = 'False' AND account_type IS NOT NULL"),
    ("minor_with_employment", "blocking", "age < 14 AND job <> 'student'"),
    ("land_ownership_without_acres", "info", "owns = 'True' AND acres = 0"),
)


@query(
    "contra_cross",
    _with(
        " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS rule, '{s}' AS severity FROM now WHERE {c}" for n, s, c in _CROSS_RULES),
        wide=f"SELECT conv_id, turn, {_CROSS_COLS} FROM said GROUP BY 1, 2",
        now=f"SELECT conv_id, turn, {_CARRY} FROM wide WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    ),
)
def contra_cross(v: Views) -> DataFrame:
    return conv.cross_field(_collapsed(v), YEAR)


@query(
    "contra_resolve",
    _with(
        f"""SELECT d.conv_id, d.turn, d.field, CASE WHEN severity = 'blocking' AND c.turn IS NOT NULL THEN 'info' ELSE severity END AS severity
        FROM direct d LEFT JOIN (SELECT DISTINCT conv_id, turn FROM msg WHERE {_CORR}) c USING (conv_id, turn)""",
        **DIRECT,
        msg=_MSG,
    ),
)
def contra_resolve(v: Views) -> DataFrame:
    corrected = messages(v).where(conv.is_correction(F.col("message")))
    return conv.resolve(conv.direct(_collapsed(v)), corrected).select("conv_id", "turn", "field", "severity")


# ---- sessions ---------------------------------------------------------------


@query(
    "session_profile",
    _with(
        """SELECT conv_id, field, arg_max(struct_pack(n := num), turn).n AS num, arg_max(struct_pack(t := text), turn).t AS text, max(turn) AS source_turn,
           CASE WHEN count(*) > 1 THEN 'update' ELSE 'set' END AS change_type FROM said GROUP BY 1, 2"""
    ),
)
def session_profile(v: Views) -> DataFrame:
    return conv.session_profile(_collapsed(v))


_VIABLE = quoted(V.VIABLE_FIELDS)


@query("session_viable", _with(f"SELECT conv_id, count(DISTINCT field) AS n_fields, count(DISTINCT field) FILTER (field IN ({_VIABLE})) = 4 AS viable FROM said GROUP BY 1"))
def session_viable(v: Views) -> DataFrame:
    return conv.viability(_collapsed(v)).withColumn("n_fields", F.col("n_fields").cast("long"))


@query(
    "session_match_trigger",
    _with(
        f"""SELECT conv_id, min(turn_no) AS trigger_turn, max(n_turns) AS n_turns FROM (
          SELECT t.conv_id, t.turn_no, t.n_turns, count(DISTINCT s.field) AS known, count(DISTINCT s.field) FILTER (s.field IN ({_VIABLE})) AS have
          FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM (SELECT DISTINCT conv_id, turn FROM said)) t
          JOIN said s ON s.conv_id = t.conv_id AND s.turn <= t.turn GROUP BY 1, 2, 3)
        WHERE turn_no > 1 AND (have = 4 OR (turn_no >= {V.MAX_TURNS} AND known >= 2)) GROUP BY 1"""
    ),
)
def session_match_trigger(v: Views) -> DataFrame:
    return conv.match_trigger(_collapsed(v)).select("conv_id", F.col("trigger_turn").cast("long").alias("trigger_turn"), F.col("n_turns").cast("long").alias("n_turns"))


@query(
    "session_trim",
    """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down,
      count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE n <= 7 OR up = 1 OR down <= 6""",
)
def session_trim(v: Views) -> DataFrame:
    return conv.trim(v.table("conversations")).select("conv_id", "turn", "role")


@query(
    "session_expiry",
    """SELECT user_id AS conv_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS turns FROM (
      SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 72 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, s""",
)
def session_expiry(v: Views) -> DataFrame:
    """Sessions end after 72 hours of silence; sessions merge map-side before the shuffle."""
    e = v.table("events")
    return e.groupBy(F.col("user_id").alias("conv_id"), F.session_window("ts", "72 hours")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("last_seen"), F.count("*").alias("turns")
    ).drop("session_window")


@query(
    "followup_priority",
    _with(
        f"""SELECT conv_id, array_to_string(list_filter({lists(V.QUESTION_ORDER)}, lambda q: NOT list_contains(known, q)), ',') AS questions
        FROM (SELECT conv_id, list(DISTINCT field) AS known FROM said GROUP BY 1)"""
    ),
)
def followup_priority(v: Views) -> DataFrame:
    return conv.followups(_collapsed(v)).withColumn("questions", F.array_join("questions", ","))


# ---- retrieval --------------------------------------------------------------

_TOK = r"[a-zA-Z\x{0900}-\x{097F}]+"


def _index(docs: str, key: str) -> dict[str, str]:
    return {
        "toks": f"SELECT {key}, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM ({docs})",
        "tc": f"SELECT {key}, term, count(*) AS c, sum(count(*)) OVER (PARTITION BY {key}) AS total FROM toks GROUP BY 1, 2",
        "idf": f"SELECT term, count(*) AS df, ln(((SELECT count(*) FROM ({docs})) + 1) / (count(*) + 1)) + 1 AS idf FROM tc GROUP BY 1",
        "post": f"SELECT {key}, term, c / total * idf AS weight FROM tc JOIN idf USING (term)",
    }


@query(
    "rag_tfidf_build",
    "WITH " + ", ".join(f"{k} AS ({b})" for k, b in _index("SELECT doc_id, text FROM documents", "doc_id").items())
    + " SELECT term, df, round(idf, 6) AS idf, round(w, 6) AS weight FROM idf JOIN (SELECT term, sum(weight) AS w FROM post GROUP BY 1) USING (term)",
)
def rag_tfidf_build(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", "text")
    counts = retrieval.term_counts(docs, "doc_id", "text")
    per_term = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.col("c") / F.col("total")).alias("tf"))
    n = docs.agg(F.count("*")).scalar()
    weighted = F.log((n + 1) / (F.col("df") + 1)) + 1
    return per_term.select("term", "df", F.round(weighted, 6).alias("idf"), F.round(F.col("tf") * weighted, 6).alias("weight"))


_QTC = f"SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM benchmark) GROUP BY 1, 2"


@query(
    "rag_query",
    "WITH " + ", ".join(f"{k} AS ({b})" for k, b in _index("SELECT doc_id, text FROM documents", "doc_id").items())
    + f""", qt AS ({_QTC}) SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT item_id, doc_id, round(sum(q * weight), 9) AS score FROM qt JOIN post USING (term) GROUP BY 1, 2)) WHERE rank <= 3 AND score > 0""",
)
def rag_query(v: Views) -> DataFrame:
    """Documents for each benchmark passage; only terms of the queries are counted at all."""
    docs = v.table("documents").select("doc_id", "text")
    asked = retrieval.term_counts(v.table("benchmark"), "item_id", "text").select("item_id", "term", "c")
    found = retrieval.top_k_of_texts(asked, docs, "item_id", "doc_id", "text", 3)
    if found is not None:
        return found.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))
    vocabulary = broadcast_if_small(asked.select("term").distinct())
    rows = docs.select("doc_id", retrieval.tokens(F.col("text")).alias("toks")).select("doc_id", F.size("toks").alias("total"), F.explode("toks").alias("term"))
    # Written once: frequencies, bounds and scores all read these counts.
    counts = checkpoint(rows.join(vocabulary, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("k"), F.first("total").alias("total")))
    n = docs.agg(F.count("*")).scalar()
    idf = counts.groupBy("term").agg((F.log((n + 1) / (F.count("*") + 1)) + 1).alias("idf"))
    weighted = counts.join(idf, "term").select("doc_id", "term", "total", (F.col("k") / F.col("total") * F.col("idf")).alias("weight"))
    index = checkpoint(retrieval.blocked(weighted, F.col("total")).drop("total"))
    return retrieval.top_k_pruned(asked, index, "item_id", "doc_id", 3).select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_RAG_DOCS = """SELECT s.scheme_id, s.position, concat_ws(' ', scheme_name, ministry, s.state_scope, body) AS text FROM (SELECT * FROM schemes WHERE status = 'active') s LEFT JOIN (
  SELECT scheme_id, string_agg(concat_ws(' ', display_text, rule_id, field, display_text), ' ' ORDER BY ord) AS body FROM active GROUP BY 1) USING (scheme_id)"""


def _scheme_docs(v: Views) -> DataFrame:
    return retrieval.scheme_documents(v.schemes().where("status = 'active'"), v.bound_rules())


@query("rag_document", oc.sql("SELECT * FROM rdocs", rdocs=_RAG_DOCS))
def rag_document(v: Views) -> DataFrame:
    return _scheme_docs(v)


# A profile's query: every known field path with its value.
_PTEXT = """SELECT profile_id, string_agg(field || ' ' || us, ' ' ORDER BY field) AS text FROM profile_fields WHERE uk NOT IN ('null', 'list') GROUP BY 1"""
RAG = {
    "rdocs": _RAG_DOCS,
    **_index("SELECT scheme_id, text FROM rdocs", "scheme_id"),
    "ptext": _PTEXT,
    "qt": f"SELECT profile_id, term, count(*) AS q FROM (SELECT profile_id, unnest(regexp_extract_all(lower(text), '{_TOK}')) AS term FROM ptext) GROUP BY 1, 2",
    "hits": """SELECT profile_id, scheme_id, score FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY score DESC, scheme_id) AS rank FROM (
      SELECT profile_id, scheme_id, round(sum(q * weight), 9) AS score FROM qt JOIN post USING (term) GROUP BY 1, 2)) WHERE rank <= 5 AND score > 0""",
    "need": "SELECT scheme_id, list(DISTINCT field) AS required FROM active GROUP BY 1",
    "have": "SELECT profile_id, list(field) AS known FROM profile_fields WHERE uk <> 'null' GROUP BY 1",
    "ctx": """SELECT h.*, required, list_filter(required, lambda f: NOT list_contains(known, f)) AS gaps FROM hits h JOIN need USING (scheme_id) JOIN have USING (profile_id)""",
}


def _contexts(v: Views, k: int = 5) -> DataFrame:
    pairs = F.concat(
        F.transform(
            F.arrays_zip(F.array(*[F.lit(p) for p, _ in model.PROFILE_FIELDS]).alias("field"), F.col("cells").alias("cell")),
            lambda z: F.struct(z["field"].alias("field"), z["cell"].alias("cell")),
        ),
        F.transform(F.map_entries("extras"), lambda e: F.struct(e["key"].alias("field"), e["value"].alias("cell"))),
    )
    said = F.filter(pairs, lambda p: ~p["cell"]["kind"].isin("null", "list"))
    base = v.profile_cells().withColumn("pairs", pairs)
    texts = base.select("profile_id", F.array_join(F.transform(said, lambda p: F.concat_ws(" ", p["field"], p["cell"]["s"])), " ").alias("text"))
    known = base.select("profile_id", F.transform(F.filter("pairs", lambda p: p["cell"]["kind"] != "null"), lambda p: p["field"]).alias("known"))
    asked = retrieval.term_counts(texts, "profile_id", "text").select("profile_id", "term", "c")
    index = retrieval.postings(_scheme_docs(v), "scheme_id", "text")
    hits = retrieval.top_k(asked, index, "profile_id", "scheme_id", k, small="index")
    required = v.bound_rules().groupBy("scheme_id").agg(F.array_sort(F.collect_set("field")).alias("required"))
    return retrieval.contexts(hits, required, known, "profile_id")


@query(
    "rag_context",
    oc.sql(
        """SELECT profile_id, scheme_id, score, array_to_string(list_sort(gaps), ',') AS gaps, round((len(required) - len(gaps)) / greatest(len(required), 1), 2) AS coverage,
           CASE WHEN score > 0.5 THEN 'high' WHEN score > 0.2 THEN 'medium' ELSE 'low' END AS relevance FROM ctx""",
        **RAG,
    ),
)
def rag_context(v: Views) -> DataFrame:
    return _contexts(v).select("profile_id", "scheme_id", "score", F.array_join(F.array_sort("gaps"), ",").alias("gaps"), "coverage", "relevance")


_RANKED = f"""SELECT profile_id, field, schemes, row_number() OVER (PARTITION BY profile_id ORDER BY schemes DESC, field) AS rank FROM (
  SELECT profile_id, field, count(*) AS schemes FROM (SELECT profile_id, unnest(gaps) AS field FROM ctx) WHERE field IN ({quoted(V.QUESTION_ORDER)}) GROUP BY 1, 2)"""


@query("rag_gap_rank", oc.sql(_RANKED, **RAG))
def rag_gap_rank(v: Views) -> DataFrame:
    return retrieval.gap_rank(_contexts(v), "profile_id").withColumn("rank", F.col("rank").cast("long"))


@query("rag_questions", oc.sql(f"SELECT profile_id, string_agg(field, ',' ORDER BY rank) AS questions FROM ({_RANKED}) WHERE rank <= 3 GROUP BY 1", **RAG))
def rag_questions(v: Views) -> DataFrame:
    top = retrieval.gap_rank(_contexts(v), "profile_id").where("rank <= 3")
    return top.groupBy("profile_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "field"))), lambda x: x["field"]), ",").alias("questions")
    )


_NAMEQ = derive.NAME_QUERIES_SQL.format(orders="orders")
_NAMES = derive.NAMES_SQL.format(part="part")


@query(
    "scheme_name_search",
    f"""SELECT query_id, arg_max(scheme_id, hits * 1000000000 - position) AS scheme_id, max(hits) AS hits FROM (
      SELECT q.query_id, n.scheme_id, n.position, count(*) AS hits FROM (
        SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9]+')) AS word FROM ({_NAMEQ})) WHERE word NOT IN ({quoted(V.STOP_WORDS)})) q
      JOIN ({_NAMES}) n ON contains(lower(concat_ws(' ', n.scheme_name, n.short_name)), q.word) GROUP BY 1, 2, 3) GROUP BY 1""",
)
def scheme_name_search(v: Views) -> DataFrame:
    names = v.spark.sql(derive.NAMES_SQL, part=v.table("part"))
    return retrieval.name_search(v.spark.sql(derive.NAME_QUERIES_SQL, orders=v.table("orders")), names)


# ---- what-if ----------------------------------------------------------------

CHANGES = {f: (f, True, "bool") for f, _, _ in V.SUGGESTIONS}


def _what_if(v: Views) -> DataFrame:
    if "whatif" not in v._plans:
        changes = {n: (f, F.lit(val), kind) for n, (f, val, kind) in CHANGES.items()}
        v._plans["whatif"] = whatif.evaluate(v.profile_cells(), v.nested_rules(), changes)
    return v._plans["whatif"]


def _scenario_ctes() -> dict[str, str]:
    """The determination CTEs once more over profiles widened by scenario."""
    names = ["current", *CHANGES]
    rows = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    replaced = ", ".join(
        f"CASE WHEN s.i = {i} THEN true ELSE p.{model.column_of(f)} END AS {model.column_of(f)}" for i, f in enumerate(CHANGES, start=1)
    )
    ctes = dict(oc.CTES)
    base = ctes["profiles"]
    ctes["profiles"] = f"SELECT p.* REPLACE (p.profile_id * 10 + s.i AS profile_id, {replaced}) FROM ({base}) p CROSS JOIN (VALUES {rows}) s(i, name)"
    return ctes


_CHANGE = """CASE WHEN old_status = new_status THEN 'unchanged' WHEN nr > orank THEN CASE WHEN new_status = 'ELIGIBLE' THEN 'gained' ELSE 'improved' END
  WHEN nr < orank THEN CASE WHEN old_status = 'ELIGIBLE' THEN 'lost' ELSE 'worsened' END ELSE 'none' END"""
_RANK = lambda c: f"CASE {c} WHEN 'ELIGIBLE' THEN 3 WHEN 'NEAR_MISS' THEN 2 WHEN 'INSUFFICIENT_DATA' THEN 1 ELSE 0 END"


def _scenario_sql(final: str) -> str:
    ctes = _scenario_ctes()
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(CHANGES, start=1))
    ctes["pairs"] = f"""SELECT CAST(floor(b.profile_id / 10) AS BIGINT) AS profile_id, b.scheme_id, n.name AS scenario, b.status AS old_status, d.status AS new_status
      FROM dets b JOIN dets d ON d.scheme_id = b.scheme_id AND CAST(floor(d.profile_id / 10) AS BIGINT) = CAST(floor(b.profile_id / 10) AS BIGINT)
      JOIN (VALUES {names}) n(i, name) ON n.i = d.profile_id % 10 WHERE b.profile_id % 10 = 0"""
    ctes["changes"] = f"SELECT *, {_CHANGE} AS change FROM (SELECT *, {_RANK('old_status')} AS orank, {_RANK('new_status')} AS nr FROM pairs)"
    return "WITH " + ",\n".join(f"{k} AS ({b})" for k, b in ctes.items()) + "\n" + final


@query("whatif_apply", _scenario_sql("SELECT scenario, scheme_id, new_status AS status, count(*) AS n FROM pairs GROUP BY 1, 2, 3"))
def whatif_apply(v: Views) -> DataFrame:
    rows = whatif.aligned(_what_if(v), list(CHANGES))
    return rows.groupBy("scenario", "scheme_id", F.col("new_status").alias("status")).agg(F.count("*").alias("n"))


_COUNTS = ", ".join(f"count(*) FILTER (change = '{c}') AS {c}" for c in ("gained", "lost", "improved", "worsened", "unchanged"))
_IMPACT = """count(*) FILTER (old_status = 'ELIGIBLE') AS current_eligible, count(*) FILTER (new_status = 'ELIGIBLE') AS what_if_eligible,
  CASE WHEN count(*) FILTER (new_status = 'ELIGIBLE') > count(*) FILTER (old_status = 'ELIGIBLE') THEN 'positive'
       WHEN count(*) FILTER (new_status = 'ELIGIBLE') < count(*) FILTER (old_status = 'ELIGIBLE') THEN 'negative' ELSE 'neutral' END AS net_impact"""


@query("whatif_compare", _scenario_sql(f"SELECT profile_id, scenario, {_COUNTS}, {_IMPACT} FROM changes GROUP BY 1, 2"))
def whatif_compare(v: Views) -> DataFrame:
    return whatif.compare(whatif.aligned(_what_if(v), list(CHANGES)), ["profile_id", "scenario"])


# A scheme that starts or ends between two evaluations has a status on one side only.
_NEW, _ENDED = "position % 5 = 0", "position % 5 = 1"


@query(
    "join_whatif",
    _scenario_sql(
        f"""SELECT profile_id, {_COUNTS}, {_IMPACT} FROM (SELECT *, {_CHANGE} AS change FROM (SELECT *, {_RANK('old_status')} AS orank, {_RANK('new_status')} AS nr FROM (
          SELECT profile_id, CASE WHEN {_NEW} THEN 'INELIGIBLE' ELSE old_status END AS old_status, CASE WHEN {_ENDED} THEN 'INELIGIBLE' ELSE new_status END AS new_status
          FROM pairs JOIN schemes USING (scheme_id) WHERE scenario = '{next(iter(CHANGES))}'))) GROUP BY 1"""
    ),
)
def join_whatif(v: Views) -> DataFrame:
    """The profile as it is against a scenario; each side lacks schemes the other has."""
    rows = whatif.aligned(_what_if(v), list(CHANGES)).where(F.col("scenario") == next(iter(CHANGES)))
    rows = rows.join(v.schemes().select("scheme_id", "position"), "scheme_id")
    old = rows.where(f"NOT ({_NEW})").select("profile_id", "scheme_id", F.col("old_status").alias("status"))
    new = rows.where(f"NOT ({_ENDED})").select("profile_id", "scheme_id", F.col("new_status").alias("status"))
    return whatif.compare(whatif.join_results(old, new), ["profile_id"])


_OPTIONS = ", ".join(f"({i}, '{f}', '{t}', {p})" for i, (f, t, p) in enumerate(V.SUGGESTIONS))


@query(
    "whatif_suggest",
    oc.sql(
        f"""SELECT profile_id, rank, field, suggestion, potential FROM (
          SELECT p.profile_id, o.field, o.suggestion, o.potential, row_number() OVER (PARTITION BY p.profile_id ORDER BY o.potential DESC, o.i) AS rank
          FROM profiles p CROSS JOIN (VALUES {_OPTIONS}) o(i, field, suggestion, potential)
          WHERE NOT coalesce(CASE o.field {' '.join(f"WHEN '{f}' THEN p.{model.column_of(f)}" for f, _, _ in V.SUGGESTIONS)} END, false)) WHERE rank <= 3"""
    ),
)
def whatif_suggest(v: Views) -> DataFrame:
    return whatif.suggestions(v.profiles()).withColumn("rank", F.col("rank").cast("long"))
