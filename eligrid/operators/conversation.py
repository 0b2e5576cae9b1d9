"""Conversation analytics: labels, normalisers, guards, contradictions, session folds.

Turn-level folds first collapse to one row per (conversation, field, turn) with
map-side combining, so a conversation that dominates the input is reduced before any
window orders it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligrid.functions import vocab as V


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _any_in(text: Column, markers) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(text, m))


# ---- labels -----------------------------------------------------------------


def language(text: Column) -> Column:
    """struct(language, confidence, script) from script shares and marker words."""
    t = _strip(text)
    count = lambda p: F.regexp_count(t, F.lit(p))
    latin = count("[A-Za-z]")
    deva = count(r"[\x{0900}-\x{0963}\x{0966}-\x{096F}\x{0971}-\x{097F}]")
    other = F.length(t) - count(r"(?U)\s") - count(r"\p{P}") - latin - deva
    total = latin + deva + F.greatest(other, F.lit(1))
    d, l = deva / total, latin / total
    words = F.regexp_extract_all(F.lower(t), F.lit("([a-zA-Z]+)"), 1)
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(m) for m in V.HINGLISH_MARKERS])))
    marked = hits >= F.when(F.size(words) <= 6, 1).otherwise(2)

    def made(lang: str, confidence: float, script: str) -> Column:
        return F.struct(F.lit(lang).alias("language"), F.lit(confidence).alias("confidence"), F.lit(script).alias("script"))

    return (
        F.when(t == "", made("en", 1.0, "latin"))
        .when(d >= 0.80, made("hi", 0.95, "devanagari"))
        .when((d >= 0.20) & (l >= 0.20), made("hinglish", 0.85, "mixed"))
        .when(l >= 0.80, F.when(marked, made("hinglish", 0.75, "latin")).otherwise(made("en", 0.90, "latin")))
        .otherwise(made("en", 0.50, "latin"))
    )


def intent(text: Column, gathering: Column, has_results: Column) -> Column:
    """Ordered keyword cascade; depends on the dialogue state and on results being shown."""
    t = _strip(F.lower(text))
    bare = F.regexp_replace(t, r"[!.?]+$", "")
    greeting = F.regexp_replace(t, r"[!.?,]+$", "")
    asks = F.exists(
        F.array(*[F.lit(q) for q in V.QUESTIONS]), lambda q: (t == q) | F.startswith(t, F.concat(q, F.lit(" ")))
    )
    leaves = (
        t.isin(*V.EXITS_WORD) | bare.isin(*V.EXITS_WORD)
        | F.exists(F.array(*[F.lit(x) for x in V.EXITS_PHRASE]), lambda x: F.startswith(t, x))
    )
    return (
        F.when(t == "", "confirm")
        .when(t.isin(*V.CONFIRM_EXACT), F.when(gathering, "provide_info").otherwise("confirm"))
        .when(greeting.isin(*V.GREETINGS), "greeting")
        .when(_any_in(t, V.SKIPS), "skip_field")
        .when(leaves, "exit")
        .when(_any_in(t, V.CORRECTION_INTENT), "correct_info")
        .when(_any_in(t, V.MATCH_TRIGGERS) | t.isin(*V.MATCH_EXACT), "trigger_matching")
        .when(_any_in(t, V.WHAT_IFS), "what_if")
        .when(asks, "ask_question")
        .when(t.rlike(r"(?U)^\d+$"), F.when(has_results & ~gathering, "request_detail").otherwise("provide_info"))
        .otherwise("provide_info")
    )


def is_correction(text: Column) -> Column:
    return _any_in(F.lower(text), V.CORRECTIONS_EN) | _any_in(text, V.CORRECTIONS_HI)


def inferences(text: Column) -> Column:
    """Array of (field, value, trigger): the first trigger of each field."""
    t = F.lower(text)
    table = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.lit(w).alias("trigger"))
            for i, (w, f, v) in enumerate(V.INFERENCES)
        ]
    )
    hit = F.filter(table, lambda r: F.contains(t, r["trigger"]))
    fields = F.transform(hit, lambda r: r["field"])
    return F.filter(hit, lambda r, i: F.array_position(fields, r["field"]) == i + 1)


# ---- value normalisers ------------------------------------------------------


def state_code(raw: Column) -> Column:
    code = F.try_element_at(_map(V.STATE_ALIASES), F.lower(_strip(raw)))
    short = (F.length(raw) == 2) & F.upper(raw).isin(*V.STATE_CODES_KNOWN)
    abbreviated = (F.length(_strip(raw)) == 2) & F.upper(_strip(raw)).isin(*V.STATE_CODES_KNOWN)
    return F.coalesce(code, F.when(short, F.upper(raw)), F.when(abbreviated, F.upper(_strip(raw))), raw)


def caste_code(raw: Column) -> Column:
    key = F.lower(_strip(raw))
    upper = F.upper(_strip(raw))
    return F.coalesce(
        F.try_element_at(_map(V.CASTE_ALIASES), key),
        F.when(upper.isin("SC", "ST", "OBC", "GENERAL", "EWS"), upper),
        raw,
    )


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, "(?U)" + pattern, 1), F.lit("")).try_cast("double")


def money(raw: Column) -> Column:
    """Integer rupees of lakh, crore, thousand or plain amounts; 0 without a number."""
    t = _strip(F.replace(F.replace(F.lower(raw), F.lit(","), F.lit("")), F.lit("₹"), F.lit("")))
    scaled = [(_first(t, r"([\d.]+)\s*" + unit) * by).cast("bigint") for unit, by in V.MONEY_UNITS]
    return F.coalesce(*scaled, _first(t, r"([\d.]+)").cast("bigint"), F.lit(0).cast("bigint"))


def land(raw: Column) -> Column:
    """Acres; bigha and hectare are converted and rounded to two places."""
    t = _strip(F.lower(raw))
    scaled = [F.round(_first(t, r"([\d.]+)\s*" + unit) * by, 2) for unit, by in V.LAND_UNITS]
    return F.coalesce(*scaled, _first(t, r"([\d.]+)"), F.lit(0.0))


def age(raw: Column, as_of_year: int) -> Column:
    """Age from a birth year in the text, else its first integer, else 0."""
    year = F.nullif(F.regexp_extract(raw, r"(?U)\b((?:19|20)\d{2})\b", 1), F.lit("")).try_cast("int")
    number = F.nullif(F.regexp_extract(raw, r"(?U)(\d+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(F.lit(as_of_year) - year, number, F.lit(0))


def number_words(text: Column) -> Column:
    """Number word plus unit to digits; the text between matches is kept as it is."""
    pattern = r"(?iU)\b(" + "|".join(V.NUMBER_WORDS) + r")\s+" + V.NUMBER_UNITS
    gaps = F.split(text, pattern)
    words = F.regexp_extract_all(text, F.lit(pattern), 1)
    units = F.regexp_extract_all(text, F.lit(pattern), 2)
    pairs = F.arrays_zip(gaps.alias("gap"), words.alias("word"), units.alias("unit"))

    def rebuilt(p: Column) -> Column:
        n = _map(V.NUMBER_WORDS)[F.lower(p["word"])]
        unit = F.lower(p["unit"])
        said = (
            F.when(unit.isin("hazar", "hazaar"), (n * 1000).cast("string"))
            .when(unit.isin("lakh", "lac"), (n * 100000).cast("string"))
            .otherwise(F.concat(n.cast("string"), F.lit(" "), unit))
        )
        return F.concat(p["gap"], F.coalesce(said, F.lit("")))

    return F.array_join(F.transform(pairs, rebuilt), "")


# ---- extraction guard -------------------------------------------------------


def guard_issues(as_of_year: int) -> Column:
    """Per-field issues of an extraction row as (check, status) pairs."""
    field, num, text, span = (F.col(c) for c in ("field", "num", "text", "span"))
    bounds = {**V.BOUNDS, "applicant.birth_year": (V.BIRTH_YEAR_FLOOR, as_of_year)}
    lo = _map({k: float(v[0]) for k, v in bounds.items()})[field]
    hi = _map({k: float(v[1]) for k, v in bounds.items()})[field]
    known = F.create_map(*[x for k, ws in V.ALLOWED.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in ws]))])[field]
    issue = lambda check, status: F.struct(F.lit(check).alias("check"), F.lit(status).alias("status"))
    return F.array_compact(
        F.array(
            F.when((num < lo) | (num > hi), issue("range", "REJECT")),
            F.when(known.isNotNull() & text.isNotNull() & ~F.array_contains(known, F.lower(text)), issue("vocab", "WARN")),
            F.when(
                field.isin(*V.NUMERIC_FIELDS)
                & (F.coalesce(span, F.lit("")).isin("", "null", "None") | ~span.rlike(r"[\d,.]")),
                issue("anchor", "WARN"),
            ),
        )
    )


def collapse(extractions: DataFrame) -> DataFrame:
    """One row per conversation, turn and field: the last value said in the turn."""
    return extractions.groupBy("conv_id", "field", "turn").agg(
        F.max_by(F.struct("num", "text", "span"), "seq").alias("last")
    ).select("conv_id", "turn", "field", "last.num", "last.text", "last.span")


def _by_field(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Pivot chosen fields of a message to columns by conditional aggregation."""
    return rows.groupBy("conv_id", "turn").agg(
        *[F.max(F.when(F.col("field") == f, F.col(kind))).alias(name) for name, (f, kind) in fields.items()]
    )


PAIR_FIELDS = {
    "age": ("applicant.age", "num"), "born": ("applicant.birth_year", "num"),
    "monthly": ("household.income_monthly", "num"), "annual": ("household.income_annual", "num"),
}


def guard_report(collapsed: DataFrame, as_of_year: int) -> DataFrame:
    """passed / warned / rejected per field; cross checks only see fields that survive."""
    checked = collapsed.withColumn("issues", guard_issues(as_of_year))
    own = (
        F.when(F.exists("issues", lambda i: i["status"] == "REJECT"), "rejected")
        .when(F.size("issues") > 0, "warned")
        .otherwise("passed")
    )
    judged = checked.withColumn("own", own)
    crossed = guard_cross(judged.where("own <> 'rejected'"), as_of_year).select("conv_id", "turn", "field", F.lit(True).alias("crossed"))
    return judged.join(crossed, ["conv_id", "turn", "field"], "left").select(
        "conv_id", "turn", "field",
        F.when((F.col("own") == "passed") & F.col("crossed"), "warned").otherwise(F.col("own")).alias("verdict"),
        F.size("issues").alias("n_issues"),
    )


def guard_cross(rows: DataFrame, as_of_year: int) -> DataFrame:
    """Warnings on fields of one message that disagree with each other."""
    wide = _by_field(rows, PAIR_FIELDS)
    years = F.abs((as_of_year - F.floor("born")) - F.floor("age")) > 2
    money_off = (F.col("annual") > 0) & (F.abs(F.col("monthly") * 12 - F.col("annual")) / F.col("annual") > 0.25)
    found = F.array_compact(
        F.array(F.when(years, F.lit("applicant.age")), F.when(money_off, F.lit("household.income_monthly")))
    )
    return wide.select("conv_id", "turn", F.explode(found).alias("field"))


# ---- contradictions ---------------------------------------------------------


def direct(collapsed: DataFrame) -> DataFrame:
    """Type 1: a value differs from the one said in an earlier turn."""
    w = Window.partitionBy("conv_id", "field").orderBy("turn")
    rows = collapsed.withColumns({"old_num": F.lag("num").over(w), "old_text": F.lag("text").over(w), "old_turn": F.lag("turn").over(w)})
    changed = (F.col("num") != F.col("old_num")) | (F.col("text") != F.col("old_text"))
    shift = F.abs(F.col("num") - F.col("old_num")) / F.abs("old_num")
    severity = F.when(
        F.col("field").isin(*V.CRITICAL_FIELDS),
        F.when((F.col("old_num") != 0) & (shift <= 0.10), "warning").otherwise("blocking"),
    ).otherwise("warning")
    return rows.where(F.col("old_turn").isNotNull() & changed).withColumn("severity", severity)


def within_message(collapsed: DataFrame, as_of_year: int) -> DataFrame:
    """Type 2: age against birth year, monthly against annual income, in one message."""
    wide = _by_field(collapsed, PAIR_FIELDS)
    years = F.abs(F.floor("age") - (as_of_year - F.floor("born"))) > 1
    annual = F.floor("annual")
    money_off = F.abs(F.floor("monthly") * 12 - annual) / F.greatest(annual, F.lit(1)) > 0.20
    flag = lambda pair, severity: F.struct(F.lit(pair).alias("pair"), F.lit(severity).alias("severity"))
    found = F.array_compact(F.array(F.when(years, flag("age_birth", "blocking")), F.when(money_off, flag("income", "warning"))))
    return wide.select("conv_id", "turn", F.inline(found))


def implicit(collapsed: DataFrame, inferred: DataFrame) -> DataFrame:
    """Type 3: an explicit value against the latest inference of an earlier turn."""
    said = collapsed.select("conv_id", "field", "turn", "text", F.lit(None).cast("string").alias("guess"))
    guessed = inferred.groupBy("conv_id", "field", "turn").agg(F.max_by("value", "seq").alias("guess")).select(
        "conv_id", "field", "turn", F.lit(None).cast("string").alias("text"), "guess"
    )
    w = Window.partitionBy("conv_id", "field").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    rows = said.unionByName(guessed).withColumn("assumed", F.last("guess", ignorenulls=True).over(w))
    return rows.where("text IS NOT NULL AND assumed IS NOT NULL AND text <> assumed").select(
        "conv_id", "turn", "field", "text", "assumed"
    )


CROSS_FIELDS = {
    **PAIR_FIELDS,
    "tax": ("employment.is_income_tax_payer", "text"), "disabled": ("applicant.disability_status", "text"),
    "pct": ("applicant.disability_percentage", "num"), "account": ("documents.bank_account", "text"),
    "account_type": ("documents.bank_account_type", "text"), "job": ("employment.type", "text"),
    "owns": ("applicant.land_ownership_status", "text"), "acres": ("household.land_acres", "num"),
}


def cross_field(collapsed: DataFrame, as_of_year: int) -> DataFrame:
    """Type 4: seven rules on the profile as it stands after each turn."""
    wide = _by_field(collapsed, CROSS_FIELDS)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    now = wide.select("conv_id", "turn", *[F.last(c, ignorenulls=True).over(w).alias(c) for c in CROSS_FIELDS])
    c = F.col
    checks = (
        ("income_monthly_annual_consistency", "warning", F.abs(c("monthly") * 12 - c("annual")) / F.greatest(c("annual"), F.lit(1.0)) > 0.20),
        ("tax_payer_income_threshold", "warning", (c("tax") == "True") & (c("annual") < 250000)),
        ("disability_percentage_without_status", "warning", (c("disabled") == "False") & (c("pct") > 0)),
        ("age_birth_year_consistency", "blocking", F.abs(c("age") - (as_of_year - c("born"))) > 1),
        ("bank_account_type_without_account", "warning", (c("account") == "False") & c("account_type").isNotNull()),
        ("minor_with_employment", "blocking", (c("age") < 14) & (c("job") != "student")),
        ("land_ownership_without_acres", "info", (c("owns") == "True") & (c("acres") == 0)),
    )
    found = F.array_compact(
        F.array(*[F.when(test, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, test in checks])
    )
    return now.select("conv_id", "turn", F.inline(found))


def resolve(flags: DataFrame, corrected_turns: DataFrame) -> DataFrame:
    """Correction wording in a turn turns its blocking type-1 flags into notes."""
    marked = corrected_turns.select("conv_id", "turn", F.lit(True).alias("corrected")).distinct()
    return flags.join(marked, ["conv_id", "turn"], "left").withColumn(
        "severity",
        F.when((F.col("severity") == "blocking") & F.col("corrected"), "info").otherwise(F.col("severity")),
    )


# ---- session folds ----------------------------------------------------------


def session_profile(collapsed: DataFrame) -> DataFrame:
    """Current value per field with provenance and how it came about."""
    return collapsed.groupBy("conv_id", "field").agg(
        F.max_by(F.struct("num", "text"), "turn").alias("v"),
        F.max("turn").alias("source_turn"), F.count("*").alias("turns_said"),
    ).select(
        "conv_id", "field", "v.num", "v.text", "source_turn",
        F.when(F.col("turns_said") > 1, "update").otherwise("set").alias("change_type"),
    )


def viability(collapsed: DataFrame) -> DataFrame:
    """Whether the minimum fields are present, per conversation."""
    return collapsed.groupBy("conv_id").agg(F.collect_set("field").alias("fields")).select(
        "conv_id", F.size("fields").alias("n_fields"),
        (F.size(F.array_except(F.array(*[F.lit(f) for f in V.VIABLE_FIELDS]), "fields")) == 0).alias("viable"),
    )


def match_trigger(collapsed: DataFrame) -> DataFrame:
    """Turn number at which matching first runs.

    When all minimum fields are known, or from the tenth turn with two fields; never
    on the first turn.
    """
    turns = collapsed.select("conv_id", "turn").distinct()
    ranked = turns.withColumn("turn_no", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    known = collapsed.groupBy("conv_id", "field").agg(F.min("turn").alias("turn")).join(ranked, ["conv_id", "turn"])
    minimum = F.col("field").isin(*V.VIABLE_FIELDS)
    per_conv = known.groupBy("conv_id").agg(
        F.count_if(minimum).alias("have"), F.max(F.when(minimum, F.col("turn_no"))).alias("viable_at"),
        F.sort_array(F.collect_list("turn_no")).alias("firsts"),
    ).join(ranked.groupBy("conv_id").agg(F.max("turn_no").alias("n_turns")), "conv_id")
    by_viable = F.when(F.col("have") == len(V.VIABLE_FIELDS), F.greatest(F.col("viable_at"), F.lit(2)))
    by_count = F.when(F.size("firsts") >= 2, F.greatest(F.try_element_at("firsts", F.lit(2)), F.lit(V.MAX_TURNS)))
    at = F.least(by_viable, by_count)
    return per_conv.select("conv_id", at.alias("trigger_turn"), "n_turns").where("trigger_turn <= n_turns")


def trim(turns: DataFrame, recent: int = 6) -> DataFrame:
    """First turn plus the latest six; up to seven turns that is all of them, also where turns share a number.

    All parts are rank filters, which prune inside each task before the shuffle, so a very long conversation is never
    ordered as a whole. Other columns break ties, the same way in both orders; the first row is added only where the
    conversation has more rows than the latest six.
    """
    order = ["turn", *[c for c in turns.columns if c not in ("conv_id", "turn")]]
    newest = Window.partitionBy("conv_id").orderBy(*[F.desc_nulls_last(c) for c in order])
    oldest = Window.partitionBy("conv_id").orderBy(*[F.asc_nulls_first(c) for c in order])
    late = turns.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= recent + 1)
    longer = late.where(F.col("rn") == recent + 1).select(F.col("conv_id").alias("long_id"))
    first = turns.withColumn("rn", F.row_number().over(oldest)).where(F.col("rn") <= 1)
    return late.where(F.col("rn") <= recent).unionByName(first.join(longer, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi")).drop("rn")


def followups(profile_fields: DataFrame) -> DataFrame:
    """Questions still open per conversation, in order."""
    known = profile_fields.groupBy("conv_id").agg(F.collect_set("field").alias("known"))
    return known.select("conv_id", F.array_except(F.array(*[F.lit(q) for q in V.QUESTION_ORDER]), "known").alias("questions"))
