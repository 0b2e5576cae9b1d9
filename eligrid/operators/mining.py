"""Rule mining: eligibility prose to structured rules, one row-local pass per text.

Splitting, classification and number extraction are built-in string functions on
literal patterns, so a text never leaves its task; only per-scheme reviews group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eligrid import model
from eligrid.functions import patterns as P
from eligrid.session import checkpoint

# Bytes of distinct texts up to which their analysis is broadcast.
TEXT_BYTES = 32 << 20

# ---- fixed values: level names to state codes, field to condition type ------
LEVEL_CODES = {
    "andhra pradesh": "AP", "assam": "AS", "bihar": "BR", "chhattisgarh": "CG", "delhi": "DL",
    "goa": "GA", "gujarat": "GJ", "haryana": "HR", "himachal pradesh": "HP", "jharkhand": "JH",
    "karnataka": "KA", "kerala": "KL", "madhya pradesh": "MP", "maharashtra": "MH", "manipur": "MN",
    "meghalaya": "ML", "mizoram": "MZ", "nagaland": "NL", "odisha": "OD", "punjab": "PB",
    "rajasthan": "RJ", "sikkim": "SK", "tamil nadu": "TN", "telangana": "TS", "uttar pradesh": "UP",
    "uttarakhand": "UK", "west bengal": "WB",
}
# ---- end of fixed values ----------------------------------------------------


def found(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Unanchored search with Unicode word, digit and space classes."""
    return text.rlike(("(?iuU)" if ignore_case else "(?U)") + pattern)


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group of the first match, NULL where nothing matches."""
    return F.nullif(F.regexp_extract(text, "(?U)" + pattern, n), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def any_of(text: Column, pats) -> Column:
    out = found(text, pats[0])
    for p in pats[1:]:
        out = out | found(text, p)
    return out


def sentences(texts: DataFrame, column: str = "eligibility") -> DataFrame:
    """One row per kept sentence (ten characters or more), numbered from one."""
    parts = F.transform(F.split(column, r"(?U)[.!?]\s+"), strip)
    kept = F.filter(parts, lambda s: F.length(s) >= 10)
    return texts.select("*", F.posexplode(kept).alias("pos", "sentence")).withColumn(
        "counter", F.col("pos") + 1
    ).drop("pos")


def analysed(rows: DataFrame, columns: dict[str, Column], text: str = "sentence", limit: int = TEXT_BYTES) -> DataFrame:
    """Add columns that follow from a text alone, worked out once per distinct text.

    Prose repeats its sentences, so the patterns run over the distinct ones and rows look their results up in a
    broadcast. Where the distinct texts are larger than the limit every row is worked out in place, with the same result.
    """

    def added(df: DataFrame) -> DataFrame:
        for name, value in columns.items():
            df = df.withColumn(name, value)
        return df

    texts = checkpoint(rows.select(F.col(text).alias("_text")).distinct())
    if (texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) > limit:
        return added(rows)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = texts.repartition(parts, "_text").withColumn(text, F.col("_text")).transform(added).select("_text", *columns)
    kept = rows.drop(*columns)
    return kept.join(F.broadcast(checkpoint(own)), F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def rule_type(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(any_of(t, P.DISQUALIFYING), "disqualifying")
        .when(any_of(t, P.PREREQUISITE) & ~found(t, P.STANDARD_CONDITION), "prerequisite")
        .otherwise("eligibility")
    )


def canonical_field(text: Column) -> Column:
    t = F.lower(text)
    chain = None
    for pattern, field in P.FIELD_PATTERNS:
        chain = F.when(found(t, pattern), field) if chain is None else chain.when(found(t, pattern), field)
    return chain.otherwise(P.OTHER_FIELD)


def condition_type(field: Column) -> Column:
    """Condition type by substring; "age" is tested first and wins inside other words."""
    has = lambda w: F.contains(field, F.lit(w))
    return (
        F.when(has("age"), "age_range")
        .when(
            has("employment"),
            F.when(has("income_tax"), "employment:income_tax_status")
            .when(has("govt_employee"), "employment:govt_employee_status")
            .when(has("epfo") | has("esic") | has("nps"), "employment:social_security_status")
            .otherwise("occupation"),
        )
        .when(has("income"), "income_ceiling")
        .when(has("gender"), "gender")
        .when(has("caste"), "caste_category")
        .when(has("occupation"), "occupation")
        .when(has("residence") | (has("location") & has("state")), "domicile")
        .when(has("bpl") | has("poverty"), "poverty_status")
        .when(has("documents"), F.concat(F.lit("document:"), F.element_at(F.split(field, r"\."), -1)))
        .when(has("disability"), "disability")
        .when(has("marital"), "marital_status")
        .when(has("education"), "education_level")
        .when(has("land") | has("assets"), "land_ownership")
        .when(has("family"), "family_size")
        .otherwise("other")
    )


def currency(text: Column) -> Column:
    """Rupee amount of Indian notation (lakh, crore, comma groups) as an integer."""
    t = F.lower(text)
    scaled = lambda s, by: (F.regexp_replace(s, ",", "").try_cast("double") * by).cast("bigint")
    return F.coalesce(
        scaled(group(t, P.LAKH_MARKED), 100000),
        scaled(group(t, P.LAKH), 100000),
        scaled(group(t, P.CRORE), 10000000),
        F.regexp_replace(group(t, P.RUPEES), ",", "").try_cast("bigint"),
    )


def numeric_range(text: Column) -> Column:
    """struct(lo, hi): the only number, or least and greatest of several.

    A decimal among the numbers makes the whole text unreadable, as it is integers
    that are asked for.
    """
    raw = F.transform(
        F.regexp_extract_all(text, F.lit("(?U)(" + P.NUMBER + ")"), 1), lambda n: F.regexp_replace(n, ",", "")
    )
    numbers = F.transform(raw, lambda n: n.try_cast("bigint"))
    clean = ~F.exists(raw, lambda n: F.contains(n, F.lit("."))) & (F.size(numbers) > 0)
    return F.struct(
        F.when(clean, F.array_min(numbers)).alias("lo"),
        F.when(clean & (F.size(numbers) > 1), F.array_max(numbers)).alias("hi"),
    )


def operator(text: Column) -> Column:
    """struct(op, val, val_max) by the first pattern that applies."""
    t = F.lower(text)
    none = F.lit(None).cast("bigint")
    make = lambda op, v=none, hi=none: F.struct(F.lit(op).alias("op"), v.alias("val"), hi.alias("val_max"))
    num = lambda p, n=1: group(t, p, n).try_cast("bigint")
    money = currency(text)
    chain = F.when(found(t, P.LTE_MONEY) & money.isNotNull(), make("LTE", money)).when(
        found(t, P.GTE_MONEY) & money.isNotNull(), make("GTE", money)
    )
    for p in P.BETWEEN_PATTERNS:
        chain = chain.when(found(t, p), make("BETWEEN", num(p), num(p, 2)))
    for op, p in P.NUMBER_PATTERNS:
        chain = chain.when(found(t, p), make(op, num(p)))
    return chain.when(any_of(t, P.IN_PATTERNS), make("IN")).otherwise(make("EQ"))


def in_values(text: Column, field: Column) -> Column:
    """Enumerated values by field; the first field family that yields any."""
    t = F.lower(text)
    has = lambda w: F.contains(field, F.lit(w))
    castes = F.array_compact(
        F.array(*[F.when(F.contains(t, F.lit(c.lower())) | F.contains(text, F.lit(c)), F.lit(c)) for c in P.CASTE_VALUES])
    )
    genders = F.array_compact(F.array(*[F.when(found(t, p), F.lit(g)) for p, g in P.GENDER_VALUES]))
    jobs = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit("(?U)(" + P.OCCUPATIONS + ")"), 1)))
    words = lambda ws: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in ws]))
    empty = F.array().cast("array<string>")
    use = lambda cond, arr: F.when(cond & (F.size(arr) > 0), arr)
    return F.coalesce(
        use(has("caste"), castes),
        use(has("gender"), genders),
        use(has("occupation"), jobs),
        use(has("education"), words(P.EDUCATION_VALUES)),
        use(has("marital"), words(P.MARITAL_VALUES)),
        empty,
    )


def confidence(text: Column, op: Column, value: Column) -> Column:
    t = F.lower(text)
    has = lambda w: F.contains(t, F.lit(w))
    return (
        F.when(
            op.isin(*model.NUMERIC_OPERATORS) & value.isNotNull(),
            F.when(found(text, P.MONEY_WORDS, ignore_case=True), 0.92).otherwise(0.95),
        )
        .when(has("must") | has("should"), 0.85)
        .when(has("may") | has("can"), 0.72)
        .when(has("or") & has("and"), 0.65)
        .when(has("some") | has("any") | has("may vary") | has("subject"), 0.55)
        .otherwise(0.70)
    )


def condition_text(field: Column, op: Column, value: Column, lo: Column, hi: Column, text: Column) -> Column:
    short = F.replace(F.element_at(F.split(field, r"\."), -1), F.lit("_"), F.lit(" "))
    signs = {"GTE": "≥", "LTE": "≤", "GT": ">", "LT": "<", "EQ": "="}
    chain = F.when(
        (op == "BETWEEN") & lo.isNotNull() & hi.isNotNull(),
        F.concat(short, F.lit(" between "), lo.cast("string"), F.lit(" and "), hi.cast("string")),
    )
    for name, sign in signs.items():
        chain = chain.when(
            (op == name) & value.isNotNull(), F.concat(short, F.lit(f" {sign} "), value.cast("string"))
        )
    cut = F.when(F.length(text) <= 120, text).otherwise(F.concat(F.substring(text, 1, 117), F.lit("...")))
    return chain.when(op == "IN", F.concat(short, F.lit(" in eligible categories"))).otherwise(cut)


def parser_flags(text: Column) -> Column:
    """Array of (code, name, severity) the parser's own detector raises, in order."""
    t = F.lower(text)

    def check(code, name, severity, pattern, also, unless):
        hit = found(t, pattern)
        if also:
            hit = hit & found(t, also)
        if unless:
            hit = hit & ~found(text, unless)
        return F.when(
            hit, F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), F.lit(severity).alias("severity"))
        )

    return F.array_compact(F.array(*[check(*c) for c in P.PARSER_CHECKS]))


def state_code(level: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in LEVEL_CODES.items() for x in kv])
    key = strip(F.lower(level))
    return (
        F.when(level.isNull() | (level == "") | (F.lower(level) == "central"), "central")
        .otherwise(F.coalesce(F.try_element_at(codes, key), F.substring(F.upper(level), 1, 2)))
    )


def extract_rules(texts: DataFrame) -> DataFrame:
    """All rules of all texts; a blank text yields one placeholder rule.

    `sentence` is the whole sentence and what later steps read; quote and display text are shortened for show only.
    """
    blank = F.coalesce(strip(F.col("eligibility")), F.lit("")) == ""
    text, op, val = F.col("sentence"), F.col("found_op.op"), F.col("found_op.val")
    # In this order: later ones read earlier ones.
    parsed = {
        "rule_type": rule_type(text), "field": canonical_field(text), "found_op": operator(text), "flags": parser_flags(text),
        "operator": op,
        "value": F.when(op != "BETWEEN", val),
        "value_min": F.when(op == "BETWEEN", val),
        "value_max": F.when(op == "BETWEEN", F.col("found_op.val_max")),
        "values": F.when(op == "IN", in_values(text, F.col("field"))).otherwise(F.array().cast("array<string>")),
        "confidence": confidence(text, op, val),
        "condition_type": condition_type(F.col("field")),
        "source_quote": F.substring("sentence", 1, 200),
        "display_text": F.substring("sentence", 1, 100),
        "condition": condition_text(F.col("field"), F.col("operator"), F.col("value"), F.col("value_min"), F.col("value_max"), text),
    }
    rows = analysed(sentences(texts.where(~blank)), parsed).withColumn("notes", F.lit(None).cast("string"))
    none = F.lit(None).cast("bigint")
    flag_type = rows.schema["flags"].dataType
    placeholder = texts.where(blank).withColumns(
        {
            "counter": F.lit(1),
            "rule_type": F.lit("eligibility"), "field": F.lit(P.OTHER_FIELD), "operator": F.lit("EQ"),
            "value": none, "value_min": none, "value_max": none,
            "values": F.array().cast("array<string>"), "confidence": F.lit(0.0),
            "condition_type": F.lit("other"), "condition": F.lit("No eligibility criteria extracted"),
            "sentence": F.lit(""), "source_quote": F.lit(""), "display_text": F.lit("Empty eligibility text"),
            "notes": F.lit("Empty eligibility text"), "flags": F.array().cast(flag_type),
        }
    )
    columns = [
        "position", "slug", "counter", "rule_type", "condition_type", "field", "operator", "value",
        "value_min", "value_max", "values", "condition", "sentence", "source_quote", "display_text", "confidence", "flags", "notes",
    ]
    both = rows.select(columns).unionByName(placeholder.select(columns))
    return both.withColumns(
        {
            "rule_id": F.concat("slug", F.lit("-K-R"), F.lpad(F.col("counter").cast("string"), 3, "0")),
            "scheme_id": F.concat("slug", F.lit("-KAGGLE")),
            "audit_status": F.lit("PENDING"),
            "source_url": F.concat(F.lit("kaggle://indian-government-schemes/"), "slug"),
            "flag_ids": F.transform(
                "flags",
                lambda f, i: F.concat(F.lit("AMB-"), F.col("slug"), F.lit("-"), F.lpad(i.cast("string"), 3, "0")),
            ),
        }
    )


def review(mined: DataFrame) -> DataFrame:
    """Review decision per scheme: the first reason that applies, in priority order."""
    quote = F.lower("sentence")
    loud = F.filter("flags", lambda f: f["severity"].isin("HIGH", "CRITICAL"))
    grouped = mined.groupBy("slug").agg(
        F.min(
            F.when(
                F.size(loud) > 0,
                F.struct("counter", loud[0]["name"].alias("name"), loud[0]["severity"].alias("severity")),
            )
        ).alias("loud"),
        F.min(F.when(F.col("confidence") < 0.65, F.struct("counter", "confidence"))).alias("low"),
        F.sum(F.size("flags")).alias("flags"),
        F.bool_or(F.contains(quote, F.lit("discretion")) | F.contains(quote, F.lit("subject to"))).alias("discretion"),
        F.count("*").alias("rules"),
    )
    low_text = F.concat(F.lit("Low confidence ("), F.format_string("%.2f", F.col("low.confidence")), F.lit(")"))
    many_text = F.concat(F.lit("Multiple ambiguities detected ("), F.col("flags").cast("string"), F.lit(")"))
    reason = (
        F.when(F.col("loud").isNotNull(), F.concat(F.lit("Ambiguity: "), F.col("loud.name")))
        .when(F.col("low").isNotNull(), low_text)
        .when(F.col("flags") > 3, many_text)
        .when(F.col("discretion"), F.lit("Contains discretionary language"))
    )
    return grouped.select(
        "slug", "rules", F.col("flags").alias("n_flags"), reason.alias("reason"),
        F.when(F.col("loud").isNotNull(), F.col("loud.severity")).when(reason.isNotNull(), "MEDIUM").alias("severity"),
        reason.isNotNull().alias("flagged"),
    )


def with_batch(schemes: DataFrame, size: int = 50, width: int = 100_000) -> DataFrame:
    """Batch number by file position, without one task ordering the whole table.

    Rows are ranked inside position ranges of fixed width; a range's offset is the
    running count of the ranges before it, a table of one row per range.
    """
    ranged = schemes.withColumn("range_no", F.floor(F.col("position") / width))
    counts = ranged.groupBy("range_no").agg(F.count("*").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range_no").orderBy("position")
    return (
        ranged.withColumn("rn", F.row_number().over(inside))
        .join(offsets, "range_no")
        .withColumn("row_no", F.col("offset") + F.col("rn"))
        .withColumn("batch", (F.floor((F.col("row_no") - 1) / size) + 1).cast("long"))
        .drop("range_no", "rn", "offset")
    )
