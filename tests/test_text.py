"""Literal cases of the text operators."""

from pyspark.sql import functions as F

from eligrid.operators import ambiguity, conversation, mining
from eligrid.sources import feeds


def col(spark, values, build):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("x"))).collect()]


def test_currency(spark):
    texts = ["Rs. 2,50,000", "₹2.5 lakh", "3 lakh", "1.5 crore", "300000", "nothing"]
    assert col(spark, texts, mining.currency) == [250000, 250000, 300000, 15000000, None, None]


def test_operator(spark):
    texts = ["Age between 18 and 40", "18-40 years", "at least 60", "income not exceed Rs. 2 lakh", "SC or ST applicants of obc and general", "must be a farmer", "under 14"]
    got = [(o.op, o.val, o.val_max) for o in col(spark, texts, mining.operator)]
    assert got == [("BETWEEN", 18, 40), ("BETWEEN", 18, 40), ("GTE", 60, None), ("LTE", 200000, None), ("IN", None, None), ("EQ", None, None), ("LT", 14, None)]


def test_age_wins_inside_other_words(spark):
    assert col(spark, ["applicant.disability_percentage", "documents.aadhaar", "household.income_annual"], mining.condition_type) == [
        "age_range", "document:aadhaar", "income_ceiling",
    ]


def test_lookahead_types(spark):
    got = col(spark, ["below poverty line", "below poverty line of 5000", "domicile", "domicile 3 years"], ambiguity.detect)
    assert [10 in got[0], 10 in got[1], 23 in got[2], 23 in got[3]] == [True, False, True, False]


def test_severity_upgrade(spark):
    rows = spark.createDataFrame([(1, "household.income_annual"), (1, "location.state"), (9, ""), (18, "")], "c int, f string")
    got = [r[0] for r in rows.select(ambiguity.severity(F.col("c"), F.col("f"))).collect()]
    assert got == ["CRITICAL", "HIGH", "CRITICAL", "LOW"]


def test_number_words_keep_the_rest(spark):
    texts = ["baara saal ka hu", "Do lakh aur teen hazar", "das log", "ek do Saal"]
    assert col(spark, texts, conversation.number_words) == ["12 saal ka hu", "200000 aur 3000", "das log", "ek 2 saal"]


def test_money_land_age(spark):
    assert col(spark, ["2.5 lac", "₹12,000", "1 करोड़", "x"], conversation.money) == [250000, 12000, 10000000, 0]
    assert col(spark, ["10 bigha", "2 हेक्टेयर", "3.5", "none"], conversation.land) == [6.2, 4.94, 3.5, 0.0]
    assert col(spark, ["born in 1990", "I am 42", "unknown"], lambda c: conversation.age(c, 2026)) == [36, 42, 0]


def test_language(spark):
    got = col(spark, ["मेरी उम्र पैंतीस साल है।", "mera naam ravi", "I am a farmer", "  ", "मेरा name ravi hai भाई"], conversation.language)
    assert [g.language for g in got] == ["hi", "hinglish", "en", "en", "hinglish"]


def test_html_section(spark):
    page = "<p>x</p><SECTION class='a' id='eligibility'>\n <b>Age</b>&nbsp;18+\n</SECTION>"
    assert col(spark, [page, "<p></p>"], feeds.section_text) == ["Age &nbsp;18+", ""]
