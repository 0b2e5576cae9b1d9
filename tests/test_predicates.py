"""Truth tables of the fourteen operators as literal rows."""

import pytest
from pyspark.sql import functions as F

from eligrid.functions import cells, predicates

T, N = True, None
INT, TEXT, YES, NO, LIST = ("num", "5", 5.0, None), ("str", "x", None, None), ("bool", "True", 1.0, None), ("bool", "False", 0.0, None), ("list", "['a', 'b']", None, ["a", "b"])
NULL, EMPTY, DIGITS, NAN = ("null", None, None, None), ("list", "[]", None, []), ("str", "7", 7.0, None), ("num", "nan", float("nan"), None)


def ask(spark, op, u, v=NULL, lo=None, hi=None, items=(), ok=True):
    schema = f"u {cells.CELL}, v {cells.CELL}, lo double, hi double, items array<{cells.CELL}>, ok boolean"
    row = spark.createDataFrame([(u, v, lo, hi, list(items), ok)], schema)
    got = predicates.evaluate_as(
        op, predicates.cell_of(F.col("u")), predicates.cell_of(F.col("v")), F.col("lo"), F.col("hi"), F.col("items"), F.col("ok")
    )
    named = predicates.evaluate(
        F.lit(predicates.OPCODE[op]), predicates.cell_of(F.col("u")), predicates.cell_of(F.col("v")), F.col("lo"), F.col("hi"), F.col("items"), F.col("ok")
    )
    a, b = row.select(got, named).first()
    assert a == b
    return a


@pytest.mark.parametrize(
    "op,u,v,want",
    [
        ("EQ", NULL, INT, N), ("EQ", INT, INT, T), ("EQ", YES, ("num", "1", 1.0, None), T), ("EQ", YES, TEXT, N),
        ("EQ", YES, NULL, N), ("EQ", TEXT, NULL, N), ("EQ", TEXT, INT, N), ("EQ", INT, NULL, False), ("EQ", LIST, NULL, False),
        ("EQ", LIST, INT, False), ("EQ", LIST, LIST, T), ("EQ", YES, NO, False), ("EQ", NAN, NAN, False),
        ("NEQ", INT, NULL, T), ("NEQ", TEXT, INT, N), ("NEQ", TEXT, TEXT, False),
        ("LT", DIGITS, ("num", "8", 8.0, None), T), ("LT", TEXT, INT, N), ("LT", LIST, INT, N), ("LTE", INT, INT, T),
        ("GT", YES, ("num", "0", 0.0, None), T), ("GTE", INT, NULL, N), ("GTE", NAN, INT, False), ("LT", NULL, INT, N),
        ("CONTAINS", LIST, ("str", "a", None, None), T), ("CONTAINS", LIST, INT, False), ("CONTAINS", ("str", "farmer", None, None), ("str", "arm", None, None), T),
        ("CONTAINS", INT, INT, N), ("CONTAINS", YES, ("str", "ru", None, None), T), ("CONTAINS", NULL, TEXT, N),
        ("MATCHES", ("str", "BRX", None, None), ("str", "R.", None, None), T), ("MATCHES", INT, ("str", "^6", None, None), False),
        ("IS_NULL", NULL, NULL, T), ("IS_NULL", EMPTY, NULL, False), ("IS_NOT_NULL", INT, NULL, T), ("IS_NOT_NULL", NULL, NULL, False),
    ],
)
def test_two_sided(spark, op, u, v, want):
    assert ask(spark, op, u, v) is want


@pytest.mark.parametrize(
    "op,u,items,want",
    [
        ("IN", NULL, [INT], N), ("IN", INT, [], False), ("IN", INT, [TEXT, INT], T), ("IN", TEXT, [INT], False),
        ("IN", YES, [("num", "1", 1.0, None)], T), ("NOT_IN", INT, [], T), ("NOT_IN", NULL, [], N), ("NOT_IN", TEXT, [TEXT], False),
        ("NOT_MEMBER", TEXT, [], T), ("NOT_MEMBER", TEXT, [TEXT], N), ("NOT_MEMBER", LIST, [("str", "b", None, None)], False),
        ("NOT_MEMBER", EMPTY, [TEXT], T), ("NOT_MEMBER", NULL, [], N),
    ],
)
def test_lists(spark, op, u, items, want):
    assert ask(spark, op, u, items=items) is want


@pytest.mark.parametrize(
    "u,lo,hi,want", [(INT, 5.0, 9.0, T), (INT, 1.0, 5.0, T), (INT, 6.0, 9.0, False), (INT, None, 9.0, N), (TEXT, 1.0, 2.0, N), (NULL, 1.0, 2.0, N)]
)
def test_between(spark, u, lo, hi, want):
    assert ask(spark, "BETWEEN", u, lo=lo, hi=hi) is want


def test_invalid_pattern_never_reaches_the_matcher(spark):
    assert ask(spark, "MATCHES", TEXT, ("str", "([", None, None), ok=False) is None
    rows = spark.createDataFrame([("([",), ("^a",), (None,)], "p string").select(predicates.pattern_is_valid(F.col("p"))).collect()
    assert [r[0] for r in rows] == [False, True, True]


def test_text_as_double_rejects_java_suffixes(spark):
    rows = spark.createDataFrame([("1d",), ("12",), (" -3.5 ",), ("1e3",), ("x",)], "s string")
    assert [r[0] for r in rows.select(cells.text_as_double(F.col("s"))).collect()] == [None, 12.0, -3.5, 1000.0, None]
