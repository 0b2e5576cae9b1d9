"""The 14 predicate operators as Column expressions with three-valued results.

TRUE / FALSE / NULL ("cannot determine"). Nothing here raises: every cast is
guarded, and a regular expression is only applied where `pattern_ok` holds.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligrid.model import OPERATORS

OPCODE = {name: i for i, name in enumerate(OPERATORS)}


class Cell(NamedTuple):
    """The four columns of a typed cell, so that callers choose where they live."""

    kind: Column
    s: Column
    f: Column
    a: Column


def cell_of(c: Column) -> Cell:
    return Cell(c["kind"], c["s"], c["f"], c["a"])

def unknown() -> Column:
    return F.lit(None).cast("boolean")


def is_null(u: Cell) -> Column:
    return u.kind == "null"


def _numeric(c: Cell) -> Column:
    return c.kind.isin("num", "bool")


def _same_number(x: Column, y: Column) -> Column:
    # Spark orders NaN above all and equal to itself; comparisons with NaN are false here.
    return F.when(F.isnan(x) | F.isnan(y), False).otherwise(x == y)


def equals(u: Cell, v: Cell) -> Column:
    """Untyped equality: numbers and booleans by value, others within their kind."""
    return (
        F.when(_numeric(u) & _numeric(v), _same_number(u.f, v.f))
        .when(u.kind != v.kind, False)
        .when(u.kind == "str", u.s == v.s)
        .when(u.kind == "list", u.a == v.a)
        .otherwise(u.kind == "null")
    )


def eq(u: Cell, v: Cell) -> Column:
    either_bool = (u.kind == "bool") | (v.kind == "bool")
    one_text = (u.kind == "str") != (v.kind == "str")
    both_numeric = _numeric(u) & _numeric(v)
    return F.when(is_null(u), unknown()).when(
        ~both_numeric & (either_bool | one_text), unknown()
    ).otherwise(equals(u, v))


def neq(u: Cell, v: Cell) -> Column:
    return ~eq(u, v)


def _ordered(u: Cell, v: Cell, compare) -> Column:
    x, y = u.f, v.f
    return (
        F.when(x.isNull() | y.isNull(), unknown())
        .when(F.isnan(x) | F.isnan(y), False)
        .otherwise(compare(x, y))
    )


def lt(u: Cell, v: Cell) -> Column:
    return _ordered(u, v, lambda x, y: x < y)


def lte(u: Cell, v: Cell) -> Column:
    return _ordered(u, v, lambda x, y: x <= y)


def gt(u: Cell, v: Cell) -> Column:
    return _ordered(u, v, lambda x, y: x > y)


def gte(u: Cell, v: Cell) -> Column:
    return _ordered(u, v, lambda x, y: x >= y)


def between(u: Cell, lo: Column, hi: Column) -> Column:
    x = u.f
    return (
        F.when(x.isNull() | lo.isNull() | hi.isNull(), unknown())
        .when(F.isnan(x) | F.isnan(lo) | F.isnan(hi), False)
        .otherwise((x >= lo) & (x <= hi))
    )


def _has(items: Column, u: Cell) -> Column:
    return F.exists(items, lambda v: equals(u, cell_of(v)))


def in_list(u: Cell, items: Column) -> Column:
    return (
        F.when(is_null(u), unknown())
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, False)
        .otherwise(_has(items, u))
    )


def not_in_list(u: Cell, items: Column) -> Column:
    return (
        F.when(is_null(u), unknown())
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, True)
        .otherwise(~_has(items, u))
    )


def not_member(u: Cell, items: Column) -> Column:
    # List elements are texts, so only text items of the group can match one.
    texts = F.transform(F.filter(items, lambda v: v["kind"] == "str"), lambda v: v["s"])
    return (
        F.when(is_null(u), unknown())
        .when(F.coalesce(F.size(items), F.lit(0)) <= 0, True)
        .when(u.kind != "list", unknown())
        .otherwise(~F.coalesce(F.arrays_overlap(u.a, texts), F.lit(False)))
    )


def contains(u: Cell, v: Cell) -> Column:
    return (
        F.when(is_null(u), unknown())
        .when(
            u.kind == "list",
            (v.kind == "str") & F.coalesce(F.exists(u.a, lambda x: x == v.s), F.lit(False)),
        )
        .when(v.kind != "str", unknown())
        .otherwise(F.contains(u.s, v.s))
    )


def matches(u: Cell, v: Cell, pattern_ok: Column) -> Column:
    pattern = F.coalesce(v.s, F.lit("None"))
    return F.when(is_null(u) | ~pattern_ok, unknown()).otherwise(F.regexp_like(u.s, pattern))


def pattern_is_valid(pattern: Column) -> Column:
    """Compile the pattern on the JVM once per rule; a broken one yields false."""
    compiled = F.try_reflect(
        F.lit("java.util.regex.Pattern"), F.lit("compile"), F.coalesce(pattern, F.lit("None"))
    )
    return compiled.isNotNull()


def evaluate_as(
    op: str, u: Cell, v: Cell, lo: Column, hi: Column, items: Column, pattern_ok: Column
) -> Column:
    """Result of one named operator."""
    return {
        "EQ": lambda: eq(u, v),
        "NEQ": lambda: neq(u, v),
        "LT": lambda: lt(u, v),
        "LTE": lambda: lte(u, v),
        "GT": lambda: gt(u, v),
        "GTE": lambda: gte(u, v),
        "BETWEEN": lambda: between(u, lo, hi),
        "IN": lambda: in_list(u, items),
        "NOT_IN": lambda: not_in_list(u, items),
        "NOT_MEMBER": lambda: not_member(u, items),
        "IS_NULL": lambda: is_null(u),
        "IS_NOT_NULL": lambda: ~is_null(u),
        "CONTAINS": lambda: contains(u, v),
        "MATCHES": lambda: matches(u, v, pattern_ok),
    }[op]()


def evaluate(
    opcode: Column, u: Cell, v: Cell, lo: Column, hi: Column, items: Column, pattern_ok: Column
) -> Column:
    """Dispatch on the operator's code; an unknown operator cannot be determined.

    Codes follow model.OPERATORS, so families are contiguous and found in two steps.
    """

    def family(*names: str) -> Column:
        chain = None
        for name in names:
            branch = (opcode == OPCODE[name], evaluate_as(name, u, v, lo, hi, items, pattern_ok))
            chain = F.when(*branch) if chain is None else chain.when(*branch)
        return chain

    return (
        F.when(opcode <= OPCODE["NEQ"], family("EQ", "NEQ"))
        .when(opcode <= OPCODE["BETWEEN"], family("LT", "LTE", "GT", "GTE", "BETWEEN"))
        .when(opcode <= OPCODE["NOT_MEMBER"], family("IN", "NOT_IN", "NOT_MEMBER"))
        .otherwise(family("IS_NULL", "IS_NOT_NULL", "CONTAINS", "MATCHES"))
    )
