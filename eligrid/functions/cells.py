"""The typed cell: one struct that carries a dynamically typed rule or profile value.

`kind` is null|str|num|bool|list, `s` the text form, `f` the value as a double
where it has one, `a` the list elements.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL = "struct<kind:string,s:string,f:double,a:array<string>>"
# What a text must look like to be read as a number (rejects Java's 1d, 0x1p3).
NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _cell(kind: Column, s: Column, f: Column, a: Column) -> Column:
    return F.struct(
        kind.alias("kind"),
        s.cast("string").alias("s"),
        f.cast("double").alias("f"),
        a.cast("array<string>").alias("a"),
    )


def text_as_double(s: Column) -> Column:
    return F.when(F.trim(s).rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))


def bool_text(b: Column) -> Column:
    return F.when(b, "True").when(~b, "False")


def list_text(a: Column) -> Column:
    quoted = F.transform(a, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def cell(value: Column, kind: str) -> Column:
    """Cell of a typed column; kind is int|float|str|bool|list."""
    none = F.lit(None)
    if kind in ("int", "float"):
        made = _cell(F.lit("num"), value, value, none)
    elif kind == "bool":
        made = _cell(F.lit("bool"), bool_text(value), value.cast("int"), none)
    elif kind == "list":
        made = _cell(F.lit("list"), list_text(value), none, value)
    else:
        made = _cell(F.lit("str"), value, text_as_double(value), none)
    return F.when(value.isNotNull(), made).otherwise(null_cell())


def null_cell() -> Column:
    none = F.lit(None)
    return _cell(F.lit("null"), none, none, none)


def cell_from_text(kind: Column, text: Column) -> Column:
    """Cell of a rule value stored as (kind, text)."""
    none = F.lit(None)
    f = (
        F.when(kind == "num", text.try_cast("double"))
        .when(kind == "bool", (text == "True").cast("double"))
        .when(kind == "str", text_as_double(text))
    )
    return _cell(
        F.when(text.isNull(), "null").otherwise(kind), text, f, none
    )
