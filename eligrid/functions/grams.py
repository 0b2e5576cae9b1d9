"""Substrings of a text as array expressions, in time linear in its length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def grams(text: Column, size: int) -> Column:
    """All substrings of `size` characters in order; none of a shorter or null text.

    A substring is found by counting from the start of its text, so the text is cut into short chunks first; each takes
    the beginning of the next one along, so that no substring is lost between them.
    """

    def windows(piece: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(piece) - size + 1)
        return F.when(F.length(piece) >= size, F.transform(starts, lambda i: F.substring(piece, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))

    def overlapping(chunks: Column) -> Column:
        return F.zip_with(chunks, F.slice(chunks, 2, F.size(chunks)), lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, size - 1), F.lit(""))))

    chunks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    return F.flatten(F.transform(F.element_at(F.transform(F.array(chunks), overlapping), 1), windows))
