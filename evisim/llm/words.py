"""Word definition shared by the operators: maximal runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A word in Java's, DuckDB's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def n_words(column: str = "text") -> Column:
    """Number of words; 0 for null."""
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")
