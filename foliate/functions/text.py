"""Text expressions with fixed, explicit definitions of space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as space in Unicode, as a regular-expression class.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0  -     　]"


def collapse(c: Column) -> Column:
    """Runs of space as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and all-space texts."""
    return c.isNull() | (F.length(strip(c)) == 0)


def excerpt(c: Column, limit: int = 240) -> Column:
    """The collapsed text; beyond ``limit`` characters its start and an ellipsis, ``limit`` characters together."""
    short = collapse(c)
    return F.when(F.length(short) > limit, F.concat(F.rtrim(F.substring(short, 1, limit - 3)), F.lit("..."))).otherwise(short)
