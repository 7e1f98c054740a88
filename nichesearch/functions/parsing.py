"""Strict parsing of field data under ANSI mode: what does not parse is NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of presence and absence.
PRESENT = ["1", "true", "yes", "present", "presence"]
ABSENT = ["0", "false", "no", "absent", "absence"]

NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|nan|NaN|inf|Infinity|-inf)\s*$"
YEAR, DAY = r"^\d{4}$", r"^\d{4}-\d{2}-\d{2}([T ].*)?$"


def coordinate(raw: Column) -> Column:
    """A number, or NULL; units or suffixes that a plain cast would let pass do not."""
    return F.when(raw.rlike(NUMBER), F.trim(raw).try_cast("double"))


def presence(raw: Column) -> Column:
    """1, 0, or NULL for any other spelling, blanks included."""
    text = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(text.isin(PRESENT), F.lit(1)).when(text.isin(ABSENT), F.lit(0))


def observed(raw: Column) -> Column:
    """The day: a bare year is its first of January, an interval its begin, a time of day is dropped."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    first = F.substring_index(text, "/", 1)
    return F.when(text.rlike(YEAR), F.concat(text, F.lit("-01-01")).try_cast("date")).when(first.rlike(DAY), F.substring(first, 1, 10).try_cast("date"))
