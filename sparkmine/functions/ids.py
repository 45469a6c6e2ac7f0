"""Column expressions that read dirty identifiers and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that do not belong to an id when they stand around it.
AROUND = " \t\r\n"


def clean_id(c: Column) -> Column:
    """The id without white space around it; null where nothing is left. Letter case is kept."""
    trimmed = F.btrim(c.cast("string"), F.lit(AROUND))
    return F.when(trimmed != "", trimmed)


def whole_number_id(c: Column) -> Column:
    """The whole number an id stands for (``07``, ``7.0`` and ``7`` are 7); null where it is no whole number that fits a long."""
    t = F.btrim(c.cast("string"), F.lit(AROUND))
    whole = F.regexp_extract(t, r"^([+-]?[0-9]+)(?:\.0*)?$", 1)
    # most ids are plain digits, for which no pattern is needed
    return F.when((t != "") & (F.translate(t, "0123456789", "") == ""), t.try_cast("bigint")).when(whole != "", whole.try_cast("bigint"))


def calendar_day(c: Column) -> Column:
    """The day (``yyyy-MM-dd``) written at the start of a date text, with ``-`` or ``/`` between its parts; null where it is no day."""
    t = F.btrim(c.cast("string"), F.lit(AROUND))
    iso = F.concat_ws("-", *(F.regexp_extract(t, r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?![0-9])", i) for i in (1, 2, 3)))
    return F.date_format(F.when(F.length(iso) >= 8, iso).try_cast("date"), "yyyy-MM-dd")
