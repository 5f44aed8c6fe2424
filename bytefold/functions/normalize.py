"""Spelling rules of the store tables as column expressions (all stay inside codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters counted as blanks at the ends of a text.
BLANKS = " \t\r\n\x0b\x0c"

_STAMP = r"^\d{8}_\d{6}_\d{1,6}$"
_ZONED = r"([+-]\d{2}:?\d{2}|[zZ])$"


def trimmed(col: Column | str) -> Column:
    """The text without blanks at its ends; null stays null."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def norm_id(col: Column | str) -> Column:
    """An id in its one spelling: lower case, no blanks, no hyphens; null if nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.translate(c, BLANKS + "-", "")), F.lit(""))


def norm_label(col: Column | str) -> Column:
    """A label in its one spelling: trimmed, lower case, inner blanks and hyphens as ``_``."""
    return F.translate(F.lower(trimmed(col)), " \t-", "___")


def norm_source(col: Column | str) -> Column:
    """A source name whatever its case, outer blanks and word separators."""
    return F.nullif(F.regexp_replace(F.lower(trimmed(col)), r"[\s_\-]+", "_"), F.lit(""))


def norm_hex(col: Column | str) -> Column:
    """A byte value as lower-case hex digits, or null if the text is no byte value."""
    c = F.translate(F.lower(F.col(col) if isinstance(col, str) else col), BLANKS + ":-", "")
    bare = F.when(c.startswith("0x"), F.substring(c, 3, 2_147_483_647)).otherwise(c)
    good = (F.length(bare) > 0) & (F.length(bare) % 2 == 0) & (F.translate(bare, "0123456789abcdef", "") == "")
    return F.when(good, bare)


def instant_micros(col: Column | str) -> Column:
    """Microseconds since the epoch of a time kept as text; null if it is no time.

    Takes ISO 8601 with or without an offset (none means UTC), a blank instead of ``T``, and
    the dump stamp ``YYYYMMDD_HHMMSS_micro``.  Does not depend on the session time zone.
    """
    c = trimmed(col)
    stamp = F.concat(
        F.substring(c, 1, 4), F.lit("-"), F.substring(c, 5, 2), F.lit("-"), F.substring(c, 7, 2), F.lit("T"),
        F.substring(c, 10, 2), F.lit(":"), F.substring(c, 12, 2), F.lit(":"), F.substring(c, 14, 2), F.lit("."),
        F.lpad(F.substring(c, 17, 6), 6, "0"), F.lit("Z"),
    )
    iso = F.when(c.rlike(_ZONED), c).otherwise(F.concat(c, F.lit("Z")))
    return F.unix_micros(F.when(c.rlike(_STAMP), stamp).otherwise(iso).try_cast("timestamp"))


def micros_of(col: Column | str) -> Column:
    """Microseconds since the epoch of a zone-less UTC timestamp column."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(F.concat(c.cast("string"), F.lit("Z")).try_cast("timestamp"))


def month_of(micros: Column) -> Column:
    """``YYYY-MM`` in UTC of a time in microseconds, ``unknown`` if it is null."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / F.lit(86_400_000_000)).cast("int"))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))
