"""Forms in which texts and days of different systems compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_text(c: Column) -> Column:
    """Without spaces, tabs and line ends at its ends; blank becomes null."""
    return F.nullif(F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+\z", ""), F.lit(""))


_DAY = r"\A([0-9]{4})(?:-([0-9]{1,2})-([0-9]{1,2})|/([0-9]{1,2})/([0-9]{1,2})|\.([0-9]{1,2})\.([0-9]{1,2})|([0-9]{2})([0-9]{2}))(?:[T ]00:?00(?::?00(?:[.,]0+)?)?(?: ?(?:Z|UTC|[+-]00:?00))?)?\z"


def day_or_text(c: Column) -> Column:
    """``YYYY-MM-DD`` of a real day written year first, with or without a midnight time; else the plain text."""
    t = plain_text(c)
    part = lambda *groups: F.concat(*(F.coalesce(F.regexp_extract(t, _DAY, g), F.lit("")) for g in groups))
    iso = F.concat_ws("-", part(1), F.lpad(part(2, 4, 6, 8), 2, "0"), F.lpad(part(3, 5, 7, 9), 2, "0"))
    day = F.to_date(F.try_to_timestamp(F.when(t.rlike(_DAY), iso), F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), t)
