"""Recognising values that only stand in for a missing one."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words written where no value is known (compared lower-cased and trimmed).
STAND_INS = (
    "n/a", "na", "n.a.", "n/a.", "none", "null", "nil", "nan", "unknown", "undefined", "unspecified",
    "not available", "not applicable", "not specified", "not set", "missing", "tba", "tbd", "tbc", "to be announced",
    "to be determined", "coming soon", "soon", "soon™", "void", "empty", "no data", "no value", "blank",
    "#n/a", "#na", "#ref!", "#value!", "#null!", "#name?", "#div/0!", "(null)", "(none)", "<null>", "<none>", "(unknown)", "<na>",
)

#: White space of any script, with the invisible characters that editors leave at the ends of a value.
SPACE_CLASS = r"[\s\p{Z}\x{200B}\x{FEFF}]"
_ENDS = re.compile(r"^[\s​﻿]+|[\s​﻿]+$")
_WORDLIKE = re.compile(r"\w")
_SET = frozenset(STAND_INS)


def squeezed_ends(c: Column) -> Column:
    """``c`` without white space at its ends (any script's, not only U+0020)."""
    return F.regexp_replace(c, rf"^{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def is_stand_in(c: Column) -> Column:
    """True for null, blank, punctuation without a letter or digit, and the fixed words."""
    t = F.lower(squeezed_ends(c))
    return c.isNull() | ~t.rlike(r"[\p{L}\p{N}]") | t.isin(*STAND_INS)


def stands_for_missing(value: str | None) -> bool:
    """The same test for one Python value."""
    if value is None:
        return True
    v = _ENDS.sub("", value).lower()
    return v in _SET or not any(ch.isalnum() for ch in v)
