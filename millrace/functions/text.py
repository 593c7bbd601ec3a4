"""Text forms as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notes in round brackets that offers' titles carry, all of which a join key leaves out.
TITLE_NOTES = (
    "steam", "epic games store", "epic games", "gog", "indiegala", "origin", "ea origin", "ubisoft connect",
    "ubisoft", "humble bundle", "drm-free", "itch.io", "battle.net", "playstation", "xbox", "switch",
)

#: ASCII white space, the same class in Java's and RE2's patterns.
BLANKS = "[ \\t\\n\\f\\r\\x0B]+"


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(c, BLANKS, " ")), F.lit(""))


def is_blank(c: Column) -> Column:
    """Not null, but nothing besides white space."""
    return c.isNotNull() & squeeze(c).isNull()


def canonical_key(c: Column) -> Column:
    """The key on which titles of different sources join.

    In this order: null becomes "", one trailing word "giveaway" goes, known notes in round brackets become a space, then
    lower case and squeezed. Patterns know Unicode's white space. The rules run once: a title that ends in the word twice
    keeps one.
    """
    notes = "|".join(re.escape(n).replace("\\ ", " ") for n in TITLE_NOTES)
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?iU)\bgiveaway\b\s*$", "")
    t = F.regexp_replace(t, rf"(?iU)\(\s*(?:{notes})\s*\)", " ")
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def audit_text(c: Column) -> Column:
    """The form in which an audit compares: text, trimmed, null as ""."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def loosely_equal(a: Column, b: Column) -> Column:
    """Equality of two texts without case and outer spaces; null if either is null."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))
