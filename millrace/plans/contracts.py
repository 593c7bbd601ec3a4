"""Schemas, column roles and lineage of the catalogue pipelines."""

from __future__ import annotations

from pyspark.sql.types import LongType, StringType, StructField, StructType

# The fields of the three sources, in the order of their documents.
CATALOGUE_FIELDS = ("id", "title", "thumbnail", "short_description", "game_url", "genre", "platform", "publisher", "developer", "release_date", "freetogame_profile_url")
OFFER_FIELDS = ("id", "title", "worth", "thumbnail", "image", "description", "instructions", "open_giveaway_url", "published_date", "type", "platforms", "end_date", "users", "status", "gamerpower_url")
CONTRAST_FIELDS = ("id", "title", "thumbnail", "short_description", "game_url", "genre", "platform", "publisher", "developer", "release_date", "profile_url")

# Column roles and what stands for a missing value in each.
CRITICAL = ("id", "title")
IMPORTANT = ("genre", "platform", "publisher", "developer")
DESCRIPTIVE = ("thumbnail", "short_description", "game_url", "freetogame_profile_url")
CATEGORIES = IMPORTANT
UNKNOWN, NOT_AVAILABLE = "Unknown", "Not Available"
PLACEHOLDERS = {c: UNKNOWN for c in IMPORTANT} | {c: NOT_AVAILABLE for c in DESCRIPTIVE}

TYPES = {"id": "int", "release_date": "date"}
KEY, DATE, YEAR, JOIN_KEY = "id", "release_date", "release_year", "title_match"

# The columns that enrichment brings in, by their names in the sources.
OFFER_COLUMNS = {
    "id": "gamerpower_id", "worth": "gamerpower_worth", "type": "gamerpower_type", "platforms": "gamerpower_platforms", "status": "gamerpower_status",
    "users": "gamerpower_users", "published_date": "gamerpower_published_date", "end_date": "gamerpower_end_date", "gamerpower_url": "gamerpower_url",
}
CONTRAST_COLUMNS = {
    "id": "mmobomb_id", "genre": "mmobomb_genre", "platform": "mmobomb_platform", "publisher": "mmobomb_publisher", "developer": "mmobomb_developer",
    "release_date": "mmobomb_release_date", "profile_url": "mmobomb_profile_url",
}
COMPARED = IMPORTANT
OFFER_WRAPPER, CONTRAST_WRAPPER = "giveaways", "games"


def _schema(fields: tuple[str, ...], whole: tuple[str, ...] = ("id",)) -> StructType:
    return StructType([StructField(f, LongType() if f in whole else StringType()) for f in fields])


CATALOGUE, CONTRAST = _schema(CATALOGUE_FIELDS), _schema(CONTRAST_FIELDS)
OFFERS = _schema(OFFER_FIELDS, ("id", "users"))


def lineage() -> dict[str, str]:
    """Each column of the enriched table with where it comes from."""
    out = {c: "catalogue" for c in CATALOGUE_FIELDS} | {YEAR: f"derived from {DATE}", JOIN_KEY: "derived from title"}
    out |= {n: f"offers.{c}" for c, n in OFFER_COLUMNS.items()} | {n: f"contrast.{c}" for c, n in CONTRAST_COLUMNS.items()}
    return out | {f"{c}_match": f"comparison of {c} with contrast.{c}" for c in COMPARED}
