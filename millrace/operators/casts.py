"""Casts that turn what cannot be read into null and count it, and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strict_date(c: Column) -> Column:
    """The day of a text exactly ``yyyy-MM-dd``; null for anything else, impossible days too."""
    return F.to_date(F.try_to_timestamp(F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c), F.lit("yyyy-MM-dd")))


def to_contract(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their contracted types: dates strictly, numbers by ``try_cast``; other columns stay as they are."""
    def cast(name: str) -> Column:
        kind = types.get(name)
        if kind is None:
            return F.col(name)
        if kind == "date" and dict(df.dtypes)[name] == "string":
            return strict_date(F.col(name)).alias(name)
        return F.col(name).try_cast(kind).alias(name)

    return df.select(*map(cast, df.columns))


def cast_counts(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row: for each contracted column ``<c>_before`` (values), ``<c>_read`` and ``<c>_lost``."""
    cast = to_contract(df.select(*(F.col(c) for c in types), *(F.col(c).alias(f"_raw_{c}") for c in types)), types)
    out = []
    for c in types:
        raw, now = F.col(f"_raw_{c}"), F.col(c)
        out += [F.count(raw).alias(f"{c}_before"), F.count(now).alias(f"{c}_read"), F.count_if(raw.isNotNull() & now.isNull()).alias(f"{c}_lost")]
    return cast.agg(*out)


def add_year(df: DataFrame, column: str, name: str) -> DataFrame:
    """The year of a date column as a further column; without such a column, or if it is no date, nothing is added."""
    kinds = dict(df.dtypes)
    if kinds.get(column) not in ("date", "timestamp", "timestamp_ntz"):
        return df
    return df.withColumn(name, F.year(column))
