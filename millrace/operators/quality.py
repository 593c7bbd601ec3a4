"""Validation of a cleaned table and its quality score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.naming import fresh


def schema_difference(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) columns, sorted."""
    return sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))


def final_checks(df: DataFrame, key: str, critical: list[str], types: dict[str, str]) -> DataFrame:
    """One row: ``duplicate_keys``, ``critical_nulls``, ``<c>_typed`` for each of ``types``, and ``valid``.

    A column that does not exist is not typed right. Null keys count as one key.
    """
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"), sum((F.sum(F.col(c).isNull().cast("long")) for c in critical if c in df.columns), F.lit(0)).alias("_nulls"))
    kinds = dict(df.dtypes)
    checks = per_key.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"), F.coalesce(F.sum("_nulls"), F.lit(0)).cast("long").alias("critical_nulls"))
    typed = {f"{c}_typed": F.lit(kinds.get(c) == t) for c, t in types.items()}
    valid = (F.col("duplicate_keys") == 0) & (F.col("critical_nulls") == 0)
    for c in typed.values():
        valid = valid & c
    return checks.withColumns(typed).withColumn("valid", valid)


def _component(problems, rows):
    """100 times the share without problem, 0 at least, to two places; 100 of nothing."""
    return F.when(rows == 0, F.lit(100.0)).otherwise(F.round(F.greatest(F.lit(0.0), 1 - problems / rows) * 100, 2))


def quality_score(before: DataFrame, after: DataFrame, key: str, critical: list[str], types: dict[str, str]) -> DataFrame:
    """One row: ``uniqueness``, ``completeness``, ``typing``, ``resolution`` and their mean ``score``, all in percent.

    Uniqueness and completeness are of the cleaned table (surplus keys, nulls of critical columns, two in a row counting
    twice); typing is the share of ``types`` that its columns have; resolution is how many of the problems found before
    (full duplicates and nulls) are gone. Components are rounded before they are averaged; empty tables score 100.
    """
    n = fresh("_n", before)
    groups = before.groupBy(*before.columns).agg(F.count("*").alias(n))
    nulls = sum((F.col(c).isNull().cast("int") for c in before.columns), F.lit(0))
    was = groups.agg((F.coalesce(F.sum(F.col(n) - 1), F.lit(0)) + F.coalesce(F.sum(nulls * F.col(n)), F.lit(0))).alias("found"))
    rows = after.agg(F.count("*").alias("rows"))
    left = final_checks(after, key, critical, types)
    typed = sum((F.col(f"{c}_typed").cast("int") for c in types), F.lit(0))
    both = was.join(left, how="cross").join(rows, how="cross")  # one row each
    surplus, missing = F.col("duplicate_keys"), F.col("critical_nulls")
    out = both.select(
        _component(surplus, F.col("rows")).alias("uniqueness"),
        _component(missing, F.col("rows")).alias("completeness"),
        F.round(typed * 100.0 / max(1, len(types)), 2).alias("typing"),
        _component(surplus + missing, F.col("found")).alias("resolution"),
    )
    return out.withColumn("score", F.round((F.col("uniqueness") + F.col("completeness") + F.col("typing") + F.col("resolution")) / 4, 2))
