"""The tiered policy for missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_incomplete(df: DataFrame, critical: list[str]) -> DataFrame:
    """Rows in which every critical column that exists has a value."""
    return df.dropna(how="any", subset=[c for c in critical if c in df.columns] or None) if critical else df


def impute(df: DataFrame, placeholders: dict[str, str]) -> DataFrame:
    """Nulls of text columns replaced by their placeholder; columns that do not exist are passed over."""
    return df.fillna({c: v for c, v in placeholders.items() if c in df.columns})


def apply_null_policy(df: DataFrame, critical: list[str], placeholders: dict[str, str]) -> DataFrame:
    """Rows without a critical value go, all other missing values of known columns get their placeholder."""
    return impute(drop_incomplete(df, critical), placeholders)


def null_policy_counts(df: DataFrame, critical: list[str], columns: list[str]) -> DataFrame:
    """One row: rows before, dropped and after, and ``imputed_<column>`` of the rows that stay, in one aggregation."""
    gone = F.lit(False)
    for c in (c for c in critical if c in df.columns):
        gone = gone | F.col(c).isNull()
    return df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(gone).alias("rows_dropped"),
        F.count_if(~gone).alias("rows_after"),
        *(F.count_if(~gone & F.col(c).isNull()).alias(f"imputed_{c}") for c in columns if c in df.columns),
    )
