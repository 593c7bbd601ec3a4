"""Profiles of a table as one-row metric frames, each from a single aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.naming import fresh
from millrace.functions.text import is_blank
from millrace.operators.casts import strict_date


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def number_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    whole = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in df.dtypes if (t in whole or t.startswith("decimal")) and c not in exclude]


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``nulls_<column>`` of every column."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns or df.columns))


def blank_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``blanks_<column>`` of every text column: values of nothing but white space."""
    return df.agg(*(F.count_if(is_blank(F.col(c))).alias(f"blanks_{c}") for c in columns or text_columns(df)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``rows``, ``rows_distinct``, ``duplicates``: pre-aggregated by whole row, nulls equal to each other."""
    n = fresh("_n", df)
    groups = df.groupBy(*df.columns).agg(F.count("*").alias(n))
    out = groups.agg(F.coalesce(F.sum(n), F.lit(0)).alias("rows"), F.count("*").alias("rows_distinct"))
    return out.withColumn("duplicates", F.col("rows") - F.col("rows_distinct"))


def _distinct(c: Column) -> Column:
    """Distinct values, null counting as one."""
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))


def key_metrics(df: DataFrame, key: str) -> DataFrame:
    """``rows``, ``keys`` (null counts as one), ``surplus_rows``, ``least_key``, ``greatest_key``."""
    per_key = df.groupBy(key).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
        F.min(key).alias("least_key"), F.max(key).alias("greatest_key"),
    )


def date_validity(df: DataFrame, column: str) -> DataFrame:
    """``valid`` and ``invalid`` among the values; all of a date column are valid."""
    c = F.col(column)
    good = strict_date(c).isNotNull() if dict(df.dtypes)[column] == "string" else c.isNotNull()
    return df.agg(F.count_if(good).alias("valid"), F.count_if(c.isNotNull() & ~good).alias("invalid"))


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``distinct_<column>``, null counting as a value."""
    return df.agg(*(_distinct(F.col(c)).alias(f"distinct_{c}") for c in columns))


def full_profile(df: DataFrame, key: str, date: str | None = None, categories: tuple[str, ...] = ()) -> DataFrame:
    """Everything above in one row: sizes, sums of nulls and blanks, duplicates, key, date and categories.

    Two scans: whole rows are counted once, and feed all sums; the key's and the categories' values are counted
    together, unpivoted, and feed the numbers of distinct ones. An empty table has zeros and no key range.
    """
    n = fresh("_n", df)
    groups = df.groupBy(*df.columns).agg(F.count("*").alias(n))
    times = lambda c: F.coalesce(F.sum(c.cast("long") * F.col(n)), F.lit(0).cast("long"))
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    blanks = sum((is_blank(F.col(c)).cast("long") for c in text_columns(df)), F.lit(0))
    sums = [F.count("*").alias("rows_distinct"), times(F.lit(1)).alias("_rows"), F.lit(len(df.columns)).alias("columns"), times(nulls).alias("total_nulls"), times(blanks).alias("total_blanks")]
    if date:
        good = strict_date(F.col(date)).isNotNull() if dict(df.dtypes)[date] == "string" else F.col(date).isNotNull()
        sums += [times(good).alias("dates_valid"), times(F.col(date).isNotNull() & ~good).alias("dates_invalid")]
    whole = groups.agg(*sums, F.min(key).alias("least_key"), F.max(key).alias("greatest_key"))
    names = [key, *categories]
    parts = [F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(names)]
    values = df.select(F.explode(F.array(*parts)).alias("p")).select("p.i", "p.v").groupBy("i", "v").agg(F.lit(1).alias("_one"))
    distinct = values.agg(*(F.count_if(F.col("i") == i).alias("keys" if not i else f"distinct_{c}") for i, c in enumerate(names)))
    both = whole.join(distinct, how="cross")  # rows of metrics, one each
    dates = ["dates_valid", "dates_invalid"] if date else []
    return both.select(
        "rows_distinct", (F.col("_rows") - F.col("rows_distinct")).alias("duplicates"), "columns", "total_nulls", "total_blanks", *dates, F.col("_rows").alias("rows"),
        "keys", (F.col("_rows") - F.col("keys")).alias("surplus_rows"), "least_key", "greatest_key", *(f"distinct_{c}" for c in categories),
    )
