"""Deduplication at the level of rows, keys and derived keys, and the keyed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.naming import fresh
from millrace.operators.latest import latest_per_key


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each row once; nulls are equal to each other."""
    return df.dropDuplicates()


def one_per_key(df: DataFrame, key: str, order: list[Column], null_is_a_key: bool = False) -> DataFrame:
    """The first row of each key in a total ``order``, the same survivor however the data are partitioned.

    Rows with a null key are all kept, or with ``null_is_a_key`` treated as one key's.
    """
    if not null_is_a_key:
        return latest_per_key(df, [key], order, keep_null_keys=True)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    name = fresh("_rank", df)
    return df.withColumn(name, rank).where(F.col(name) == 1).drop(name)


def deduplicate(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Both levels: full rows first, then keys, a null key counting as one. An absent key column skips the second."""
    rows = distinct_rows(df)
    return one_per_key(rows, key, order, null_is_a_key=True) if key in df.columns else rows


def duplicate_counts(df: DataFrame, key: str) -> DataFrame:
    """One row: ``rows_before``, ``full_duplicates``, ``rows_distinct``, ``key_duplicates``, ``rows_after``."""
    n = fresh("_n", df)
    groups = df.groupBy(*df.columns).agg(F.count("*").alias(n))
    by_key = groups.groupBy(key).agg(F.sum(n).alias("_n"), F.count("*").alias("_distinct"))
    total = by_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("_distinct"), F.lit(0)).alias("rows_distinct"), F.count("*").alias("rows_after"))
    return total.select(
        "rows_before", (F.col("rows_before") - F.col("rows_distinct")).alias("full_duplicates"), "rows_distinct",
        (F.col("rows_distinct") - F.col("rows_after")).alias("key_duplicates"), "rows_after",
    )


def most_recent(df: DataFrame, key: str, priority: Column, ties: list[Column]) -> DataFrame:
    """The row of highest ``priority`` per derived key, null last, then by ``ties``; rows with an empty or null key all stay."""
    named = F.col(key).isNotNull() & (F.col(key) != "")
    best = latest_per_key(df.where(named), [key], [priority.desc_nulls_last(), *ties])
    return best.unionByName(df.where(~named))


def source_summary(df: DataFrame, key: str) -> DataFrame:
    """One row about a source before one row per derived key is taken: ``records``, ``keyed``, ``unique_keys``, ``duplicate_keys``, ``surplus_rows``, ``without_key``.

    A duplicate key is one that more than one record bears; rows with an empty or null key belong to none.
    """
    named = F.col(key).isNotNull() & (F.col(key) != "")
    per_key = df.groupBy(F.when(named, F.col(key)).alias("_k")).agg(F.count("*").alias("_n"))
    known, zero = F.col("_k").isNotNull(), F.lit(0).cast("long")
    out = per_key.agg(
        F.coalesce(F.sum("_n"), zero).alias("records"), F.coalesce(F.sum(F.when(known, F.col("_n"))), zero).alias("keyed"),
        F.count("_k").alias("unique_keys"), F.count_if(known & (F.col("_n") > 1)).alias("duplicate_keys"),
    )
    return out.withColumns({"surplus_rows": F.col("keyed") - F.col("unique_keys"), "without_key": F.col("records") - F.col("keyed")})


def recency(c: Column) -> Column:
    """A text date or time as a timestamp for ordering; what is neither becomes null, and so comes last."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def upsert(existing: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(table, rejected): whole-row replacement of ``existing`` by ``batch`` on ``key``; the last in ``order`` wins within a batch.

    Columns that a batch lacks become null, and columns unknown to the table are left out. Rows without key, which belong
    to no record, come out as rejected. An empty batch leaves the table as it is.
    """
    fitted = batch.select(*(F.col(c).cast(t) if c in batch.columns else F.lit(None).cast(t).alias(c) for c, t in existing.dtypes), *(c for c in batch.columns if c.startswith("_")))
    known = fitted.where(F.col(key).isNotNull())
    latest = latest_per_key(known, [key], order).select(*existing.columns)
    kept = existing.join(latest.select(key), key, "left_anti").select(*existing.columns)
    return kept.unionByName(latest), batch.where(F.col(key).isNull())
