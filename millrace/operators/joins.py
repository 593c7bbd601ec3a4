"""Joins that measure their coverage, key overrides, and checks of cardinality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.naming import fresh


def select_prefixed(df: DataFrame, names: dict[str, str], key: str) -> DataFrame:
    """The key and the columns of ``names`` that exist, renamed; absent ones are passed over."""
    return df.select(key, *(F.col(c).alias(n) for c, n in names.items() if c in df.columns))


def apply_overrides(df: DataFrame, overrides: DataFrame, title: str, key: str) -> DataFrame:
    """``key`` replaced where the raw ``title`` has an override.

    ``overrides`` has ``title``, ``target_key`` and ``seq``; it matches exactly, the last of several entries counts, and
    blank targets none. Rows of ``df`` are neither lost nor multiplied.
    """
    usable = overrides.where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("target_key", F.lit("")) != ""))
    raw, target = fresh("_title", df), fresh("_target", df)
    last = usable.groupBy(F.col("title").alias(raw)).agg(F.max_by("target_key", "seq").alias(target))
    joined = df.join(last, F.col(title) == F.col(raw), "left")
    return joined.withColumn(key, F.coalesce(target, key)).select(*df.columns)


def coverage_join(base: DataFrame, source: DataFrame, key: str, found: str = "matched") -> DataFrame:
    """Left join on a derived key in which an empty or null key joins nothing; ``found`` says whether a row matched.

    The source's columns follow the base's; those of a name that the base has too are prefixed by ``found`` and an
    underscore. Whether the smaller side is broadcast is left to its measured size.
    """
    k, hit = fresh("_key", base, source), fresh("_found", base, source)
    names = {c: f"{found}_{c}" if c in base.columns else c for c in source.columns if c != key}
    b = base.withColumn(k, F.nullif(F.col(key), F.lit("")))
    s = source.select(F.nullif(F.col(key), F.lit("")).alias(k), *(F.col(c).alias(n) for c, n in names.items()), F.lit(True).alias(hit)).where(F.col(k).isNotNull())
    joined = b.join(s, k, "left").withColumn(found, F.coalesce(hit, F.lit(False)))
    return joined.select(*base.columns, *names.values(), found)


def coverage(joined: DataFrame, base_key: str, found: str = "matched") -> DataFrame:
    """One row: ``base_rows``, ``matched``, ``unmatched`` (base keys, each once), ``ambiguous`` keys, ``coverage_percent``."""
    per_key = joined.groupBy(base_key).agg(F.max(F.col(found).cast("int")).alias("_hit"), F.count("*").alias("_n"))
    out = per_key.agg(
        F.count("*").alias("base_rows"), F.coalesce(F.sum("_hit"), F.lit(0)).cast("long").alias("matched"), F.count_if(F.col("_n") > 1).alias("ambiguous")
    ).withColumn("unmatched", F.col("base_rows") - F.col("matched"))
    return out.withColumn("coverage_percent", percent(F.col("matched"), F.col("base_rows")))


def percent(part, whole):
    """``part`` of ``whole`` in percent to two places, half up; 0 of nothing."""
    exact = part.cast("decimal(20,0)") * 100 / whole.cast("decimal(20,0)")
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(exact, 2).cast("double"))


def enrich(base: DataFrame, sources: list[tuple[DataFrame, str]], key: str) -> DataFrame:
    """``base`` left-joined with every source in turn; each source has one row per key and a name for its match flag."""
    return reduce(lambda acc, s: coverage_join(acc, s[0], key, s[1]), sources, base)


def cardinality(stages: list[tuple[str, DataFrame, DataFrame]], key: str) -> DataFrame:
    """A row per stage: ``stage``, ``rows_before``, ``rows_after``, ``change``, ``duplicate_keys`` after it, ``preserved``."""
    def one(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
        b = before.agg(F.count("*").alias("rows_before"))
        a = after.groupBy(key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_after"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_keys"))
        both = b.join(a, how="cross")  # one row each
        same = (F.col("rows_before") == F.col("rows_after")) & (F.col("duplicate_keys") == 0)
        return both.select(F.lit(name).alias("stage"), "rows_before", "rows_after", (F.col("rows_after") - F.col("rows_before")).alias("change"), "duplicate_keys", same.alias("preserved"))

    return reduce(DataFrame.unionByName, (one(*s) for s in stages))
