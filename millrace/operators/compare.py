"""Comparing fields, tables and sets of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import audit_text, loosely_equal


def agreement_flags(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """A nullable boolean for each of ``pairs``: whether two columns agree loosely; null if either is null.

    Pairs of which a column does not exist are passed over.
    """
    return df.withColumns({n: loosely_equal(F.col(a), F.col(b)) for n, (a, b) in pairs.items() if a in df.columns and b in df.columns})


def audit(source: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Long form of all differences: ``key``, ``finding`` (``missing``, ``extra`` or a field), ``source_value``, ``stored_value``.

    One full outer join on ``key``; values compare trimmed, null as "". Rows without key are not looked at; of a key that
    is repeated each pair is compared.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(key, F.struct(*(audit_text(F.col(c)).alias(c) for c in fields)).alias(name))

    both = side(source, "s").join(side(stored, "t"), key, "full_outer")
    entry = lambda finding, a, b: F.struct(F.lit(finding).alias("finding"), a.cast("string").alias("source_value"), b.cast("string").alias("stored_value"))
    none = F.lit(None)
    diffs = F.array_compact(F.array(*(F.when(F.col(f"s.{c}") != F.col(f"t.{c}"), entry(c, F.col(f"s.{c}"), F.col(f"t.{c}"))) for c in fields)))
    found = F.when(F.col("t").isNull(), F.array(entry("missing", none, none))).when(F.col("s").isNull(), F.array(entry("extra", none, none))).otherwise(diffs)
    return both.select(key, F.inline(found))


def audit_verdict(source: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: counts of both sides, ``missing``, ``extra``, ``differing`` keys, ``counts_match`` and ``success``.

    Success asks for nothing missing, extra or differing; whether counts match is told apart from it.
    """
    per_key = audit(source, stored, key, fields).groupBy(key).agg(F.max("finding").alias("f"))
    found = per_key.agg(F.count_if(F.col("f") == "missing").alias("missing"), F.count_if(F.col("f") == "extra").alias("extra"), F.count_if(~F.col("f").isin("missing", "extra")).alias("differing"))
    counts = source.agg(F.count("*").alias("source_rows")).join(stored.agg(F.count("*").alias("stored_rows")), how="cross")
    out = counts.join(found, how="cross")  # one row each
    return out.withColumns(
        {"counts_match": F.col("source_rows") == F.col("stored_rows"), "success": (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("differing") == 0)}
    )


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that ``a`` has more often than ``b`` and the reverse, with ``side`` (``left`` or ``right``), each as often as surplus."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: ``only_left``, ``only_right`` and ``common`` keys, each key once, nulls left out."""
    one = lambda df, flag: df.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias(flag))
    both = one(a, "l").join(one(b, "r"), key, "full_outer")
    return both.agg(
        F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common")
    )


def listed_keys(df: DataFrame, key: str, limit: int = 30) -> DataFrame:
    """One row: ``n`` and ``listing``, the ``limit`` smallest distinct keys and how many more there are.

    The keys listed are a bounded top; they are found by partial sorts and never gathered beyond ``limit``.
    """
    keys = df.where(F.col(key).isNotNull()).select(key).distinct()
    top = keys.orderBy(key).limit(limit).agg(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ", ").alias("top"))
    out = keys.agg(F.count("*").alias("n")).join(top, how="cross")  # one row each
    more = F.when(F.col("n") > limit, F.concat(F.lit(" ... ("), (F.col("n") - limit).cast("string"), F.lit(" more)"))).otherwise("")
    return out.select("n", F.concat("top", more).alias("listing"))
