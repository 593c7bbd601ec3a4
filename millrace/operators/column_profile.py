"""Column-level quality profiles of loads and the shifts between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.missing import SPACE_CLASS, is_stand_in, squeezed_ends

# What the bytes 80 to BF of UTF-8 become when read as Windows-1252 or Latin-1.
_CONT = "\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178"
_MOJIBAKE = f"[\u00c2-\u00df][{_CONT}]|[\u00e0-\u00ef][{_CONT}]{{2}}|[\u00f0-\u00f4][{_CONT}]{{3}}"
BROKEN = rf"[\p{{Cc}}\p{{Co}}\x{{FFFD}}]|{_MOJIBAKE}"
#: The same pattern with the characters themselves, for SQL engines whose patterns have no escapes for them.
BROKEN_SQL = "[\\p{Cc}\\p{Co}\ufffd]|" + _MOJIBAKE
MARKUP = r"(?i)://|\bwww\.|[\w.+-]+@[\w-]+\.\w|</?[a-z][^<>]*>|&(?:[a-z][a-z0-9]{1,15}|#\d{1,7}|#x[0-9a-f]{1,6});"


def ill_formed_day(first: str = "1990-01-01", last: str = "2026-12-31"):
    """A test of a text column: not exactly a real day ``YYYY-MM-DD`` from ``first`` to ``last``; null passes."""

    def test(c: Column) -> Column:
        day = F.try_to_date(F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c), "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c), F.lit("yyyy-MM-dd")))
        return c.isNotNull() & ~F.coalesce(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(False))

    return test


def ill_formed_name(c: Column) -> Column:
    """A test of a text column: it cannot stand as a company's name as written; null passes.

    Blank or without a letter, standing for missing, padded, with broken characters, or holding an address or markup.
    """
    return c.isNotNull() & (
        ~c.rlike(r"\p{L}") | is_stand_in(c) | (squeezed_ends(c) != c) | c.rlike(rf"^{SPACE_CLASS}|{SPACE_CLASS}\z") | c.rlike(BROKEN) | c.rlike(MARKUP)
    )


def _long(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.column_name", "p.value")


def _by_column(rules: dict[str, object], value: Column) -> Column:
    out = F.lit(False)
    for name, rule in rules.items():
        out = F.when(F.col("column_name") == name, rule(value)).otherwise(out)
    return out


def value_counts(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """Exact counts of every value (null included) by load and column; hot values are summed before the shuffle."""
    return _long(df, [load], columns).groupBy(load, "column_name", "value").agg(F.count("*").alias("n"))


def profile_columns(df: DataFrame, load: str, rules: dict[str, object]) -> DataFrame:
    """One row per load and column: rows, nulls, ill-formed, distinct values, least and greatest value, largest share.

    ``rules`` maps each profiled column to its test of ill-formedness. Made from the unpivoted value counts, so
    exact. An empty table gives no row; a column of nulls has no least and greatest value.
    """
    counts = value_counts(df, load, list(rules)).withColumn("bad", _by_column(rules, F.col("value")))
    known = F.col("value").isNotNull()
    return counts.groupBy(load, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("n_ill_formed"),
        F.count("value").alias("n_distinct"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
        F.max(F.when(known, F.col("n"))).alias("n_most_frequent"),
    )


def load_shifts(df: DataFrame, load: str, rules: dict[str, object], kinds: dict[str, object] | None = None) -> DataFrame:
    """For each load but the first, and column: how its distribution differs from the preceding load's.

    Classes are null, ill-formed and the single values (``kinds`` may map a column to a coarser class). Gives
    ``n_now``, ``n_before``, ``gap`` (sum over classes of abs(c1 * n0 - c0 * n1), exact), ``half_sum`` (half the sum of
    absolute differences of shares), ``psi`` (population stability index, shares of 0 taken as half a row) and
    ``chi_square`` with its degrees of freedom. Counts are aggregated by class before loads meet.
    """
    value = F.col("value")
    kind = value
    for name, f in (kinds or {}).items():
        kind = F.when(F.col("column_name") == name, f(value)).otherwise(kind)
    label = F.when(value.isNull(), "null").when(_by_column(rules, value), "ill-formed").otherwise(F.concat(F.lit("="), kind))
    freq = value_counts(df, load, list(rules)).groupBy(load, "column_name", label.alias("label")).agg(F.sum("n").alias("n"))
    loads = df.select(F.col(load)).where(F.col(load).isNotNull()).distinct()
    loads = loads.select(F.col(load), F.lead(load).over(Window.orderBy(load)).alias("_next"))  # as many rows as loads
    now = freq.select(load, "column_name", "label", F.col("n").alias("c1"), F.lit(0).cast("long").alias("c0"))
    before = (
        freq.join(loads.where(F.col("_next").isNotNull()), load)
        .select(F.col("_next").alias(load), "column_name", "label", F.lit(0).cast("long").alias("c1"), F.col("n").alias("c0"))
    )
    both = now.unionByName(before).groupBy(load, "column_name", "label").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    totals = both.groupBy(load, "column_name").agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0")).where("n0 > 0 and n1 > 0")
    d = lambda c: F.col(c).cast("decimal(18,0)")
    p, q = F.greatest(F.col("c1"), F.lit(0.5)) / F.col("n1"), F.greatest(F.col("c0"), F.lit(0.5)) / F.col("n0")
    rest = F.col("c1") + F.col("c0")
    e1 = rest * F.col("n1") / (F.col("n1") + F.col("n0"))
    e0 = rest * F.col("n0") / (F.col("n1") + F.col("n0"))
    return (
        both.join(totals, [load, "column_name"])
        .groupBy(load, "column_name")
        .agg(
            F.first("n1").alias("n_now"),
            F.first("n0").alias("n_before"),
            F.sum(F.abs(d("c1") * d("n0") - d("c0") * d("n1"))).alias("gap"),
            F.sum((p - q) * F.log(p / q)).alias("psi"),
            F.sum((F.col("c1") - e1) ** 2 / e1 + (F.col("c0") - e0) ** 2 / e0).alias("chi_square"),
            (F.count("*") - 1).alias("degrees"),
        )
        .withColumn("half_sum", F.col("gap").cast("double") / (2.0 * F.col("n_now") * F.col("n_before")))
    )


def quality_findings(df: DataFrame, load: str, key: str, rules: dict[str, object], kinds: dict[str, object] | None = None, limit_tenths: int = 1) -> DataFrame:
    """Ill-formed values row by row, and shifts between loads: ``check_name``, ``load``, ``column_name``, ``key``.

    ``value``: a row per ill-formed value. ``shift``, with key 0: a load and column whose half sum of differences of
    shares is ``limit_tenths`` tenths or more, decided in whole numbers. An empty table gives no finding; repeated
    rows are found each; rows without load are checked but in no shift.
    """
    keyed = dict(df.dtypes)[key]
    bad = _long(df, [load, key], list(rules)).where(_by_column(rules, F.col("value")))
    bad = bad.select(F.lit("value").alias("check_name"), load, "column_name", key)
    shifts = load_shifts(df, load, rules, kinds)
    far = F.col("gap") * 5 >= F.col("n_now").cast("decimal(18,0)") * F.col("n_before").cast("decimal(18,0)") * limit_tenths
    shifts = shifts.where(far).select(F.lit("shift").alias("check_name"), load, "column_name", F.lit(0).cast(keyed).alias(key))
    return bad.unionByName(shifts)
