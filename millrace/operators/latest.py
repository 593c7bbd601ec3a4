"""The row that holds for a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.naming import fresh


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key in ``order``, which should be total.

    Spark limits each key's rows within every input partition before the shuffle (WindowGroupLimit), so a key that
    holds a third of all rows sends one row per partition. Rows with a null key are dropped, or with
    ``keep_null_keys`` all kept, since they belong to no key. Ties beyond ``order`` are decided arbitrarily.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    name = fresh("_rank", df)
    best = df.where(known).withColumn(name, rank).where(F.col(name) == 1).drop(name)
    return best.unionByName(df.where(~known)) if keep_null_keys else best
