"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.naming import fresh
from millrace.session import cut

#: A key is hot from this share of all rows; so there are at most a thousand of them.
HOT_SHARE = 0.001
#: Bytes of hot keys' small rows that are broadcast; where they are more, hot keys are salted.
BROADCAST_BYTES = 16 << 20


def join_large_small(large: DataFrame, small: DataFrame, key: str, counts: DataFrame, count: str, total: int, share: float = HOT_SHARE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Inner join of many rows per ``key`` with few rows per ``key``.

    ``counts`` has each key once with ``count``, about its number of large rows of ``total``; it is looked at first, and
    should be written already. Without a hot key this is a plain join. Else the hot keys' small rows, if their measured
    size allows it, are broadcast, and so their large rows stay where they are; beyond ``limit`` bytes hot keys are
    salted, by a hash of all columns of the large row, and what is broadcast is 12 bytes a hot key.
    ``large`` is read twice if there are hot keys, so it should be cheap to read. Rows with a null key are dropped, as by
    any inner join.
    """
    hot_at = max(1.0, total * share)
    hot = counts.where(F.col(key).isNotNull() & (F.col(count) > hot_at)).select(key, F.ceil(F.col(count) / hot_at).cast("int").alias(fresh("_parts", large, small)))
    if hot.isEmpty():
        return large.join(small, key)
    parts = hot.columns[1]
    theirs = cut(small.join(F.broadcast(hot.select(key)), key, "left_semi"))
    size = theirs.agg(F.sum(F.octet_length(F.to_json(F.struct(*theirs.columns)))).alias("n")).first()["n"] or 0
    if size <= limit:
        rest = large.join(F.broadcast(theirs.select(key).distinct()), key, "left_anti").join(small, key)
        return large.join(F.broadcast(theirs), key).select(*rest.columns).unionByName(rest)
    salt, mark = fresh("_salt", large, small), fresh("_mark", large, small)
    marks = F.broadcast(hot.groupBy(F.xxhash64(key).alias(mark)).agg(F.max(parts).alias(parts)))
    of_large = F.when(F.col(parts).isNotNull(), F.pmod(F.xxhash64(F.lit(0), *large.columns), F.col(parts)).cast("int")).otherwise(0)
    placed = large.withColumn(mark, F.xxhash64(key)).join(marks, mark, "left").withColumn(salt, of_large).drop(mark, parts)
    spread = small.withColumn(mark, F.xxhash64(key)).join(marks, mark, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))).drop(mark, parts)
    return placed.join(spread, [key, salt]).drop(salt)
