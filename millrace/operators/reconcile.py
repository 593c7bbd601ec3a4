"""Differences between two copies of data by invertible Bloom lookup tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.canonical import day_or_text, plain_text
from millrace.operators.latest import latest_per_key
from millrace.session import cut

#: Differences that a bucket's table is sized for, and its cells in each of three parts: about twice as many cells.
BUCKET_ROOM, THIRD = 512, 352
#: Cells in each part of an estimator's stratum.
STRATUM_THIRD = 64
#: Up to so many buckets the tables are summed where the rows are; of more, rows go to their bucket first.
LOCAL_BUCKETS = 64
#: Differing keys of which rows are fetched by a broadcast (16 bytes each); more are fetched by a shuffle.
BROADCAST_KEYS = 1_000_000

# The primes of the 64-bit xxHash.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_MASK = (1 << 64) - 1
_SEEDS = {"check": 7, 0: 11, 1: 12, 2: 13}


def mixed(value: int, seed: int) -> int:
    """The 64-bit xxHash of one long, unsigned: what ``xxhash64`` of a bigint column gives under ``seed``."""
    k = (value & _MASK) * _P2 & _MASK
    k = (k << 31 | k >> 33) * _P1 & _MASK
    h = ((seed + _P5 + 8) & _MASK) ^ k
    h = ((h << 27 | h >> 37) * _P1 + _P4) & _MASK
    h = (h ^ h >> 33) * _P2 & _MASK
    h = (h ^ h >> 29) * _P3 & _MASK
    return h ^ h >> 32


def of_entry(name: str | int, key: int, row: int) -> int:
    """The signed hash of an entry that Spark makes as ``xxhash64(seed, key, row)``, all of them longs."""
    h = mixed(row, mixed(key, mixed(_SEEDS[name], 42)))
    return h - (1 << 64) if h >> 63 else h


def _of_entry(name: str | int) -> Column:
    return F.xxhash64(F.lit(_SEEDS[name]).cast("long"), F.col("_key"), F.col("_row"))


def tables(entries: DataFrame, third: int) -> DataFrame:
    """The difference table of each ``_bucket`` of ``entries`` (``_bucket``, ``_sign``, ``_key``, ``_row``).

    Each entry goes into three cells: a signed count and exclusive ors of key, row hash and check. Cells are summed
    before they move; what is on both sides cancels.
    """
    cells = F.array(*((F.pmod(_of_entry(j), F.lit(third)) + j * third).cast("int") for j in range(3)))
    laid = entries.select("_bucket", F.explode(cells).alias("_cell"), "_sign", "_key", "_row", _of_entry("check").alias("_check"))
    return laid.groupBy("_bucket", "_cell").agg(
        F.sum("_sign").alias("n"), *(F.bit_xor(c).alias(a) for c, a in (("_key", "k"), ("_row", "r"), ("_check", "x")))
    )


def peel(cells: list[tuple[int, int, int, int, int]], third: int) -> list[tuple[int, int]] | None:
    """The (key, row) entries left in a table of (cell, n, k, r, x), or None if it holds too many to be told apart.

    A cell gives an entry only if it is pure: its count is one and its check is that of its key and row.
    """
    state = {c: [n, k, r, x] for c, n, k, r, x in cells}
    pure = lambda s: abs(s[0]) == 1 and s[3] == of_entry("check", s[1], s[2])
    ready = [c for c, s in state.items() if pure(s)]
    found: list[tuple[int, int]] = []
    while ready:
        s = state[ready.pop()]
        if not pure(s):
            continue
        n, k, r, x = s
        found.append((k, r))
        for j in range(3):
            q = state[of_entry(j, k, r) % third + j * third]
            q[0] -= n
            q[1] ^= k
            q[2] ^= r
            q[3] ^= x
            if pure(q):
                ready.append(of_entry(j, k, r) % third + j * third)
    return None if any(any(s) for s in state.values()) else found


def peeled(cells: DataFrame, third: int) -> DataFrame:
    """``_bucket``, ``_key``, ``_row``, ``ok``: the entries of each bucket; one row with ``ok`` false if it can't be peeled."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        bucket = group["_bucket"].iloc[0]
        found = peel(list(zip(*(group[c].tolist() for c in ("_cell", "n", "k", "r", "x")), strict=True)), third)
        if found is None:
            return pd.DataFrame({"_bucket": [bucket], "_key": [0], "_row": [0], "ok": [False]})
        return pd.DataFrame({"_bucket": bucket, "_key": [k for k, _ in found], "_row": [r for _, r in found], "ok": True}).astype({"_key": "int64", "_row": "int64", "ok": "bool"})

    return cells.groupBy("_bucket").applyInPandas(run, "_bucket long, _key long, _row long, ok boolean")


def estimated_differences(entries: DataFrame) -> int:
    """About how many ``entries`` (``_sign``, ``_key``, ``_row``) are on one side only, from tables of fixed size.

    Entries fall into strata, each half as likely as the one before, and every stratum has a small table. The sparse
    strata peel whole; their count, scaled by the share of all entries that they are, is the estimate.
    """
    mark = F.xxhash64(F.lit(5).cast("long"), F.col("_key"), F.col("_row"))
    zeros = F.length(F.regexp_extract(F.bin(F.shiftrightunsigned(mark, 1).bitwiseOR(F.lit(1 << 62))), "0*$", 0))
    found = peeled(tables(entries.withColumn("_bucket", zeros.cast("long")), STRATUM_THIRD), STRATUM_THIRD)
    counts = {r["_bucket"]: r["n"] if r["ok"] else None for r in found.groupBy("_bucket", "ok").agg(F.count("*").alias("n")).collect()}  # 64 strata at most
    total = 0
    for stratum in range(63, -1, -1):
        n = counts.get(stratum, 0)
        if n is None:
            # what was counted is 2 ** -(stratum + 1) of all; too little to go by is taken as a full table
            return max(total, 2 * STRATUM_THIRD) << (stratum + 1)
        total += n
    return total


def differing_keys(left: DataFrame, right: DataFrame, differences: int | None = None) -> DataFrame:
    """``_key`` of every entry (``_key``, ``_row``) that only one of two sides has.

    Tables are sized by the number of ``differences``, estimated where it is not given, and not by the number of rows.
    Few tables are summed in the tasks that read the rows, so that a task sends cells and no rows; for many, entries
    of 16 bytes go to their bucket first. A bucket whose table holds more than it can give is compared entry by entry.
    """
    both = left.select("_key", "_row", F.lit(1).cast("long").alias("_sign")).unionByName(right.select("_key", "_row", F.lit(-1).cast("long").alias("_sign")))
    expected = estimated_differences(both) if differences is None else differences
    buckets = max(1, -(-(expected + expected // 4) // BUCKET_ROOM))
    both = both.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(3).cast("long"), F.col("_key")), F.lit(buckets)).cast("long"))
    if buckets > LOCAL_BUCKETS:
        both = both.repartition("_bucket")
    found = cut(peeled(tables(both, THIRD), THIRD))
    failed = found.where("not ok").select("_bucket")
    keys = found.where("ok").select("_key")
    if not failed.isEmpty():
        rest = both.join(failed, "_bucket", "left_semi")
        keys = keys.unionByName(rest.groupBy("_key", "_row").agg(F.sum("_sign").alias("_n")).where("_n <> 0").select("_key"))
    return keys.distinct()


def _entries(df: DataFrame, key: str, values: list[Column], recent: str | None) -> DataFrame:
    """``_key`` and ``_row`` (a hash of the canonical ``values``) of the latest rows of each key, hashed before they move.

    Of several latest rows that are not alike the two with the least and the greatest hash stay, so that their key
    differs from whatever single row the other side has.
    """
    row = F.xxhash64(F.lit(1).cast("long"), *(F.coalesce(v, F.lit("\x00")) for v in values))
    at = F.col(recent) if recent else F.lit(0)
    hashed = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), at.alias("_at"), row.alias("_row"))
    best = lambda r: F.max(F.struct("_at", r.alias("r")))["r"]
    latest = hashed.groupBy("_key").agg(best(F.col("_row")).alias("_high"), F.bitwise_not(best(F.bitwise_not(F.col("_row")))).alias("_low"))
    return latest.select("_key", F.explode(F.array_distinct(F.array("_high", "_low"))).alias("_row"))


def reconcile(
    left: DataFrame, right: DataFrame, key: str, columns: list[str], days: list[str] = (), left_name: str = "left", right_name: str = "right",
    recent: str | None = None, left_ties: list[Column] = (), right_ties: list[Column] = (),
) -> DataFrame:
    """Keys on one side only and fields that differ: ``key``, ``finding`` (``only_in_<side>`` or the field), one row each.

    ``key`` is an integer. Of a key's rows on one side the one with the greatest ``recent`` holds, then the first by
    ``left_ties`` or ``right_ties`` (without these, by the columns themselves). Texts are equal if equal after trimming
    spaces, tabs and line ends, null and blank being the same; those of ``days`` also if they are the same real day.

    Rows are hashed where they are read; keys that differ come from difference tables, and only their rows are fetched
    and compared field by field. Rows with a null key are left out; a null ``recent`` is the oldest; repeated rows
    change nothing; two empty tables give an empty result; other columns are not read.
    """
    canonical = {c: (day_or_text if c in days else plain_text)(F.col(c)) for c in columns}
    sides = [cut(_entries(df, key, list(canonical.values()), recent)) for df in (left, right)]
    wanted = cut(differing_keys(*sides).select(F.col("_key").alias(key)))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted

    def fetch(df: DataFrame, ties: list[Column], side: str) -> DataFrame:
        order = [F.col(recent).desc_nulls_last()] if recent else []
        got = latest_per_key(df.join(wanted, key, "left_semi"), [key], [*order, *(ties or [F.col(c) for c in columns])])
        return got.select(F.col(key), F.struct(*(v.alias(c) for c, v in canonical.items())).alias(side))

    pair = fetch(left, left_ties, "l").join(fetch(right, right_ties, "r"), key, "full_outer")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns)))
    findings = (
        F.when(F.col("r").isNull(), F.array(F.lit(f"only_in_{left_name}")))
        .when(F.col("l").isNull(), F.array(F.lit(f"only_in_{right_name}")))
        .otherwise(differing)
    )
    return pair.select(key, F.explode(findings).alias("finding"))
