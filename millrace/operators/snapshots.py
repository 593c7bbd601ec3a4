"""What changed between consecutive full snapshots, by content-defined chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.canonical import plain_text

#: A key opens a chunk with this chance; keys are sorted within ranges of so many.
CHUNK_ROWS, RANGE_KEYS = 32, 4096


def snapshot_changes(df: DataFrame, load: str, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """From each load to the next: ``load`` (the later one), ``key``, ``change_kind`` (added, removed, changed).

    Within a load the row with the greatest ``order`` (columns, nulls least) holds for its key; rows are hashed where
    they are read, so that keys and hashes move and no texts. Snapshots are sorted by key within ranges of keys;
    a chunk begins at every key whose hash says so, hence at the same places in all snapshots, and is told by a
    digest of 128 bits of its rows. Chunks with the same digest as in the neighbouring load are discarded; only
    rows of the others are compared, by key and row hash.

    Texts compare trimmed, null and blank being the same. Rows without key or load belong to no record; a single
    load, or an empty table, gives no change; repeated rows change nothing; further columns are not read.
    """
    known = df.where(F.col(load).isNotNull() & F.col(key).isNotNull())
    content = [F.coalesce(plain_text(F.col(c)), F.lit("\x00")) for c in columns]
    hashed = known.select(
        F.col(load).alias("_load"),
        F.col(key).alias("_key"),
        *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)),
        F.xxhash64(F.lit("one"), F.col(key), *content).alias("_one"),
        F.xxhash64(F.lit("two"), F.col(key), *content).alias("_two"),
    )
    latest = F.max(F.struct(*(f"_o{i}" for i in range(len(order))), "_one", "_two")).alias("_row")
    rows = hashed.groupBy("_load", "_key").agg(latest).select("_load", "_key", F.floor(F.col("_key") / F.lit(RANGE_KEYS)).alias("_range"), "_row._one", "_row._two")
    sorted_keys = Window.partitionBy("_load", "_range").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.pmod(F.xxhash64("_key"), F.lit(CHUNK_ROWS)) == 0, F.col("_key"))
    rows = rows.withColumn("_chunk", F.coalesce(F.last(opens, ignorenulls=True).over(sorted_keys), F.col("_range") * RANGE_KEYS - 1))

    loads = known.select(F.col(load).alias("_load")).distinct()
    by_load = Window.orderBy("_load")  # as many rows as loads
    loads = loads.select("_load", F.lag("_load").over(by_load).alias("_before"), F.lead("_load").over(by_load).alias("_after"))
    digest = F.struct(F.count("*"), F.bit_xor("_one"), F.bit_xor("_two"))
    chunks = rows.groupBy("_load", "_range", "_chunk").agg(digest.alias("_digest")).join(loads, "_load")
    by_chunk = Window.partitionBy("_range", "_chunk").orderBy("_load")
    same = lambda shift, at: F.coalesce((shift("_load").over(by_chunk) == F.col(at)) & (shift("_digest").over(by_chunk) == F.col("_digest")), F.lit(False))
    chunks = chunks.select(
        "_load", "_range", "_chunk", "_before", "_after",
        (F.col("_before").isNotNull() & ~same(F.lag, "_before")).alias("_new"),
        (F.col("_after").isNotNull() & ~same(F.lead, "_after")).alias("_old"),
    ).where("_new or _old")
    left = rows.join(chunks, ["_load", "_range", "_chunk"])
    sides = F.array_compact(F.array(F.when(F.col("_new"), F.struct(F.col("_load").alias("at"), F.lit(True).alias("new"))), F.when(F.col("_old"), F.struct(F.col("_after").alias("at"), F.lit(False).alias("new")))))
    meet = left.select("_key", F.struct("_one", "_two").alias("_row"), F.explode(sides).alias("s")).groupBy(F.col("s.at").alias(load), F.col("_key").alias(key)).agg(
        F.max(F.when(F.col("s.new"), F.col("_row"))).alias("now"), F.max(F.when(~F.col("s.new"), F.col("_row"))).alias("then")
    )
    kind = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return meet.select(load, key, kind.alias("change_kind")).where(F.col("change_kind").isNotNull())
