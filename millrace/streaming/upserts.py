"""The keyed upsert as a stream's sink."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.latest import latest_per_key
from millrace.sources.sinks import COMPLETE, complete, file_system, new_version, remove, versions


def _manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """Which version holds each part of the table, as the newest complete version says."""
    done, _ = versions(spark, path)
    if not done:
        return {}
    fs, at = file_system(spark, f"{path}/{done[-1]}/{COMPLETE}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def read_upserted(spark: SparkSession, path: str, parts: list[str] | None = None, ordering: bool = False) -> DataFrame | None:
    """The table at ``path`` (of some ``parts`` only), without the columns for ordering unless asked; None if there is nothing."""
    where = _manifest(spark, path)
    folders = [f"{path}/{v}/_part={p}" for p, v in where.items() if parts is None or p in parts]
    if not folders:
        return None
    table = spark.read.parquet(*folders)
    return table if ordering else table.select(*(c for c in table.columns if not c.startswith("_")))


def upsert_batch(batch: DataFrame, path: str, key: str, order: list[str], parts: int = 64) -> None:
    """Merge ``batch`` into the table at ``path``: of all rows of a key ever seen the one with the greatest ``order`` stays.

    ``order`` names columns (nulls least), which are stored, so that a late row of a later batch does not replace a
    newer one; of equal ones the later sent stays, and a batch sent again changes nothing. The table is cut into ``parts``
    by a hash of the key, and only the parts that a batch touches are read and written. They count together, once a
    manifest is complete. Rows without key belong to no record.
    """
    spark = batch.sparkSession
    part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("_part")
    rows = batch.where(F.col(key).isNotNull()).persist()
    try:
        touched = sorted(str(r[0]) for r in rows.select(part).distinct().collect())  # ``parts`` at most
        if not touched:
            return
        was, (done, unfinished) = _manifest(spark, path), versions(spark, path)
        both = rows.withColumn("_sent", F.lit(1))
        if (old := read_upserted(spark, path, touched, ordering=True)) is not None:
            both = old.withColumn("_sent", F.lit(0)).unionByName(both, allowMissingColumns=True).select(*old.columns, "_sent")
        best = [F.col(c).desc_nulls_last() for c in [*order, "_sent"]]
        merged = latest_per_key(both.select("*", part).repartition("_part"), ["_part", key], best).drop("_sent")
        version = new_version(spark, path)
        merged.write.partitionBy("_part").parquet(f"{path}/{version}")
        now = was | {p: version for p in touched}
        complete(spark, path, version, json.dumps(now))
        # what neither this manifest nor the one before names is removed
        for gone in set(done[:-1] + [n for n in unfinished if done and n < done[-1]]) - set(now.values()) - set(was.values()):
            remove(spark, f"{path}/{gone}")
    finally:
        rows.unpersist()


def upsert_stream(stream: DataFrame, path: str, key: str, order: list[str], checkpoint: str, parts: int = 64, **trigger) -> StreamingQuery:
    """Upsert every micro-batch of ``stream`` into the table at ``path`` (``upsert_batch``, ``read_upserted``)."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: upsert_batch(batch, path, key, order, parts))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
