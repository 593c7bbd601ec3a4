"""Ingest: fetch, land, upsert into the store, sample, audit."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import FAILURES
from millrace.operators.compare import audit, audit_verdict, listed_keys
from millrace.operators.dedup import upsert
from millrace.operators.sample import write_sample
from millrace.plans import contracts as C
from millrace.plans.report import flat, render
from millrace.sources.fetch import Fetcher, http_fetcher, land
from millrace.sources.files import field_drift, read_json_records
from millrace.sources.sinks import make_folders, read_snapshot, swap_snapshot, write_text

SUCCESS, FAILURE, DIFFERENCES = 0, 1, 2


@dataclass(frozen=True)
class IngestResult:
    code: int
    stored: int = 0
    rejected: int = 0
    message: str = ""


def latest_batch(records: DataFrame, fields: tuple[str, ...] = C.CATALOGUE_FIELDS) -> DataFrame:
    """Records with their order in the document as ``_ord``."""
    return records.select(*fields).withColumn("_ord", F.monotonically_increasing_id())


def run(spark: SparkSession, address: str, folder: str, fetch: Fetcher | None = None, stamp: str = "latest") -> IngestResult:
    """One ingest into ``folder`` (``raw``, ``store``, ``sample``, ``report``): exit code 0, or 2 if store and source differ, or 1.

    The raw document is landed before it is looked at. The store is replaced whole or not at all; records without id
    or title are not stored but counted as rejected.
    """
    root = Path(folder)
    try:
        make_folders(str(root / "raw"), str(root / "sample"), str(root / "report"))
        raw = land(address, str(root / "raw" / f"catalogue_{stamp}.json"), fetch or http_fetcher())
        records = read_json_records(spark, raw, C.CATALOGUE)
        missing, unexpected = field_drift(spark, raw, C.CATALOGUE)
        batch = latest_batch(records)
        good = batch.where(F.col("title").isNotNull())
        store = str(root / "store")
        existing = read_snapshot(spark, store)
        base = existing if existing is not None else spark.createDataFrame([], C.CATALOGUE).withColumn("ingested_at", F.lit(None).cast("timestamp"))
        table, _ = upsert(base.drop("ingested_at"), good, C.KEY, [F.col("_ord").desc()])
        old = base.select(C.KEY, F.col("ingested_at").alias("_was"))
        renewed = good.select(C.KEY).distinct().withColumn("_new", F.lit(True))
        stamped = table.join(old, C.KEY, "left").join(renewed, C.KEY, "left")
        stamped = stamped.withColumn("ingested_at", F.when(F.coalesce("_new", F.lit(False)), F.current_timestamp()).otherwise(F.col("_was")))
        swap_snapshot(stamped.select(*C.CATALOGUE_FIELDS, "ingested_at"), store)

        stored = read_snapshot(spark, store).drop("ingested_at")
        write_sample(stored, C.KEY, str(root / "sample" / "catalogue_sample.csv"))
        last, _ = upsert(spark.createDataFrame([], C.CATALOGUE), good, C.KEY, [F.col("_ord").desc()])
        fields = list(C.CATALOGUE_FIELDS[1:])
        verdict = audit_verdict(last, stored, C.KEY, fields).first()
        absent = audit(last, stored, C.KEY, fields)
        lists = {f: listed_keys(absent.where(F.col("finding") == f), C.KEY).first()["listing"] or "none" for f in ("missing", "extra")}
        rejected = batch.count() - good.where(F.col(C.KEY).isNotNull()).count()
        code = SUCCESS if verdict["success"] else DIFFERENCES
        text = render(
            "Audit of source and store",
            [("source", {"address": address, "missing fields": ", ".join(missing) or "none", "unexpected fields": ", ".join(unexpected) or "none", "rejected records": rejected}), ("counts", flat(verdict)), ("keys", lists)],
            "complete" if code == SUCCESS else "store and source differ",
        )
        write_text(text, str(root / "report" / "audit.txt"))
        return IngestResult(code, stored.count(), rejected)
    except FAILURES as e:
        return IngestResult(FAILURE, message=str(e))
