"""Writers: snapshots in versions, CSV files, texts."""

from __future__ import annotations

import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from millrace.errors import StoreError

#: The file that makes a version count: it is made when all of the version is written.
COMPLETE = "_COMPLETE"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` (local, HDFS or an object store) and its path object."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(complete, unfinished) versions of the snapshot at ``path``, oldest first."""
    fs, at = file_system(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []
    names = [n for n in names if n.startswith("v") and n[1:9].isdigit()]
    done = [n for n in names if fs.exists(file_system(spark, f"{path}/{n}/{COMPLETE}")[1])]
    return done, [n for n in names if n not in done]


def new_version(spark: SparkSession, path: str) -> str:
    """A name that sorts behind all versions, finished or not."""
    done, unfinished = versions(spark, path)
    last = max([int(n[1:9]) for n in done + unfinished], default=0)
    return f"v{last + 1:08d}-{uuid.uuid4().hex[:8]}"


def complete(spark: SparkSession, path: str, version: str, text: str = "") -> None:
    """Make a written version count; one file is created, which every file system does wholly or not at all."""
    fs, at = file_system(spark, f"{path}/{version}/.{COMPLETE}")
    out = fs.create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    if not fs.rename(at, file_system(spark, f"{path}/{version}/{COMPLETE}")[1]):
        raise StoreError(f"{path}: {version} could not be completed")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def swap_snapshot(df: DataFrame, path: str) -> None:
    """Write ``df`` as the newest version under ``path``; ``df`` may have been read from there.

    A reader takes the newest complete version, so it sees the old table or the new one whatever stops the writer,
    and nothing is deleted before the new one counts. The version before stays, for those who are still reading it; older
    ones, and what stopped writers left, are removed.
    """
    spark = df.sparkSession
    done, unfinished = versions(spark, path)
    version = new_version(spark, path)
    try:
        df.write.parquet(f"{path}/{version}")
        complete(spark, path, version)
    except Exception as e:
        remove(spark, f"{path}/{version}")
        raise StoreError(f"{path} could not be written") from e
    for old in done[:-1] + [n for n in unfinished if done and n < done[-1]]:
        remove(spark, f"{path}/{old}")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version at ``path``, or None if there is none; a plain Parquet folder is read as it is."""
    done, unfinished = versions(spark, path)
    if done:
        return spark.read.parquet(f"{path}/{done[-1]}")
    fs, at = file_system(spark, path)
    return spark.read.parquet(path) if fs.exists(at) and not unfinished and fs.listStatus(at) else None


#: Texts are written as they are, with their outer spaces.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with header at ``path``: one file written by one task, for small tables, or with ``single`` false a folder of parts."""
    if not single:
        df.write.mode("overwrite").options(**_CSV).csv(path)
        return
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    parts = target.with_name(f".{target.name}.parts")
    shutil.rmtree(parts, ignore_errors=True)
    df.coalesce(1).write.options(**_CSV).csv(str(parts))
    found = sorted(parts.glob("part-*.csv"))
    if not found:
        raise StoreError(f"{path} could not be written")
    found[0].replace(target)
    shutil.rmtree(parts)


def write_text(text: str, path: str) -> None:
    """A UTF-8 text file; folders are made."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")


def make_folders(*paths: str) -> None:
    for p in paths:
        Path(p).mkdir(parents=True, exist_ok=True)
