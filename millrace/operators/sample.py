"""Reproducible samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import SampleError
from millrace.sources.sinks import write_csv


def seeded_sample(df: DataFrame, key: str, n: int = 20, seed: int = 42) -> DataFrame:
    """``n`` rows (all, if there are fewer) chosen by a hash of seed and key, in order of ``key``.

    The same rows whatever the partitioning; each partition offers its best ``n`` only. Rows of the same key are told
    apart by their remaining columns; an empty table gives an empty sample.
    """
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    ties = [F.col(c).cast("string") for c in df.columns if c != key]
    return df.orderBy(mark, key, *ties).limit(n).orderBy(key, *ties)


@dataclass(frozen=True)
class SampleResult:
    """How many rows a sample was asked for, chosen from and given, and where it was written."""

    asked: int
    of: int
    rows: int
    path: str


def write_sample(df: DataFrame, key: str, path: str, n: int = 20, seed: int = 42) -> SampleResult:
    """A seeded sample as one CSV file at ``path``; a sample of nothing, or of fewer than no rows, is an error."""
    if n < 1:
        raise SampleError(f"a sample of {n} rows was asked for")
    of = df.count()
    if not of:
        raise SampleError(f"there is nothing to sample for {path}")
    write_csv(seeded_sample(df, key, n, seed), path)
    return SampleResult(n, of, min(n, of), path)
