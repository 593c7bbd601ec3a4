"""Names for helper columns that no column of the data has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``frames`` is called so (case does not matter)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
