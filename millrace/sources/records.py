"""Frames from records and pandas tables in memory, by an explicit schema."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from millrace.errors import SourceError


def from_records(spark: SparkSession, records: Iterable[Mapping], schema: StructType) -> DataFrame:
    """Records by field name: unknown fields are left out, absent ones null; a value of the wrong type is an error."""
    names = schema.fieldNames()
    rows = [tuple(r.get(n) for n in names) for r in records]
    try:
        return spark.createDataFrame(rows, schema)
    except Exception as e:
        raise SourceError(f"records do not fit {schema.simpleString()}") from e


def from_pandas(spark: SparkSession, table: pd.DataFrame, schema: StructType) -> DataFrame:
    """A pandas table by column name, with every kind of missing value (NaN, NaT, NA) as null."""
    plain = table.reindex(columns=schema.fieldNames()).astype(object)
    columns = {f.name: [_whole(v, f.dataType.typeName()) if known else None for v, known in zip(plain[f.name], plain[f.name].notna(), strict=True)] for f in schema.fields}
    return from_records(spark, (dict(zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)), schema)


def _whole(value: object, kind: str) -> object:
    """Numbers that pandas holds as floats, for want of null, as whole ones where the schema asks for these."""
    return int(value) if kind in ("byte", "short", "integer", "long") and isinstance(value, float) and value.is_integer() else value
