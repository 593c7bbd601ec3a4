"""Mixed timestamp notations and zones to one unambiguous form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.instants import normal_forms


@F.pandas_udf(StringType())
def normal_form(value: pd.Series, zone: pd.Series) -> pd.Series:
    """The normal form of each value, its local times read in ``zone`` (null: UTC); null if it names no real day."""
    return normal_forms(value, zone)


def normalise_timestamps(df: DataFrame, key: str, fields: list[str], zone: str) -> DataFrame:
    """One row per value of ``fields`` that names a real day or moment: ``key``, ``field_name``, ``normal_form``.

    A narrow pass over the needed columns without any shuffle. Values are tokenised into shape masks;
    a mask's parser is made once per Python worker and applied to all its values together.

    Null, blank, stand-in and impossible values give no row; an empty table gives an empty result;
    repeated rows give repeated results; other columns of ``df`` are not read. A zone name that is no
    zone's gives no row for values that need it. Times before 1900 or after 2100 take their zone's
    nearest known offset.
    """
    parts = [F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields]
    long = (
        df.select(F.col(key).alias("_key"), F.col(zone).alias("_zone"), F.explode(F.array(*parts)).alias("p"))
        .select("_key", "_zone", "p.field_name", "p.value")
        .where(F.col("value").rlike(r"\p{N}"))
    )
    schema = f"{key} {dict(df.dtypes)[key]}, field_name string, normal_form string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            form = normal_forms(b["value"], b["_zone"])
            keep = form.notna()
            yield pd.DataFrame({key: b["_key"][keep], "field_name": b["field_name"][keep], "normal_form": form[keep]})

    return long.mapInPandas(run, schema)
