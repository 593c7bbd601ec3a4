"""Readers of JSON, CSV and mapping files, against explicit contracts."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from millrace.errors import SourceError

CORRUPT = "_corrupt_record"


def read_json_records(spark: SparkSession, path: str, schema: StructType, wrapper: str | None = None) -> DataFrame:
    """Records of a JSON document that is an array, or an object that holds the array under ``wrapper``.

    Fields beyond ``schema`` are left out and absent ones null. A document that is no JSON, has no records, or records
    that are no objects, is an error.
    """
    head = spark.read.option("wholetext", True).text(path).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    corrupt = StructField(CORRUPT, StringType())
    if head is None or head["c"] not in ("[", "{"):
        raise SourceError(f"{path} holds no JSON document")
    if head["c"] == "{":
        if wrapper is None:
            raise SourceError(f"{path} holds an object where an array of records is expected")
        raw = reader.schema(StructType([StructField(wrapper, ArrayType(schema)), corrupt])).json(path).cache()
        bad = raw.where(F.col(CORRUPT).isNotNull()).count()
        records = raw.select(F.inline(wrapper))
    else:
        raw = reader.schema(StructType([*schema.fields, corrupt])).json(path).cache()
        bad = raw.where(F.col(CORRUPT).isNotNull()).count()
        records = raw.drop(CORRUPT)
    if bad:
        raise SourceError(f"{path} has {bad} records that cannot be read")
    if records.isEmpty():
        raise SourceError(f"{path} has no records")
    return records


def field_drift(spark: SparkSession, path: str, schema: StructType, wrapper: str | None = None) -> tuple[list[str], list[str]]:
    """(missing, unexpected) fields of all records of a document, sorted."""
    found = spark.read.option("multiLine", True).json(path)
    if wrapper and wrapper in found.columns:
        found = found.select(F.inline(wrapper))
    expected = set(schema.fieldNames())
    return sorted(expected - set(found.columns)), sorted(set(found.columns) - expected)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV with header, quoted line ends and doubled quotes; empty cells are null, quoted empty ones are empty texts, words such as NA are text."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False)
    return reader.option("nullValue", "\x00").option("emptyValue", "").csv(path)  # no cell holds the null character alone


MAPPING_FIELDS = ("target_title", "offers_title", "contrast_title", "method")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The manual key overrides, in file order as ``seq``, nulls as ""; a file that is not there gives none, one without the columns is an error."""
    schema = StructType([StructField(c, StringType()) for c in MAPPING_FIELDS])
    if not Path(path).exists():
        return spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("long"))
    with Path(path).open(encoding="utf-8") as f:
        header = f.readline().strip().split(",")
    if missing := [c for c in MAPPING_FIELDS if c not in header]:
        raise SourceError(f"{path} lacks the columns {', '.join(missing)}")
    frame = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(*MAPPING_FIELDS).fillna("")
    return frame.withColumn("seq", F.monotonically_increasing_id())
