"""SQLite tables as a Spark data source, read in ranges of rowid, each by its own connection."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.errors import StoreError


class RowidRange(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = schema.fieldNames()
        self.path, self.table, self.parts = options["path"], options["table"], int(options.get("partitions", 4))

    def partitions(self) -> list[RowidRange]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as c:
            low, high = c.execute(f"select min(rowid), max(rowid) from {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowidRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [RowidRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowidRange) -> Iterator[tuple]:
        connection = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            columns = ", ".join(map(_quoted, self.names))
            yield from connection.execute(f"select {columns} from {_quoted(self.table)} where rowid >= ? and rowid < ?", (partition.low, partition.high))
        finally:
            connection.close()


class SqliteSource(DataSource):
    """Options: ``path``, ``table``, ``partitions``; the schema is given by the reader of the table."""

    @classmethod
    def name(cls) -> str:
        return "millrace_sqlite"

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "REAL": "double"}
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            info = c.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        return ", ".join(f"`{r[1]}` {kinds.get(r[2].upper(), 'string')}" for r in info)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: StructType | str | None = None, partitions: int = 4) -> DataFrame:
    """A table of a SQLite file; ``schema`` selects and types columns. A missing file, table or row is an error."""
    if not Path(path).exists():
        raise StoreError(f"{path} does not exist")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as c:
        if not c.execute("select 1 from sqlite_master where type in ('table', 'view') and name = ?", (table,)).fetchone():
            raise StoreError(f"{path} has no table {table}")
        if not c.execute(f"select 1 from {_quoted(table)} limit 1").fetchone():
            raise StoreError(f"the table {table} of {path} is empty")
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("millrace_sqlite").option("path", path).option("table", table).option("partitions", partitions)
    return (reader.schema(schema) if schema is not None else reader).load()


def sqlite_keys(spark: SparkSession, path: str, table: str, key: str) -> DataFrame:
    """The distinct keys of a table, null left out; only the key column is read."""
    kind = dict(read_sqlite(spark, path, table).dtypes)[key]
    return read_sqlite(spark, path, table, f"`{key}` {kind}").where(F.col(key).isNotNull()).distinct()


def write_sqlite(df: DataFrame, path: str, table: str, key: str) -> int:
    """Keyed upsert of ``df`` into a SQLite file in one transaction, as an export; rows without key are passed over.

    Rows stream to the driver one partition at a time. Either all rows are written or none.
    """
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    kinds = {"int": "INTEGER", "bigint": "INTEGER", "double": "REAL", "boolean": "INTEGER"}
    columns = ", ".join(f"{_quoted(c)} {kinds.get(t, 'TEXT')}" + (" PRIMARY KEY" if c == key else "") for c, t in df.dtypes)
    marks = ", ".join("?" * len(df.columns))
    plain = df.select(*(df[c] if t in kinds else df[c].cast("string") for c, t in df.dtypes)).where(df[key].isNotNull())
    connection, n = sqlite3.connect(path), 0
    try:
        with connection:
            connection.execute(f"create table if not exists {_quoted(table)} ({columns})")
            for row in plain.toLocalIterator():
                connection.execute(f"insert or replace into {_quoted(table)} values ({marks})", tuple(row))
                n += 1
    except sqlite3.Error as e:
        raise StoreError(f"{path}: {e}") from e
    finally:
        connection.close()
    return n
