"""A relational database as a Spark source and sink: many partitions by key range, filters worked out by the database.

For any driver of Python's database interface that takes `?` for parameters; sqlite3 if none is named. The database has to be
reachable by all executors (a file of SQLite: in a shared folder).

    register(spark)
    spark.read.format("relational").option("database", path).option("table", "documents").option("key", "id").load()
    rows.write.format("relational").mode("append").option("database", path).option("table", "documents").option("key", "id").save()
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

PARTITIONS = 8
#: Rows asked for, or put in, at a time.
ROWS = 5000
#: Seconds to wait for another writer.
PATIENCE = 600

_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def register(spark: SparkSession) -> None:
    """Registers the source in a session and lets it take filters."""
    spark.dataSource.register(RelationalSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> DataType:
    """The type of a column by its declared type's affinity."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return DoubleType()
    return BinaryType() if "BLOB" in d else StringType()


def sql_type(kind: DataType) -> str:
    if isinstance(kind, (LongType, IntegerType, ShortType, ByteType, BooleanType)):
        return "INTEGER"
    if isinstance(kind, (DoubleType, FloatType)):
        return "REAL"
    if isinstance(kind, (StringType, BinaryType)):
        return "TEXT" if isinstance(kind, StringType) else "BLOB"
    raise ValueError(f"a column of type {kind.simpleString()} can't be stored")


def connect(options: dict[str, str]):
    module = importlib.import_module(options.get("driver", "sqlite3"))
    return module.connect(options["database"], **({"timeout": PATIENCE} if module.__name__ == "sqlite3" else {}))


class RelationalSource(DataSource):
    """Options: database, table; key (a column to deal rows by, best the primary key), partitions, driver."""

    @classmethod
    def name(cls) -> str:
        return "relational"

    def schema(self) -> StructType:
        with closing(connect(self.options)) as c:
            columns = c.execute("select name, type from pragma_table_info(?) order by cid", (self.options["table"],)).fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}; give a schema if the database isn't SQLite")
        return StructType([StructField(n, spark_type(t)) for n, t in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return RangeReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TableWriter(dict(self.options), schema, overwrite)


@dataclass
class KeyRange(InputPartition):
    """Rows whose key is at least low and below high (up to high in the last range); or, with neither, those without a key."""

    low: object = None
    high: object = None
    last: bool = False


class RangeReader(DataSourceReader):
    """One query for each key range. Ranges hold as many rows each, by the keys that the filters leave.

    Rows of one key stay together. Each partition reads with a connection of its own, so a table that is written to meanwhile
    may show rows of before and after.
    """

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema
        self.conditions: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons, IN and null checks of numbers and strings; gives the others back to Spark."""
        for f in filters:
            column = quoted(".".join(f.attribute)) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool) and v == v
            if column and isinstance(f, (IsNull, IsNotNull)):
                self.conditions.append(f"{column} is {'not ' if isinstance(f, IsNotNull) else ''}null")
            elif column and type(f) in _COMPARED and plain(f.value):
                self.conditions.append(f"{column} {_COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif column and isinstance(f, In) and f.value and len(f.value) <= 500 and all(map(plain, f.value)):
                self.conditions.append(f"{column} in ({', '.join('?' * len(f.value))})")
                self.values += f.value
            else:
                yield f

    def _where(self, *more: str) -> str:
        every = [*self.conditions, *more]
        return " where " + " and ".join(every) if every else ""

    def partitions(self) -> list[KeyRange]:
        key, n = self.options.get("key"), int(self.options.get("partitions", PARTITIONS))
        if not key:
            return [KeyRange(last=True)]
        k, table = quoted(key), quoted(self.options["table"])
        with closing(connect(self.options)) as c:
            firsts = c.execute(f"select min(k), max(k) from (select {k} k, ntile({n}) over (order by {k}) b from {table}{self._where(f'{k} is not null')}) group by b order by 1", self.values).fetchall()
            without = c.execute(f"select 1 from {table}{self._where(f'{k} is null')} limit 1", self.values).fetchone()
        starts = sorted({low for low, _ in firsts})
        ranges = [KeyRange(a, b) for a, b in zip(starts, starts[1:], strict=False)]
        if starts:
            ranges.append(KeyRange(starts[-1], firsts[-1][1], True))
        return ranges + [KeyRange()] * bool(without) or [KeyRange(last=True, low=0, high=-1)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        k = quoted(self.options.get("key", ""))
        if not self.options.get("key"):
            more, values = [], []
        elif partition.low is None:
            more, values = [f"{k} is null"], []
        else:
            more, values = [f"{k} >= ?", f"{k} {'<=' if partition.last else '<'} ?"], [partition.low, partition.high]
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        with closing(connect(self.options)) as c:
            found = c.execute(f"select {columns} from {quoted(self.options['table'])}{self._where(*more)}", [*self.values, *values])
            while rows := found.fetchmany(ROWS):
                yield from rows


@dataclass
class Put(WriterCommitMessage):
    """The label of a task's rows in the staging table."""

    label: str


class TableWriter(DataSourceWriter):
    """Tasks fill a staging table, each under a label of its own; commit moves the rows of the tasks that count, in one transaction.

    So a task that fails or runs twice adds nothing. With a key, a row takes the place of one with the same key.
    """

    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.options, self.schema, self.overwrite = options, schema, overwrite
        self.stage = quoted(f"stage_{uuid.uuid4().hex}")
        with closing(connect(options)) as c, c:
            c.execute(f"create table {self.stage} ({self._columns(True)}, label text)")

    def _columns(self, declared: bool) -> str:
        return ", ".join(quoted(f.name) + (" " + sql_type(f.dataType) if declared else "") for f in self.schema.fields)

    def write(self, iterator: Iterator[Row]) -> Put:
        label = uuid.uuid4().hex
        put = f"insert into {self.stage} values ({', '.join('?' * (len(self.schema.fields) + 1))})"
        with closing(connect(self.options)) as c:
            rows = iter(iterator)
            for first in rows:
                with c:
                    c.executemany(put, [(*r, label) for r in chain([first], islice(rows, ROWS - 1))])
        return Put(label)

    def commit(self, messages: list[Put | None]) -> None:
        table, key = quoted(self.options["table"]), self.options.get("key")
        unique = f", primary key ({quoted(key)})" if key else ""
        with closing(connect(self.options)) as c:
            c.execute("create temp table counted (label text primary key)")
            c.executemany("insert into counted values (?)", [(m.label,) for m in messages if m])
            c.commit()
            with c:
                c.execute("begin immediate")
                c.execute(f"create table if not exists {table} ({self._columns(True)}{unique})")
                if self.overwrite:
                    c.execute(f"delete from {table}")
                c.execute(f"insert {'or replace ' if key else ''}into {table} ({self._columns(False)}) select {self._columns(False)} from {self.stage} where label in (select label from counted)")
                c.execute(f"drop table {self.stage}")

    def abort(self, messages: list[Put | None]) -> None:
        with closing(connect(self.options)) as c, c:
            c.execute(f"drop table if exists {self.stage}")


def read_table(spark: SparkSession, database: str, table: str, key: str | None = None, partitions: int = PARTITIONS, **options: str) -> DataFrame:
    """A table as a DataFrame, in partitions by ranges of key."""
    register(spark)
    own = options | {"database": database, "table": table, "partitions": str(partitions)} | ({"key": key} if key else {})
    return spark.read.format("relational").options(**own).load()


def write_table(rows: DataFrame, database: str, table: str, key: str | None = None, mode: str = "append", **options: str) -> None:
    """Adds rows to a table (made if need be), or replaces its rows (mode "overwrite")."""
    register(rows.sparkSession)
    own = options | {"database": database, "table": table} | ({"key": key} if key else {})
    rows.write.format("relational").mode(mode).options(**own).save()
