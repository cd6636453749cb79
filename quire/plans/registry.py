"""Registered queries: a name, what it computes over the tables of a folder, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers f(tables) under a name."""

    def add(f: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def literal(v) -> str:
    """A value as SQL."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def same_over(table: str, *columns: str) -> tuple[Callable[[Tables], DataFrame], str]:
    """For a fixture's over: columns of a whole table, by expressions that both sides read."""
    return lambda t: getattr(t, table).selectExpr(*columns), f"select {', '.join(columns)} from {table}"


class Fixture:
    """A small table of literal rows, the same on both sides.

    over: columns of the same names over a whole table, as (a function of the tables, SQL); its queries run there, too.
    """

    def __init__(self, schema: str, rows: list[tuple], over: tuple[Callable[[Tables], DataFrame], str] | None = None):
        self.schema, self.rows, self.over = schema, rows, over
        self.names = [c.strip().split(" ")[0] for c in _columns(schema)]
        kinds = [_kind(c.strip().split(" ", 1)[1]) for c in _columns(schema)]
        values = ", ".join("(" + ", ".join(f"{literal(v)}::{k}" for v, k in zip(r, kinds, strict=True)) + ")" for r in rows)
        self.sql = f"(select * from (values {values}) fixture({', '.join(self.names)}))"

    def df(self, t: Tables) -> DataFrame:
        return t.spark.createDataFrame(self.rows, self.schema)


def _columns(schema: str) -> list[str]:
    out, depth = [""], 0
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append("")
        else:
            out[-1] += ch
    return out


def _kind(spark_type: str) -> str:
    t = spark_type.strip()
    if t.startswith("array<"):
        return _kind(t[6:-1]) + "[]"
    return {"string": "varchar", "int": "integer", "long": "bigint", "double": "double", "boolean": "boolean"}[t]


def scalar(name: str, fixture: Fixture, sql: str, /, *, once: Callable[..., Column] | None = None, **columns: Callable[..., Column]) -> None:
    """A query of expressions over a fixture; sql selects the same from {t}. once: what is worked out once; the columns are then made of it alone."""
    if name in QUERIES:
        raise ValueError(f"two queries are called {name}")

    def picked(df: DataFrame) -> DataFrame:
        own = [F.col(c) for c in fixture.names]
        if once is not None:
            df, own = df.select(fixture.names[0], F.explode(F.array(once(*own))).alias("_once")), [F.col("_once")]
        return df.select(*fixture.names[:1], *(f(*own).alias(c) for c, f in columns.items()))

    QUERIES[name] = lambda spark, folder: picked(fixture.df(Tables(spark, folder)))
    ORACLES[name] = sql.replace("{t}", fixture.sql)
    if fixture.over:
        table, table_sql = fixture.over
        QUERIES[f"{name}_documents"] = lambda spark, folder: picked(table(Tables(spark, folder)))
        ORACLES[f"{name}_documents"] = sql.replace("{t}", f"({table_sql})")
