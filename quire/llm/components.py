"""Connected components of a link table, by alternating large-star and small-star steps; DataFrame operations only."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of two longs in one partition.
PART_ROWS = 1 << 18


def folder(spark: SparkSession) -> None:
    """Sees to the shared checkpoint folder that the cluster names in spark.checkpoint.dir; only on one machine a folder of our own."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isEmpty():
        return
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not path and not context._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(path or tempfile.mkdtemp(prefix="checkpoints-"))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a job's shuffle files are deleted when it has ended; for work in steps that each end with a checkpoint or file."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with a number: one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (f"{name}{i or ''}" for i in count()) if x.lower() not in taken)


def small(df: DataFrame, most: int) -> DataFrame:
    """A checkpointed table, sent to every task if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read back: smaller than a checkpoint where values repeat."""
    folder(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the component's smallest node.

    Each step keeps at most as many rows as there are links and never gathers a node's neighbours: it needs their minimum
    only. Nodes that link to themselves alone, and nulls, are left out. A table of up to PART_ROWS links, in one partition,
    is worked on without shuffles: each shuffle is a thread of the driver for a minute, and small tables take many steps.
    """
    folder(links.sparkSession)
    e, one = _compact(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while not _stars(e):
        large = _lowest(_turned(e, ("u", "v"), ("v", "u")), one).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _turned(_lowest(large, one), ("v", "m"), ("u", "m")).where("u > v").distinct()
        e, one = (small.checkpoint().coalesce(1), one) if one else _compact(small)  # it doesn't grow
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _turned(e: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) for each of these pairs of columns of each row; unlike a union, in as many partitions."""
    return e.select(F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))).alias("e")).select("e.u", "e.v")


def _lowest(e: DataFrame, one: bool) -> DataFrame:
    """e with m, the smallest v of each u. Of one partition of PART_ROWS links, a node's may be gathered."""
    return e.withColumn("m", F.min("v").over(Window.partitionBy("u"))) if one else e.join(e.groupBy("u").agg(F.min("v").alias("m")), "u")


def _compact(links: DataFrame) -> tuple[DataFrame, bool]:
    """links, checkpointed, and whether in one partition; a table of few rows in few partitions, as each of them costs files in every later shuffle."""
    links = links.checkpoint()
    parts = 1 + links.count() // PART_ROWS
    return links.coalesce(parts) if parts == 1 or parts < links.rdd.getNumPartitions() else links, parts == 1


def _stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    end = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("vs")), F.struct(F.col("v").alias("node"), F.lit(0).alias("vs")))).alias("end")).select("end.*")
    return end.groupBy("node").agg(F.sum("vs").alias("vs"), F.min("vs").alias("least")).where("vs > 1 or vs > least").isEmpty()
