"""Places in an order over a whole table, without gathering it: ranges, places within a range, and sums of the ranges' sizes."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import shared_folder


def numbered(rows: DataFrame, *order: str | Column, name: str = "pos") -> DataFrame:
    """rows with their place, from 0, in this order; rows that tie take some order among themselves.

    Rows are ranged and sorted, and written once, so that each keeps its place. To the driver goes the size of each
    partition alone.
    """
    place = F.monotonically_increasing_id()  # the partition above the lowest 33 bits, the row in it below
    path = shared_folder(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, place).write.parquet(path)
    held = rows.sparkSession.read.parquet(path)
    part, local = F.shiftright(name, 33).cast("int"), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in held.groupBy(part).count().collect())
    before = [0, *accumulate(n for _, n in sizes)]
    starts = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_in int, _start long")
    placed = held.join(F.broadcast(starts), part == F.col("_in"))
    return placed.withColumn(name, F.col("_start") + local).select(*rows.columns, name)
