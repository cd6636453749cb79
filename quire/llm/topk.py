"""Exact top-k search by aggregation of sorted lists without random access (NRA).

Vectors are whole numbers, floor(scale * x); the score is the inner product. A cell holds some of the vectors and keeps one
list per dimension, sorted by component. For a query each list is read from the end where its contributions are highest.
What has been read of a vector bounds its score: at most what the lists' current positions still allow, at least what their
ends do. Reading goes on until no vector but the k best can be among them, or ties with them, or until the lists end; those
left get their final scores, and ties go to the smaller id. Cells' results are merged by query.

Vectors are dealt into cells at random and queries into blocks, both of bounded size, so every query meets every vector
and no task holds more than one cell and one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _text as tx
from quire.llm.components import folder

K, SCALE = 5, 256
CELL, BLOCK = 16_384, 16_384
#: Shares of the lists after which bounds are compared; with the last one all has been read and every bound is the score.
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0)
#: Queries whose bounds are held at once.
QUERIES = 128
#: Whole numbers up to here are exact in a float64, in a long.
FLOAT, LONG = 1 << 53, 1 << 63


class Lists:
    """The sorted lists of one cell's vectors."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.ids, self.copies, self.vectors = ids, copies, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable")  # of each dimension, ascending
        self.depths: list[int] = []  # how far the lists were read for each query

    def read(self, depth: int) -> tuple[np.ndarray, ...]:
        """For lists read to a depth from the top, and from the bottom: what has been read, over the frontier and over the far end; then frontiers and ends."""
        n, d = self.vectors.shape
        v, columns = self.vectors.astype(np.float64), np.arange(d)
        low, high = v.min(0), v.max(0)
        out = []
        for part, edge, end in ((self.order[n - depth :], v[self.order[n - depth], columns], low), (self.order[:depth], v[self.order[depth - 1], columns], high)):
            seen = np.zeros((n, d), bool)
            seen[part, columns] = True
            out += [np.where(seen, v - edge, 0), np.where(seen, v - end, 0), edge, end]
        return tuple(out)

    def best(self, queries: np.ndarray, own: list[tuple[int, int]], k: int) -> Iterator[list[tuple[int, int]]]:
        """(id, score) of the k best vectors for each query, except its own.

        All queries of the block read the lists to the same depths, so what they have read is added up by matrix products:
        where a component is positive its list is read from the top, where it is negative from the bottom. A query is done
        when no more vectors can be among its k + 1 best (its own may be one) than that, or when all has been read.
        """
        n = len(self.ids)
        left: list[np.ndarray] = [np.arange(n)] * len(queries)
        self.depths = [0] * len(queries)
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        open_ = np.arange(len(queries)) if n > k + 1 else np.zeros(0, np.int64)
        # what rounding may add up to where products leave the whole numbers that a float64 holds
        most = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, self.vectors.shape[1])
        slack = 0.0 if most < FLOAT / 8 else most * 1e-12
        for share in DEPTHS:
            if not len(open_):
                break
            depth = min(n, int(np.ceil(share * n)))
            top_edge, top_end, edge_up, end_up, low_edge, low_end, edge_down, end_down = self.read(depth)
            still = []
            for a in range(0, len(open_), QUERIES):
                part = open_[a : a + QUERIES]
                u, w = up[part], down[part]
                above = u @ top_edge.T + w @ low_edge.T + (u @ edge_up + w @ edge_down)[:, None]
                below = u @ top_end.T + w @ low_end.T + (u @ end_up + w @ end_down)[:, None]
                bar = np.partition(below, n - k - 1, axis=1)[:, n - k - 1] - slack
                for i, x in enumerate(part):
                    left[x] = np.flatnonzero(above[i] + slack >= bar[i])
                    self.depths[x] = depth
                    if len(left[x]) > k + 1 and depth < n:
                        still.append(x)
            open_ = np.array(still, np.int64)
        # products that leave 64 bits are worked out in Python's whole numbers
        wide = most >= LONG / 2
        for x, (q, o) in enumerate(zip(queries, own, strict=True)):
            rest = left[x]
            rest = rest[(self.ids[rest] != o[0]) | (self.copies[rest] != o[1])]
            score = np.array([sum(map(int.__mul__, v.tolist(), q.tolist())) for v in self.vectors[rest]], object) if wide else self.vectors[rest] @ q
            order = sorted(range(len(rest)), key=lambda i: (-score[i], self.ids[rest[i]], self.copies[rest[i]]))[:k] if wide else np.lexsort((self.copies[rest], self.ids[rest], -score))[:k]
            yield [(int(self.ids[rest[i]]), min(max(int(score[i]), 1 - LONG), LONG - 1)) for i in order]


def _search(k: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and vectors.num_rows:
            dense = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            lists = Lists(vectors.column("vec_id").to_numpy(), vectors.column("copy").to_numpy(), dense(vectors))
            own = list(zip(queries.column("vec_id").to_pylist(), queries.column("copy").to_pylist(), strict=True))
            for (i, c), best in zip(own, lists.best(dense(queries), own, k), strict=True):
                out += [(i, c, v, s) for v, s in best]
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "query_copy", "vec_id", "score"), columns, strict=True)})

    return search


def nearest(embeddings: DataFrame, every: int = 50, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose vec_id is divisible by ``every`` the k best other rows.

    Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part; neither do vectors
    with a component that leaves 64 bits when scaled. Scores that leave 64 bits are returned as the largest or smallest
    long, in the order of the true scores within a cell. Rows that repeat are
    rows of their own: each is a query, and each may be the other's result. Vectors are compared with those of equal length
    only, of any length. Fewer than k other rows give fewer results; an empty table gives none. Columns other than vec_id
    and embedding are ignored, whatever their names.
    """
    spark = embeddings.sparkSession
    tx.importable(spark)
    folder(spark)
    x = embeddings["embedding"].cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).try_cast("long"))
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float(LONG)))
    rows = embeddings.where(fine & embeddings["vec_id"].isNotNull()).select(embeddings["vec_id"].cast("long").alias("vec_id"), whole.alias("v"))
    # copy tells equal rows apart; worked out once, as a lost executor's rows might be numbered anew
    rows = rows.withColumn("copy", F.monotonically_increasing_id()).checkpoint()
    sizes = {r["d"]: (r["n"], r["q"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}  # a row for each length
    size = F.size("v")
    hashed = F.xxhash64("vec_id", "copy")
    dealt = lambda of, most: F.create_map(*(F.lit(y) for d, s in sizes.items() for y in (d, max(1, -(-s[of] // most)))))[size] if sizes else F.lit(1)
    cells, blocks = dealt(0, CELL), dealt(1, BLOCK)
    vectors = rows.select("vec_id", "copy", "v", size.alias("d"), F.pmod(hashed, cells).alias("cell"), blocks.alias("blocks"))
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "copy", "v", size.alias("d"), F.pmod(F.xxhash64(F.lit(1), "vec_id", "copy"), blocks).alias("block"), cells.alias("cells"))
    # the cells of the grid: every block of queries with every cell of vectors
    vectors = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("d", "cell", "block", "vec_id", "copy", "v")
    queries = queries.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).select("d", "cell", "block", "vec_id", "copy", "v")
    grid = ["d", "cell", "block"]
    found = queries.groupBy(*grid).cogroup(vectors.groupBy(*grid)).applyInArrow(_search(k), "query_id long, query_copy long, vec_id long, score long")
    best = found.groupBy("query_id", "query_copy").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("best"))  # k rows of each cell
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))

