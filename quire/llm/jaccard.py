"""N-gram Jaccard join over count vectors in R-trees.

A document's set holds its distinct k-word shingles (52-bit hashes of 64-bit hashes). The join finds the connected
components of "Jaccard similarity of at least percent / 100":

1. Documents with equal sets are one node.
2. Each node is dealt out by its prefix: the first n - ceil(t n) + 1 shingles in one global order. Two linked nodes share a
   shingle of their prefixes whatever the order is; shingles of a broad passage (in about a thousandth of all documents or
   more) come last in it, so they rarely deal anything out. Prefix shingles of one node only are dropped, and equal groups
   are treated once.
3. Each group indexes its nodes' count vectors in a packed R-tree: shingles are hashed into groups, a vector holds the
   number of shingles in each group, and no two sets share more than the sum of the coordinates' minima. Upper corners
   bound subtrees, points bound pairs; of the pairs that are left a spanning forest goes on, never all of them.
4. The forests' components are candidates. One task gets the sets of a component and verifies links exactly until nothing
   outside the largest verified component is unexamined.

No task holds many more than MOST_HELD nodes of a group or component: larger ones are dealt to blocks, and each pair of
blocks is a task's; the links that they find are connected afterwards.

A plain R-tree over all documents can't prune: count vectors of hashed shingles of equally long texts lie close together
in every coordinate. Dealing out by prefix keeps its groups small without losing a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _text as tx
from quire.llm.components import connected, folder, small

_U = np.uint64
_TOKEN = _U((1 << 52) - 1)
MOST_GROUPS = 256
LEAF = 32
#: Shingles counted together in a task, and the share of their documents from which on a shingle is broad.
COUNTED = 1 << 20
BROAD = 1000
#: The order's exceptions; what isn't among them is ordered by its hash alone.
MOST_BROAD = 1 << 16
#: Up to so many candidates are sent to every task (8 bytes each) to pick their texts; more are joined by a shuffle.
BROADCAST_IDS = 1 << 21
#: Nodes of one group, or of one candidate component, that a task holds; more are dealt to cells of two blocks each.
MOST_HELD = 1024
#: Stands for a null doc_id inside, behind all others.
NO_ID = (1 << 63) - 1


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int, broad: tx.Lookup | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets): the distinct shingles of each document, ascending; broad ones behind the others if given."""
    w = tx.Words(raw, off, tx.BLANK_SEPARATED)
    h = w.hashes()
    start, s = tx.windows(h, w.first, k)
    doc = np.searchsorted(w.first, start, side="right") - 1
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        doc = np.r_[doc, short]
        s = np.r_[s, np.array([tx.whole(h[w.first[d] : w.first[d + 1]]) for d in short], _U)]
    key = np.unique((doc.astype(_U) << _U(52)) | (s >> _U(12)))
    doc, token = (key >> _U(52)).astype(np.int64), key & _TOKEN
    if broad is not None and len(broad.keys):
        late = np.zeros(len(token), bool)
        late[broad.find(token << _U(12))[0]] = True
        if late.any():
            token = token[np.lexsort((token, late, doc))]
    return token, np.searchsorted(doc, np.arange(len(off)))


def fingerprints(token: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, which doesn't depend on its order; empty sets have 0."""
    total = np.r_[_U(0), np.cumsum(tx.mix(token))]
    other = np.r_[_U(0), np.cumsum(tx.mix(token ^ _U(0xA5A5A5A5A5A5A5A5)))]
    n = np.diff(at).astype(_U)
    out = tx.mix((total[at[1:]] - total[at[:-1]]) ^ ((other[at[1:]] - other[at[:-1]]) * _U(0x9E3779B97F4A7C15)) ^ n)
    return np.where(n > 0, out, _U(0)).view(np.int64)


def _groups(n: np.ndarray) -> np.ndarray:
    """Into how many groups a set of n shingles is hashed: a power of two near n / 8."""
    bits = np.ceil(np.log2(np.maximum(n, 1) / 8)).clip(3, np.log2(MOST_GROUPS))
    return (1 << bits.astype(np.int64)).astype(np.int64)


def _vectors(token: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Count vectors (16-bit); b"" where a count doesn't fit."""
    n = np.diff(at)
    d = _groups(n)
    owner = np.repeat(np.arange(len(n)), n)
    size = np.cumsum(d) - d
    counts = np.bincount(size[owner] + (token & (d[owner] - 1).astype(_U)).astype(np.int64), minlength=int(d.sum()))
    narrow = counts.astype("<u2")
    return [b"" if big else narrow[a : a + m].tobytes() for a, m, big in zip(size, d, np.maximum.reduceat(counts, size) > 65535 if len(n) else [], strict=True)]


def _count_broad(k: int):
    """Rows (shingle, documents that hold it), only of shingles that many of the documents counted together hold; (null, all documents)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate([np.zeros(0, _U), *held]), return_counts=True)
            much = n >= max(8, docs // BROAD)
            return pa.RecordBatch.from_arrays([pa.array([None, *token[much].view(np.int64)], pa.int64()), pa.array(np.r_[docs, n[much]].astype(np.int64))], ["token", "n"])

        held: list[np.ndarray] = []
        docs = size = 0
        for b in batches:
            for lo, hi, raw, off in tx.slices(b.column(0)):
                token, _ = shingle_sets(raw, off, k)
                held.append(token)
                docs, size = docs + hi - lo, size + len(token)
                if size >= COUNTED:
                    yield flush()
                    held, docs, size = [], 0, 0
        yield flush()

    return count


def _describe(k: int, percent: int, broad: np.ndarray):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = tx.Lookup(broad)
        for b in batches:
            for lo, hi, raw, off in tx.slices(b.column(1)):
                token, at = shingle_sets(raw, off, k, late)
                n = np.diff(at)
                take = np.where(n > 0, n + (-percent * n) // 100 + 1, 0)  # n - ceil(t n) + 1
                prefix, _ = tx.ranges(at[:-1], take)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)].astype(np.int32)), pa.array(token[prefix].view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(fingerprints(token, at)), pa.array(_vectors(token, at), pa.binary()), lists], ["doc_id", "n", "node", "vector", "prefix"])

    return describe


def _held(batches: Iterator[pa.RecordBatch], *columns: int) -> list[np.ndarray]:
    parts = [[b.column(c).to_numpy(zero_copy_only=False) for c in columns] for b in batches]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in columns]


def _shared_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's (token, node): the groups of nodes that share a token, equal groups once, as (group, node)."""
    token, node = _held(batches, 0, 1)
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[fresh], node[fresh]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
    count = np.diff(np.r_[begin, len(token)])
    begin, count = begin[count > 1], count[count > 1]
    if len(begin):
        total = np.r_[_U(0), np.cumsum(tx.mix(node.view(_U)))]
        group = tx.mix((total[begin + count] - total[begin]) ^ count.astype(_U)).view(np.int64)
        group, first = np.unique(group, return_index=True)
        rows, owner = tx.ranges(begin[first], count[first])
        for a in range(0, len(rows), 1 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(group[owner[a : a + (1 << 20)]]), pa.array(node[rows[a : a + (1 << 20)]])], ["group", "node"])


class Union:
    """Disjoint sets of 0 .. n - 1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up


def _fold(v: np.ndarray, d: int) -> np.ndarray:
    return v if len(v) == d else v.reshape(-1, d).sum(0)


def bounded_forest(n: np.ndarray, vectors: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and count vectors allow a link; R-tree join of one group with itself.

    Leaves are runs of LEAF points by size, then by the widest coordinate within slabs; each has its points' upper corner.
    """
    m, edges = len(n), []
    if not all(len(v) for v in vectors):  # a count that didn't fit: no bound for this group
        vectors = [np.full(1, x) for x in n]
    d = min(map(len, vectors))
    flat = np.stack([_fold(v, d) for v in vectors]).astype(np.int32)
    order = np.argsort(n, kind="stable")
    for a in range(0, m, LEAF * LEAF):
        slab = order[a : a + LEAF * LEAF]
        order[a : a + LEAF * LEAF] = slab[np.argsort(flat[slab][:, flat[slab].std(0).argmax()], kind="stable")]
    size, flat = n[order], flat[order]
    begin = np.arange(0, m, LEAF)
    upper = np.maximum.reduceat(flat, begin)
    least, most = np.minimum.reduceat(size, begin), np.maximum.reduceat(size, begin)
    need = lambda x, y: -(-percent * (x + y) // (100 + percent))
    union = Union(m)
    root = union.roots()
    for i in range(len(begin)):
        a, z = begin[i], min(begin[i] + LEAF, m)
        shut = np.minimum.reduceat(root, begin) == np.maximum.reduceat(root, begin)
        other = np.arange(i, len(begin))
        other = other[(percent * least[other] <= 100 * most[i]) & (percent * least[i] <= 100 * most[other])]
        other = other[~(shut[i] & shut[other] & (root[begin[other]] == root[a])) | (other == i)]
        other = other[np.minimum(upper[i], upper[other]).sum(1) >= need(least[i], least[other])]
        joined = False
        for j in other:
            b, y = begin[j], min(begin[j] + LEAF, m)
            shared = np.minimum(flat[a:z, None], flat[None, b:y]).sum(2)
            ok = (shared >= need(size[a:z, None], size[None, b:y])) & (root[a:z, None] != root[None, b:y])
            for p, q in zip(*np.nonzero(ok), strict=True):
                if p + a == q + b or union.root(p + a) == union.root(q + b):
                    continue
                p_, q_ = order[p + a], order[q + b]
                e = min(len(vectors[p_]), len(vectors[q_]))
                if e > d and np.minimum(_fold(vectors[p_], e), _fold(vectors[q_], e)).sum() < need(n[p_], n[q_]):
                    continue
                union.join(p + a, q + b)
                edges.append((int(p_), int(q_)))
                joined = True
        if joined:
            root = union.roots()
    return edges


def _forests(percent: int):
    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, node, n, vector = _held(batches, 0, 1, 2, 3)
        order = np.argsort(group, kind="stable")
        group, node, n, vector = group[order], node[order], n[order], vector[order]
        begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        ids, place = np.unique(node, return_inverse=True)
        local = Union(len(ids))  # links that the partition's own groups already give
        for a, z in zip(begin, np.r_[begin[1:], len(group)], strict=True):
            if z - a > 1:
                for p, q in bounded_forest(n[a:z].astype(np.int64), [np.frombuffer(v, "<u2") if v else np.zeros(0) for v in vector[a:z]], percent):
                    local.join(place[a + p], place[a + q])
        root = local.roots()
        linked = root != np.arange(len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[root[linked]])], ["a", "b"])

    return forests


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, off in tx.slices(b.column(2)):
                token, at = shingle_sets(raw, off, k)
                binary = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(8 * at.astype(np.int64)), pa.py_buffer(token)]).cast(pa.binary())
                out = pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), binary], ["candidate", "node", "tokens"])
                yield out.filter(pa.array(fingerprints(token, at) == out.column(1).to_numpy()))  # another text may have the same doc_id

    return sets


def verified(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The component, as its smallest member's place, of each of some sets under exact Jaccard similarity."""
    m = len(sets)
    size = np.array(list(map(len, sets)))
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(token, kind="stable")
    _, code = np.unique(token, return_inverse=True)
    posting = owner[order]
    begin = np.r_[0, np.cumsum(np.bincount(code))]
    at = np.r_[0, np.cumsum(size)]
    union = Union(m)
    open_ = np.ones(m, bool)  # not yet compared with all others
    root = union.roots()
    while True:
        # pairs inside a component don't matter, and those with the largest one are seen from outside it
        largest = np.bincount(root, minlength=m).argmax()
        left = np.flatnonzero(open_ & (root != largest)) if not open_.all() else np.arange(1)
        if not len(left):
            return root
        i = left[0]
        open_[i] = False
        own = code[at[i] : at[i + 1]]
        rows, _ = tx.ranges(begin[own], begin[own + 1] - begin[own])
        shared = np.bincount(posting[rows], minlength=m)
        for j in np.flatnonzero((100 * shared >= percent * (size + size[i] - shared)) & (root != root[i])):
            union.join(i, j)
        root = union.roots()


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            root = verified(sets, percent)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[r] for r in root], pa.int64())], ["a", "b"])

        current, nodes, sets = None, [], []
        for b in batches:  # sorted by candidate, so one component is held at a time
            for candidate, node, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if candidate != current and nodes:
                    yield solve()
                    nodes, sets = [], []
                current = candidate
                nodes.append(node)
                sets.append(np.frombuffer(tokens, _U))
        if nodes:
            yield solve()

    return verify


def _celled(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """rows with key replaced by one for each cell, so that no key has many more than MOST_HELD rows and any two rows of one key meet.

    sizes has key and n, the number of its rows. Keys of more rows are dealt to blocks; a cell is a pair of blocks.
    """
    large = sizes.where(F.col("n") > MOST_HELD).select(F.col(key).alias("_key"), F.ceil(F.col("n") * 2 / MOST_HELD).cast("long").alias("_blocks")).checkpoint()
    if large.isEmpty():
        return rows
    own, blocks = F.pmod(F.xxhash64("node"), F.col("_blocks")), F.col("_blocks")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: F.xxhash64(F.col(key), F.least(own, j), F.greatest(own, j)))
    dealt = rows.join(small(large, BROADCAST_IDS), F.col(key) == F.col("_key"), "left")
    return dealt.withColumn(key, F.explode(F.when(blocks.isNull(), F.array(F.col(key))).otherwise(cells))).drop("_key", "_blocks")


def link_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of documents: doc_id, n_shingles, node (equal for equal sets), component_id (the smallest doc_id that links reach).

    Texts of fewer than k words are one shingle. Null, empty and wordless texts have no shingle, node 0, and their own doc_id
    as component_id. Rows that repeat link like any equal texts. Texts of any length are taken whole; of an empty table nothing is returned. A null doc_id names no component: one that has no other gets
    null. Columns other than doc_id and text are ignored, whatever their names.
    """
    spark = documents.sparkSession
    tx.importable(spark)
    folder(spark)
    docs = documents.select(F.coalesce(documents["doc_id"].cast("long"), F.lit(NO_ID)).alias("doc_id"), tx.text_or_empty(documents).alias("text"))
    counted = docs.select("text").mapInArrow(tx.released(_count_broad(k)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).checkpoint()
    total = counted.where("token is null").agg(F.sum("n")).first()[0] or 0
    broad = counted.where(f"token is not null and n >= {max(8, total // BROAD)}").orderBy(F.desc("n"), "token").limit(MOST_BROAD)
    broad = np.array([r["token"] for r in broad.collect()], np.int64).view(_U) << _U(12)  # at most MOST_BROAD

    described = docs.mapInArrow(tx.released(_describe(k, percent, broad)), "doc_id long, n long, node long, vector binary, prefix array<long>").checkpoint()
    nodes = described.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).checkpoint()
    own = described.where("n > 0").join(nodes, "node").where("doc_id = first_doc")
    dealt = own.select(F.explode("prefix").alias("token"), "node").repartition("token").mapInArrow(tx.released(_shared_prefixes), "group long, node long")
    dealt = dealt.distinct().checkpoint()
    dealt = _celled(dealt, "group", dealt.groupBy("group").agg(F.count("*").alias("n")))
    points = dealt.join(own.select("node", "n", "vector").dropDuplicates(["node", "n"]), "node").select("group", "node", "n", "vector")
    candidates = connected(points.repartition("group").mapInArrow(tx.released(_forests(percent)), "a long, b long"))
    picked = candidates.join(nodes, "node").select(F.col("root").alias("candidate"), "node", F.col("first_doc").alias("doc_id")).checkpoint()
    texts = docs.join(small(picked, BROADCAST_IDS), "doc_id").select("candidate", "node", "text")
    sets = texts.mapInArrow(tx.released(_sets(k)), "candidate long, node long, tokens binary")
    sets = _celled(sets, "candidate", picked.groupBy("candidate").agg(F.count("*").alias("n")))
    links = sets.repartition("candidate").sortWithinPartitions("candidate").mapInArrow(tx.released(_verify(percent)), "a long, b long")
    links = connected(links)
    rooted = nodes.join(links, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    component = rooted.join(lowest, "root").select("node", "component_id")
    out = described.select("doc_id", "n", "node").join(component, "node", "left")
    named = lambda c: F.when(c != NO_ID, c)
    return out.select(named(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), "node", named(F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id"))
