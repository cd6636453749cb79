"""The prefix trie of conversations, by rolling fingerprints of their first turns.

A conversation's turns are hashed and summed as a polynomial in the depth, modulo 2^64, so a fingerprint of the first d
turns is a running sum: numpy scans over the rows of sorted partitions, with what a conversation brings from earlier
partitions added afterwards. Conversations that share depth and fingerprint are candidates. The one with the smallest id
represents them, and every other turn is compared with the representative's at that depth, and the node before with its
node before. Where they differ, the conversation takes fingerprints of another hash from there on, and all is compared again.

Rollup needs no walk over levels. A conversation represents its own nodes from some depth on; above it stands among those
that it shares (``borrowed``). The leaves below a node are its members whose last node is theirs and ends the path, and the
tokens saved below it are the words of its members at depths where they aren't the representative.

No conversation, no node and no group of copies is gathered anywhere: positions, fingerprints and digests are made from
sorted streams, everything else by partial aggregates and joins that Spark may split. What goes to the driver is one row
for each partition of a scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import _text as tx
from quire.llm.components import folder, written

_U = np.uint64
_ODD = _U(0xD1342543DE82EF95)
#: Ids in one piece of the text that is digested.
IDS = 2048
#: Conversations of one family, and the most turns that one takes from its head.
FAMILY, TAKEN = 20, 3


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_no (from 1), role, text: each conversation's rows by turn (null first), role, text; equal rows all stay.

    Null roles and texts are empty, rows without conv_id are left out. A conversation of any length is dealt to many tasks:
    rows are ranged by all columns and numbered in each partition, and what a conversation has in earlier ones is added.
    """
    spark = conversations.sparkSession
    tx.importable(spark)
    empty = lambda c: F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c)
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), empty("role"), empty("text"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "text", "tie"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            at = np.arange(len(ids)) - np.repeat(start, np.diff(np.r_[start, len(ids)])) + 1
            if ids[0] == last:
                at[: start[1] if len(start) > 1 else None] += n
            last, n = ids[-1], at[-1]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(at), batch.column("role"), batch.column("text"), pa.array(np.full(len(ids), part))], names=["conv_id", "turn_no", "role", "text", "part"])

    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(rows.mapInArrow(tx.released(count), "conv_id long, turn_no long, role string, text string, part long"))
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("turn_no", F.struct("conv_id", "turn_no")).alias("n"))
    return _carried(rows, ends, {"turn_no": "n"})


def _carried(rows: DataFrame, ends: DataFrame, sums: dict[str, str]) -> DataFrame:
    """rows without part, with what their conversation has summed up in earlier partitions added to columns; sums: column to end's column.

    ends has a row for each partition: its first and last conversation and the sums of the last. These rows go to the
    driver. Sums are modulo 2^64.
    """
    names = sorted(set(sums.values()))
    carry, brought = [], dict.fromkeys(names, 0)
    before = None
    for r in sorted(ends.collect()):
        if r["first"] == before and any(brought.values()):
            carry.append((r["part"], r["first"], *(_signed(brought[n]) for n in names)))
        brought = {n: r[n] + (brought[n] if r["first"] == r["last"] == before else 0) for n in names}
        before = r["last"]
    if not carry:
        return rows.drop("part")
    given = rows.sparkSession.createDataFrame(carry, "part long, conv_id long, " + ", ".join(f"_{n} long" for n in names))
    joined = rows.join(F.broadcast(given), ["part", "conv_id"], "left")  # a row for each partition at most
    return joined.withColumns({c: F.when(F.col(f"_{n}").isNull(), F.col(c)).otherwise(_plus(F.col(c), F.col(f"_{n}"))) for c, n in sums.items()}).select([c for c in rows.columns if c != "part"])


def _signed(n: int) -> int:
    n %= 1 << 64
    return n - (1 << 64) if n >> 63 else n


def _plus(a: Column, b: Column) -> Column:
    """The sum of two longs modulo 2^64."""
    half = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(half) + b.bitwiseAND(half)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))


def hash_turns(roles: pa.Array, texts: pa.Array, seed: int) -> np.ndarray:
    """A 64-bit hash of each turn. Seeds from 1 on are for turns that clashed before: other, slower hashes."""
    if seed:
        key = seed.to_bytes(8, "little")
        both = zip(roles.to_pylist(), texts.to_pylist(), strict=True)
        return np.fromiter((int.from_bytes(hashlib.blake2b(f"{len(r)} {r}{t}".encode(), digest_size=8, key=key).digest(), "little") for r, t in both), _U, len(texts))
    out = []
    for column in (roles, texts):
        out.append(np.concatenate([tx.hash_spans(raw, off[:-1], off[1:]) for _, _, raw, off in tx.slices(column)]))
    return tx.mix(out[0] * _ODD + out[1])


def _power(n: np.ndarray) -> np.ndarray:
    """_ODD to the powers n, modulo 2^64."""
    out, base, n = np.ones(len(n), _U), _ODD, n.astype(_U)
    while n.any():
        out = np.where(n & _U(1), out * base, out)
        base, n = _U(int(base) ** 2 % (1 << 64)), n >> _U(1)
    return out


_SCAN = "conv_id long, depth long, n_turns long, role string, text string, words long, before long, prev long, key long, part long"


def _fingerprints(turns: DataFrame, seed: int) -> DataFrame:
    """turns with words (of the text), before (words of the turns before), key and prev (the fingerprints with this turn, and without)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, key, words = TaskContext.get().partitionId(), None, _U(0), 0
        for batch in batches:
            for first, end, raw, off in tx.slices(batch.column("text")):
                own = batch.slice(first, end - first)
                ids, depth = own.column("conv_id").to_numpy(), own.column("depth").to_numpy()
                start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                sizes = np.diff(np.r_[start, len(ids)])
                terms = hash_turns(own.column("role"), own.column("text"), seed) * _power(depth)
                n = tx.Words(raw, off, tx.BLANK_SEPARATED, lower=False).counts
                total, total_n = np.cumsum(terms, dtype=_U), np.cumsum(n)
                here = total - np.repeat((total - terms)[start], sizes)
                here_n = total_n - np.repeat((total_n - n)[start], sizes)
                if ids[0] == last:
                    here[: sizes[0]] += key
                    here_n[: sizes[0]] += words
                last, key, words = ids[-1], here[-1], here_n[-1]
                columns = [pa.array(x) for x in (n, here_n - n, (here - terms).view(np.int64), here.view(np.int64), np.full(len(ids), part))]
                yield pa.RecordBatch.from_arrays([own.column(c) for c in ("conv_id", "depth", "n_turns", "role", "text")] + columns, names=[c.split()[0] for c in _SCAN.split(", ")])

    rows = turns.select("conv_id", "depth", "n_turns", "role", "text").repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    rows = written(rows.mapInArrow(tx.released(scan), _SCAN))
    at_end = lambda c: F.max_by(c, F.struct("conv_id", "depth"))
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), at_end(F.col("key")).alias("k"), at_end(F.col("before") + F.col("words")).alias("w"))
    return _carried(rows, ends, {"key": "k", "prev": "k", "before": "w"})


def _members(turns: DataFrame) -> DataFrame:
    """Rows of turns that several conversations share, with rep (the smallest of these), verified: conv_id, depth, n_turns, words, before, rep."""
    rows, seed = _fingerprints(turns, 0), 0
    while True:
        groups = rows.groupBy("depth", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("rep")).where("n > 1").drop("n")
        shared = written(rows.join(groups, ["depth", "key"]))
        own = shared.where("conv_id = rep").select("depth", "key", F.col("prev").alias("_prev"), F.col("role").alias("_role"), F.col("text").alias("_text"))
        differs = shared.where("conv_id <> rep").join(own, ["depth", "key"]).where("role <> _role or text <> _text or prev <> _prev")
        split = differs.groupBy("conv_id").agg(F.min("depth").alias("from")).checkpoint()
        if split.isEmpty():
            return shared.select("conv_id", "depth", "n_turns", "words", "before", "rep")
        seed += 1
        other = _fingerprints(turns.join(split.select("conv_id"), "conv_id", "left_semi"), seed).join(split, "conv_id").where("depth >= from")
        other = other.select("conv_id", "depth", "from", F.col("key").alias("_key"), F.col("prev").alias("_prev"))
        now = rows.join(other, ["conv_id", "depth"], "left")
        rows = written(now.select("conv_id", "depth", "n_turns", "role", "text", "words", "before", F.when(F.col("depth") > F.col("from"), F.col("_prev")).otherwise(F.col("prev")).alias("prev"), F.coalesce("_key", "key").alias("key")))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node, a distinct sequence of the first depth turns (role, text); the root, of depth 0, has none.

    turns: conv_id, depth (from 1 without gaps), n_turns (of its conversation), role, text; no nulls. conversations: every
    conv_id once, with n_turns, those without turns as well. A node's members are the conversations that start with it.
    Returns conv_id (the smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless
    nodes below it, itself included), saved_tokens (over it and all nodes below, the members but one times the words of the
    last text) and ends_sha256 (of the comma-joined ids, ascending, of members that end here). No conversations give no rows.
    """
    spark = turns.sparkSession
    tx.importable(spark)
    folder(spark)
    rows = turns.select("conv_id", "depth", "n_turns", "role", "text")
    all_ = conversations.select("conv_id", "n_turns")
    root, n_all = all_.agg(F.min("conv_id"), F.count("*")).first()
    if not n_all:
        return spark.createDataFrame([], NODES)
    shared = _members(rows)
    # for each conversation: the last depth at which another represents it, which one, its words up to there, the last depth that it shares
    borrowed = shared.groupBy("conv_id").agg(
        F.max(F.when(F.col("rep") != F.col("conv_id"), F.struct("depth", "rep"))).alias("b"),
        F.sum(F.when(F.col("rep") != F.col("conv_id"), F.col("words"))).alias("owed"),
        F.max("depth").alias("shared"),
    )
    is_root = F.col("conv_id") == root
    shape = all_.join(borrowed, "conv_id", "left").select(
        "conv_id",
        "n_turns",
        F.when(is_root, -1).otherwise(F.coalesce("b.depth", F.lit(0))).cast("long").alias("last"),
        F.when(~is_root, F.coalesce("b.rep", F.lit(root))).alias("parent"),
        F.coalesce("owed", F.lit(0)).alias("owed"),
        F.coalesce("shared", F.lit(0)).alias("shared"),
    )
    shape = shape.checkpoint()
    more = shape.where("parent is not null and n_turns > last").groupBy(F.col("parent").alias("conv_id"), F.col("last").alias("depth")).agg(F.count("*").alias("more")).checkpoint()
    ended = shape.join(more.select("conv_id", F.col("depth").alias("n_turns"), "more"), ["conv_id", "n_turns"], "left")
    shape = ended.withColumn("leaf", ((F.col("n_turns") > F.col("last")) & F.col("more").isNull()).cast("long")).drop("more").checkpoint()
    # nodes with several members
    summed = shared.join(shape.select("conv_id", "leaf", "owed"), "conv_id")
    several = summed.groupBy(F.col("rep"), "depth").agg(F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.when(F.col("conv_id") != F.col("rep"), F.col("owed") - F.col("before")).otherwise(0)).alias("saved_tokens")).withColumnRenamed("rep", "conv_id")
    top = shape.agg(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("owed").alias("saved_tokens"))
    ends = shared.where("n_turns = depth").select("rep", "depth", "conv_id").unionAll(shape.where("n_turns = 0").select(F.lit(root).cast("long"), F.lit(0).cast("long"), "conv_id"))
    several = several.unionAll(top).join(more, ["conv_id", "depth"], "left").join(shape.select("conv_id", "n_turns", "last", "parent"), "conv_id").join(_digests(ends), ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") - 1 > F.col("last"), F.col("conv_id")).otherwise(F.col("parent"))
    goes_on = (F.col("n_turns") > F.col("depth")).cast("long")
    none = hashlib.sha256(b"").hexdigest()
    several = several.select("conv_id", "depth", F.when(F.col("depth") > 0, parent).alias("parent_conv_id"), "n_convs", (goes_on + F.coalesce("more", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    # nodes of one conversation alone
    alone = rows.select("conv_id", "depth", "n_turns").join(shape.select("conv_id", "last", "parent", "shared"), "conv_id").where("depth > shared")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = alone.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), goes_on.alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("n_turns") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    return several.unionAll(alone)


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _digests(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of ends (rep, depth, conv_id). A digest is read in order, so ids are joined to pieces in many tasks first, and pieces streamed."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []
        out: list[tuple] = []

        def flush(most: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= most:
                yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "first", "ids"), r, strict=True)) for r in out], schema=pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))
                out.clear()

        for batch in batches:
            for *node, i in zip(*(batch.column(c).to_pylist() for c in ("rep", "depth", "conv_id")), strict=True):
                if node != at or len(ids) >= IDS:
                    if ids:
                        out.append((*at, ids[0], ",".join(map(str, ids))))
                    at, ids = node, []
                ids.append(i)
            yield from flush(1000)
        if ids:
            out.append((*at, ids[0], ",".join(map(str, ids))))
        yield from flush(1)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, out = None, None, []
        for batch in batches:
            for *node, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if node != at:
                    if sha:
                        out.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["conv_id", "depth", "ends_sha256"])
                out = []
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], names=["conv_id", "depth", "ends_sha256"])

    cut = ends.repartitionByRange("conv_id").sortWithinPartitions("rep", "depth", "conv_id").mapInArrow(pieces, "conv_id long, depth long, first long, ids string")
    return cut.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of which each starts as the head of its family does, and the lengths of all: what prefix_trie takes.

    A family are FAMILY ids, its head the one that FAMILY divides. A conversation takes the head's first h turns (all, if it
    has fewer; none, if there is no head), h being the CRC-32 of its decimal id modulo TAKEN + 1, and goes on with its own
    turns after its first h.
    """
    own = numbered(conversations)
    n = own.groupBy("conv_id").agg(F.max("turn_no").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (TAKEN + 1)
    shape = n.withColumns({"h": h, "head": F.col("conv_id") - F.col("conv_id") % FAMILY})
    shape = shape.join(n.select(F.col("conv_id").alias("head"), F.col("n").alias("_n")), "head", "left").withColumn("given", F.least("h", F.coalesce("_n", F.lit(0))))
    shape = shape.select("conv_id", "head", "h", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")).checkpoint()
    taken = own.where(F.col("turn_no") <= TAKEN).withColumnRenamed("conv_id", "head").join(shape.where("given > 0"), "head").where("turn_no <= h")
    rest = own.join(shape, "conv_id").where("turn_no > h")
    columns = lambda depth: ["conv_id", depth.alias("depth"), "n_turns", "role", "text"]
    turns = taken.select(*columns(F.col("turn_no"))).unionAll(rest.select(*columns(F.col("given") + F.col("turn_no") - F.col("h"))))
    return turns, shape.select("conv_id", "n_turns")


ORACLE_SQL = r"""
with own as (
  select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) p, coalesce(role, '') r, coalesce(text, '') t
  from conversations where conv_id is not null),
sized as (select c, count(*) n from own group by c),
hashed as (
  select c, n, c - c % 20 head,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::bigint) % 4 h
  from sized),
shape as (select s.c, s.head, s.h, least(s.h, coalesce(d.n, 0)) given from hashed s left join sized d on d.c = s.head),
turns as (
  select s.c, o.p d, o.r, o.t from shape s join own o on o.c = s.head and o.p <= s.h
  union all select s.c, s.given + o.p - s.h, o.r, o.t from shape s join own o on o.c = s.c and o.p > s.h),
whole as (select s.c, coalesce(list({'r': r, 't': t} order by d) filter (where d is not null), []) q from shape s left join turns using (c) group by s.c),
paths as (select c, d, q[1:d] pre, len(q) l, case when d = 0 then 0 else len(regexp_extract_all(q[d].t, '[^\x20\x09-\x0D]+')) end w from whole, unnest(range(0, len(q) + 1)) u(d)),
nodes as (
  select pre, d, min(c) id, count(*) n, max(w) w, max(l) = d leaf, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where l = d), '')) ends
  from paths group by pre, d),
member as (select p.c, p.d, n.id from paths p join nodes n on n.d = p.d and n.pre = p.pre),
below as (select m.id, m.d, u.d ud, u.n, u.w, u.leaf from nodes u join member m on m.c = u.id and m.d <= u.d)
select n.id conv_id, n.d::bigint "depth", m.id parent_conv_id, n.n n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends ends_sha256
from nodes n join (
  select id, d, (count(*) filter (where ud = d + 1))::bigint n_children, (count(*) filter (where leaf))::bigint n_leaves, sum((n - 1) * w)::bigint saved_tokens from below group by id, d) s
  on s.id = n.id and s.d = n.d
left join member m on m.c = n.id and m.d = n.d - 1
"""
