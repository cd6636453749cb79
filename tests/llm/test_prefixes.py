"""The prefix trie against brute force: families, ties, nulls, copies, one very long conversation, clashing hashes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import prefixes
from tests.oracle import connect, same

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
words = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))


def ordered(rows):
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            own[c].append((n is not None, n or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(r)] for c, r in own.items()}


def families(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = own.get(c - int(np.fmod(c, 20)), [])
        out[c] = head[:h] + turns[h:]
    return out


def trie(whole):
    nodes = defaultdict(list)
    for c, q in whole.items():
        for d in range(len(q) + 1):
            nodes[tuple(q[:d])].append(c)
    kids = defaultdict(list)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(nodes[n]) - 1) * words(n[-1][1]) if n else 0)
    return sorted(str((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))))) for n, m in nodes.items())


def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(-30, 200), 1_000_000, 10**12]:
        for n in range(rng.randrange(6)):
            out.append((c, n, rng.choice(["user", "assistant", None]), rng.choice(["a b", "", None, "c", "ü 日本\tx", f"only {c}"])))
    out += [(5, None, "user", "null turn comes first"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (None, 0, "user", "no id"), (40, 1, "user", "long " * 40_000)]
    out += [(c, n, "user", f"copy {n}") for c in range(300, 400) for n in range(4)]  # copies
    out += [(777, n, "user", "one long conversation") for n in range(2000)]
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumns({"depth": F.lit("x"), "key": F.lit(1), "Rep": F.lit(2), "n_turns": F.lit(3), "tie": F.lit(4), "part": F.lit(5)}).repartition(7).cache()


def found(df):
    assert df.columns == COLUMNS
    return sorted(str(tuple(r)) for r in df.collect())


def test_numbered(conversations):
    """Positions go on over partitions: one conversation has more rows than any of them."""
    got = defaultdict(list)
    for r in prefixes.numbered(conversations).collect():
        got[r["conv_id"]].append((r["turn_no"], (r["role"], r["text"])))
    assert {c: [x for _, x in sorted(q)] for c, q in got.items()} == ordered(rows())
    assert all([n for n, _ in sorted(q)] == list(range(1, len(q) + 1)) for q in got.values())


def test_trie_of_families(conversations):
    expected = trie(families(ordered(rows())))
    assert found(prefixes.prefix_trie(*prefixes.rebuilt(conversations))) == expected


def test_trie_without_families(conversations):
    """Whole copies, and conversations without turns."""
    own = prefixes.numbered(conversations)
    n = own.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    empty = conversations.sparkSession.createDataFrame([(-99, 0), (5000, 0)], "conv_id long, n_turns long")
    turns = own.join(n, "conv_id").withColumnRenamed("turn_no", "depth")
    expected = trie(ordered(rows()) | {-99: [], 5000: []})
    assert found(prefixes.prefix_trie(turns, n.unionByName(empty))) == expected


@pytest.mark.parametrize("good_seed", [1, 2])
def test_clashes_are_split(conversations, monkeypatch, good_seed):
    """A hash of two bits puts nearly everything together; turn-by-turn checks take it apart."""
    right = prefixes.hash_turns

    def weak(roles, texts, seed):
        h = right(roles, texts, seed)
        return h if seed >= good_seed else h % np.uint64(4 + seed)

    monkeypatch.setattr(prefixes, "hash_turns", weak)
    few = conversations.where("conv_id < 120")
    assert found(prefixes.prefix_trie(*prefixes.rebuilt(few))) == trie(families(ordered([r for r in rows() if r[0] is not None and r[0] < 120])))


def test_many_ends_in_pieces(conversations, monkeypatch):
    monkeypatch.setattr(prefixes, "IDS", 3)
    assert found(prefixes.prefix_trie(*prefixes.rebuilt(conversations.where("conv_id >= 300")))) == trie(families(ordered([r for r in rows() if r[0] is not None and r[0] >= 300])))


def test_no_conversations(conversations):
    assert prefixes.prefix_trie(*prefixes.rebuilt(conversations.limit(0))).collect() == []


def test_sql_is_right_itself(conversations, spark, tmp_path):
    """The DuckDB oracle on odd rows."""
    few = conversations.where("conv_id is null or conv_id < 777").select("conv_id", "turn", "role", "text")
    few.coalesce(1).write.parquet(f"{tmp_path}/c")
    c = connect(str(tmp_path))
    c.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    same(prefixes.prefix_trie(*prefixes.rebuilt(few)), c, prefixes.ORACLE_SQL)
