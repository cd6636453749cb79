"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is pretrained: a trie of byte contexts up to ORDER bytes long, with the number of times each byte followed. A
text's bytes are preceded by the byte 0xFF as often as the longest context is long and followed by one; UTF-8 has no such
byte. A byte is coded in the longest context that the trie has. There it gets count / (total + distinct), and the escape
gets distinct / (total + distinct); after an escape the next shorter context codes it with the symbols of the longer ones
excluded; below the empty context, what no training text holds shares the rest evenly. The score of a text is the sum of
log10 probabilities of its bytes and the end.

Counts cover every training text. In a task they are added up per slice and per task, then by Spark. No counted branch is
dropped. As the counts are fixed, escapes and exclusions of each context are worked out once. A model of up to MOST_GRAMS
branches of its longest contexts is sent to every task as a trie: contexts of up to three bytes have a table of all their
bytes, and the longest ones a sorted list of their branches. A larger model stays in tables, a row for each context and
each branch, and every gram of the texts gets its probability by joins; no key of these has more than 256 rows a side.
Both give the same scores, but for rounding.

The unigram base needs the training count of every word of every text, and the vocabulary grows with the corpus. Texts are
dealt into chunks; each chunk asks once for each of its distinct words (and grams, if the model is in tables), the answers
come by a join, and chunk and answers meet in one group. No word's rows are more than the number of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _text as tx
from quire.llm.components import folder

ORDER = 4
MOST_GRAMS = 1 << 20
CHUNK_CHARACTERS = 16_000_000
HELD_OUT, FOLDS = 0, 10
_U = np.uint64
_WORD, _GRAM = 0, 1
#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x5BD1E9955BD1E995)


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, offsets): the bytes of each document and its end, each behind the ORDER bytes before it, as one 40-bit key."""
    n, docs = np.diff(off), len(off) - 1
    padded = np.full(len(raw) + (ORDER + 1) * docs, 0xFF, _U)
    padded[np.arange(len(raw)) + np.repeat(ORDER + (ORDER + 1) * np.arange(docs), n)] = raw
    key = padded[ORDER:].copy()
    for j in range(1, ORDER + 1):
        key |= padded[ORDER - j : len(padded) - j] << _U(8 * j)
    rows, _ = tx.ranges(off[:-1] + (ORDER + 1) * np.arange(docs), n + 1)
    return key[rows].view(np.int64), off + np.arange(docs + 1)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each document's words and end."""
    w = tx.Words(raw, off, tx.BLANK_SEPARATED)
    at = w.first + np.arange(len(off))
    out = np.full(at[-1], END)
    body = np.ones(len(out), bool)
    body[at[1:] - 1] = False
    out[body] = w.hashes()
    return out, at


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, key, n) of the training texts' words and grams, added up within a task."""
    held: dict[int, list] = {_WORD: [], _GRAM: []}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, parts in held.items():
            if parts:
                keys, n = _added(parts)
                for a in range(0, len(keys), 1 << 17):
                    k = keys[a : a + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.astype(_U).view(np.int64)), pa.array(n[a : a + (1 << 17)])], ["kind", "key", "n"])
            held[kind] = []

    for b in batches:
        for _, _, raw, off in tx.slices(b.column(0)):
            word, gram = np.unique(tokens(raw, off)[0], return_counts=True), np.unique(grams(raw, off)[0], return_counts=True)
            held[_WORD].append(word)
            held[_GRAM].append(gram)
            size += len(word[0]) + len(gram[0])
            if size > 1 << 22:
                yield from flush()
                size = 0
    yield from flush()


class Places:
    """Hash tables from 64-bit keys to their places; find() gives -1 for what is no key.

    A key whose slot is taken goes to the next table, so an empty slot ends the search.
    """

    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys, _U(64 - max(8, (2 * len(keys)).bit_length()))
        self.tables, left = [], np.arange(len(keys), dtype=np.int32)
        for factor in self.FACTORS:
            table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
            slot = self._slot(keys[left], factor)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        self.rest = left[np.argsort(keys[left])]

    def _slot(self, keys: np.ndarray, factor: int) -> np.ndarray:
        return ((keys.view(_U) * _U(factor)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        open_ = slice(None)
        for factor, table in zip(self.FACTORS, self.tables, strict=True):
            k = keys[open_]
            at = table[self._slot(k, factor)]
            hit = (at >= 0) & (self.keys[at] == k) if len(self.keys) else np.zeros(len(k), bool)
            index = np.arange(len(keys)) if isinstance(open_, slice) else open_
            out[index[hit]] = at[hit]
            open_ = index[(at >= 0) & ~hit]
        if len(self.rest) and len(open_):
            own = self.keys[self.rest]
            at = np.minimum(np.searchsorted(own, keys[open_]), len(own) - 1)
            hit = own[at] == keys[open_]
            out[open_[hit]] = self.rest[at[hit]]
        return out


class Trie:
    """Probabilities of every byte in every context that the counts have; key: context and byte, one byte each."""

    def __init__(self, gram5: tuple[np.ndarray, np.ndarray], gram4: tuple[np.ndarray, np.ndarray], gram3: tuple[np.ndarray, np.ndarray]):
        (k4, n4), (k3, n3) = gram4, gram3
        ok = np.isin(k4 & 0xFFFFFF, k3)  # a branch goes only if its shorter context has it too
        k4, n4 = k4[ok], n4[ok]
        used = np.unique(np.r_[k3 & 0xFF, (k3 >> 8) & 0xFF, (k3 >> 16) & 0xFF]).astype(np.int64)
        self.a = a = len(used) + 1  # the last code is for bytes that no training text holds
        self.bits = max(1, int(a - 1).bit_length())
        self.code = np.full(256, a - 1, np.int64)
        self.code[used] = np.arange(a - 1)
        c = self.code
        ctx4, sym4 = (c[k4 >> 24] << 2 * self.bits) | (c[(k4 >> 16) & 255] << self.bits) | c[(k4 >> 8) & 255], c[k4 & 255]
        ctx3, sym3 = (c[(k3 >> 16) & 255] << self.bits) | c[(k3 >> 8) & 255], c[k3 & 255]
        two, row2 = np.unique(ctx3, return_inverse=True)
        m2 = np.zeros((len(two), a))
        np.add.at(m2, (row2, sym3), n3)
        m1 = np.zeros((a, a))
        np.add.at(m1, (ctx3 & ((1 << self.bits) - 1), sym3), n3)
        m0 = m1.sum(0, keepdims=True)
        last = (1 << self.bits) - 1
        side = 1 << self.bits
        # rows: the empty context, contexts of one byte, of two, of three
        one = np.flatnonzero(m1.sum(1))
        tables = [self._rows([m0]), self._rows([m1[one], np.repeat(m0, len(one), 0)])]
        start1 = np.zeros(side, np.int64)
        start1[one] = 1 + np.arange(len(one))
        tables.append(self._rows([m2, m1[two & last], np.repeat(m0, len(two), 0)]))
        start2 = np.tile(start1, (side, 1))
        start2.flat[two] = 1 + len(one) + np.arange(len(two))
        three, row3 = np.unique(ctx4, return_inverse=True)
        parent = start2.flat[three & ((1 << 2 * self.bits) - 1)] - 1 - len(one)
        step = 1 << 13
        order = np.argsort(row3, kind="stable")
        edge = np.searchsorted(row3[order], np.arange(0, len(three) + step, step))
        for i, lo in enumerate(range(0, len(three), step)):
            own = order[edge[i] : edge[i + 1]]
            hi = min(lo + step, len(three))
            m3 = np.zeros((hi - lo, a))
            np.add.at(m3, (row3[own] - lo, sym4[own]), n4[own])
            p = parent[lo:hi]
            m2_ = np.where((p >= 0)[:, None], m2[np.maximum(p, 0)], 0)
            tables.append(self._rows([m3, m2_, m1[three[lo:hi] & last], np.repeat(m0, hi - lo, 0)]))
        self.log = np.concatenate(tables).ravel()
        self.three, self.base, self.start2 = three, 1 + len(one) + len(two), start2.astype(np.int32)
        self.start: np.ndarray | None = None
        # what the longest contexts need of the order-3 rows: log total, log escape, and which bytes they have
        total = np.bincount(row3, n4, len(three)) + np.bincount(row3, minlength=len(three))
        self.total3, self.escape3 = np.log10(total), np.log10(np.bincount(row3, minlength=len(three)) / total) if len(three) else total
        self.seen3 = np.zeros((len(three), a), bool)
        self.seen3[row3, sym4] = True
        self._longest(gram5, dict(zip(("key", "n"), (k4, n4), strict=True)), three, ctx4)

    def _longest(self, gram5: tuple[np.ndarray, np.ndarray], gram4: dict, three: np.ndarray, ctx4: np.ndarray) -> None:
        """Contexts of four bytes: their branches' probabilities, and for each context what an escape from it needs."""
        order = np.argsort(gram4["key"])
        k4, n4, row = gram4["key"][order], gram4["n"][order], np.searchsorted(three, ctx4[order])
        total3, distinct3 = np.bincount(row, n4, len(three)), np.bincount(row, minlength=len(three))
        order = np.argsort(gram5[0])
        k5, n5 = gram5[0][order], gram5[1][order]
        at = np.minimum(np.searchsorted(k4, k5 & 0xFFFFFFFF), max(len(k4) - 1, 0))
        ok = k4[at] == k5 & 0xFFFFFFFF if len(k4) else np.zeros(len(k5), bool)
        k5, n5, at = k5[ok], n5[ok], at[ok]
        self.four, first, node = np.unique(k5 >> 8, return_index=True, return_inverse=True)
        distinct = np.bincount(node, minlength=len(self.four))
        total = np.bincount(node, n5, len(self.four)) + distinct
        self.key5, self.context4, self.log5 = Places(k5), Places(self.four), (np.log10(n5) - np.log10(total[node])).astype(np.float32)
        shorter = row[at[first]]
        left = distinct3[shorter] - distinct  # order-3 symbols that the longer context doesn't have, and their counts
        rest = total3[shorter] - np.bincount(node, n4[at], len(self.four)) + left
        own = np.log10(distinct / total)
        log = lambda x: np.log10(np.maximum(x, 1))
        self.to_seen = (own - log(rest)).astype(np.float32)
        self.to_unseen = (own + np.where(left > 0, log(left) - log(rest), 0)).astype(np.float32)

    def _rows(self, chain: list[np.ndarray]) -> np.ndarray:
        """log10 of each code's probability, for contexts whose counts at their own and every shorter length are given."""
        p = np.zeros(chain[0].shape)
        escape = np.ones(len(p))
        seen = np.zeros(p.shape, bool)
        for counts in chain:
            live = np.where(seen, 0, counts)
            distinct = (live > 0).sum(1)
            total = live.sum(1) + distinct
            share = np.divide(escape, total, out=np.zeros(len(p)), where=total > 0)
            p += live * share[:, None]
            escape = np.where(total > 0, distinct * share, escape)
            seen |= counts > 0
        left = 256 - seen.sum(1)
        p = np.where(seen, p, np.divide(escape, left, out=np.zeros(len(p)), where=left > 0)[:, None])
        return np.log10(np.maximum(p, 1e-300)).astype(np.float32)

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.start is None:  # for each three bytes the row of their longest known context
            side = 1 << self.bits
            self.start = np.tile(self.start2.ravel(), side)
            self.start[self.three] = self.base + np.arange(len(self.three))
        key, at = grams(raw, off)
        c, b = self.code, self.bits
        symbol = c[key & 255]
        row = self.start[(c[(key >> 24) & 255] << 2 * b) | (c[(key >> 16) & 255] << b) | c[(key >> 8) & 255]].astype(np.int64)
        p = self.log[row * self.a + symbol].astype(np.float64)
        pos = self.key5.find(key)
        hit = pos >= 0
        p[hit] = self.log5[pos[hit]]
        miss = np.flatnonzero(~hit)
        pos = self.context4.find(key[miss] >> 8)
        miss, pos = miss[pos >= 0], pos[pos >= 0]
        if len(miss):
            three = row[miss] - self.base
            seen = self.seen3[three, symbol[miss]]
            p[miss] += np.where(seen, self.to_seen[pos] + self.total3[three], self.to_unseen[pos] - self.escape3[three])
        return np.add.reduceat(p, at[:-1])


def _all(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    t = counts.toArrow()
    return t.column("key").to_numpy().astype(np.int64), t.column("n").to_numpy().astype(np.float64)


def _shorter(gram: DataFrame, n: int) -> DataFrame:
    """Counts of the grams' last n bytes."""
    return gram.groupBy((F.col("key") % (1 << 8 * n)).alias("key")).agg(F.sum("n").alias("n"))


def _contexts(gram: DataFrame, shorter: DataFrame | None, parents: DataFrame | None, order: int) -> DataFrame:
    """A row for each context of order bytes that the counts have.

    t and d are its total and distinct branches. A byte that has its count n in the context of k - 1 bytes, and in no longer
    one, gets log10(n) + e{k} - w{k}: e is the sum of the escapes to it, w the weight left there after exclusions. For k = 0
    no context has the byte, and n is 1. own is the escape from this context if nothing is excluded.
    """
    # the branches of a context are branches of the shorter one, too: with what they count there they are excluded there
    excluded = gram if shorter is None else gram.withColumn("_key", F.col("key") % (1 << 8 * order)).join(shorter.select(F.col("key").alias("_key"), F.col("n").alias("x")), "_key")
    own = excluded.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"), (F.lit(0) if shorter is None else F.sum("x")).alias("x"))
    own = own.withColumns({"own": F.log10(F.col("d") / (F.col("t") + F.col("d"))), f"e{order + 1}": F.lit(0.0), f"w{order + 1}": F.log10(F.col("t") + F.col("d"))})
    if parents is None:
        return own.drop("x").withColumns({"e0": F.col("own"), "w0": F.log10(F.greatest(256 - F.col("d"), F.lit(1)))})
    up = parents.select(F.col("context").alias("_up"), *(F.col(c).alias(f"_{c}") for c in parents.columns if c != "context"))
    distinct = F.col("_d") - F.col("d")
    left = F.col("_t") - F.col("x") + distinct
    between = F.when(distinct > 0, F.log10(distinct / left)).otherwise(0.0)
    both = own.join(up, F.col("context") % (1 << 8 * (order - 1)) == F.col("_up")).withColumns({f"e{order}": F.col("own"), f"w{order}": F.log10(F.greatest(left, F.lit(1)))})
    both = both.withColumns({f"e{k}": F.col(f"_e{k}") - F.col("_own") + between + F.col("own") for k in range(order)} | {f"w{k}": F.col(f"_w{k}") for k in range(order)})
    return both.select("context", "t", "d", "own", *(f"{x}{k}" for k in range(order + 2) for x in "ew"))


def _probabilities(gram: DataFrame, asked: DataFrame) -> DataFrame:
    """key and p, the log10 of its last byte's probability behind the others, of every gram (key) asked for."""
    levels = [*(_shorter(gram, o + 1).checkpoint() for o in range(ORDER)), gram]
    contexts = p = None
    for o, level in enumerate(levels):
        contexts = _contexts(level, levels[o - 1] if o else None, contexts, o).checkpoint()
        keys = asked.select((F.col("key") % (1 << 8 * (o + 1))).alias("key")).distinct()
        if p is None:
            known = keys.withColumns({"k": F.lit(0), "log_n": F.lit(0.0), "p": F.lit(-math.log10(256))})
        else:
            known = keys.withColumn("_key", F.col("key") % (1 << 8 * o)).join(p.withColumnRenamed("key", "_key"), "_key").drop("_key")
        found = known.join(level.select("key", "n"), "key", "left").withColumns({"k": F.when(F.col("n").isNotNull(), o + 1).otherwise(F.col("k")), "log_n": F.when(F.col("n").isNotNull(), F.log10("n")).otherwise(F.col("log_n"))})
        at = lambda c, o=o: F.get(F.array(*(F.col(f"{c}{k}") for k in range(o + 2))), F.col("k"))
        in_context = found.withColumn("context", F.shiftright("key", 8)).join(contexts, "context", "left")
        p = in_context.select("key", "k", "log_n", F.when(F.col("t").isNull(), F.col("p")).otherwise(F.col("log_n") + at("e") - at("w")).alias("p")).checkpoint()
    return p.select("key", "p")


def score_texts(documents: DataFrame, held_out: int = HELD_OUT, folds: int = FOLDS) -> DataFrame:
    """One row per row of documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows whose crc32 of doc_id, as text, modulo folds isn't held_out (a null doc_id counts as empty text, so
    as 0). Null and empty texts have one token, the end. Rows that repeat count as often in training. If no row is for
    training, all bytes are equally likely and the base's counts are 0. Columns other than doc_id and text are ignored.
    """
    spark = documents.sparkSession
    tx.importable(spark)
    folder(spark)
    key = documents["doc_id"].cast("long")
    docs = documents.select(key.alias("doc_id"), (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == held_out).alias("held_out"), tx.text_or_empty(documents).alias("text"))
    counts = docs.where("not held_out").select("text").mapInArrow(tx.released(_count), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).checkpoint()
    known = counts.where(f"kind = {_WORD}")
    n_train, v = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    gram = counts.where(f"kind = {_GRAM}").select("key", "n")
    sent = gram.count() <= MOST_GRAMS
    model = spark.sparkContext.broadcast(Trie(*map(_all, (gram, _shorter(gram, 4), _shorter(gram, 3))))) if sent else None  # no level has more grams than the longest
    known = known.select(F.lit(_WORD).alias("kind"), "key", F.col("n").cast("double").alias("n"))
    if not sent:
        of_others = docs.where("held_out").select("text").mapInArrow(tx.released(_count), "kind int, key long, n long").where(f"kind = {_GRAM}").select("key")
        known = known.unionAll(_probabilities(gram, gram.select("key").unionAll(of_others).distinct().checkpoint()).select(F.lit(_GRAM), "key", "p"))

    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = max(8, -(-total // CHUNK_CHARACTERS))
    # one exchange of the texts serves the question and the answer
    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition("chunk")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each of a partition's chunks, and its grams if the model isn't sent."""
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            b = b.sort_by("chunk")
            chunk = b.column("chunk").to_numpy()
            edge = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(chunk) else []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                texts = b.column("text").slice(a, z - a)
                for kind, hashes in ((_WORD, tokens),) if sent else ((_WORD, tokens), (_GRAM, grams)):
                    new = [np.unique(hashes(raw, off)[0]).view(np.int64) for _, _, raw, off in tx.slices(texts)]
                    held[int(chunk[a]), kind] = np.unique(np.concatenate([held.get((int(chunk[a]), kind), np.zeros(0, np.int64)), *new]))
        for (c, kind), own in held.items():
            for a in range(0, len(own), 1 << 17):
                k = own[a : a + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c, np.int64)), pa.array(np.full(len(k), kind, np.int32)), pa.array(k)], ["chunk", "kind", "key"])

    def score(texts: pa.Table, counted: pa.Table) -> pa.Table:
        def answers_of(kind: int) -> tuple[np.ndarray, np.ndarray]:
            own = counted.column("kind").to_numpy() == kind
            ids = counted.column("key").to_numpy().astype(np.int64)[own].view(_U)
            order = np.argsort(ids)
            return ids[order], counted.column("n").to_numpy()[own][order].astype(np.float64)

        (ids, c), (gram_ids, gram_p) = answers_of(_WORD), answers_of(_GRAM)

        def by_tables(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
            key, at = grams(raw, off)
            return np.add.reduceat(gram_p[np.searchsorted(gram_ids, key.view(_U))], at[:-1])

        out = []
        for lo, hi, raw, off in tx.slices(texts.column("text")):
            h, at = tokens(raw, off)
            pos = np.minimum(np.searchsorted(ids, h), max(len(ids) - 1, 0))
            n = np.where(ids[pos] == h, c[pos], 0.0) if len(ids) else np.zeros(len(h))
            size = np.diff(at)
            base = np.add.reduceat(np.log10(n + 0.1), at[:-1]) - size * np.log10(n_train + 0.1 * (v + 1))
            rows = texts.slice(lo, hi - lo)
            out.append(pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": size, "n_known": np.add.reduceat((n > 0).astype(np.int64), at[:-1]), "train_tokens": np.full(hi - lo, n_train, np.int64), "base_score": base, "score": model.value.scores(raw, off) if sent else by_tables(raw, off)}))
        return pa.concat_tables(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = chunked.mapInArrow(words, "chunk long, kind int, key long").join(known, ["kind", "key"]).select("chunk", "kind", "key", "n")
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)
