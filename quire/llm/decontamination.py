"""Benchmark decontamination by a prefix-filtered set join.

A window is ``width`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
window is contained in a document where its words stand consecutively, so containment is 1 and the necessary prefix of a
window under the global order (document frequency, rarest first) is its single rarest word. The join therefore works in
three steps: count the document frequency of the benchmark's words over all documents; find each document word that is
some window's rarest word; place the window so that the two words meet (positional bound), drop placements that leave the
document (length bound), and compare what remains word by word.

Benchmarks are read in blocks of about BLOCK_WORDS words, each small enough to broadcast; documents pass the blocks one
after another and carry their hits along. No document text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _text as tx

BLOCK_WORDS = 1 << 19
WIDTH = 10
_U = np.uint64


class _Block:
    """Windows of some items: word hashes in rows by window length, ordered by their prefix word."""

    def __init__(self, ids: list[str], words: list[np.ndarray], width: int, rarity: dict[int, int]):
        self.ids, self.by_length = ids, []
        by: dict[int, list] = {}
        for i, w in enumerate(words):
            n = min(width, len(w))
            for a in range(len(w) - n + 1 if n else 0):
                by.setdefault(n, []).append((i, w[a : a + n]))
        for n, rows in sorted(by.items()):
            item = np.array([i for i, _ in rows])
            text = np.stack([w for _, w in rows])
            df = np.array([[rarity.get(int(x), 0) for x in row] for row in text])
            # rarest first; the hash breaks ties alike everywhere, then the first place of the word in the window
            at = np.array([min(range(n), key=lambda j, d=d, t=t: (d[j], int(t[j]), j)) for d, t in zip(df, text, strict=True)])
            prefix = text[np.arange(len(text)), at]
            order = np.argsort(prefix, kind="stable")
            keys, begin, count = np.unique(prefix[order], return_index=True, return_counts=True)
            self.by_length.append((n, item[order], text[order], at[order], tx.Lookup(keys), begin, count))

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start word, number of words, item) of every occurrence."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        doc_end = np.repeat(first[1:], np.diff(first))
        doc_start = np.repeat(first[:-1], np.diff(first))
        for n, item, text, at, lookup, begin, count in self.by_length:
            where, key = lookup.find(h)
            step = 1 << 14
            for a in range(0, len(where), step):
                w, owner = tx.ranges(begin[key[a : a + step]], count[key[a : a + step]])
                word = where[a : a + step][owner]
                start = word - at[w]
                ok = (start >= doc_start[word]) & (start + n <= doc_end[word])
                start, w = start[ok], w[ok]
                for j in range(n):
                    ok = h[start + j] == text[w, j]
                    start, w = start[ok], w[ok]
                found.append((start, np.full(len(start), n), item[w]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _frequencies(vocabulary: np.ndarray):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total = tx.Lookup(vocabulary), np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for _, _, raw, off in tx.slices(b.column(0)):
                w = tx.Words(raw, off, tx.ALPHANUMERIC)
                at, key = lookup.find(w.hashes())
                doc = np.searchsorted(w.first, at, side="right")
                pair = np.unique(doc * len(vocabulary) + key)
                total += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": lookup.keys.view(np.int64)[total > 0], "df": total[total > 0]})

    return count


def _scan(block: _Block, last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = (b.column(2).to_pylist(), b.column(3).to_pylist()) if b.num_columns > 2 else None
            for lo, hi, raw, off in tx.slices(b.column(1)):
                w = tx.Words(raw, off, tx.ALPHANUMERIC)
                start, n, item = block.hits(w.hashes(), w.first)
                doc = np.searchsorted(w.first, start, side="right") - 1
                order = np.lexsort((start, doc))
                start, n, item, doc = start[order], n[order], item[order], doc[order]
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                spans = old[0][lo:hi] if old else [[] for _ in range(hi - lo)]
                items = old[1][lo:hi] if old else [[] for _ in range(hi - lo)]
                for d in np.unique(doc):
                    s = start[edge[d] : edge[d + 1]] - w.first[d]
                    spans[d] = _merged([*zip(spans[d][::2], spans[d][1::2], strict=True), *zip(s.tolist(), (s + n[edge[d] : edge[d + 1]]).tolist(), strict=True)])
                    items[d] = sorted({*items[d], *(block.ids[i] for i in item[edge[d] : edge[d + 1]])})
                out = {"doc_id": b.column(0).slice(lo, hi - lo), "text": b.column(1).slice(lo, hi - lo), "spans": pa.array(spans, pa.list_(pa.int64())), "items": pa.array(items, pa.list_(pa.string()))}
                if last:
                    del out["text"]
                    out |= {"n_words": w.counts.astype(np.int64), "n_hit": pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64())}
                yield pa.RecordBatch.from_pydict(out)

    return scan


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Starts and ends of the stretches that the spans cover."""
    out: list[int] = []
    for a, z in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def find_contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of documents: doc_id, n_words, n_hit, spans (starts and ends of stretches of hit words), items (ids, sorted as strings).

    Null or wordless texts have no words and no hits; items without words have no window; items whose id is null can't be
    named and take no part. Rows of documents that repeat are reported as often as they occur; several rows with one
    item_id are one item. Columns other than doc_id, item_id and text are ignored, whatever their names.
    """
    tx.importable(documents.sparkSession)
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), tx.text_or_empty(documents).alias("text"))
    items = benchmark.select(benchmark["item_id"].cast("string").alias("i"), tx.text_or_empty(benchmark).alias("t")).where("i is not null").distinct()
    found, blocks = docs, list(_blocks(items))
    for k, (ids, words) in enumerate(blocks):
        vocabulary, rarity = np.unique(np.concatenate([np.zeros(0, _U), *words])), {}
        if len(vocabulary):
            counted = docs.select("text").mapInArrow(tx.released(_frequencies(vocabulary)), "word long, df long").groupBy("word").agg(F.sum("df").alias("df"))
            rarity = {r["word"] % (1 << 64): r["df"] for r in counted.collect()}  # no more rows than the block has words
        last = k == len(blocks) - 1
        found = found.mapInArrow(tx.released(_scan(_Block(ids, words, width, rarity), last)), "doc_id long, spans array<long>, items array<string>, n_words long, n_hit long" if last else "doc_id long, text string, spans array<long>, items array<string>")
    return found.select("doc_id", "n_words", "n_hit", "spans", "items")


def _blocks(items: DataFrame) -> Iterator[tuple[list[str], list[np.ndarray]]]:
    """Items in blocks of bounded size; at least one block."""
    ids: list[str] = []
    words: list[np.ndarray] = []
    size = blocks = 0
    for r in items.orderBy("i", "t").toLocalIterator():
        w = tx.hash_words([r["t"]], tx.ALPHANUMERIC)[0]
        if len(w):
            ids.append(r["i"])
            words.append(w)
            size += len(w)
        if size >= BLOCK_WORDS:
            yield ids, words
            ids, words, size, blocks = [], [], 0, blocks + 1
    if ids or not blocks:
        yield ids, words


def report(found: DataFrame) -> DataFrame:
    """The digest of find_contamination's rows that the query returns."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
