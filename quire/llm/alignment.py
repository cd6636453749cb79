"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and how usual each pair of ids is.

Both tokenizers read a text part by part: a part begins where neither of them has a token across, so its tokens, groups
and links are worked out once and remembered. A slice of about two megabytes of text becomes postings: for each id of the
second tokenizer (the side id) the ids it is linked with, and for each of these the documents and multiplicities.

Counts and maxima belong to side ids, sums to documents, so the postings are shuffled by side id. To keep a side id that
stands in every document from being one task's work, cells are made of BUCKETS of side ids by stripes of slices, as many
stripes as there are postings for. Each cell gets one sorted stream, which Spark spills as it needs: of each side id first
its pre-aggregated partial counts, which are summed and whose maximum is taken in place, then the postings of that stripe,
which become contributions to documents. The contributions of a document come from BUCKETS cells at most and are summed.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import _text as tx
from quire.llm.components import folder, written

SLICE = 1 << 21
BUCKETS = 8
#: A cell's share of postings and of documents, on average at most.
CELL_POSTINGS, CELL_DOCS = 1 << 22, 1 << 20
#: Distinct parts a worker remembers before it starts anew.
REMEMBERED = 600_000

_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "▁"

_DOCS = "slice long, place int, doc_id long, n_a long, n_b long, n_links long, groups string"
_POSTINGS = "side int, ids array<int>, counts array<long>, sizes binary, places binary, times binary"
_ARROW = pa.schema(
    [("slice", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_links")]
    + [("groups", pa.string()), ("side", pa.int32()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("sizes", "places", "times")]
)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """What a worker knows of the two tokenizers and of the parts it has met. Parts have numbers, from 0, in columns."""

    def __init__(self, paths: tuple[str, str]):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(paths[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        decoded = lambda t: bytes(byte[ch] for ch in t) if all(ch in byte for ch in t) else t.encode()
        self.bytes_a = [decoded(self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (list(map(len, x)) for x in (self.bytes_a, self.bytes_b))
        self.said_a, self.said_b = (list(map(str, range(len(x)))) for x in (self.bytes_a, self.bytes_b))
        whole = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.part = part_pattern(whole)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.n_a, self.n_b, self.n_links, self.first, self.bad = array("q"), array("q"), array("q"), array("q", [0]), array("b")
        self.groups: list[str] = []
        self.pair_number: dict[int, int] = {}
        self.links = array("q")  # pair numbers of all parts, one part after another

    def learn(self, parts: list[str]) -> None:
        """Works out parts that have the next numbers."""
        pairs = self.pair_number
        bytes_a, bytes_b, size_a, size_b, said_a, said_b = (x.__getitem__ for x in (self.bytes_a, self.bytes_b, self.size_a, self.size_b, self.said_a, self.said_b))
        # behind a line break no space is put before the part; the mark at the start and the break are two tokens
        of_b = self.b.encode([f"\n{p}" for p in parts])
        for p, a, b in zip(parts, self.a.encode_batch_fast(parts, add_special_tokens=False), of_b, strict=True):
            a, b = a.ids, b[2:]
            raw = p.encode()
            bad = b"".join(map(bytes_a, a)) != raw or b"".join(map(bytes_b, b)) != raw
            n, group = 0, ""
            if not bad:
                ends_a, ends_b = list(accumulate(map(size_a, a))), list(accumulate(map(size_b, b)))
                common = {*ends_a}.intersection(ends_b)
                n = len(common)
                text_a, text_b = list(map(said_a, a)), list(map(said_b, b))
                if n == 1:
                    group = f"{','.join(text_a)}|{','.join(text_b)}"
                    self.links.append(pairs.setdefault(b[-1] << 32 | a[-1], len(pairs)))
                else:
                    groups, first_a, first_b = [], 0, 0
                    for end in sorted(common):
                        i, j = ends_a.index(end, first_a) + 1, ends_b.index(end, first_b) + 1
                        groups.append(f"{','.join(text_a[first_a:i])}|{','.join(text_b[first_b:j])}")
                        self.links.append(pairs.setdefault(b[j - 1] << 32 | a[i - 1], len(pairs)))
                        first_a, first_b = i, j
                    group = ";".join(groups)
            self.bad.append(bad)
            self.n_a.append(len(a))
            self.n_b.append(len(b))
            self.n_links.append(n)
            self.first.append(len(self.links))
            self.groups.append(group)


def part_pattern(pieces: list[str]) -> re.Pattern:
    """Of parts: these begin at a blank, tab or line break behind something that is no space, and at an ASCII mark behind a letter.

    Byte-level pre-tokenisers split at all these places. The other vocabulary is looked through: a place where one of its
    pieces goes across doesn't begin a part.
    """
    across = {(x, y) for p in pieces for x, y in zip(p, p[1:], strict=False)}
    if any("\n" in pair for pair in across):
        raise ValueError("the second vocabulary has pieces across line breaks")
    spaces = "".join(s for s in " \t\n" if not any(y == (SPACE if s == " " else s) and not re.match(f"[{_SPACES}{SPACE}]", x) for x, y in across))
    letters = "".join(sorted(ch for ch in {ch for p in pieces for ch in p} if ch.isalpha()))
    marks = "".join(ch for ch in map(chr, range(33, 127)) if not ch.isalnum() and not any((x, ch) in across for x in letters))
    stop = f"[{re.escape(marks)}{spaces}]"
    odd = f"(?:(?![{spaces}])[{_SPACES}{SPACE}])"  # spaces that begin no part behind something else
    rest = rf"[^{_SPACES}{SPACE}]+(?:{odd}[{_SPACES}{SPACE}]*[^{_SPACES}{SPACE}]*)*"
    return re.compile(rf"[{_SPACES}{SPACE}]*(?:[{re.escape(letters)}]+(?={stop}|\Z)|{rest})|[{_SPACES}{SPACE}]+")


_aligners: dict[tuple[str, str], Aligner] = {}


def _sliced(batches: Iterator[pa.RecordBatch], aligner: Aligner, digest: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document, and one for each side id of each slice with its postings."""
    n_slices = 0
    task = TaskContext.get()
    own = (task.partitionId() if task else 0) << 32
    for batch in batches:
        for first, end, raw, off in tx.slices(batch.column("text"), SLICE):
            found = [aligner.part.findall(f" {raw[a:z].tobytes().decode()}") if a < z else [] for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            if len(aligner.number) > REMEMBERED:
                aligner.forget()
            number = aligner.number
            new = list({*chain.from_iterable(found)}.difference(number))
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            for i in range(0, len(new), 4096):
                aligner.learn(new[i : i + 4096])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = list(map(number.__getitem__, chain.from_iterable(found)))
            parts = np.array(flat, np.int64)
            del found
            doc = np.repeat(np.arange(len(sizes)), sizes)
            column = lambda c, kind=np.int64: np.frombuffer(c, kind).copy()
            # a document with a part whose tokens don't give its bytes has no tokens
            n = end - first
            bad = np.zeros(n, bool)
            bad[doc[column(aligner.bad, np.int8)[parts] != 0]] = True
            texts, group = iter(flat), aligner.groups.__getitem__
            said = [";".join(map(group, list(islice(texts, k)))) for k in sizes.tolist()]
            said = ["" if b else s for s, b in zip(said, bad.tolist(), strict=True)]
            if digest:
                said = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]
            good = ~bad[doc]
            parts, doc = parts[good], doc[good]
            sums = [np.bincount(doc, column(c)[parts], n).astype(np.int64) for c in (aligner.n_a, aligner.n_b, aligner.n_links)]
            at = own + n_slices
            n_slices += 1
            yield _batch(n, slice=pa.array(np.full(n, at)), place=pa.array(np.arange(n, dtype=np.int32)), doc_id=batch.column("doc_id").slice(first, n), n_a=pa.array(sums[0]), n_b=pa.array(sums[1]), n_links=pa.array(sums[2]), groups=pa.array(said))
            counts = column(aligner.n_links)[parts]
            take, owner = tx.ranges(column(aligner.first)[parts], counts)
            postings = _postings(column(aligner.links)[take], doc[owner], np.fromiter(aligner.pair_number, np.int64, len(aligner.pair_number)), n)
            if postings:
                m = len(postings["side"])
                yield _batch(m, slice=pa.array(np.full(m, at)), **postings)


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _postings(pair: np.ndarray, doc: np.ndarray, codes: np.ndarray, n_docs: int) -> dict[str, pa.Array]:
    """Rows by side id of links, given by pair number and document; codes are side id << 32 | id of the pair numbers."""
    if not len(pair):
        return {}
    used = np.zeros(len(codes), bool)
    used[pair] = True
    used = np.flatnonzero(used)
    used = used[np.argsort(codes[used])]
    place = np.zeros(len(codes), np.int64)
    place[used] = np.arange(len(used))
    key, times = np.unique(place[pair] * n_docs + doc, return_counts=True)
    which, doc = key // n_docs, (key % n_docs).astype(np.uint16)
    totals = np.bincount(which, times, len(used)).astype(np.int64)
    # a multiplicity over 255 is several postings
    more = -(-times // 255)
    repeated = np.repeat(np.arange(len(times)), more)
    last = np.cumsum(more) - 1
    short = np.full(len(repeated), 255, np.uint8)
    short[last] = times - 255 * (more - 1)
    doc, which = doc[repeated], which[repeated]
    side, ids = codes[used] >> 32, (codes[used] & 0xFFFFFFFF).astype(np.int32)
    sizes = np.bincount(which, minlength=len(used)).astype(np.uint32)
    begin = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
    pairs = np.r_[begin, len(side)]
    rows = np.r_[0, np.cumsum(sizes, dtype=np.int64)][pairs]
    return {
        "side": pa.array(side[begin].astype(np.int32)),
        "ids": pa.ListArray.from_arrays(pa.array(pairs, pa.int32()), pa.array(ids)),
        "counts": pa.ListArray.from_arrays(pa.array(pairs, pa.int32()), pa.array(totals)),
        "sizes": _binary(sizes, pairs),
        "places": _binary(doc, rows),
        "times": _binary(short, rows),
    }


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """values as bytes, cut at offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, place, count_sum, n_best) from streams sorted by cell, side id, and counts before postings."""
    cell = side = None
    ids = counts = None
    best = 0
    sums: dict[int, list[np.ndarray]] = {}

    def emitted() -> Iterator[pa.RecordBatch]:
        for at, (total, top) in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at)), pa.array(some.astype(np.int32)), pa.array(total[some]), pa.array(top[some])], names=["slice", "place", "count_sum", "n_best"])
        sums.clear()

    for batch in batches:
        rows = batch.to_pydict()
        for own, b, at, own_ids, own_counts, sizes, places, times in zip(rows["cell"], rows["side"], rows["slice"], rows["ids"], rows["counts"], rows["sizes"], rows["places"], rows["times"], strict=True):
            if own != cell:
                yield from emitted()
                cell, side = own, None
            if sizes is None:  # partial counts of a side id
                if b != side:
                    side, parts = b, []
                parts.append((own_ids, own_counts))
                ids = None
                continue
            if ids is None:
                ids, inverse = np.unique(np.concatenate([np.array(x, np.int64) for x, _ in parts]), return_inverse=True)
                counts = np.zeros(len(ids), np.int64)
                np.add.at(counts, inverse, np.concatenate([np.array(n, np.int64) for _, n in parts]))
                best = counts.max()
            each = np.repeat(counts[np.searchsorted(ids, np.array(own_ids, np.int64))], np.frombuffer(sizes, np.uint32))
            doc, n = np.frombuffer(places, np.uint16).astype(np.int64), np.frombuffer(times, np.uint8).astype(np.int64)
            have = sums.get(at)
            if have is None or len(have[0]) <= doc.max():
                grown = [np.zeros(int(doc.max()) + 257, np.int64) for _ in range(2)]
                for old, new in zip(have or (), grown, strict=False):
                    new[: len(old)] = old
                sums[at] = have = grown
            np.add.at(have[0], doc, each * n)
            np.add.at(have[1], doc, np.where(each == best, n, 0))
    yield from emitted()


def align(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best, count_sum, and groups.

    paths: a byte-level BPE file of tokenizers (A, which reads the text behind a space) and a sentencepiece BPE model with
    byte fallback (B, which puts the space itself); workers must have them. Places where A and B tokens both end cut a text
    into groups, written as a1,a2|b1;a3|b2,b3; digest puts the SHA-256 of that in its place. A link is an A and a B token that end together. A pair of ids
    counts as many links as the corpus has of it; n_best are links of a pair that no other pair of that B id surpasses.

    A text that is null or empty, or that a tokenizer doesn't give back byte for byte, has no tokens: zeros, and '' for
    groups. Rows count each, also repeated ones and those without doc_id. Long texts are worked on whole, one at a time. An
    empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tx.importable(spark)
    folder(spark)
    paths = paths or default_paths()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _aligners:
            _aligners[paths] = Aligner(paths)
        yield from _sliced(batches, _aligners[paths], digest)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), tx.text_or_empty(docs).alias("text"))
    rows = written(rows.mapInArrow(tx.released(work), f"{_DOCS}, {_POSTINGS}"))
    own = rows.where("place is not null").select("slice", "place", "doc_id", "n_a", "n_b", "n_links", "groups")
    postings = rows.where("side is not null").select("slice", "side", "ids", "counts", "sizes", "places", "times")
    # counts before the shuffle: a row for each id pair and task, then for each pair
    pairs = postings.select("side", F.explode(F.arrays_zip("ids", "counts")).alias("p")).groupBy("side", "p.ids").agg(F.sum("p.counts").alias("n"))
    totals = written(pairs.groupBy("side", F.pmod(F.xxhash64("ids"), F.lit(16)).alias("part")).agg(F.collect_list("ids").alias("ids"), F.collect_list("n").alias("counts")))
    n_postings, n_docs = postings.agg(F.coalesce(F.sum(F.octet_length("times")), F.lit(0))).first()[0], own.count()
    stripes = 1 + max(n_postings // (BUCKETS * CELL_POSTINGS), n_docs // CELL_DOCS)
    bucket = F.pmod(F.hash("side"), F.lit(BUCKETS))
    null = F.lit(None)
    first = totals.select(F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), "side", null.cast("long").alias("slice"), "ids", "counts", *(null.cast("binary").alias(c) for c in ("sizes", "places", "times")))
    then = postings.select(F.pmod(F.xxhash64("slice"), F.lit(stripes)).cast("int").alias("stripe"), "side", "slice", "ids", null.cast("array<long>").alias("counts"), "sizes", "places", "times")
    cells = first.unionAll(then).withColumn("cell", F.col("stripe") * BUCKETS + bucket).drop("stripe")
    # nulls come first: the counts of a side id stand before its postings
    streams = cells.repartition(stripes * BUCKETS, "cell").sortWithinPartitions("cell", "side", "slice")
    gave = streams.mapInArrow(tx.released(_contributions), "slice long, place int, count_sum long, n_best long")
    gave = gave.groupBy("slice", "place").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(gave, ["slice", "place"], "left").select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", zero("n_best"), zero("count_sum"), "groups")


def report(aligned: DataFrame) -> DataFrame:
    return aligned.withColumnRenamed("groups", "groups_sha256")
