"""Packing of tokenised documents by shortest-pack-first over the length histogram.

A document becomes its token ids and id 0, cut into pieces of SIZE tokens and a rest. Only the histogram of piece lengths
(at most SIZE bins) is packed: lengths are placed longest first, each into the pattern that is the shortest so far if it
has room, else into a new pattern; a pattern stands for as many sequences as its count. Pieces find their sequence by
rank: the pieces of a length are numbered, and each place of each pattern takes a stretch of those numbers. Numbers are
dealt within SALTS groups of every length, so no length is ever gathered in one task; what goes to the driver or to every
task is bounded by SIZE x SALTS counts.

Ids are those of the `tokenizers` file. Text is split where its pre-tokeniser always splits (at white space), each distinct
part is encoded once per worker by the same byte-pair ranks, and texts that hold a special token or unusual white space go
to `tokenizers` whole.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import _text as tx
from quire.llm.components import folder

SIZE = 1024
SALTS = 64
SLICE = 1 << 21
#: Distinct parts whose ids a worker remembers, at least; twice as many at most.
REMEMBERED = 120_000

#: White space that splits every text: a run before a word gives its last blank to the word.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(0x09, 0x0E), 0x20]] = False


def tokenizer_paths() -> tuple[str, str]:
    """Default files: of tokenizers, and the same vocabulary as byte-pair ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    def __init__(self, paths: tuple[str, str]):
        import public_tokenizers
        import tiktoken

        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.json, self.whole = paths[0], None
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = self.fast._core_bpe.encode_single_piece
        self.young: dict[int, bytes] = {}
        self.old: dict[int, bytes] = {}

    def part(self, b: bytes) -> bytes:
        """The part's ids, four bytes each."""
        s = b.decode()
        one = s[s[0] == " " :].isalpha()  # one pre-token
        return array("I", self.piece(b) if one else self.fast.encode_ordinary(s)).tobytes()

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, offsets) with id 0 behind each document."""
        start, end, doc = _parts(raw, off)
        slow = _slow(raw, off)
        fast = ~slow[doc]
        start, end, doc = start[fast], end[fast], doc[fast]
        keys, first, inverse = np.unique(tx.hash_spans(raw, start, end), return_index=True, return_inverse=True)
        known = []
        for k, a, z in zip(keys.tolist(), start[first].tolist(), end[first].tolist(), strict=True):
            ids = self.young.get(k)
            if ids is None:
                self.young[k] = ids = self.old.get(k) or self.part(raw[a:z].tobytes())
            known.append(ids)
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), np.uint32)
        take, _ = tx.ranges((np.cumsum(size) - size)[inverse], size[inverse])
        n = np.bincount(doc, size[inverse], len(off) - 1).astype(np.int64)
        whole = self._whole(raw, off, np.flatnonzero(slow))
        for d, ids in whole.items():
            n[d] = len(ids)
        offsets = np.r_[0, np.cumsum(n + 1)]
        out = np.zeros(offsets[-1], np.uint32)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        for d, ids in whole.items():
            out[offsets[d] : offsets[d] + len(ids)] = ids
            body[offsets[d] : offsets[d] + len(ids)] = False
        out[body] = pool[take]
        return out, offsets

    def _whole(self, raw: np.ndarray, off: np.ndarray, docs: np.ndarray) -> dict[int, list[int]]:
        if len(docs) and self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.json)
        return {int(d): self.whole.encode(raw[off[d] : off[d + 1]].tobytes().decode(), add_special_tokens=False).ids for d in docs}


def _parts(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the parts of each text that are encoded on their own, in order."""
    w = tx.Words(raw, off, _IN_WORD, lower=False)
    doc = np.repeat(np.arange(len(off) - 1), w.counts)
    before = np.r_[0, w.end[:-1]] if len(w.end) else w.end
    before = np.maximum(before, off[doc])  # where the white space before each word starts
    blank = (w.start > before) & (raw[w.start - 1] == 0x20)
    start = w.start - blank
    rest = start - before  # white space that isn't the word's
    # what stands before the last white-space character is one part; if the last isn't a blank, it is a part too
    last = (rest > 0) & ~blank
    run = rest - last > 0
    tail = np.flatnonzero(off[1:] > np.maximum(off[:-1], np.r_[0, w.end][w.first[1:]]))  # texts that end in white space
    tail_start = np.maximum(off[tail], np.r_[0, w.end][w.first[tail + 1]])
    starts = np.concatenate([start, before[run], w.start[last] - 1, tail_start])
    ends = np.concatenate([w.end, (start - last)[run], w.start[last], off[tail + 1]])
    docs = np.concatenate([doc, doc[run], doc[last], tail])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order], docs[order]


def _slow(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Texts with white space beyond ASCII, or with what may be a special token."""
    n = len(raw)
    p = np.r_[raw, np.zeros(3, np.uint8)]
    a, b, c = p[:n], p[1 : n + 1], p[2 : n + 2]
    odd = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    odd |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    odd |= (a == 0x3C) & (b == 0x7C)
    out = np.zeros(len(off) - 1, bool)
    out[np.searchsorted(off, np.flatnonzero(odd), side="right") - 1] = True
    return out


_encoders: dict[tuple[str, str], Encoder] = {}


def cut(documents: DataFrame, paths: tuple[str, str] | None = None, size: int = SIZE) -> DataFrame:
    """The pieces of every row of documents: doc_id, start (tokens before it), length, doc_tokens, ids (little-endian 32-bit).

    Null and empty texts are one piece of id 0. Rows that repeat give their pieces as often. No documents give no pieces.
    Columns other than doc_id and text are ignored, whatever their names.
    """
    tx.importable(documents.sparkSession)
    paths = paths or tokenizer_paths()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if paths not in _encoders:
            _encoders[paths] = Encoder(paths)
        encoder = _encoders[paths]
        for b in batches:
            for lo, hi, raw, off in tx.slices(b.column(1), SLICE):  # the more text, the fewer parts that are looked up again
                ids, at = encoder.ids(raw, off)
                n = np.diff(at)
                count = -(-n // size)
                k, owner = tx.ranges(np.zeros(len(n), np.int64), count)
                start = k * size
                length = np.minimum(n[owner] - start, size)
                begin = 4 * np.r_[at[owner] + start, at[-1]]
                binary = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(n[owner]), binary], ["doc_id", "start", "length", "doc_tokens", "ids"])

    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), tx.text_or_empty(documents).alias("text"))
    return docs.mapInArrow(tx.released(pieces), "doc_id long, start long, length long, doc_tokens long, ids binary")


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of sequences) that hold each length as often as the histogram has it."""
    open_: dict[int, list[list]] = {}  # by tokens used
    full: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], used: int, count: int) -> None:
        if used == size:
            full.append((pattern, count))
        else:
            open_.setdefault(used, []).append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left, fresh = histogram[length], []
        while left:
            used = min(open_, default=size)
            if used + length > size:
                break
            pattern, count = open_[used].pop()
            if not open_[used]:
                del open_[used]
            n = min(count, left)
            if count > n:
                open_.setdefault(used, []).append([pattern, count - n])
            put((*pattern, length), used + length, n)
            left -= n
        if left:
            per = size // length  # nothing that is open has room: new packs, each with as many of this length as fit
            whole, rest = divmod(left, per)
            fresh += [((length,) * per, whole)] * (whole > 0) + [((length,) * rest, 1)] * (rest > 0)
        for pattern, count in fresh:
            put(pattern, sum(pattern), count)
    return full + [(p, c) for used in sorted(open_, reverse=True) for p, c in open_[used]]


def place(pieces: DataFrame, size: int = SIZE, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """pieces with sequence_id and offset; they need length and the columns by which equal lengths are ordered."""
    spark = pieces.sparkSession
    tx.importable(spark)
    folder(spark)
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)).cast("int")).checkpoint()
    counts = sorted((r["length"], r["_salt"], r["count"]) for r in pieces.groupBy("length", "_salt").count().collect())  # at most SIZE x SALTS
    histogram: dict[int, int] = {}
    before = []
    for length, salt, n in counts:
        before.append((length, salt, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    taken: dict[int, int] = {}
    slots = []
    sequences = 0
    for pattern, n in shortest_pack_first(histogram, size):
        offset = 0
        for length in pattern:
            slots.append((length, taken.get(length, 0), sequences, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        sequences += n
    slots.sort()
    slot = np.array(slots, np.int64).reshape(-1, 4)
    keys = (slot[:, 0] << 48) | slot[:, 1]
    names = [c for c in pieces.columns if c != "_salt"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(slot[at, 2] + rank - slot[at, 1]), pa.array(slot[at, 3])], [*names, "sequence_id", "offset"])

    offsets = F.broadcast(spark.createDataFrame(before, "length long, _salt int, _before long"))
    ranked = pieces.join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.select(names).dtypes)
    return ranked.mapInArrow(assign, f"{schema}, sequence_id long, offset long")


def pack(documents: DataFrame, paths: tuple[str, str] | None = None, size: int = SIZE) -> DataFrame:
    """Where each piece of each document goes: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Cases are as in cut(). The ids themselves are cut()'s; assemble() puts them into their sequences.
    """
    digest = cut(documents, paths, size).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return place(digest, size, ("doc_id", "start", "ids_crc32"))


def assemble(documents: DataFrame, packed: DataFrame, paths: tuple[str, str] | None = None, size: int = SIZE) -> DataFrame:
    """sequence_id and ids of each sequence, for documents whose ids are distinct."""
    ids = cut(documents, paths, size).select("doc_id", "start", "ids")
    return packed.join(ids, ["doc_id", "start"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.transform("p", lambda x: x["ids"]).alias("pieces"))
