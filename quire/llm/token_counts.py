"""Token counts by heap-and-linked-list byte-pair merging, without making identifiers.

A part of a text starts as a linked list of symbols. A heap holds every adjacent pair that the vocabulary can merge; the
pair of the lowest rank (of equal ranks the leftmost) is popped and merged, its new neighbours are pushed, and pairs that a
merge has used up are skipped when they come up. What is counted is the symbols at the start less the merges.

Texts are cut into parts only where no merge can reach across, so counts of parts add up, and a worker counts each
distinct part once while it remembers it. Parts are told apart by their characters, not by a hash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import _text as tx

LIMIT = 4096
#: Distinct parts whose counts a worker remembers, at least; twice as many at most.
REMEMBERED = 600_000
#: Characters of a long text that are cut into parts at a time, at least.
STRETCH = 1 << 20

SPACE = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merges(symbols: list[int], merge: dict[int, tuple[int, int]], bits: int) -> int:
    """How many merges byte-pair merging makes of these symbols, which are used up.

    merge has (rank, the symbol it becomes) of each pair that is merged, by left << bits | right. Symbols above the last but
    two of bits stand in no pair.
    """
    n = len(symbols)
    found = merge.get
    # the heap holds rank << place | left symbol's place; numbers below 2^30 are Python's fastest
    place = 15 if n < 1 << 15 else 40
    heap = [m[0] << place | i for i, m in enumerate([found(a << bits | b) for a, b in zip(symbols, symbols[1:], strict=False)]) if m]
    if not heap:
        return 0
    heapify(heap)
    gone = (1 << bits) - 1
    symbols.append(gone)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    done = 0
    last = (1 << place) - 1
    while heap:
        v = heappop(heap)
        i = v & last
        j = after[i]
        m = found(symbols[i] << bits | symbols[j])
        if m is None or m[0] != v >> place:  # a merge has used this pair up
            continue
        done += 1
        symbols[i] = both = m[1]
        symbols[j] = gone
        after[i] = k = after[j]
        before[k] = i
        if m := found(both << bits | symbols[k]):
            heappush(heap, m[0] << place | i)
        h = before[i]
        if h >= 0 and (m := found(symbols[h] << bits | both)):
            heappush(heap, m[0] << place | h)
    return done


class Pieces:
    """A sentencepiece BPE model with byte fallback: merges by score, one token for each byte of an unknown character.

    Parts begin at a space behind something else, stand around a line break, and end between a letter and an ASCII mark,
    if the vocabulary has no piece across such a place; else at spaces only.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        order = {s: r for r, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        number = {p: i for i, p in enumerate(pieces)}
        self.bits = bits = (len(number) + 2).bit_length()
        self.unknown = (1 << bits) - 2
        halves = ((p[:cut], p[cut:], p) for p in number for cut in range(1, len(p)))
        self.merge = {number[a] << bits | number[b]: (order[pieces[p]], number[p]) for a, b, p in halves if a in number and b in number}
        self.symbols = {p: i for p, i in number.items() if len(p) == 1} | {" ": number[SPACE]}
        spanned = {(x, y) for p in pieces for x, y in zip(p, p[1:], strict=False)}
        if any(y == SPACE != x for x, y in spanned) or not all(ch in pieces for p in pieces for ch in p) or sp.encode("a  ﬁ") != sp.encode("a ▁ﬁ"):
            raise ValueError("this model merges across words, has symbols that are no pieces, or rewrites texts")
        letters = "".join(sorted(ch for ch in {ch for p in pieces for ch in p} if ch.isalpha()))
        marks = "".join(ch for ch in map(chr, range(33, 127)) if not ch.isalnum() and not any((x, ch) in spanned for x in letters))
        joined = any("\n" in pair for pair in spanned)
        line = "" if joined else "\n"
        ends = f"[{re.escape(marks)} {SPACE}{line}]" if marks else f"[ {SPACE}{line}]"
        self.part = re.compile(rf"[ {SPACE}]*[{re.escape(letters)}]+(?={ends}|\Z)|[ {SPACE}]+[^ {SPACE}{line}]*|[^ {SPACE}{line}]+" + ("" if joined else "|\n"))
        self.cut = re.compile(rf"(?<=[^ {SPACE}])(?= )")

    def parts(self, text: str) -> Iterator[list[str]]:
        for piece in stretches(f" {text}" if text else "", self.cut):
            yield self.part.findall(piece)

    def count(self, part: str) -> int:
        known, unknown = self.symbols, self.unknown
        symbols = [known.get(ch, unknown) for ch in part]
        start = len(symbols) if unknown not in symbols else sum(1 if ch in known else len(ch.encode()) for ch in part)
        return start - merges(symbols, self.merge, self.bits)


class Bytes:
    """A byte-level BPE file of tokenizers. Its special strings inside a text are one token each, as the library has it by default."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("this file holds no plain byte-level BPE")
        ids = spec["model"]["vocab"]
        self.bits = bits = (max(ids.values()) + 3).bit_length()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merge = {ids[a] << bits | ids[b]: (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}
        # the printable characters of Latin-1 stand for themselves, the other bytes for the characters from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in set(shown)]
        self.symbols = {b: ids[chr(b)] for b in shown} | {b: ids[chr(256 + i)] for i, b in enumerate(others)}
        self.special = {t["content"] for t in spec.get("added_tokens", ())}
        names = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.split = regex.compile(f"({names})") if names else None
        self.part = regex.compile(public_tokenizers.PATTERN)
        self.cut = re.compile(r"(?<=[A-Za-z0-9,.])(?= [A-Za-z])")

    def parts(self, text: str) -> Iterator[list[str]]:
        for s in self.split.split(text) if self.split else [text]:
            if s in self.special:
                yield [s]
            else:
                for piece in stretches(s, self.cut):
                    yield self.part.findall(piece)

    def count(self, part: str) -> int:
        if part in self.special:
            return 1
        symbols = [self.symbols[b] for b in part.encode()]
        start = len(symbols)
        return start - merges(symbols, self.merge, self.bits)


def stretches(text: str, cut: re.Pattern) -> Iterator[str]:
    """text in stretches that end at a place where cut matches, of STRETCH characters or as many more as it takes."""
    at = 0
    while at < len(text):
        m = cut.search(text, at + STRETCH) if len(text) - at > STRETCH else None
        end = m.start() if m else len(text)
        yield text[at:end] if at or m else text
        at = end


class Counter(dict):
    """Counts of parts, worked out when first asked for."""

    def __init__(self, model: Pieces | Bytes):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, part: str) -> int:
        n = self.old.get(part)
        n = self[part] = self.model.count(part) if n is None else n
        return n

    def tokens(self, text: str) -> int:
        n = 0
        for parts in self.model.parts(text):
            n += sum(map(self.__getitem__, parts))
            if len(self) > REMEMBERED:
                self.old = dict(self)
                self.clear()
        return n


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter of a vocabulary file: .model of sentencepiece, .json of tokenizers."""
    if path not in _counters:
        _counters[path] = Counter(Pieces(path) if path.endswith(".model") else Bytes(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), n_tokens and over_limit (more than limit) of every whole text, without special tokens added.

    path is that of a vocabulary file, which every worker must have. A null text counts as empty: no bytes, no tokens. Each row
    is counted by itself, so repeated rows and rows without doc_id stay. Long texts are counted a stretch at a time. An empty
    table gives no rows; columns other than doc_id and text are ignored, whatever their names.
    """
    tx.importable(docs.sparkSession)
    path = path or default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path).tokens
        for batch in batches:
            for first, end, raw, off in tx.slices(batch.column("text")):
                n = np.fromiter((tokens(raw[a:z].tobytes().decode()) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)), np.int64, end - first)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), tx.text_or_empty(docs).alias("text"))
    return rows.mapInArrow(tx.released(work), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
