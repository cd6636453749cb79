"""Words of whole texts, found and hashed on the UTF-8 bytes of Arrow columns.

Every operator of this package that runs in Python reads its texts through :func:`slices`, which cuts an Arrow batch into
pieces of about half a megabyte (a longer document is a piece of its own), so a worker's memory follows the longest document
and not the batch. Both word classes treat every non-ASCII character as a word character, so bytes can stand for code
points.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
SLICE_ROWS = 4000
BATCH_ROWS = 500

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.RandomState(20240229).randint(1, 1 << 62, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words [^\x20\x09-\x0D]+ and, after lower-casing, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
BLANK_SEPARATED = np.ones(256, bool)
BLANK_SEPARATED[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[0x30:0x3A] = ALPHANUMERIC[0x61:0x7B] = ALPHANUMERIC[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds the batches they get."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    # whole texts go to Python in batches: fewer rows each, so that JVM and worker hold a few megabytes
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, after which a worker gives back what it has freed: it is kept for later tasks of other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return run


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + (1 << 17)), base, dtype=_U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 23:
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]: a polynomial in an odd base modulo 2^64, by differences of one running sum."""
    if not len(start):
        return np.zeros(0, _U)
    n = len(buf)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[buf] * _power("up", _BASE, n), out=total[1:])
    h = (total[end] - total[start]) * _power("down", _BASE_INV, n + 1)[start]
    return mix(h + (end - start).astype(_U))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a string column without nulls; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(off, off[at] + size, side="right")) - 1
        end = min(max(end, at + 1), len(column), at + SLICE_ROWS)
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


class Words:
    """The words of the documents in one slice: byte offsets start and end, and first[d]:first[d + 1] for document d."""

    __slots__ = ("buf", "end", "first", "start")

    def __init__(self, raw: np.ndarray, off: np.ndarray, is_word: np.ndarray, lower: bool = True):
        self.buf = LOWER[raw] if lower else raw
        n = len(raw)
        inside = is_word[self.buf]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[off[:-1][off[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[off[1:][off[1:] > 0] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return hash_spans(self.buf, self.start, self.end)


def hash_words(texts: list[str], is_word: np.ndarray) -> list[np.ndarray]:
    """Word hashes of each of a few texts, as Words.hashes gives them."""
    if not texts:
        return []
    out = []
    for first, end, raw, off in slices(pa.array(texts, pa.large_string())):
        w = Words(raw, off, is_word)
        h = w.hashes()
        out += [h[w.first[i] : w.first[i + 1]] for i in range(end - first)]
    return out


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every k consecutive words that stand in one document."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    s = h[: n - k + 1].copy()
    for j in range(1, k):
        s = s * _U(0xD6E8FEB86659FD93) + h[j : n - k + 1 + j]
    left = np.repeat(first[1:], np.diff(first))[: n - k + 1] - np.arange(n - k + 1)
    ok = np.flatnonzero(left >= k)
    return ok, mix(s[ok])


def whole(h: np.ndarray) -> np.uint64:
    """The hash that windows() gives a window of just these words."""
    return windows(h, np.array([0, len(h)]), len(h))[1][0]


class Lookup:
    """Sorted distinct 64-bit keys with a bit table in front; find() returns positions, -1 where a value is no key."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, dtype=_U))
        bits = max(16, int(len(self.keys) * 16).bit_length())
        self.shift = _U(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.keys >> self.shift] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes into values, positions among the keys) of those values that are keys."""
        if not len(self.keys) or not len(values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[values >> self.shift])
        pos = np.searchsorted(self.keys, values[at])
        pos[pos == len(self.keys)] = 0
        ok = self.keys[pos] == values[at]
        return at[ok], pos[ok]


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes starts[i] .. starts[i] + counts[i] - 1 one after another, and i for each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return starts[owner] + np.arange(len(owner)) - before[owner], owner
