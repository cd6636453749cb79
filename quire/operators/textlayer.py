"""Tables in the text layer of pages, found from ruling lines and the alignment of words by five strategies in turn.

A page's elements (words and lines) are gathered into a row, or one partition of a table function in SQL: its cells need all
of them together, and a page is bounded. Everything that comes after, from judging to numbering, is DataFrames again. A page
that can't be worked out gives no tables, and is counted.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quire.functions import tables as tb
from quire.operators.infer import CAPTION, CAPTION_WORD, STRATEGIES, _starts, _steps, _sums, has_caption
from quire.sources.shared import kept


class Tolerances(NamedTuple):
    """In points. snap: edges so near are one; join: gaps that an edge bridges; meet: how near crossing edges come; words: words in line."""

    snap: float = 3.0
    join: float = 3.0
    meet: float = 3.0
    words: float = 1.0
    least_words: int = 3


# Tolerances of the strategies, in their order.
TOLERANCES = (Tolerances(), Tolerances(meet=5.0), Tolerances(least_words=2), Tolerances(), Tolerances(least_words=2))
#: Lines thinner than this are edges; shorter edges than LEAST_EDGE are not. Words whose tops are so near stand in one line of text.
THIN, LEAST_EDGE, TEXT_LINE = 1.0, 3.0, 3.0


class Word(NamedTuple):
    text: str
    x0: float
    top: float
    x1: float
    bottom: float


class Edge(NamedTuple):
    """At a place across (x of a vertical edge, y of a horizontal one), from low to high along it."""

    at: float
    low: float
    high: float


def runs(items: list, value: Callable[[Any], float], tolerance: float) -> list[list]:
    """items sorted by value, parted where the step between neighbours is over the tolerance."""
    out: list[list] = []
    last = None
    for x in sorted(items, key=value):
        v = value(x)
        if last is not None and v - last <= tolerance:
            out[-1].append(x)
        else:
            out.append([x])
        last = v
    return out


def ruled(lines: list[Word], vertical: bool) -> list[Edge]:
    if vertical:
        return [Edge((w.x0 + w.x1) / 2, w.top, w.bottom) for w in lines if w.x1 - w.x0 <= THIN]
    return [Edge((w.top + w.bottom) / 2, w.x0, w.x1) for w in lines if w.bottom - w.top <= THIN]


def column_edges(words: list[Word], t: Tolerances) -> list[Edge]:
    """An edge left of each column of words that share a left, right or middle place, and one right of the last."""
    sides = (lambda w: w.x0, lambda w: w.x1, lambda w: (w.x0 + w.x1) / 2)
    found = [r for side in sides for r in runs(words, side, t.words) if len(r) >= t.least_words]
    columns: list[tuple[float, float, list[Word]]] = []
    for r in sorted(found, key=len, reverse=True):
        left, right = min(w.x0 for w in r), max(w.x1 for w in r)
        if all(right < a or left > b for a, b, _ in columns):
            columns.append((left, right, r))
    if not columns:
        return []
    top, bottom = min(w.top for *_, r in columns for w in r), max(w.bottom for *_, r in columns for w in r)
    return [Edge(x, top, bottom) for x in [*sorted(a for a, _, _ in columns), max(b for _, b, _ in columns)]]


def row_edges(words: list[Word], t: Tolerances) -> list[Edge]:
    """An edge above and below each line of words."""
    rows = runs(words, lambda w: w.top, t.words)
    if not rows:
        return []
    left, right = min(w.x0 for w in words), max(w.x1 for w in words)
    return [Edge(y, left, right) for r in rows for y in (min(w.top for w in r), max(w.bottom for w in r))]


def tidy(edges: list[Edge], t: Tolerances) -> list[Edge]:
    """Edges near one another at their mean place, those in one line joined, short ones left out."""
    out = []
    for near in runs(edges, lambda e: e.at, t.snap):
        at, own = sum(e.at for e in near) / len(near), []
        for e in sorted(near, key=lambda e: e.low):
            if own and e.low <= own[-1][1] + t.join:
                own[-1][1] = max(own[-1][1], e.high)
            else:
                own.append([e.low, e.high])
        out += [Edge(at, low, high) for low, high in own if high - low >= LEAST_EDGE]
    return out


def cells(down: list[Edge], across: list[Edge], meet: float) -> list[tuple[float, float, float, float]]:
    """(x0, top, x1, bottom) of the smallest boxes whose corners are crossings and whose sides lie on edges."""
    crossing: dict[tuple[float, float], tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    for i, v in enumerate(down):
        for j, h in enumerate(across):
            if v.low - meet <= h.at <= v.high + meet and h.low - meet <= v.at <= h.high + meet:
                crossing[v.at, h.at][0].add(i)
                crossing[v.at, h.at][1].add(j)
    in_column, in_row = defaultdict(list), defaultdict(list)
    for x, y in sorted(crossing):
        in_column[x].append(y)
        in_row[y].append(x)
    on = lambda p, q, way: not crossing[p][way].isdisjoint(crossing[q][way])

    def box(x: float, y: float) -> tuple[float, float, float, float] | None:
        lower = [b for b in in_column[x] if b > y and on((x, y), (x, b), 0)]
        right = [r for r in in_row[y] if r > x and on((x, y), (r, y), 1)]
        for b in lower:
            for r in right:
                if (r, b) in crossing and on((x, b), (r, b), 1) and on((r, y), (r, b), 0):
                    return x, y, r, b
        return None

    return [c for p in list(crossing) if (c := box(*p))]


def grouped(boxes: list[tuple[float, float, float, float]]) -> list[list[tuple[float, float, float, float]]]:
    """Boxes that share corners, directly or through others, from the top; single ones are no table."""
    up = list(range(len(boxes)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    first: dict[tuple[float, float], int] = {}
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        for corner in ((x0, y0), (x0, y1), (x1, y0), (x1, y1)):
            up[root(i)] = root(first.setdefault(corner, i))
    groups = defaultdict(list)
    for i, b in enumerate(boxes):
        groups[root(i)].append(b)
    return sorted((g for g in groups.values() if len(g) > 1), key=lambda g: min((b[1], b[0]) for b in g))


def texts(words: list[Word], box: tuple[float, float, float, float]) -> str:
    """The words whose middles are in the box, line by line."""
    x0, top, x1, bottom = box
    own = [w for w in words if x0 <= (w.x0 + w.x1) / 2 < x1 and top <= (w.top + w.bottom) / 2 < bottom]
    if len(own) == 1:
        return own[0].text + ""
    return "\n".join(" ".join(w.text for w in sorted(r, key=lambda w: w.x0)) for r in runs(own, lambda w: w.top, TEXT_LINE))


#: Pages drawn alike share their cells: a worker remembers those of so many sets of edges, each of so many crossings at most.
REMEMBERED, MOST_CROSSINGS = 4096, 512


def placed(down: tuple[Edge, ...], across: tuple[Edge, ...], meet: float) -> list[tuple[tuple, list[list[tuple | None]]]]:
    """(box, rows of its cells' boxes) of the tables that edges make."""
    out = []
    for group in grouped(cells(list(down), list(across), meet)):
        columns = sorted({b[0] for b in group})
        by_place = {(b[1], b[0]): b for b in group}
        rows = [[by_place.get((y, x)) for x in columns] for y in sorted({b[1] for b in group})]
        out.append(((min(b[0] for b in group), min(b[1] for b in group), max(b[2] for b in group), max(b[3] for b in group)), rows))
    return out


_remembered = lru_cache(REMEMBERED)(placed)


class Page:
    """A page's words and lines. What several strategies share is worked out once. ValueError for boxes without sense."""

    def __init__(self, words: list[Word], lines: list[Word]):
        for _, x0, top, x1, bottom in (*words, *lines):
            if not (x0 <= x1 and top <= bottom):  # also where a place is no number
                raise ValueError("a box ends before it begins")
        self.words, self.lines, self._edges, self._bands = words, lines, {}, {}
        self._order = sorted(range(len(words)), key=lambda i: words[i].top + words[i].bottom)
        self._middles = [(words[i].top + words[i].bottom) / 2 for i in self._order]

    def edges(self, vertical: bool, by: str, t: Tolerances) -> tuple[Edge, ...]:
        key = vertical, by, t.snap, t.join, *((t.words, t.least_words) if vertical else (t.words,)) * (by != "lines")
        if key not in self._edges:
            own = ruled(self.lines, vertical) if by == "lines" else (column_edges if vertical else row_edges)(self.words, t)
            self._edges[key] = tuple(tidy(own, t))
        return self._edges[key]

    def between(self, top: float, bottom: float) -> list[Word]:
        """The words whose middles lie so high, in the page's order."""
        if (top, bottom) not in self._bands:
            self._bands[top, bottom] = [self.words[i] for i in sorted(self._order[bisect_left(self._middles, top) : bisect_left(self._middles, bottom)])]
        return self._bands[top, bottom]

    def tables(self, vertical: str, horizontal: str, t: Tolerances) -> list[tuple[tuple, list[list[str | None]]]]:
        """(box, rows) of the tables that one strategy finds."""
        down, across = self.edges(True, vertical, t), self.edges(False, horizontal, t)
        found = (_remembered if len(down) * len(across) <= MOST_CROSSINGS else placed)(down, across, t.meet)
        return [(box, [[texts(self.between(c[1], c[3]), c) if c else None for c in r] for r in rows]) for box, rows in found]


def page_tables(words: list[Word], lines: list[Word], vertical: str, horizontal: str, t: Tolerances) -> list[tuple[tuple, list[list[str | None]]]]:
    """(box, rows) of the tables that one strategy finds on a page. ValueError for boxes without sense."""
    return Page(words, lines).tables(vertical, horizontal, t)


def by_strategies(words: list[Word], lines: list[Word]) -> Iterator[tuple]:
    """strategy, table_no, x0, top, x1, bottom, rows, failed of all tables on a page; whatever is wrong with it stays with it."""
    page, wrong = None, None
    try:
        page = Page(words, lines)
    except Exception as e:
        wrong = e
    for s, t in zip(STRATEGIES, TOLERANCES, strict=True):
        try:
            if page is None:
                raise wrong
            found = page.tables(s["vertical"] or "lines", s["horizontal"] or "lines", t)
        except Exception as e:
            yield s["seq"], None, None, None, None, None, None, f"{type(e).__name__}: {e}"
            continue
        for i, (box, rows) in enumerate(found):
            yield s["seq"], i, *box, rows, None


@udtf
class FindTables:
    """find_tables(table(elements)): the tables of each page by each strategy, and a row with failed for one that can't be worked out."""

    @staticmethod
    def analyze(elements: AnalyzeArgument) -> AnalyzeResult:
        if not elements.isTable:
            raise ValueError("find_tables takes a table of elements")
        kinds = {f.name: f.dataType for f in elements.dataType.fields}
        missing = {"doc_id", "page", "kind", "text", "x0", "top", "x1", "bottom"} - kinds.keys()
        if missing:
            raise ValueError(f"elements need {sorted(missing)}")
        number = [StructField(c, DoubleType()) for c in ("x0", "top", "x1", "bottom")]
        schema = StructType([StructField("doc_id", kinds["doc_id"]), StructField("page", kinds["page"]), StructField("strategy", IntegerType()), StructField("table_no", IntegerType()), *number, StructField("rows", ArrayType(ArrayType(StringType()))), StructField("failed", StringType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id"), PartitioningColumn("page")], orderBy=[OrderingColumn(c) for c in ("top", "x0", "text")])

    def __init__(self):
        self.at, self.words, self.lines = None, [], []

    def eval(self, r) -> None:
        self.at = r["doc_id"], r["page"]
        (self.words if r["kind"] == "word" else self.lines).append(Word(r["text"], r["x0"], r["top"], r["x1"], r["bottom"]))

    def terminate(self) -> Iterator[tuple]:
        if self.at is None:
            return
        for row in by_strategies(self.words, self.lines):
            yield *self.at, *row


def register(spark: SparkSession) -> None:
    spark.udtf.register("find_tables", FindTables)


FOUND = {"strategy": pa.int32(), "table_no": pa.int32(), "x0": pa.float64(), "top": pa.float64(), "x1": pa.float64(), "bottom": pa.float64(), "rows": pa.list_(pa.list_(pa.string())), "failed": pa.string()}
CAPTIONS = pa.list_(pa.struct({"text": pa.string(), "top": pa.float64(), "bottom": pa.float64()}))
PLACES = ("x0", "top", "x1", "bottom")
BARE = [s["seq"] for s in STRATEGIES if s["vertical"] == s["horizontal"] == "text"]
#: Elements worked on at a time, about; a page is never cut.
PIECE = 100_000


def find_tables(elements: DataFrame) -> DataFrame:
    """doc_id, page, strategy, table_no, x0, top, x1, bottom, rows, failed: all that any strategy finds, unjudged.

    elements: doc_id, page, kind ("word" or "line"), text, x0, top, x1, bottom. Where a strategy fails on a page, failed says
    why and there is no table. Elements may come in any order; other columns are ignored. An empty table gives no rows.
    """
    return find_with_captions(elements).drop("captions")


def find_with_captions(elements: DataFrame) -> DataFrame:
    """What find_tables gives, and captions: with a table of text edges alone, its page's lines (text, top, bottom) as caption_lines has them."""
    e = F.struct("kind", "text", *(F.col(c).cast("double").alias(c) for c in PLACES))
    return find_in_pages(elements.groupBy("doc_id", "page").agg(F.collect_list(e).alias("elements")))


def find_in_pages(pages: DataFrame) -> DataFrame:
    """find_with_captions of pages that are rows already: doc_id, page and elements, an array of (kind, text, x0, top, x1, bottom), the places as doubles."""
    pages = pages.select("doc_id", "page", F.col("elements").alias("e"))
    kinds = dict(pages.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column("e").offsets.to_numpy()
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
                piece = b.slice(at, to - at)
                for page, columns in _piece(piece.column("e"), ends[at : to + 1] - ends[at]):
                    take = pa.array(page, pa.int64())
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(take), piece.column("page").take(take), *columns], names=["doc_id", "page", *FOUND, "captions"])
                at = to

    return pages.mapInArrow(work, f"doc_id {kinds['doc_id']}, page {kinds['page']}, strategy int, table_no int, x0 double, top double, x1 double, bottom double, rows array<array<string>>, failed string, captions array<struct<text:string,top:double,bottom:double>>")


# Many pages at once: arrays of elements, edges or words, page by page, each with its page's number in the piece.


def _piece(pages: pa.ListArray, ends: np.ndarray) -> Iterator[tuple[np.ndarray | list[int], list[pa.Array]]]:
    """Pages of the rows found, and the rows' columns."""
    values, n = pages.flatten(), len(ends) - 1
    word = pc.equal(values.field("kind"), "word").fill_null(False).to_numpy(zero_copy_only=False)
    places = np.stack([values.field(c).to_numpy(zero_copy_only=False) for c in PLACES])
    page = np.repeat(np.arange(n), np.diff(ends))
    x0, top, x1, bottom = places
    with np.errstate(invalid="ignore"):
        bad = ~((x0 <= x1) & (top <= bottom)) | ~np.isfinite(places).all(0) | (np.signbit(places) & (places == 0)).any(0)
    bad |= word & values.field("text").is_null().to_numpy(zero_copy_only=False)
    own = np.flatnonzero(word)
    own = own[np.lexsort((x0[own], top[own], page[own]))]
    # texts put words at one place in order
    tied = np.flatnonzero((page[own][1:] == page[own][:-1]) & (top[own][1:] == top[own][:-1]) & (x0[own][1:] == x0[own][:-1]))
    odd = np.unique(np.r_[page[bad], page[own][tied]])
    good = np.ones(n, bool)
    good[odd] = False
    own, lines = own[good[page[own]]], np.flatnonzero(~word & good[page])
    yield _many_tables(n, page[own], places[:, own], values.field("text").take(pa.array(own)), page[lines], places[:, lines])
    if len(odd):
        at, rows = [], []
        for i in odd.tolist():
            e = sorted(_elements(values.slice(ends[i], ends[i + 1] - ends[i])), key=lambda e: (e[0].top, e[0].x0, e[0].text is not None, e[0].text or ""))
            words = [w for w, k in e if k]
            found = list(by_strategies(words, [w for w, k in e if not k]))
            at += [i] * len(found)
            rows += [(*r, said_lines(words) if r[0] in BARE and r[-1] is None else []) for r in found]
        columns = zip(*rows, strict=True) if rows else [[]] * (len(FOUND) + 1)
        yield at, [pa.array(list(c), kind) for c, kind in zip(columns, (*FOUND.values(), CAPTIONS), strict=True)]


def _elements(values: pa.StructArray) -> Iterator[tuple[Word, bool]]:
    """A page's elements, and whether they are words."""
    numbers = (values.field(c).to_numpy(zero_copy_only=False).tolist() for c in PLACES)
    return zip(map(Word, values.field("text").to_pylist(), *numbers), pc.equal(values.field("kind"), "word").to_pylist(), strict=True)


def said_lines(words: list[Word]) -> list[dict]:
    """text, top, bottom of a page's lines of text, if a word there has what a caption begins with."""
    if not any(w.text is not None and SAID.search(w.text) for w in words):
        return []
    joined = lambda r: " ".join(t for _, t in sorted((w.x0, w.text) for w in r if w.text is not None))
    return [{"text": joined(r), "top": min(w.top for w in r), "bottom": max(w.bottom for w in r)} for r in runs(words, lambda w: w.top, TEXT_LINE)]


SAID = re.compile(CAPTION_WORD.removeprefix("(?iu)"), re.IGNORECASE)


def _heads(group: np.ndarray, value: np.ndarray, tolerance: float) -> np.ndarray:
    """The first rows of runs: where a group begins, or a step in it is over the tolerance."""
    return np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | ~(np.diff(value) <= tolerance)][: len(group)])


def _of_heads(start: np.ndarray, n: int) -> np.ndarray:
    """The run of each of n rows."""
    return np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))


def _tidied(page: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, pages: int, t: Tolerances) -> tuple[np.ndarray, list[tuple[Edge, ...]]]:
    """tidy of each page's edges: the number of each page's set of edges, and the sets."""
    order = np.lexsort((at, page))
    page, at, low, high = page[order], at[order], low[order], high[order]
    start = _heads(page, at, t.snap)
    size = np.diff(np.r_[start, len(at)])
    mean, run = _sums(at, start, size) / np.maximum(size, 1), _of_heads(start, len(at))
    order = np.lexsort((low, run))
    page, low, high = page[order], low[order], high[order]
    # the farthest that a run has come so far, by places in the order of all highs
    values, rank = np.unique(high, return_inverse=True)
    so_far = values[np.maximum.accumulate(run * len(values) + rank) - run * len(values)]
    first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | ~(low[1:] <= so_far[:-1] + t.join)][: len(run)])
    last = np.r_[first[1:], len(run)][: len(first)] - 1
    long = so_far[last] - low[first] >= LEAST_EDGE
    edges = np.stack([mean[run[first]], low[first], so_far[last]], axis=1)[long]
    ends = np.searchsorted(page[first][long], np.arange(pages + 1)).tolist()
    raw, width, seen = edges.tobytes(), 3 * edges.itemsize, {}
    number = [seen.setdefault(raw[a * width : b * width], len(seen)) for a, b in zip(ends, ends[1:], strict=False)]
    return np.array(number, np.int64), [tuple(Edge(*e) for e in np.frombuffer(s).reshape(-1, 3).tolist()) for s in seen]


def _ruled(page: np.ndarray, places: np.ndarray, vertical: bool) -> tuple[np.ndarray, ...]:
    """ruled: page, at, low, high."""
    x0, top, x1, bottom = places
    a, b, low, high = (x0, x1, top, bottom) if vertical else (top, bottom, x0, x1)
    thin = b - a <= THIN
    return page[thin], ((a + b) / 2)[thin], low[thin], high[thin]


def _row_edges(page: np.ndarray, places: np.ndarray, pages: int, t: Tolerances) -> tuple[np.ndarray, ...]:
    """row_edges of words that go from the top: page, at, low, high."""
    x0, top, x1, bottom = places
    if not len(page):
        return page, top, x0, x1
    start, first = _heads(page, top, t.words), _starts(page)
    left, right = np.zeros(pages), np.zeros(pages)
    left[page[first]], right[page[first]] = np.minimum.reduceat(x0, first), np.maximum.reduceat(x1, first)
    of = np.repeat(page[start], 2)
    return of, np.stack([top[start], np.maximum.reduceat(bottom, start)], axis=1).ravel(), left[of], right[of]


def _column_edges(page: np.ndarray, places: np.ndarray, t: Tolerances) -> tuple[np.ndarray, ...]:
    """column_edges: page, at, low, high. The best run of every page is chosen, then the next best where it is clear of those chosen."""
    x0, top, x1, bottom = places
    if not len(page):
        return page, x0, top, bottom
    found = []
    for v in (x0, x1, (x0 + x1) / 2):
        order = np.lexsort((v, page))
        start = _heads(page[order], v[order], t.words)
        size = np.diff(np.r_[start, len(v)])
        over = lambda f, c: f.reduceat(c[order], start)  # noqa: B023, E731
        run = np.stack([page[order][start], size, over(np.minimum, x0), over(np.maximum, x1), over(np.minimum, top), over(np.maximum, bottom)])
        found.append(run[:, size >= t.least_words])
    of, size, left, right, top, bottom = np.concatenate(found, axis=1)
    order = np.lexsort((-size, of))
    of, left, right, top, bottom = (c[order] for c in (of, left, right, top, bottom))
    start = _starts(of)
    size = np.diff(np.r_[start, len(of)])
    lefts, rights, many = np.full((len(start), 8), np.inf), np.full((len(start), 8), -np.inf), np.zeros(len(start), np.int64)
    chosen = np.zeros(len(of), bool)
    for own, rows in _steps(start, size):
        most = int(many[own].max(initial=0))
        clear = ((right[rows][:, None] < lefts[own, :most]) | (left[rows][:, None] > rights[own, :most])).all(axis=1)
        own, rows = own[clear], rows[clear]
        if most == lefts.shape[1]:
            lefts, rights = (np.concatenate([c, np.full(c.shape, v)], axis=1) for c, v in ((lefts, np.inf), (rights, -np.inf)))
        lefts[own, many[own]], rights[own, many[own]] = left[rows], right[rows]
        many[own] += 1
        chosen[rows] = True
    of, left, right, top, bottom = (c[chosen] for c in (of.astype(np.int64), left, right, top, bottom))
    first = _starts(of)
    ends, tops, bottoms = (f.reduceat(c, first) if len(first) else c for f, c in ((np.maximum, right), (np.minimum, top), (np.maximum, bottom)))
    own = np.r_[_of_heads(first, len(of)), np.arange(len(first))]
    return np.r_[of, of[first]], np.r_[left, ends], tops[own], bottoms[own]


class Grid(NamedTuple):
    """A table's cells as arrays, row by row: left edges of columns, tops of rows, right and lower ends (-inf: no cell there). plain: no cell goes beyond its row and column."""

    box: tuple[float, float, float, float]
    xs: np.ndarray
    ys: np.ndarray
    x1: np.ndarray
    bottom: np.ndarray
    plain: bool


def _grids(down: tuple[Edge, ...], across: tuple[Edge, ...], meet: float) -> list[Grid]:
    out = []
    for box, rows in (_remembered if len(down) * len(across) <= MOST_CROSSINGS else placed)(down, across, meet):
        xs, ys = np.array(sorted({c[0] for r in rows for c in r if c})), np.array(sorted({c[1] for r in rows for c in r if c}))
        x1, bottom = (np.array([[c[i] if c else -np.inf for c in r] for r in rows]) for i in (2, 3))
        out.append(Grid(box, xs, ys, x1, bottom, bool((x1 <= np.r_[xs[1:], np.inf]).all() and (bottom <= np.r_[ys[1:], np.inf][:, None]).all())))
    return out


_remembered_grids = lru_cache(REMEMBERED)(_grids)


def _words_in(grid: Grid, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, cells) of the words with these middles that are in a cell."""
    if grid.plain:
        column, row = np.searchsorted(grid.xs, x, "right") - 1, np.searchsorted(grid.ys, y, "right") - 1
        inside = np.flatnonzero((column >= 0) & (row >= 0) & (x < grid.x1[row, column]) & (y < grid.bottom[row, column]))
        return inside, (row * len(grid.xs) + column)[inside]
    words, cells_ = [], []
    for r, c in zip(*np.nonzero(grid.x1 > -np.inf), strict=True):
        own = np.flatnonzero((grid.xs[c] <= x) & (x < grid.x1[r, c]) & (grid.ys[r] <= y) & (y < grid.bottom[r, c]))
        words.append(own)
        cells_.append(np.full(len(own), r * len(grid.xs) + c))
    return np.concatenate(words), np.concatenate(cells_)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())


def _many_tables(pages: int, page: np.ndarray, places: np.ndarray, texts_: pa.Array, ruled_page: np.ndarray, ruled_places: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Pages and columns of what by_strategies finds on pages without fault; their words go from the top, then from the left."""
    x0, top, x1, bottom = places
    sets = {}

    def edges(vertical: bool, by: str, t: Tolerances) -> tuple[np.ndarray, list[tuple[Edge, ...]]]:
        key = vertical, by, t.snap, t.join, *((t.words, t.least_words) if vertical else (t.words,)) * (by != "lines")
        if key not in sets:
            own = _ruled(ruled_page, ruled_places, vertical) if by == "lines" else _column_edges(page, places, t) if vertical else _row_edges(page, places, pages, t)
            sets[key] = _tidied(*own, pages, t)
        return sets[key]

    x, y = (x0 + x1) / 2, (top + bottom) / 2
    ends = np.searchsorted(page, np.arange(pages + 1))
    tables, slot, word, used = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for s, t in zip(STRATEGIES, TOLERANCES, strict=True):
        (down, downs), (across, acrosses) = edges(True, s["vertical"] or "lines", t), edges(False, s["horizontal"] or "lines", t)
        both = down * len(acrosses) + across
        order = np.argsort(both, kind="stable")
        for own in np.split(order, _starts(both[order])[1:]):
            v, h = downs[down[own[0]]], acrosses[across[own[0]]]
            grids = (_remembered_grids if len(v) * len(h) <= MOST_CROSSINGS else _grids)(v, h, t.meet)
            if not grids:
                continue
            many = ends[own + 1] - ends[own]
            words = np.repeat(ends[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
            of = np.repeat(np.arange(len(own)), many)
            for i, g in enumerate(grids):
                inside, cell = _words_in(g, x[words], y[words])
                slot.append(used + of[inside] * g.x1.size + cell)
                word.append(words[inside])
                used += len(own) * g.x1.size
                tables.append((own, s["seq"], i, g))
    slot, word = np.concatenate(slot), np.concatenate(word)
    # a cell's words in lines, from the top, each from the left
    order = np.lexsort((word, slot))
    slot, word = slot[order], word[order]
    start = _heads(slot, top[word], TEXT_LINE)
    word = word[np.lexsort((x0[word], _of_heads(start, len(word))))]
    lines = pc.binary_join(pa.ListArray.from_arrays(_offsets(np.diff(np.r_[start, len(word)])), texts_.take(pa.array(word))), " ")
    cell_texts = pc.binary_join(pa.ListArray.from_arrays(_offsets(np.bincount(slot[start], minlength=used)), lines), "\n")
    times = [len(own) for own, *_ in tables]
    repeated = lambda values, kind: np.repeat(np.array(values, kind), times, axis=0)
    missing = np.concatenate([np.zeros(0, bool), *(np.tile(g.x1.ravel() == -np.inf, len(own)) for own, *_, g in tables)])
    high, wide = repeated([len(g.ys) for *_, g in tables], np.int64), repeated([len(g.xs) for *_, g in tables], np.int64)
    by_row = pa.ListArray.from_arrays(_offsets(np.repeat(wide, high)), pc.if_else(pa.array(missing), pa.scalar(None, pa.string()), cell_texts))
    strategy, box = repeated([k for _, k, *_ in tables], np.int32), repeated([g.box for *_, g in tables] or np.zeros((0, 4)), float)
    at = np.concatenate([np.zeros(0, np.int64), *(own for own, *_ in tables)])
    columns = [pa.array(strategy), pa.array(repeated([i for *_, i, _ in tables], np.int32)), *(pa.array(c) for c in box.T.copy()), pa.ListArray.from_arrays(_offsets(high), by_row), pa.nulls(len(at), pa.string())]
    return at, [*columns, _captions(pages, page, places, texts_, np.where(np.isin(strategy, BARE), at, -1))]


def _captions(pages: int, page: np.ndarray, places: np.ndarray, texts_: pa.Array, wanted: np.ndarray) -> pa.Array:
    """said_lines of the pages wanted (-1: none)."""
    x0, top, _, bottom = places
    said = np.zeros(pages, bool)
    said[page[pc.match_substring_regex(texts_, SAID.pattern, ignore_case=True).to_numpy(zero_copy_only=False)]] = True
    own = np.flatnonzero(said[page])
    start = _heads(page[own], top[own], TEXT_LINE)
    of, own_texts = page[own][start], texts_.take(pa.array(own))
    low = np.maximum.reduceat(bottom[own], start) if len(start) else np.zeros(0)
    order = np.lexsort((pc.rank(own_texts, tiebreaker="dense").to_numpy(), x0[own], _of_heads(start, len(own))))
    lines = pc.binary_join(pa.ListArray.from_arrays(_offsets(np.diff(np.r_[start, len(own)])), own_texts.take(pa.array(order))), " ")
    values = pa.StructArray.from_arrays([lines, pa.array(top[own][start]), pa.array(low)], fields=list(CAPTIONS.value_type))
    first, many = np.searchsorted(of, np.arange(pages)), np.bincount(of, minlength=pages)
    many = np.where(wanted >= 0, many[wanted], 0)
    take = np.repeat(first[wanted] - np.cumsum(many) + many, many) + np.arange(many.sum())
    return pa.ListArray.from_arrays(_offsets(many), values.take(pa.array(take)), type=CAPTIONS)


def kept_found(elements: DataFrame) -> DataFrame:
    """What find_with_captions gives, written once to the shared folder: it is read in several places. elements may be pages, as find_in_pages takes them."""
    return kept((find_in_pages if "elements" in elements.columns else find_with_captions)(elements), "found")


def failures(found: DataFrame) -> DataFrame:
    """doc_id, page, n: pages on which strategies failed, and how many did."""
    return found.where("failed is not null").groupBy("doc_id", "page").agg(F.count("*").alias("n"))


def text_lines(elements: DataFrame) -> DataFrame:
    """doc_id, page, text, top, bottom of the lines that a page's words stand in."""
    page = Window.partitionBy("doc_id", "page").orderBy("top", "x0", "text")
    words = elements.where("kind = 'word'").withColumn("_new", (F.col("top") - F.lag("top").over(page) > TEXT_LINE).cast("int"))
    rows = words.withColumn("_line", F.sum(F.coalesce("_new", F.lit(0))).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    own = rows.groupBy("doc_id", "page", "_line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("w"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    return own.select("doc_id", "page", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), "top", "bottom")


def caption_lines(elements: DataFrame) -> DataFrame:
    """text_lines of the pages on which a word has what a caption begins with; there are no captions on the others."""
    said = elements.where(F.col("kind") == "word").where(F.col("text").rlike(CAPTION_WORD)).select("doc_id", "page").distinct()
    return text_lines(elements.join(said, ["doc_id", "page"], "left_semi"))


def extract_tables(elements: DataFrame | None, heights: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id and the tables of each page: id, page, title, markdown, html, rows, source 'pdf'; numbered within the page.

    elements as find_tables takes them, heights (doc_id, page, height). Of what the strategies find only probable tables
    count; one of text edges alone needs a caption near it, and of equal ones the first strategy's is kept. found: what
    kept_found, find_with_captions or find_in_pages has given, if it is there already; elements aren't read then.
    """
    found = find_with_captions(elements) if found is None else found
    good = tb.probable(captioned(found.where("failed is null"), heights))
    # equal tables are on one page: with it among the keys, the rows lie where the join has brought them
    first = Window.partitionBy("doc_id", "page", tb.key(F.col("page"), F.col("rows"))).orderBy("strategy", "table_no")
    kept = good.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    seq = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("strategy", "table_no"))
    return kept.withColumn("_t", tb.table_struct(F.col("page"), seq, F.col("rows"), F.lit("pdf"))).select("doc_id", "_t.*")


def captioned(found: DataFrame, heights: DataFrame) -> DataFrame:
    """The tables of find_with_captions that are of text edges alone and have a caption near them, and all others."""
    bare, tall = F.col("strategy").isin(BARE), heights.groupBy("doc_id", "page").agg(F.max("height").alias("height"))
    some = found.where(~bare | F.exists("captions", lambda c: c["text"].rlike(CAPTION)))
    return some.join(tall, ["doc_id", "page"], "left").where(~bare | has_caption(F.col("captions"), F.col("top"), F.col("bottom"), F.col("height"))).drop("captions", "height")
