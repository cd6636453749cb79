"""Tables inferred from the boxes of recognised lines, and the merging of tables from several sources.

Rows and columns are clustered in an order-dependent way (a centre moves with each line that joins it). Pages are bounded and
independent, so many go through each step at once, as arrays: the n-th line of every page moves that page's centre. The
functions on one page say what comes out, and take the pages with a place that is no finite number. Judging and rendering are
expressions again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import median

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import tables as tb
from quire.functions.text import safe_text


# Fixed values, in points: row tolerance from, to, by line height; column tolerance from, to, by width; the largest step within
# a block from, to, by the usual step, which is USUAL_STEP where there is none; how many anchors a block keeps at most.
ROW_LEAST, ROW_MOST, ROW_BY_HEIGHT = 8.0, 24.0, 0.75
COLUMN_LEAST, COLUMN_MOST, COLUMN_BY_WIDTH = 28.0, 60.0, 0.05
STEP_LEAST, STEP_MOST, STEP_BY_USUAL, USUAL_STEP = 45.0, 100.0, 2.6, 30.0
MOST_ANCHORS = 8


class Centres:
    """Moving means: a value joins the nearest one within the tolerance (the earliest of equals) or opens its own."""

    def __init__(self, tolerance: float):
        self.tolerance, self.at, self.size = tolerance, [], []

    def place(self, value: float) -> int:
        near = [(abs(value - c), i) for i, c in enumerate(self.at) if abs(value - c) <= self.tolerance]
        if not near:
            self.at.append(value)
            self.size.append(0)
        i = min(near)[1] if near else len(self.at) - 1
        self.size[i] += 1
        self.at[i] += (value - self.at[i]) / self.size[i]
        return i


def cluster_rows(lines: list[dict]) -> list[list[dict]]:
    rows: dict[int, list[dict]] = {}
    centres = Centres(max(ROW_LEAST, min(ROW_MOST, ROW_BY_HEIGHT * median(x["y1"] - x["y0"] for x in lines)))) if lines else None
    for x in sorted(lines, key=lambda x: ((x["y0"] + x["y1"]) / 2, x["x0"])):
        rows.setdefault(centres.place((x["y0"] + x["y1"]) / 2), []).append(x)
    return [sorted(rows[i], key=lambda x: x["x0"]) for i in sorted(rows)]


def blocks(rows: list[list[dict]]) -> list[list[list[dict]]]:
    """Runs of rows with two cells or more, parted where the step down is far beyond the usual."""
    rows = [r for r in rows if len(r) > 1]
    centre = [sum((c["y0"] + c["y1"]) / 2 for c in r) / len(r) for r in rows]
    steps = [b - a for a, b in zip(centre, centre[1:], strict=False)]
    down = [s for s in steps if s > 0]
    most = max(STEP_LEAST, min(STEP_MOST, STEP_BY_USUAL * (median(down) if down else USUAL_STEP)))
    cuts = [0, *(i + 1 for i, s in enumerate(steps) if s > most), len(rows)]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def anchors(rows: list[list[dict]], most: int = MOST_ANCHORS) -> list[float]:
    """The left edges that most cells share, from left to right."""
    xs = sorted(c["x0"] for r in rows if len(r) > 1 for c in r)
    if not xs:
        return []
    centres = Centres(max(COLUMN_LEAST, min(COLUMN_MOST, COLUMN_BY_WIDTH * (xs[-1] - xs[0]))))
    for x in xs:
        centres.place(x)
    return sorted(x for _, x in sorted(zip(centres.size, centres.at, strict=True), reverse=True)[:most])


def cells(row: list[dict], edges: list[float]) -> list[str]:
    """A cell for each edge: the texts nearest to it, the left edge of two as near."""
    own: list[list[str]] = [[] for _ in edges]
    for c in row:
        own[min(range(len(edges)), key=lambda i: (abs(c["x0"] - edges[i]), i))].append(c["text"])
    return [" ".join(x) for x in own]


def page_tables(lines: list[dict]) -> list[list[list[str]]]:
    """Cell rows of the blocks of a page that have three rows and two columns at least; fewer than six lines hold none."""
    if len(lines) < 6:
        return []
    found = [(b, anchors(b)) for b in blocks(cluster_rows(lines)) if len(b) > 2]
    return [[cells(r, edges) for r in b] for b, edges in found if len(edges) > 1]


def boxes(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, text and the box's edges; lines without text, with fewer than four points or without area go."""
    place = lambda p, i: F.get(p, F.lit(i)).try_cast("double")
    # nearly every box has four points, which need no function for each
    edge = lambda four, more, i: F.when(F.size("bbox") == 4, four(*(place(F.get("bbox", F.lit(k)), i) for k in range(4)))).otherwise(more(F.transform("bbox", lambda p: place(p, i))))
    edges = [edge(four, more, i).alias(f"{c}{n}") for i, c in enumerate("xy") for n, four, more in ((0, F.least, F.array_min), (1, F.greatest, F.array_max))]
    # worked out once, for the columns and for the filter
    one = F.struct(safe_text(F.col("text")).alias("text"), *edges)
    out = lines.where(F.size("bbox") >= 4).select("doc_id", "page_no", "line_no", F.inline(F.array(one)))
    return out.where("text <> '' and x1 > x0 and y1 > y0")


def _pages(lines: DataFrame) -> DataFrame:
    """doc_id, page_no and lines: a page's lines together."""
    return boxes(lines).groupBy("doc_id", F.col("page_no").cast("int").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "x0", "x1", "y0", "y1"))).alias("lines"))


# Groups of rows that follow one another are given by the index of each row's group, in order.


def _starts(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)


def _steps(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(groups, rows) of the first rows of all groups, then of the second ones, and so on."""
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    for k in range(int(size.max(initial=0))):
        own = order[: np.searchsorted(falling, -k)]
        yield own, start[own] + k


def _opens(value: np.ndarray, start: np.ndarray, size: np.ndarray, tolerance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What Centres does to sorted values of many groups: which values open a centre, and each value's centre and its size so far.

    A value is beyond the tolerance of every centre but the last.
    """
    new, at, many = np.zeros(len(value), bool), np.zeros(len(value)), np.zeros(len(value), np.int64)
    last, n = np.zeros(len(start)), np.zeros(len(start), np.int64)
    for own, rows in _steps(start, size):
        v = value[rows]
        opens = (n[own] == 0) | ~(np.abs(v - last[own]) <= tolerance[own])
        c, m = np.where(opens, v, last[own]), np.where(opens, 0, n[own]) + 1
        c += (v - c) / m
        new[rows], at[rows], many[rows], last[own], n[own] = opens, c, m, c, m
    return new, at, many


def _medians(value: np.ndarray, group: np.ndarray, n: int, otherwise: float = 0.0) -> np.ndarray:
    """The median of each of n groups."""
    v = value[np.lexsort((value, group))]
    size = np.bincount(group, minlength=n)
    start, some = np.cumsum(size) - size, size > 0
    out = np.full(n, otherwise)
    low, high = (start + (size - 1) // 2)[some], (start + size // 2)[some]
    out[some] = np.where(low == high, v[low], (v[low] + v[high]) / 2)
    return out


def _sums(value: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of groups with their rounding errors added at the end, as sum() has them."""
    total, error = np.zeros(len(start)), np.zeros(len(start))
    for own, rows in _steps(start, size):
        s, v = total[own], value[rows]
        t = s + v
        error[own] += np.where(np.abs(s) >= np.abs(v), (s - t) + v, (v - t) + s)
        total[own] = t
    return total + error


def _block_cells(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, y1: np.ndarray, pages: int) -> tuple[np.ndarray, ...]:
    """For lines of many pages in order: those in blocks of three rows or more, from left to right in each row from the top; their row and block; each block's page and number there."""
    height = _medians(y1 - y0, page, pages)
    tolerance = np.maximum(ROW_LEAST, np.minimum(ROW_MOST, ROW_BY_HEIGHT * height))
    middle = (y0 + y1) / 2
    order = np.lexsort((x0, middle, page))
    start = _starts(page[order])
    size = np.diff(np.r_[start, len(order)])
    row = np.cumsum(_opens(middle[order], start, size, tolerance[page[order][start]])[0]) - 1
    order = order[np.lexsort((x0[order], row))]
    # rows of two cells or more, and the steps between those of a page
    size = np.bincount(row)
    order, row = order[size[row] > 1], row[size[row] > 1]
    start = _starts(row)
    size = np.diff(np.r_[start, len(row)])
    of_page = page[order][start]
    centre = _sums(middle[order], start, size) / np.maximum(size, 1)
    step, same = np.r_[0.0, np.diff(centre)][: len(centre)], np.r_[False, of_page[1:] == of_page[:-1]][: len(centre)]
    down = same & (step > 0)
    most = np.maximum(STEP_LEAST, np.minimum(STEP_MOST, STEP_BY_USUAL * _medians(step[down], of_page[down], pages, USUAL_STEP)))
    block = np.cumsum(~same | (step > most[of_page])) - 1
    whole = np.bincount(block)[block] > 2 if len(block) else np.zeros(0, bool)
    number = np.unique(block[whole], return_inverse=True)[1]
    first = _starts(number)
    block_page = of_page[whole][first]
    pages_start = _starts(block_page)
    place = np.arange(len(first)) - np.repeat(pages_start, np.diff(np.r_[pages_start, len(first)]))
    cells_kept = np.repeat(whole, size)
    return order[cells_kept], np.repeat(np.arange(int(whole.sum())), size[whole]), np.repeat(number, size[whole]), block_page, place


def _block_anchors(x0: np.ndarray, block: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """anchors() of many blocks, one after another, and each one's block."""
    order = np.lexsort((x0, block))
    xs, group = x0[order], block[order]
    start = _starts(group)
    size = np.diff(np.r_[start, len(xs)])
    spread = xs[start + size - 1] - xs[start]
    tolerance = np.maximum(COLUMN_LEAST, np.minimum(COLUMN_MOST, COLUMN_BY_WIDTH * spread))
    new, at, many = _opens(xs, start, size, tolerance)
    last = np.r_[new[1:], True][: len(new)]  # a centre is where its last value leaves it
    at, many, group = at[last], many[last], group[last]
    best = np.lexsort((-at, -many, group))
    start = _starts(group[best])
    rank = np.arange(len(best)) - np.repeat(start, np.diff(np.r_[start, len(best)]))
    best = best[rank < most]
    best = best[np.lexsort((at[best], group[best]))]
    return at[best], group[best]


#: Lines worked on at a time, about; a page is never cut.
PIECE = 100_000


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict[str, np.ndarray], pa.Array, list[int]]]:
    """Parts of a batch of pages: the part, each line's page in it, places, texts, and the pages that are worked on one by one."""
    ends = b.column("lines").offsets.to_numpy()
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        part = b.slice(at, to - at)
        lines = part.column("lines").flatten()
        page = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
        places = {c: lines.field(c).to_numpy(zero_copy_only=False) for c in ("x0", "x1", "y0", "y1")}
        bad = ~np.all([np.isfinite(v) for v in places.values()], axis=0)
        odd = np.unique(page[bad])
        good = ~np.isin(page, odd)
        yield part, page[good], {c: v[good] for c, v in places.items()}, lines.field("text").filter(pa.array(good)), odd.tolist()
        at = to


def block_anchors(lines: DataFrame, most: int = MOST_ANCHORS) -> DataFrame:
    """doc_id, page_no, block and anchors: the left edges that the cells of each block of three rows or more go by, from left to right."""

    def found(part: pa.RecordBatch, at: np.ndarray, block: np.ndarray, values: pa.Array) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("page_no").take(take), pa.array(block, pa.int32()), values], ["doc_id", "page_no", "block", "anchors"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, page, p, _, odd in (x for b in batches for x in _pieces(b)):
            cell, _, block, block_page, number = _block_cells(page, p["x0"], p["y0"], p["y1"], part.num_rows)
            values, of = _block_anchors(p["x0"][cell], block, most)
            offsets = np.r_[0, np.cumsum(np.bincount(of, minlength=len(block_page)))]
            yield found(part, block_page, number, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)))
            alone = [(i, k, anchors(rows, most)) for i in odd for k, rows in enumerate(x for x in blocks(cluster_rows(part.column("lines")[i].as_py())) if len(x) > 2)]
            if alone:
                yield found(part, [i for i, _, _ in alone], [k for _, k, _ in alone], pa.array([x for *_, x in alone], pa.list_(pa.float64())))

    return _pages(lines).mapInArrow(work, f"doc_id {dict(lines.dtypes)['doc_id']}, page_no int, block int, anchors array<double>")


def infer_tables(lines: DataFrame) -> DataFrame:
    """doc_id and the tables of each page: id, page, title, markdown, html, rows, source 'ocr'; numbered within the page."""

    def found(part: pa.RecordBatch, at: np.ndarray, block: np.ndarray, rows: pa.Array) -> pa.RecordBatch:
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([part.column("doc_id").take(take), part.column("page_no").take(take), pa.array(block, pa.int32()), rows], ["doc_id", "page_no", "block", "rows"])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, page, p, texts, odd in (x for b in batches for x in _pieces(b)):
            cell, row, block, block_page, number = _block_cells(page, p["x0"], p["y0"], p["y1"], part.num_rows)
            edges, of = _block_anchors(p["x0"][cell], block, MOST_ANCHORS)
            wide = np.bincount(of, minlength=len(block_page))
            # each cell's nearest edge, the left one of two as near
            grid = np.full((len(block_page), MOST_ANCHORS), np.inf)
            grid[of, np.arange(len(of)) - np.repeat(np.cumsum(wide) - wide, wide)] = edges
            edge = np.argmin(np.abs(p["x0"][cell][:, None] - grid[block]), axis=1) if len(cell) else np.zeros(0, np.int64)
            good = (wide > 1) & (np.bincount(page, minlength=part.num_rows)[block_page] >= 6)
            cell, row, block, edge = (x[good[block]] for x in (cell, row, block, edge))
            # a slot for each row and edge, with the texts that go there from left to right
            start = _starts(row)
            row_block = block[start]
            slots = wide[row_block]
            first = np.cumsum(slots) - slots
            slot = np.repeat(first, np.diff(np.r_[start, len(row)])) + edge
            inside = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(slot, minlength=int(slots.sum())))], pa.int32()), texts.take(pa.array(cell[np.argsort(slot, kind="stable")])))
            by_row = pa.ListArray.from_arrays(pa.array(np.r_[first, slots.sum()], pa.int32()), pc.binary_join(inside, " "))
            kept = np.flatnonzero(good)
            offsets = np.r_[0, np.cumsum(np.bincount(row_block, minlength=len(block_page))[kept])]
            # blocks of two edges or more keep their numbers: they only say which come first
            yield found(part, block_page[kept], number[kept], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), by_row))
            alone = [(i, k, rows) for i in odd for k, rows in enumerate(page_tables(part.column("lines")[i].as_py()))]
            if alone:
                yield found(part, [i for i, _, _ in alone], [k for _, k, _ in alone], pa.array([r for *_, r in alone], pa.list_(pa.list_(pa.string()))))

    raw = _pages(lines).mapInArrow(infer, f"doc_id {dict(lines.dtypes)['doc_id']}, page_no int, block int, rows array<array<string>>")
    good = tb.probable(raw)
    seq = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("block"))
    return good.withColumn("seq", seq).select("doc_id", F.inline(F.array(tb.table_struct(F.col("page_no"), F.col("seq"), F.col("rows"), F.lit("ocr")))))


def merge_tables(*groups: DataFrame) -> DataFrame:
    """Tables of all groups, of equal ones on a page the first: earlier groups win, then order (ord) within the group."""
    both = None
    for i, g in enumerate(groups):
        g = g.withColumn("_group", F.lit(i)).withColumn("rows", tb.normalise_rows(F.col("rows"))).where(F.size("rows") > 0)
        both = g if both is None else both.unionByName(g, allowMissingColumns=True)
    best = Window.partitionBy("doc_id", tb.key(F.col("page"), F.col("rows"))).orderBy("_group", "ord")
    kept = both.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_group")
    return kept.withColumn("markdown", F.when(F.col("markdown") != "", F.col("markdown")).otherwise(tb.markdown(F.col("rows")))).withColumn("html", F.when(F.col("html") != "", F.col("html")).otherwise(tb.html(F.col("rows"))))


# How the text layer of a PDF is searched for tables, in this order.
STRATEGIES = [
    {"seq": 0, "vertical": None, "horizontal": None},
    {"seq": 1, "vertical": "lines", "horizontal": "lines"},
    {"seq": 2, "vertical": "text", "horizontal": "text"},
    {"seq": 3, "vertical": "lines", "horizontal": "text"},
    {"seq": 4, "vertical": "text", "horizontal": "lines"},
]
CAPTION_WORD = r"(?iu)表|table"
CAPTION = r"(?imudU)^\s*(表|table)\s*[\d一二三四五六七八九十]+"


def requires_caption(vertical, horizontal):
    return F.coalesce((vertical == "text") & (horizontal == "text"), F.lit(False))


def _near(f: Callable[[str], Column], w: Callable[[str], Column]) -> Column:
    """A text line (top, bottom) is wholly in [top - 90, top + 18] or [bottom - 8, bottom + 55] of a table, within the page (height)."""
    band = lambda low, high: (w("top") >= F.greatest(F.lit(0.0), low)) & (w("bottom") <= F.least(f("height"), high))
    return band(f("top") - 90, f("top") + 18) | band(f("bottom") - 8, f("bottom") + 55)


def near_caption(found: DataFrame, words: DataFrame, heights: DataFrame) -> DataFrame:
    """The found tables (doc_id, page, table_no, top, bottom) with a caption just above or below: text lines (doc_id, page, text,
    top, bottom) wholly in [top - 90, top + 18] or [bottom - 8, bottom + 55], within the page."""
    pages = found.join(heights, ["doc_id", "page"])
    near = _near(lambda c: F.col(f"f.{c}"), lambda c: F.col(f"w.{c}"))
    captions = words.where(F.col("text").rlike(CAPTION))
    return pages.alias("f").join(captions.alias("w"), (F.col("f.doc_id") == F.col("w.doc_id")) & (F.col("f.page") == F.col("w.page")) & near, "left_semi").select("doc_id", "page", "table_no", "top", "bottom")


def has_caption(lines: Column, top: Column, bottom: Column, height: Column) -> Column:
    """near_caption of one table over its page's text lines, an array of (text, top, bottom); false where the height is null."""
    f = {"top": top, "bottom": bottom, "height": height}
    return F.coalesce(height.isNotNull() & F.exists(lines, lambda w: w["text"].rlike(CAPTION) & _near(f.get, lambda c: w[c])), F.lit(False))
