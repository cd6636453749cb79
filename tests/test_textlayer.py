"""The text layer's tables: geometry by hand, each strategy alone, captions, equal tables, bad pages."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import textlayer as tl
from quire.operators.infer import near_caption
from quire.operators.textlayer import Edge, Tolerances, Word

ELEMENTS = "doc_id int, page int, kind string, text string, x0 double, top double, x1 double, bottom double"
ROWS = [["no", "item", "price"], ["1", "bolt", "3"], ["2", "nut", "4"], ["3", "screw", "5"]]


def words(rows, left=100.0, top=100.0):
    """Texts 60 apart, 20 below one another."""
    return [Word(c, left + 60 * i, top + 20 * n, left + 60 * i + 5 * len(c), top + 20 * n + 14) for n, r in enumerate(rows) for i, c in enumerate(r) if c]


def rules(xs, ys, low=98.0, high=None):
    down = [Word("", x, ys[0], x, ys[-1]) for x in xs]
    return down + [Word("", xs[0], y, xs[-1], y) for y in ys]


XS, YS = [98.0, 158.0, 218.0, 247.0], [98.0, 117.0, 137.0, 157.0, 176.0]


def test_edges():
    t = Tolerances()
    near = [Edge(10, 0, 50), Edge(12, 52, 100), Edge(11, 0, 20), Edge(40, 0, 2), Edge(60, 0, 10), Edge(60, 20, 30)]
    assert tl.tidy(near, t) == [Edge(11, 0, 100), Edge(60, 0, 10), Edge(60, 20, 30)]  # snapped and joined; too short; too far apart
    assert tl.ruled([Word("", 5, 0, 5.5, 9), Word("", 0, 3, 9, 3), Word("", 0, 0, 9, 9)], True) == [Edge(5.25, 0, 9)]
    own = words(ROWS)
    assert [e.at for e in tl.column_edges(own, t)] == [100, 160, 220, 245]
    assert [e.at for e in tl.row_edges(own, t)] == [100, 114, 120, 134, 140, 154, 160, 174]
    assert tl.column_edges(own[:2], t) == [] and tl.row_edges([], t) == []


def test_cells_need_edges_between_corners():
    whole = tl.cells([Edge(0, 0, 20), Edge(10, 0, 20)], [Edge(0, 0, 10), Edge(10, 0, 10), Edge(20, 0, 10)], 3)
    assert sorted(whole) == [(0, 0, 10, 10), (0, 10, 10, 20)]
    gap = tl.cells([Edge(0, 0, 20), Edge(10, 0, 4), Edge(10, 6.5, 20)], [Edge(0, 0, 10), Edge(10, 0, 10), Edge(20, 0, 10)], 3)
    assert sorted(gap) == [(0, 10, 10, 20)]  # the upper box's right side is broken
    merged = tl.cells([Edge(0, 0, 20), Edge(10, 0, 20), Edge(20, 10, 20)], [Edge(0, 0, 20), Edge(10, 0, 20), Edge(20, 0, 20)], 3)
    assert (0, 0, 10, 10) in merged and (10, 0, 20, 10) not in merged


def test_groups_are_tables():
    far = [(0, 0, 1, 1), (1, 0, 2, 1), (50, 50, 51, 51), (51, 51, 52, 52), (90, 90, 91, 91)]
    assert [len(g) for g in tl.grouped(far)] == [2, 2]  # corners join, single boxes are none


@pytest.mark.parametrize(("drawn", "vertical", "horizontal", "tolerances"), [((XS, YS), "lines", "lines", 0), (([], []), "text", "text", 2), ((XS, []), "lines", "text", 3), (([], YS), "text", "lines", 4)])
def test_strategies_find_the_same_rows(drawn, vertical, horizontal, tolerances):
    xs, ys = drawn
    lines = [Word("", x, 98, x, 176) for x in xs] + [Word("", 98, y, 247, y) for y in ys]
    found = tl.page_tables(words(ROWS), lines, vertical, horizontal, tl.TOLERANCES[tolerances])
    assert len(found) == 1
    assert [r for r in found[0][1] if any(r)] == ROWS


def test_meeting_tolerance():
    """Lines that end four points before others meet only where five are allowed."""
    lines = [Word("", x, a + 4, x, b - 4) for x in XS for a, b in zip(YS, YS[1:], strict=False)] + [Word("", XS[0], y, XS[-1], y) for y in YS]
    assert tl.page_tables(words(ROWS), lines, "lines", "lines", tl.TOLERANCES[0]) == []
    assert tl.page_tables(words(ROWS), lines, "lines", "lines", tl.TOLERANCES[1])[0][1] == ROWS


def test_texts_of_a_cell():
    own = [Word("b", 20, 0, 25, 10), Word("a", 5, 1, 10, 11), Word("c", 5, 20, 10, 30), Word("out", 95, 0, 115, 10)]
    assert tl.texts(own, (0, 0, 100, 40)) == "a b\nc"  # the last one's middle is outside
    assert tl.texts([], (0, 0, 1, 1)) == ""


@pytest.mark.parametrize("box", [(5, 0, 4, 1), (0, 5, 1, 4), (math.nan, 0, 1, 1), (0, 0, 1, math.nan)])
def test_boxes_without_sense(box):
    with pytest.raises(ValueError):
        tl.page_tables([Word("x", *box)], [], "text", "text", Tolerances())


def page(doc_id, no, own, lines=()):
    return [(doc_id, no, "word", *map_word(w)) for w in own] + [(doc_id, no, "line", *map_word(w)) for w in lines]


def map_word(w):
    return w.text, *(None if v is None else float(v) for v in w[1:])


def test_documents(spark):
    grid = rules(XS, YS)
    caption = [Word("Table", 100, 60, 125, 70), Word("1", 130, 60, 135, 70)]
    other = [["k", "v", "w"], ["a", "7", "8"], ["b", "9", "10"]]
    below = rules(XS, [y + 300 for y in YS[:4]])
    rows = page(1, 1, words(ROWS), grid) + page(1, 2, words(ROWS), grid)  # equal tables on two pages are two
    rows += page(2, 1, words(ROWS)) + page(3, 1, words(ROWS) + caption)  # no lines: only with a caption
    # two tables, numbered from the top; columns of text go through both, and the fourth strategy makes one of them
    rows += page(4, 1, words(ROWS) + words(other, top=400.0), grid + below)
    rows += page(5, 1, [*words(ROWS), Word("bad", 9, 0, 1, 1)], grid) + page(6, 1, [*words(ROWS), Word("none", None, 0, 1, 1)], grid) + page(None, 1, words(ROWS), grid)
    df = spark.createDataFrame(rows, ELEMENTS).withColumns({"rows": F.lit(1), "strategy": F.lit("x"), "_n": F.lit(2)}).repartition(4)
    heights = df.select("doc_id", "page", F.lit(800.0).alias("height")).distinct()
    got = tl.extract_tables(df, heights).collect()
    found = {(r["doc_id"], r["page"], r["id"]): r["rows"] for r in got}
    assert len(found) == len(got)
    assert found == {(1, 1, "pdf-table-1-1"): ROWS, (1, 2, "pdf-table-2-1"): ROWS, (3, 1, "pdf-table-1-1"): [["Table 1", "", ""], *ROWS], (4, 1, "pdf-table-1-1"): ROWS, (4, 1, "pdf-table-1-2"): other, (4, 1, "pdf-table-1-3"): [*ROWS, *other], (None, 1, "pdf-table-1-1"): ROWS}
    failed = tl.find_tables(df).where("failed is not null")
    assert {(r["doc_id"], r["page"], r["n"]) for r in tl.failures(failed).collect()} == {(5, 1, 5), (6, 1, 5)}
    assert all("Error" in r["failed"] and r["rows"] is None for r in failed.collect())
    assert tl.extract_tables(df.limit(0), heights).collect() == [] and tl.find_tables(df.limit(0)).collect() == []


def test_as_sql(spark):
    tl.register(spark)
    spark.createDataFrame(page(1, 1, words(ROWS), rules(XS, YS)), ELEMENTS).createOrReplaceTempView("elements")
    assert spark.sql("select rows from find_tables(table(elements)) where strategy = 0").collect()[0]["rows"] == ROWS
    with pytest.raises(Exception, match="elements need"):
        spark.sql("select * from find_tables(table(select 1 as doc_id))").collect()


def test_strategies_share_a_page_s_edges(monkeypatch):
    """What several strategies go by is worked out once for a page, and cells once for pages drawn alike; each finds what it finds alone."""
    calls = []
    for name in ("column_edges", "row_edges", "ruled", "cells"):
        monkeypatch.setattr(tl, name, lambda *a, f=getattr(tl, name), n=name: (calls.append(n), f(*a))[1])
    tl._remembered.cache_clear()
    own, lines = words(ROWS), rules(XS, YS)
    found = list(tl.by_strategies(own, lines))
    assert (calls.count("column_edges"), calls.count("row_edges"), calls.count("ruled")) == (1, 1, 2)
    n = calls.count("cells")
    again = list(tl.by_strategies(words([[c[::-1] for c in r] for r in ROWS]), lines))
    assert calls.count("cells") == n and [r[6] for r in again] == [[[c[::-1] if c else c for c in r] for r in t] for t in (r[6] for r in found)]
    alone = [t for s, at in zip(tl.STRATEGIES, tl.TOLERANCES, strict=True) for t in tl.page_tables(own, lines, s["vertical"] or "lines", s["horizontal"] or "lines", at)]
    assert [(tuple(r[2:6]), r[6]) for r in found] == alone


def test_pages_go_by_arrow(spark):
    """A page is a row of an Arrow batch, not a call for each element."""
    df = spark.createDataFrame(page(1, 1, words(ROWS), rules(XS, YS)), ELEMENTS)
    plan = tl.find_tables(df)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "PythonUDTF" not in plan


def test_caption_lines_are_those_of_pages_that_say_so(spark):
    rows = page(1, 1, [Word("表", 0, 0, 5, 10), Word("3", 9, 0, 12, 10), *words(ROWS)]) + page(2, 1, words(ROWS)) + page(3, 1, [Word("TABLE9", 0, 0, 5, 10)])
    got = {(r["doc_id"], r["text"]) for r in tl.caption_lines(spark.createDataFrame(rows, ELEMENTS)).collect()}
    assert got == {(1, "表 3"), (3, "TABLE9"), *((1, " ".join(r)) for r in ROWS)}


def odd_page(rng):
    """Words and lines in crooked rows and columns; some at one place, some without sense or text."""
    own, lines = [], []
    for _ in range(rng.choice((0, 1, 3, 8, 20, 45))):
        x, y = rng.choice((10, 52, 130.3, 210)) + rng.choice((0, 0, 0.7, 2, rng.random() * 90)), rng.randrange(9) * rng.choice((15, 20)) + rng.choice((0, 0, 0.9, 2.9))
        own.append(Word(rng.choice(("a", "bb", "表 1", "Table", "x y", "TABLE7", "")), x, y, x + rng.choice((5, 9.1, 30)), y + rng.choice((10, 12, 17.3))))
    for i in range(rng.choice((0, 0, 3, 6))):
        x = 8.0 + i * 40 + rng.random() * rng.choice((0, 2))
        steps = [(y, y + rng.choice((12, 18, 21))) for y in range(0, 180, 20)] if rng.random() < 0.3 else [(rng.choice((0, 5, 60)), rng.choice((100, 180, 200)))]
        lines += [Word("", x, a, x + rng.choice((0, 0.5)), b) for a, b in steps]
    lines += [Word("", rng.choice((8, 8, 48)), i * 20.0, rng.choice((90, 208, 250)), i * 20.0 + rng.choice((0, 1, 3))) for i in range(rng.choice((0, 0, 4, 10)))]
    own += rng.choice(([], [], [], [Word("bad", 9, 0, 1, 1)], [Word(None, 5.0, 50.0, 9.0, 60.0)], [Word("none", None, 0, 1, 1)], [Word("-0", -0.0, 0, 5, 9)], [Word("far", 0, 0, math.inf, 9)]))
    return own, lines


def test_many_pages_at_once(spark, monkeypatch):
    """Pages go through the strategies together, as arrays; what comes out is what each gives alone."""
    rng = random.Random(4)
    pages = [odd_page(rng) for _ in range(300)]
    pages[0] = words(ROWS, 100.0, 1.0), [*rules(XS, [y - 99 for y in YS]), Word("", 158.0, 18.0, 158.0, 20.0)]
    df = spark.createDataFrame([r for i, p in enumerate(pages) for r in page(i, 1, *p)], ELEMENTS).repartition(2)
    place = lambda w: (w.top, w.x0, w.text is not None, w.text or "")
    expected, number = [], lambda v: math.nan if v is None else float(v)
    for i, (own, lines) in enumerate(pages):
        own, lines = ([Word(w.text, *map(number, w[1:])) for w in e] for e in (own, lines))
        expected += [(i, *r) for r in tl.by_strategies(sorted(own, key=place), lines)]
    show = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[2], r[3] or 0))
    alone = []
    monkeypatch.setattr(tl, "PIECE", 2000)
    got = show(tl.find_tables(df).collect())
    assert repr([(i, *r) for i, _, *r in got]) == repr(sorted(expected, key=lambda r: (r[0], r[1], r[2] or 0))) and len(got) > 400
    # pages without fault take no part in the page by page way
    monkeypatch.setattr(tl, "by_strategies", lambda *a: alone.append(a) or [])
    kind = pa.list_(pa.struct({"kind": pa.string(), "text": pa.string(), **{c: pa.float64() for c in tl.PLACES}}))
    good = pa.array([[{"kind": "word", **w._asdict()} for w in words(ROWS)] + [{"kind": "line", **w._asdict()} for w in rules(XS, YS)]] * 40, kind)
    ((at, _),) = tl._piece(good, good.offsets.to_numpy())
    assert not alone and sorted(set(at.tolist())) == list(range(40))


def test_captions_come_with_the_tables(spark):
    """A page's elements are gathered once: its caption lines are those of caption_lines, and no join brings them."""
    rng = random.Random(6)
    df = spark.createDataFrame([r for i in range(200) for r in page(i, 1, *odd_page(rng))], ELEMENTS)
    heights = df.select("doc_id", "page", (F.lit(100.0) + F.col("doc_id")).alias("height")).distinct()
    bare = tl.find_with_captions(df).where("strategy = 2 and failed is null")
    got = tl.captioned(bare, heights)
    plain = bare.select("doc_id", "page", "table_no", "top", "bottom")
    expected = near_caption(plain, tl.caption_lines(df), heights)
    show = lambda rows: sorted(tuple(r) for r in rows.select("doc_id", "page", "table_no").collect())
    assert show(got) == show(expected) and 10 < got.count() < bare.count()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
    assert tl.extract_tables(df, heights)._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1


def test_pages_that_are_rows_already(spark, data):
    """Pages laid out as rows aren't taken apart and gathered again; what comes out is that of their elements."""
    from quire.plans import textlayer_queries
    from quire.plans.registry import Tables

    pages = textlayer_queries.laid_out(Tables(spark, data), bad=True)
    whole = tl.find_in_pages(pages)
    elements = pages.select("doc_id", "page", F.inline("elements"))
    show = lambda df: sorted(map(repr, df.collect()))
    assert show(whole) == show(tl.find_with_captions(elements)) and "Generate" not in whole._jdf.queryExecution().optimizedPlan().toString()
