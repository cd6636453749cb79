"""Tables inferred for many pages at once against the functions on one page."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import tables as tb
from quire.operators import infer, layout

LINES = "doc_id int, page_no int, line_no int, text string, bbox array<array<double>>"


def page(rng, n):
    """Lines in crooked rows and columns; places from a coarse grid, so that some are equal."""
    out = []
    for i in range(n):
        x, y = float(rng.choice((0, 40, 75, 76.5, 160, 300)) + rng.randrange(20)), rng.randrange(rng.choice((3, 40))) * 17.25 + rng.random() * rng.choice((0, 9))
        out.append({"line_no": i, "text": f"t{i}", "x0": x, "x1": x + rng.randrange(1, 60), "y0": y, "y1": y + rng.choice((8, 14, 14.5, 30.0))})
    return out


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    return [page(rng, rng.choice((0, 1, 5, 6, 12, 40, 90))) for _ in range(400)]


def test_blocks_and_anchors_of_many_pages(pages):
    at = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    x0, y0, y1 = (np.array([x[c] for p in pages for x in p]) for c in ("x0", "y0", "y1"))
    cell, row, block, block_page, number = infer._block_cells(at, x0, y0, y1, len(pages))
    first = np.r_[0, np.cumsum([len(p) for p in pages])]
    got = {}
    for c, r, b in zip(cell.tolist(), row.tolist(), block.tolist(), strict=True):
        got.setdefault((int(block_page[b]), int(number[b])), {}).setdefault(r, []).append(c - first[block_page[b]])
    expected = {(i, k): [[x["line_no"] for x in r] for r in b] for i, p in enumerate(pages) for k, b in enumerate(x for x in infer.blocks(infer.cluster_rows(p)) if len(x) > 2)}
    assert {k: list(v.values()) for k, v in got.items()} == expected and len(expected) > 100
    for most in (2, infer.MOST_ANCHORS):
        values, of = infer._block_anchors(x0[cell], block, most)
        own = {}
        for v, b in zip(values.tolist(), of.tolist(), strict=True):
            own.setdefault((int(block_page[b]), int(number[b])), []).append(v)
        assert own == {(i, k): infer.anchors(b, most) for i, p in enumerate(pages) for k, b in enumerate(x for x in infer.blocks(infer.cluster_rows(p)) if len(x) > 2)}


def test_tables_of_many_pages(spark, pages, monkeypatch):
    monkeypatch.setattr(infer, "PIECE", 500)
    # pages with a place that is no finite number are worked on one by one
    every = pages + [[{**x, "x1": float("inf")} if x["line_no"] == 3 else x for x in p] for p in pages if infer.page_tables(p)]
    rows = [(i, 1, x["line_no"], x["text"], [[x["x0"], x["y0"]], [x["x1"], x["y0"]], [x["x1"], x["y1"]], [x["x0"], x["y1"]]]) for i, p in enumerate(every) for x in p]
    df = spark.createDataFrame(rows, LINES).repartition(3)
    got = sorted((r["doc_id"], r["id"], r["rows"]) for r in infer.infer_tables(df).collect())
    raw = spark.createDataFrame([(i, k, t) for i, p in enumerate(every) for k, t in enumerate(infer.page_tables(p))], "doc_id int, k int, rows array<array<string>>")
    good = raw.withColumn("rows", tb.normalise_rows(F.col("rows"))).where(tb.judge(tb.shape(F.col("rows")))).orderBy("doc_id", "k").collect()
    expected, seen = [], {}
    for r in good:
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
        expected.append((r["doc_id"], f"ocr-table-1-{seen[r['doc_id']]}", r["rows"]))
    assert got == sorted(expected) and max(seen) >= len(pages)
    anchors = {(r["doc_id"], r["block"]): r["anchors"] for r in infer.block_anchors(df).collect()}
    assert anchors == {(i, k): infer.anchors(b) for i, p in enumerate(every) for k, b in enumerate(x for x in infer.blocks(infer.cluster_rows(p)) if len(x) > 2)}
    assert infer.infer_tables(df.limit(0)).collect() == [] and infer.block_anchors(df.limit(0)).collect() == []


def test_rows_are_normalised_once(spark):
    """Rows are worked out once, not again for each statistic and for the filter."""
    df = spark.createDataFrame([(1, [["a", " b "], ["1", "2"], ["3", "4"]]), (2, [["a"]])], "id int, rows array<array<string>>")
    plan = tb.probable(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnotnull(lambda") == 1 and [r["rows"][0] for r in tb.probable(df).collect()] == [["a", "b"]]


def test_gaps_sort_their_centres_once(spark):
    df = spark.createDataFrame([(1, [5.0, 1.0, 2.0]), (2, [1.0]), (3, None), (4, [0.0, 3.0, 6.0])], "id int, c array<double>")
    got = df.select("id", layout.widest_gap(F.array_sort("c")).alias("g"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("array_sort") == 1
    assert {r["id"]: r["g"] and tuple(r["g"]) for r in got.collect()} == {1: (3.0, 1, 3.5), 2: None, 3: None, 4: (3.0, 0, 1.5)}


def test_boxes_of_four_points_and_more(spark):
    nan = float("nan")
    rows = [(1, [["1", "2"], ["5", None], ["x", "8"], ["3"]]), (2, [["1", "2"], ["5", "3"], ["9", "4"], ["0", "7"], ["-1", "1"]]), (3, [["1", "1"]] * 4), (4, [["1", "2"], ["3", "4"], None, ["2", "2"]]), (5, [["1", "2"], ["3", "4"], ["NaN", "3"], ["2", "2"]]), (6, [["1", "2"]] * 3)]
    df = spark.createDataFrame([(i, 1, 1, f" t{i}\t", b) for i, b in rows], "doc_id int, page_no int, line_no int, text string, bbox array<array<string>>")
    got = {r["doc_id"]: tuple(r)[3:] for r in infer.boxes(df).collect()}
    assert repr(got) == repr({1: ("t1", 1.0, 5.0, 2.0, 8.0), 2: ("t2", -1.0, 9.0, 1.0, 7.0), 4: ("t4", 1.0, 3.0, 2.0, 4.0), 5: ("t5", 1.0, nan, 2.0, 4.0)})


def test_a_title_splits_its_text_once(spark):
    from quire.functions import meta

    df = spark.createDataFrame([(1, " \n ab\nvol. 1 图书\n 图书馆数据研究 \n"), (2, "short\n" + "w " * 60), (3, "a\nb"), (4, None)], "id int, t string")
    got = df.select("id", meta.title(meta.text_lines(F.col("t"))).alias("v"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(t") == 1
    assert {r["id"]: r["v"] for r in got.collect()} == {1: "图书馆数据研究", 2: ("w " * 60).strip(), 3: "a", 4: None}


def test_stripped_is_strip(spark):
    from quire.functions import text as tx

    df = spark.createDataFrame([(x,) for x in ("", " ", "a", " a", "a　", " \n b c \x85", "x\ty", None, "\U0001F600 ")], "t string")
    assert all(r[0] == r[1] for r in df.select(tx.strip(F.col("t")), tx.stripped(F.col("t"))).collect())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_json_is_parsed_once(spark):
    from quire.operators import store

    df = spark.createDataFrame([(1, '{"rows":[["a","b,c"],[null,"d"]],"columns":["x"]}', None), (2, '[["p"],"q"]', "| z |")], "id int, j string, m string")
    assert _plan(df.select(store.view_rows(F.col("j")).alias("v"))).count("from_json") == 2  # the array, and in it the rows
    assert _plan(df.select(tb.to_csv(F.col("j"), F.col("m")).alias("v"))).count("from_json") == 3  # arrays, objects, names
    assert [r[0] for r in df.select(tb.to_csv(F.col("j"), F.col("m"))).collect()] == ['a,"b,c"\n,d\n', "z\n"]
    assert [r[0] for r in df.select(store.view_rows(F.col("j"))).collect()] == [None, [["p"]]]


def test_statistics_are_worked_out_once(spark, data):
    from quire import plans

    assert _plan(plans.QUERIES["a06_table_stats_documents"](spark, data)).count("filter(r#") == 1
