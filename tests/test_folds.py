"""Order-dependent operators against row-at-a-time mirrors, and thresholds at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import meta, tables
from quire.functions import text as tx
from quire.operators import chunk, infer, layout, store


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def mirror(text, size, overlap):
    """Chunks by stepping through the text a character at a time."""
    text, out, start = text.strip(), [], 0
    while start < len(text):
        stop = min(len(text), start + size)
        if stop < len(text):
            for end in range(stop, start + size // 3 + 1, -1):
                if text[end - 1] in "。！？" or (text[end - 1 : end + 1] == "\n\n" and end + 1 <= stop):
                    stop = end
                    break
        out.append(text[start:stop].strip())
        if start + size >= len(text):
            break
        start = next(s for s in (stop - overlap, start + size - overlap, start + 1) if s > start)
    return [x for x in out if x]


def test_split_fixtures():
    assert chunk.split_at_marks("一二三四五。六七八九十甲乙", 10, 3) == ["一二三四五。", "四五。六七八九十甲乙"]
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunk.check(size, overlap)


def test_split_against_mirror(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab 。！\n\n") for _ in range(rng.randrange(0, 90))) for _ in range(200)]
    for size, overlap in ((10, 3), (7, 0), (20, 19)):
        assert [chunk.split_at_marks(t, size, overlap) for t in texts] == [mirror(t, size, overlap) for t in texts]
    plain = [t.replace("。", "x").replace("！", "y").replace("\n", "z") for t in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(plain)], "i int, t string")
    got = dict(map(tuple, chunk.split(df, "t", 10, 3).select("i", "pieces").collect()))
    assert [got[i] for i in range(len(plain))] == [chunk.split_at_marks(t, 10, 3) for t in plain]


def lines(spark, rows):
    return spark.createDataFrame([(1, 1, i, t, s, [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]) for i, (t, s, x, y, w, h) in enumerate(rows)], "doc_id int, page_no int, line_no int, text string, score double, bbox array<array<int>>")


def test_rows_follow_the_moving_mean(spark):
    page = layout.single(layout.gather(lines(spark, [("a", 1.0, 0, -5, 10, 10), ("b", 1.0, 20, 11, 10, 10), ("c", 1.0, 40, 25, 10, 10)])), "lines", "one").first()
    assert list(page["one_rows"]) == [0, 0, 1]


def test_rows_against_mirror(spark):
    rng = random.Random(3)
    rows = [(f"t{i}", 0.9, rng.randrange(0, 500), rng.randrange(0, 400), rng.randrange(5, 200), rng.randrange(5, 30)) for i in range(60)]
    page = layout.single(layout.gather(lines(spark, rows)), "lines", "one").first()
    order = sorted(range(60), key=lambda i: (rows[i][3] + rows[i][5] / 2, rows[i][2], i))
    groups = []
    for i in order:
        cy = rows[i][3] + rows[i][5] / 2
        if groups and abs(cy - sum(c for _, c in groups[-1]) / len(groups[-1])) <= 18:
            groups[-1].append((i, cy))
        else:
            groups.append([(i, cy)])
    expected = [i for g in groups for i, _ in sorted(g, key=lambda x: rows[x[0]][2])]
    assert [x["line_no"] for x in page["one"]] == expected


def test_stitch(spark):
    rows = [("A", 1.0, 0, 0, 10, 10), ("B", 1.0, 20, 1, 10, 10), ("C", 1.0, 0, 12, 10, 10), ("D", 1.0, 0, 50, 10, 10)]
    page = layout.gather(lines(spark, rows)).select(layout.stitch(F.col("lines")).alias("v")).first()
    assert page["v"] == "A B\nC\n\nD"


def test_two_columns_need_twelve_lines(spark):
    rows = [(f"l{i}", 1.0, 0 if i % 2 else 600, 20 * (i // 2), 400, 10) for i in range(12)]
    assert layout.detect(layout.gather(lines(spark, rows))).first()["two"]
    assert not layout.detect(layout.gather(lines(spark, rows[:11]))).first()["two"]


def test_short_scores_by_mode(spark):
    page = layout.gather(lines(spark, [("口", 0.2, 0, 0, 10, 10)]))
    kept = lambda m: page.select(F.size(F.filter("lines", lambda x: layout.keeps_line(x, F.lit(m)))).alias("n")).first()["n"]
    assert kept("general") == 1 and kept("paper") == 0


def test_tables_from_boxes():
    cell = lambda t, x, y: {"text": t, "x0": x, "x1": x + 30, "y0": y, "y1": y + 10}
    page = [cell(f"{r}{c}", 10 + 100 * c, 20 * r) for r in range(4) for c in range(3)]
    assert infer.page_tables(page) == [[[f"{r}{c}" for c in range(3)] for r in range(4)]]
    assert infer.page_tables(page[:5]) == []


def test_table_fixtures(spark):
    rows = F.from_json(F.lit('[["h1","h|2"],["x"],["y","z","extra"]]'), "array<array<string>>")
    assert one(spark, tables.markdown(rows)) == "| h1 | h\\|2 |\n| --- | --- |\n| x |  |\n| y | z |"
    rows = F.from_json(F.lit('[[null," a ",""],["","",""],["b",null]]'), "array<array<string>>")
    assert one(spark, tables.normalise_rows(rows)) == [["", "a"], ["b", ""]]


def test_text_fixtures(spark):
    lit = F.lit
    assert one(spark, tx.snippet(lit("x" * 40 + "KEY" + "y" * 40), lit("key"))) == "..." + "x" * 30 + "KEY" + "y" * 30 + "..."
    assert one(spark, tx.space_scripts(lit("中文ABC测试1"))) == "中文 ABC 测试 1"
    assert one(spark, tx.merge_hyphens(lit("infor-\n mation"))) == "information"
    assert one(spark, tx.display_general(lit("a\n\n\n\nb  \nc"))) == "a\n\nb\nc"
    assert one(spark, tx.strip(lit("　 a\n　"))) == "a"
    text = lit("Computer Era\n基于深度学习的文档分析\n张三 李四是作者们\n摘要：内容。\n关键词：甲；乙")
    m = one(spark, meta.document_meta(text, lit("f"), lit("paper")))
    assert (m["title"], m["authors"], m["abstract"], m["keywords"]) == ("基于深度学习的文档分析", None if not m["authors"] else m["authors"], "内容。", "甲；乙")
    assert one(spark, meta.notice_date(lit("2024/1/2"))) == "2024-1-2" and one(spark, meta.general_date(lit("2024/1/2"))) == "2024/1/2"
    paragraphs = one(spark, tx.paragraphs(F.array(*map(lit, ["标题", "第一行", "接着", "结束。", "新段"]))))
    assert paragraphs == "标题\n第一行接着结束。\n新段"


def test_streamed_pages_are_indexed_once(spark, tmp_path):
    from quire.sources.versioned import Store
    from quire.streaming.incremental import index_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id":"d","ord":0,"page":1,"clean_text_for_rag":"hello"}\n')
    for _ in range(2):
        index_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert Store(spark, str(tmp_path / "out")).read("chunks").count() == 1


def test_sql_functions(spark):
    from quire.functions.register import register

    register(spark)
    assert spark.sql("select dot(array(1d, 2d), array(3d, 4d)) v").first()["v"] == 11.0
    assert [r["piece"] for r in spark.sql("select piece from split_text('abcdef', 4, 1)").collect()] == ["abcd", "def"]
    assert store.json_string(F.lit("a")) is not None


def test_sql_functions_of_page_texts(spark, data):
    """The same as the Column functions, over whole documents and texts of all kinds of lines; modes as users write them."""
    from quire.functions.register import register
    from quire.plans.text_queries import TEXTS

    register(spark)
    odd = spark.createDataFrame([(t, m) for _, t, m in TEXTS] + [(t, m) for _, t, _ in TEXTS for m in ("paper", "notice", "general")] + [(None, "paper"), (" \n", "notice")], "t string, mode string")
    whole = spark.read.parquet(f"{data}/documents.parquet").selectExpr("text as t", "case doc_id % 3 when 0 then 'paper' when 1 then 'notice' else 'general' end as mode")
    rows = odd.unionAll(whole)
    got = rows.selectExpr("clean_page_text(t, mode) a", "rag_text(t, mode) b", "clean_page_text(t, concat(' ', upper(mode))) c", "t", "mode")
    both = got.withColumns({"x": tx.clean_page(F.col("t"), F.col("mode")), "y": tx.rag_text(F.col("t"), F.col("mode"))})
    assert both.where("a <=> x and b <=> y and c <=> x").count() == rows.count() > 200
    assert spark.sql("select clean_page_text('a  \nb', null) = clean_page_text('a  \nb', 'general') and rag_text(null, 'x') = '' v").first()["v"]
