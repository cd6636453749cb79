import hashlib
from collections import Counter

import pytest

from quire import plans
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_agrees_with_sql(spark, data, duck, name):
    same(plans.QUERIES[name](spark, data), duck, plans.ORACLES[name])


def rows(spark, data, name):
    return plans.QUERIES[name](spark, data).collect()


def test_inferred_tables_by_document(spark, data):
    """Every page with at least six lines in three rows and two columns gives its table; the digests of it agree."""
    tables = rows(spark, data, "x50_infer_tables")
    assert Counter(r["doc_id"] for r in tables) == {r["doc_id"]: r["n"] for r in rows(spark, data, "u06_tables_of_all_pages")}
    assert Counter(r["doc_id"] for r in tables) == Counter(r["doc_id"] for r in rows(spark, data, "a13_column_anchors"))
    assert all(r["n_rows"] >= 2 and r["id"] == f"ocr-table-{r['page']}-1" for r in tables) and all(r["n_cols"] >= 2 for r in rows(spark, data, "a13_column_anchors"))
    # clean grids of four columns: a row for each line number
    grids = {r["doc_id"]: r["n_rows"] for r in rows(spark, data, "j11_row_clusters")}
    found = {r["doc_id"]: r["n_rows"] for r in tables}
    columns = {r["doc_id"]: r["n_cols"] for r in rows(spark, data, "a13_column_anchors")}
    assert grids and all(found[i] == n and columns[i] == 4 for i, n in grids.items())


def test_parsed_texts(spark, data):
    """A row for each document with lines; digests and lengths are those of the same texts."""
    parsed, shown, rag = (rows(spark, data, q) for q in ("p08_parse_payload", "x05_display_of_lines", "x06_rag_of_lines"))
    ids = sorted(r["doc_id"] for r in parsed)
    assert ids == sorted(r["doc_id"] for r in shown) == sorted(r["doc_id"] for r in rag) == sorted(r["doc_id"] for r in rows(spark, data, "p09_page_results"))
    empty = hashlib.md5(b"").hexdigest()
    for digest, lengths in (("display", shown), ("rag", rag)):
        n = {r["doc_id"]: r["n"] for r in lengths}
        assert all((r[digest] == empty) == (n[r["doc_id"]] == 0) for r in parsed)


def test_paragraphs(spark, data):
    """The first line stands alone; the others are joined until one ends a sentence."""
    got = {r["id"]: r["v"] for r in rows(spark, data, "x13_paragraphs")}
    assert got == {1: "标题\n第一行接着结束。\n新段继续：\n最后", 2: "", 3: "only", 4: "ab！\nc"}


def test_every_query_has_sql_or_a_test():
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"x13_paragraphs"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
