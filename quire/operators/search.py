"""Keyword search with snippets over documents and their pages, and hits in line boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx


def first_match(keyword: Column, *texts: Column) -> Column:
    """The first text that contains the keyword."""
    return F.coalesce(*(F.when(tx.contains_keyword(t, keyword), t) for t in texts))


def search(documents: DataFrame, pages: DataFrame, keyword: str, doc_id: int | None = None) -> DataFrame:
    """level (0 documents, 1 pages), doc_id, file_name, page, snippet.

    A document is hit once, by its display text or else its text for retrieval, with no page; a page once, by display,
    retrieval or OCR text; both may be hit by the same place. A blank keyword hits nothing. doc_id narrows the search.
    """
    kw = F.lit(keyword)
    docs = documents if doc_id is None else documents.where(F.col("id") == doc_id)
    hit = docs.withColumn("_t", first_match(kw, F.col("display_text"), F.col("clean_text_for_rag"))).where("_t is not null")
    top = hit.select(F.lit(0).alias("level"), F.col("id").alias("doc_id"), F.col("filename").alias("file_name"), F.lit(None).cast("int").alias("page"), tx.snippet(F.col("_t"), kw).alias("snippet"))
    own = pages if doc_id is None else pages.where(F.col("doc_id") == doc_id)
    matched = own.withColumn("_t", first_match(kw, F.col("display_text"), F.col("clean_text_for_rag"), F.col("ocr_text"))).where("_t is not null").select("doc_id", "page_no", "_t")
    inner = matched.join(docs.select(F.col("id").alias("doc_id"), "filename"), "doc_id")
    return top.unionAll(inner.select(F.lit(1).alias("level"), "doc_id", F.col("filename").alias("file_name"), F.col("page_no").cast("int").alias("page"), tx.snippet(F.col("_t"), kw).alias("snippet")))


def ordered(hits: DataFrame) -> DataFrame:
    """Document hits first, newest document first, then pages in order."""
    return hits.orderBy("level", F.desc("doc_id"), "page")


def box_hits(pages: DataFrame, keyword: str) -> DataFrame:
    """doc_id, page_no, n, text, box: lines of ocr_lines_json that contain the (trimmed) keyword, case by case, and have a box of four points.

    A box goes by box or bbox. JSON that can't be read has no lines.
    """
    k = keyword.strip()
    lines = F.from_json("ocr_lines_json", "array<struct<text:string,box:array<array<double>>,bbox:array<array<double>>>>")
    rows = pages.select("doc_id", "page_no", F.posexplode(lines).alias("n", "l")).select("doc_id", "page_no", "n", tx.safe_text(F.col("l.text")).alias("text"), F.coalesce("l.box", "l.bbox").alias("box"))
    return rows.where(F.lit(bool(k)) & F.contains("text", F.lit(k)) & (F.size("box") >= 4))


def neighbours(hits: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """hits with prev and next, in a circle within each group, and local, the place on the page from 0."""
    w = Window.partitionBy(*group).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i = F.row_number().over(w) - 1
    rows = hits.withColumn("hit", i)
    return rows.withColumns({"prev": F.coalesce(F.lag("hit").over(w), F.last("hit").over(whole)), "next": F.coalesce(F.lead("hit").over(w), F.first("hit").over(whole)), "local": F.row_number().over(Window.partitionBy(*group, "page_no").orderBy(*order)) - 1})


def filter_by_name(documents: DataFrame, part: str) -> DataFrame:
    """Documents whose file name has the (trimmed) part, whatever the case; newest first."""
    k = part.strip().lower()
    return documents.where(F.contains(F.lower(F.coalesce("filename", F.lit(""))), F.lit(k))).orderBy(F.desc("id"))
