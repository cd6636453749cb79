"""Overlapping chunks of page and table texts, deduplicated, ready for an index."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import tables as tb
from quire.functions import text as tx

SIZE, OVERLAP = 900, 120
MARKS = ("\n\n", "。", "！", "？")


def check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("the chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the chunk size")


def split_at_marks(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most size characters that begin overlap characters before the last one's end; a piece ends behind the last
    paragraph or sentence mark in it if that lies beyond a third of the size."""
    text, out, at = text.strip(), [], 0
    while at < len(text):
        end = at + size
        if end >= len(text):
            out.append(text[at:])
            break
        mark = max(text.rfind(m, at, end) for m in MARKS) - at
        length = mark + 1 if mark > size // 3 else size
        out.append(text[at : at + length])
        steps = (at + length - overlap, end - overlap, at + 1)
        at = next(s for s in steps if s > at)
    return [p for p in map(str.strip, out) if p]


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """split_at_marks() of a text without marks, as an expression."""
    step = size - overlap

    def pieces(t: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.length(t) - size) / F.lit(step)).cast("int"))
        if overlap > step:
            return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(t, i * step + 1, F.lit(size)))
        # one pass cuts the text into steps; a piece is a step and the beginning of the next
        join = lambda steps: F.transform(F.slice(steps, F.lit(1), last + 1), lambda s, i: F.concat(s, F.substring(F.coalesce(F.get(steps, i + 1), F.lit("")), 1, overlap)))
        return tx.let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), join)

    return tx.let(tx.strip(text), lambda t: F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.filter(F.transform(pieces(t), tx.strip), lambda p: p != "")))


def split(df: DataFrame, column: str, size: int = SIZE, overlap: int = OVERLAP, name: str = "pieces") -> DataFrame:
    """df with the pieces of a text column. Texts without marks are cut in the JVM; only the others go to Python, as Arrow batches."""
    check(size, overlap)

    @F.pandas_udf("array<string>")
    def by_marks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_at_marks(t, size, overlap) if t else [])

    plain = ~F.coalesce(F.col(column).rlike(r"\n\n|[。！？]"), F.lit(False))
    return df.where(plain).withColumn(name, windows(F.col(column), size, overlap)).unionByName(df.where(~plain).withColumn(name, by_marks(column)))


# Fixed value: chunks that agree in so many characters are one.
PREFIX = 200


def first_by_prefix(chunks: DataFrame, order: str, *group: str) -> DataFrame:
    """Of the chunks of a group that begin with the same characters, the first in order."""
    same = Window.partitionBy(*group, F.substring("content", 1, PREFIX)).orderBy(order)
    return chunks.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def build_chunks(pages: DataFrame, tables: DataFrame | None = None, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of pages(doc_id, ord, page, page_no, clean_text_for_rag, raw_ocr_text, display_text, text) and tables(doc_id, ord, id,
    page, markdown, rows, title): doc_id, ord, content, source_type, page_no, chunk_index, table_id.

    A page gives its clean text; its raw text too if that differs by more than white space; its display text only if it has
    neither. Tables follow. Of chunks that agree in their first 200 characters a document keeps the first.
    """
    p = pages.select("doc_id", F.col("ord").alias("page_ord"), tx.page_number(F.col("page").cast("string"), F.col("page_no").cast("string")).alias("page_no"), tx.safe_text(F.col("clean_text_for_rag")).alias("clean"), tx.safe_text(F.col("raw_ocr_text")).alias("raw"), tx.strip(F.coalesce(F.when(F.col("display_text") != "", F.col("display_text")), F.col("text"), F.lit(""))).alias("display"))
    differs = (F.col("raw") != "") & ~tx.same_but_space(F.col("raw"), F.col("clean"))
    shown = ~differs & (F.col("clean") == "") & (F.col("display") != "")
    family = lambda rank, kind, head, t: F.struct(F.lit(rank).alias("family"), F.lit(kind).alias("source_type"), F.lit(head).alias("head"), t.alias("t"))
    families = F.array(family(0, "page_body", "正文/RAG链路程式化", F.col("clean")), family(1, "page_ocr", "OCR原始文本", F.when(differs, F.col("raw")).otherwise("")), family(2, "page_display", "展示文本", F.when(shown, F.col("display")).otherwise("")))
    texts = p.select("doc_id", "page_ord", "page_no", F.inline(families)).where("t <> ''")
    body = split(texts, "t", size, overlap).select("doc_id", "page_ord", "page_no", "family", "source_type", "head", F.posexplode("pieces").alias("chunk_index", "piece"))
    out = body.select("doc_id", F.struct(F.lit(0).alias("part"), F.col("page_ord").cast("long").alias("o"), "family", "chunk_index").alias("place"), F.concat(F.lit("【第"), F.col("page_no").cast("string"), F.lit("页·"), "head", F.lit("】\n"), "piece").alias("content"), "source_type", "page_no", "chunk_index", F.lit(None).cast("string").alias("table_id"))
    if tables is not None:
        t = tables.select("doc_id", "ord", F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page_no"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("tid"), tb.body_text(F.col("markdown"), F.col("rows")).alias("body"), tx.safe_text(F.col("title")).alias("title")).where("body is not null")
        head = F.concat(F.lit("【表格 "), F.when(F.col("tid") != "", F.col("tid")).otherwise("未命名"), F.lit(" · 第"), F.col("page_no").cast("string"), F.lit("页】"), F.when(F.col("title") != "", F.concat(F.lit(" "), "title")).otherwise(""))
        out = out.unionByName(t.select("doc_id", F.struct(F.lit(1).alias("part"), F.col("ord").cast("long").alias("o"), F.lit(0).alias("family"), F.lit(0).alias("chunk_index")).alias("place"), F.concat(head, F.lit("\n"), "body").alias("content"), F.lit("table").alias("source_type"), "page_no", F.lit(None).cast("int").alias("chunk_index"), F.when(F.col("tid") != "", F.col("tid")).alias("table_id")))
    kept = first_by_prefix(out, "place", "doc_id")
    return kept.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1).select("doc_id", "ord", "content", "source_type", "page_no", "chunk_index", "table_id")
