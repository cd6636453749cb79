"""The relational store of documents, pages and tables: joins, views and index state as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import tables as tb
from quire.functions import text as tx
from quire.operators.ordering import numbered


#: Rows that are gathered by document in one task, about.
PART_ROWS = 1 << 18


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt by key to as many partitions as PART_ROWS asks for: what a task sorts and gathers doesn't grow with the table.

    Without it they are gathered once where they are read, too, and a few MB of Parquet may be millions of them.
    """
    return rows.repartition(1 + rows.count() // PART_ROWS, key)


def registry(listed: DataFrame, files: DataFrame) -> DataFrame:
    """doc_id and pos: listed(pos, doc_id) stripped, then folders that hold both index files, by name; each once, first place first.

    files has doc_id and file; a folder counts with index.faiss and meta.json.
    """
    own = listed.select(tx.strip(F.col("doc_id").cast("string")).alias("doc_id"), F.struct(F.lit(0).alias("kind"), F.col("pos").cast("long").alias("pos"), F.lit("").alias("name")).alias("at")).where("doc_id <> ''")
    both = files.where(F.col("file").isin("index.faiss", "meta.json")).groupBy("doc_id").agg(F.count_distinct("file").alias("n")).where("n = 2").select("doc_id", F.struct(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pos"), F.col("doc_id").alias("name")).alias("at"))
    first = own.unionAll(both).groupBy("doc_id").agg(F.min("at").alias("at"))
    return numbered(first, "at").select("doc_id", "pos")


def indexed(vector_doc_id: Column, in_registry: Column, available: Column) -> Column:
    """By the registry where it can be read, else by whether a vector id is stored."""
    return F.when(available, F.coalesce(in_registry, F.lit(False))).otherwise(vector_doc_id.isNotNull())


def mark_indexed(documents: DataFrame, registered: DataFrame) -> DataFrame:
    """documents(id, vector_doc_id, ...) with a missing vector_doc_id filled for registered ones."""
    ids = registered.select(F.col("doc_id").cast("string").alias("_reg")).distinct()
    joined = documents.join(ids, documents["id"].cast("string") == ids["_reg"], "left")
    return joined.withColumn("vector_doc_id", F.coalesce("vector_doc_id", F.when(F.col("_reg").isNotNull(), F.col("id")))).drop("_reg")


def searchable(documents: DataFrame, registered: DataFrame) -> DataFrame:
    """Documents of status 1 that are registered."""
    ids = registered.select(F.col("doc_id").cast("string").alias("_reg"))
    return documents.where("status = 1").join(ids, documents["id"].cast("string") == ids["_reg"], "left_semi")


def names(documents: DataFrame) -> DataFrame:
    """doc_id (as a string) and doc_name of documents that have an id and a name; of several of one id, the smallest name."""
    named = documents.where(F.col("id").isNotNull() & ~tx.is_blank(F.col("filename")))
    return named.groupBy(F.col("id").cast("string").alias("doc_id")).agg(F.min(tx.strip(F.col("filename"))).alias("doc_name"))


def with_names(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """hits (doc_id, ...) with doc_name: the document's name, else its id."""
    own = names(documents).withColumnRenamed("doc_id", "_id")
    return hits.join(own, hits["doc_id"].cast("string") == own["_id"], "left").withColumn("doc_name", F.coalesce("doc_name", F.col("doc_id").cast("string"))).drop("_id")


def with_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """documents with pages: their pages in order, as structs."""
    own = _dealt(pages, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "id", "ocr_text", "display_text", "clean_text_for_rag", "raw_ocr_text"))).alias("pages"))
    return documents.join(own, documents["id"] == own["doc_id"], "left").drop("doc_id").withColumn("pages", F.coalesce("pages", F.array().cast(own.schema["pages"].dataType)))


def with_tables(documents: DataFrame, tables: DataFrame) -> DataFrame:
    own = _dealt(tables, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "page_no", "table_json", "table_markdown"))).alias("tables"))
    return documents.join(own, documents["id"] == own["doc_id"], "left").drop("doc_id").withColumn("tables", F.coalesce("tables", F.array().cast(own.schema["tables"].dataType)))


def table_view(id_: Column, page_no: Column, json: Column, md: Column) -> Column:
    """struct<id, page, title, markdown, html, rows>: the JSON's id or else the row's; an array is rows alone, bad JSON has none."""
    own = F.when(json.rlike(r"^\s*\{"), F.get_json_object(json, "$.id"))
    field = lambda f: F.when(json.rlike(r"^\s*\{"), F.get_json_object(json, f"$.{f}"))
    rows = F.when(json.rlike(r"^\s*\["), json).otherwise(field("rows"))
    return F.struct(F.coalesce(own, id_.cast("string")).alias("id"), page_no.alias("page"), field("title").alias("title"), md.alias("markdown"), field("html").alias("html"), view_rows(rows).alias("rows"))


def view_rows(rows: Column) -> Column:
    """array<array<string>> of a JSON array; what isn't an array in it is left out, nested cells stay JSON; null if nothing is left."""
    each = F.from_json(rows, "array<string>")
    kept = F.transform(F.filter(each, lambda r: r.rlike(r"^\s*\[")), lambda r: F.from_json(r, "array<string>"))
    return tx.let(kept, lambda k: F.when(F.size(k) > 0, k))


def resolve_table(tables: DataFrame, wanted: str) -> DataFrame:
    """Of each document the first table whose id, or whose JSON's id, is wanted."""
    w = wanted.strip()
    match = (F.col("id").cast("string") == w) | (F.get_json_object("table_json", "$.id") == w)
    own = tables.where(F.lit(bool(w)) & F.coalesce(match, F.lit(False)))
    return own.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))).where("_n = 1").drop("_n")


PAGE_JSON = "array<struct<page:string,page_no:string,image_path:string,image_url:string,text:string,ocr_text:string,display_text:string,clean_text_for_rag:string,raw_ocr_text:string,lines:string,ocr_lines:string>>"
TABLE_JSON = "array<struct<id:string,page:string,page_no:string,title:string,markdown:string,table_markdown:string,html:string,rows:string>>"


def parse_pages(parsed: DataFrame, column: str = "pages_json") -> DataFrame:
    """doc_id and a row for each page of a parse result's JSON, by any of its names."""
    rows = parsed.select("doc_id", F.posexplode(F.from_json(column, PAGE_JSON)).alias("pos", "p")).where("p is not null").select("doc_id", "pos", "p.*")
    return rows.select("doc_id", "pos", F.coalesce(tx.to_integer(F.col("page")), tx.to_integer(F.col("page_no"))).alias("page_no"), "image_path", "image_url", F.when(tx.is_blank(F.col("text")), F.col("ocr_text")).otherwise(F.col("text")).alias("ocr_text"), "display_text", "clean_text_for_rag", "raw_ocr_text", F.coalesce("lines", "ocr_lines").alias("ocr_lines_json"))


def parse_tables(parsed: DataFrame, column: str = "tables_json") -> DataFrame:
    """doc_id and a row for each table of a parse result's JSON: page_no, table_markdown, table_json (id, title, html, rows; nulls stay)."""
    rows = parsed.select("doc_id", F.posexplode(F.from_json(column, TABLE_JSON)).alias("pos", "t")).where("t is not null").select("doc_id", "pos", "t.*")
    meta = F.concat(F.lit('{"id":'), *(x for f, end in (("id", ',"title":'), ("title", ',"html":'), ("html", ',"rows":')) for x in (json_string(F.col(f)), F.lit(end))), F.coalesce("rows", F.lit("null")), F.lit("}"))
    return rows.select("doc_id", "pos", F.coalesce(tx.to_integer(F.col("page")), tx.to_integer(F.col("page_no"))).alias("page_no"), tx.first_non_blank(F.col("markdown"), F.col("table_markdown")).alias("table_markdown"), meta.alias("table_json"))


def json_string(c: Column) -> Column:
    """A string as JSON, null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def document_row(parsed: DataFrame) -> DataFrame:
    """The document's row of a parse result: doc_id, raw_ocr_text, display_text, clean_text_for_rag, ocr_text, table_extract_status,
    pages_json, tables_json and table_json (the tables under one key).

    parsed: doc_id, raw_ocr_text, ocr_text, display_text, text, clean_text_for_rag, table_extract_status, and pages and tables
    (arrays of structs; null ones give no JSON). Texts that are blank count as missing and give way to the next name.
    """
    c = {n: F.col(n) for n in parsed.columns}
    display = tx.first_non_blank(c["display_text"], c["text"])
    # nulls stand in the JSON as they do in the result
    as_json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    return parsed.select(
        "doc_id",
        tx.first_non_blank(c["raw_ocr_text"], c["ocr_text"]).alias("raw_ocr_text"),
        display.alias("display_text"),
        tx.first_non_blank(c["clean_text_for_rag"]).alias("clean_text_for_rag"),
        F.coalesce(display, legacy_text(F.lit(None).cast("string"), c["text"], c["ocr_text"], c["pages"])).alias("ocr_text"),
        tx.first_non_blank(c["table_extract_status"]).alias("table_extract_status"),
        as_json(c["pages"]).alias("pages_json"),
        as_json(c["tables"]).alias("tables_json"),
        F.when(c["tables"].isNotNull(), as_json(F.struct(c["tables"].alias("tables")))).alias("table_json"),
    )


def index_state(chunks: Column, fallback: Column, error: Column) -> Column:
    """struct<status, indexed>: 1 with chunks of the engine, or of the second attempt, and no error; else 2."""
    own = F.when(chunks > 0, chunks).otherwise(fallback)
    failed = ~tx.is_blank(error) & ~(F.coalesce(chunks <= 0, F.lit(True)) & F.coalesce(fallback > 0, F.lit(False)))
    ok = F.coalesce(own > 0, F.lit(False)) & ~failed
    return F.struct(F.when(ok, 1).otherwise(2).alias("status"), ok.alias("indexed"))


def legacy_text(display: Column, text: Column, ocr_text: Column, pages: Column) -> Column:
    """One text of a parse result: display text, text, OCR text, or its pages' texts with a line break behind each."""
    page = F.filter(F.transform(pages, lambda p: tx.first_non_blank(p["text"], p["ocr_text"])), lambda t: t.isNotNull())
    return F.coalesce(tx.first_non_blank(display, text, ocr_text), F.trim(F.array_join(page, "\n")), F.lit(""))


def extract_status(n_tables: Column, source: Column, has_pdf: Column, library: Column) -> Column:
    return F.when(n_tables > 0, "extracted").when(source == "image", "no_table_found").when(~has_pdf, "no_table_found").when(~library, "library_unavailable").otherwise("no_table_found")


def empty_table_text(status: Column, vector_doc_id: Column) -> Column:
    none = F.when(vector_doc_id.isNotNull() & (vector_doc_id != 0), "向量已入库；当前文档未识别到可提取表格，因此没有 CSV 可下载").otherwise("未识别到可提取表格")
    return F.when(status == "not_applicable", "当前文档类型不适用表格提取").when(status == "library_unavailable", "表格提取依赖未安装").when(status == "no_table_found", none).otherwise("暂无结构化表格结果")


def status_label(status: Column, indexed_: Column) -> Column:
    return F.when(status == 1, F.when(indexed_, "已入库").otherwise("已解析")).when(status == 0, "处理中").otherwise("失败")


def csv_export(doc_id: Column, table_id: Column, json: Column, md: Column) -> Column:
    """struct<name, body>: a file name without what file systems forbid, and the CSV behind a byte order mark."""
    name = tx.safe_filename(F.concat(F.lit("doc-"), doc_id.cast("string"), F.lit("-table-"), table_id, F.lit(".csv")))
    return F.struct(name.alias("name"), F.concat(F.lit("﻿"), tb.to_csv(json, md)).alias("body"))
