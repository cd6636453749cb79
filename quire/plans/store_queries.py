"""Queries of the store, search, chunks and retrieval over the driver's tables.

documents stand for one-page documents, conversations for documents of several pages (turn is the page), embeddings for the
index (label is the document), labels for the registry (quality 1 is indexed).
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import text as tx
from quire.operators import chunk, retrieve, search, store
from quire.operators.ordering import numbered
from quire.plans.registry import Fixture, query, same_over, scalar
from quire.sources import files
from quire.sources.settings import Settings

KEYWORD = "tion"
D = "docs as (select doc_id id, source || '-' || doc_id || case when lang = 'en' then '.pdf' else '.png' end filename, case when doc_id % 2 = 0 then text end display_text, 'RAG ' || text clean_text_for_rag, case when doc_id % 7 = 0 then doc_id end vector_doc_id, (doc_id % 3)::integer status from documents)"
G = "pages as (select conv_id doc_id, turn::integer page_no, case when turn % 2 = 0 then text end display_text, case when turn % 3 = 0 then 'RAG ' || text end clean_text_for_rag, text ocr_text from conversations)"
REG = "reg as (select distinct doc_id from labels where quality = 1)"


def docs(t):
    d = t.documents
    return d.select(F.col("doc_id").alias("id"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "en", ".pdf").otherwise(".png")).alias("filename"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("display_text"), F.concat(F.lit("RAG "), "text").alias("clean_text_for_rag"), F.when(F.col("doc_id") % 7 == 0, F.col("doc_id")).alias("vector_doc_id"), (F.col("doc_id") % 3).cast("int").alias("status"))


def pages(t):
    c = t.conversations
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_no"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("display_text"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("RAG "), "text")).alias("clean_text_for_rag"), F.col("text").alias("ocr_text"))


reg = lambda t: t.labels.where("quality = 1").select("doc_id").distinct()

# keyword search


def _snippet(x: str) -> str:
    p = f"(instr(lower({x}), '{KEYWORD}') - 1)"
    n = len(KEYWORD)
    return f"case when {p} > 30 then '...' else '' end || substring({x}, greatest(0, {p} - 30) + 1, least(length({x}), {p} + {n + 30}) - greatest(0, {p} - 30)) || case when {p} + {n + 30} < length({x}) then '...' else '' end"


HAS = lambda x: f"contains(lower({x}), '{KEYWORD}')"
LEVEL0 = f"select 0 as level, id as doc_id, filename as file_name, null::integer as page, {_snippet('t')} as snippet from (select *, case when {HAS('display_text')} then display_text when {HAS('clean_text_for_rag')} then clean_text_for_rag end t from docs) where t is not null"
LEVEL1 = f"select 1 as level, g.doc_id, d.filename as file_name, page_no as page, {_snippet('t')} as snippet from (select *, case when {HAS('display_text')} then display_text when {HAS('clean_text_for_rag')} then clean_text_for_rag when {HAS('ocr_text')} then ocr_text end t from pages) g join docs d on d.id = g.doc_id where t is not null"
query("j08_keyword_search", f"select doc_id, source, {_snippet('text')} as snippet from documents where {HAS('text')}")(lambda t: t.documents.where(tx.contains_keyword(F.col("text"), F.lit(KEYWORD))).select("doc_id", "source", tx.snippet(F.col("text"), F.lit(KEYWORD)).alias("snippet")))
query("u04_search_union", f"with {D}, {G} {LEVEL0} union all {LEVEL1}")(lambda t: search.search(docs(t), pages(t), KEYWORD))
query("o16_search_order", f"with {D}, {G}, h as ({LEVEL0} union all {LEVEL1}) select row_number() over (order by level, doc_id desc, page) as n, level, doc_id, page from h")(lambda t: numbered(search.search(docs(t), pages(t), KEYWORD), "level", F.desc("doc_id"), "page").select((F.col("pos") + 1).alias("n"), "level", "doc_id", "page"))
query("f29_search_scope", f"with {D}, {G} select * from ({LEVEL0} union all {LEVEL1}) where doc_id = 4")(lambda t: search.search(docs(t), pages(t), KEYWORD, doc_id=4))
query("f24_name_filter", f"with {D} select id, filename from docs where contains(lower(filename), 'src1-')")(lambda t: search.filter_by_name(docs(t), " SRC1- ").select("id", "filename"))
query("a18_hit_counts", f"select doc_id, (length(text) - length(replace(text, '{KEYWORD}', ''))) // {len(KEYWORD)} as n from documents")(lambda t: t.documents.select("doc_id", F.regexp_count("text", F.lit(KEYWORD)).cast("long").alias("n")))
OCR = Fixture("doc_id int, page_no int, ocr_lines_json string", [(1, 1, '[{"text":" Key one ","box":[[0,0],[4,0],[4,2],[0,2]]},{"text":"key","box":[[0,0],[1,1],[1,1],[1,1]]},{"text":"Key two","bbox":[[1,1],[2,1],[2,2],[1,2]]},{"text":"Key three","box":[[1,1]]}]'), (1, 2, "not json"), (2, 1, None), (1, 3, '[{"text":"last Key","box":[[5,5],[9,5],[9,8],[5,8]]}]')])
query("f28_box_hits", "select * from (values (1, 1, 0, 'Key one'), (1, 1, 2, 'Key two'), (1, 3, 0, 'last Key')) x(doc_id, page_no, n, text)")(lambda t: search.box_hits(OCR.df(t), " Key ").select("doc_id", "page_no", "n", "text"))
query("x31_defensive_lines", "select * from (values (1, 1, 4), (1, 2, 0), (2, 1, 0), (1, 3, 1)) x(doc_id, page_no, n)")(lambda t: OCR.df(t).select("doc_id", "page_no", F.coalesce(F.size(F.filter(F.from_json("ocr_lines_json", "array<struct<text:string>>"), lambda x: x.isNotNull())), F.lit(0)).alias("n")).withColumn("n", F.greatest("n", F.lit(0))))
query("w11_circular_hits", "select * from (values (1, 1, 0, 0, 2, 1, 0), (1, 1, 2, 1, 0, 2, 1), (1, 3, 0, 2, 1, 0, 0)) x(doc_id, page_no, n, hit, prev, next, local)")(lambda t: search.neighbours(search.box_hits(OCR.df(t), "Key"), ["page_no", "n"], ["doc_id"]).select("doc_id", "page_no", "n", "hit", "prev", "next", "local"))
query("j12_local_index", "select * from (values (1, 1, 0, 0), (1, 1, 2, 1), (1, 3, 0, 0)) x(doc_id, page_no, n, local)")(lambda t: search.neighbours(search.box_hits(OCR.df(t), "Key"), ["page_no", "n"], ["doc_id"]).select("doc_id", "page_no", "n", "local"))

# store
query("f01_by_key", "select doc_id, lang, source from documents where doc_id = 17")(lambda t: t.documents.where("doc_id = 17").select("doc_id", "lang", "source"))
query("f02_by_page", "select conv_id, turn, role from conversations where conv_id = 3 and turn = 1")(lambda t: t.conversations.where("conv_id = 3 and turn = 1").select("conv_id", "turn", "role"))
query("f16_searchable", f"with {D}, {REG} select id from docs where status = 1 and id in (select doc_id from reg)")(lambda t: store.searchable(docs(t), reg(t)).select("id"))
query("j04_searchable_docs", f"with {D}, {REG} select id, filename from docs where status = 1 and exists (select 1 from reg where reg.doc_id = id)")(lambda t: store.searchable(docs(t), reg(t)).select("id", "filename"))
query("j03_mark_indexed", f"with {D}, {REG} select id, coalesce(vector_doc_id, reg.doc_id) as vector_doc_id from docs left join reg on reg.doc_id = id")(lambda t: store.mark_indexed(docs(t), reg(t)).select("id", "vector_doc_id"))
query("f17_indexed_predicate", f"with {D}, {REG} select id, case when id % 5 <> 0 then reg.doc_id is not null else vector_doc_id is not null end as v from docs left join reg on reg.doc_id = id")(lambda t: docs(t).join(reg(t).withColumn("r", F.lit(True)), F.col("id") == F.col("doc_id"), "left").select("id", store.indexed(F.col("vector_doc_id"), F.col("r"), F.col("id") % 5 != 0).alias("v")))
query("s15_registry_ids", f"with {REG} select doc_id from reg")(lambda t: reg(t))
query("s16_registry_or_unknown", "select doc_id, quality = 1 as indexed from labels where quality is not null")(lambda t: t.labels.where("quality is not null").select("doc_id", (F.col("quality") == 1).alias("indexed")))
DETAIL = "select id, n_pages, h from (select id, count(page_no) n_pages, md5(coalesce(string_agg(page_no || ':' || ocr_text, '|' order by page_no, ocr_text), '')) h from docs left join pages on pages.doc_id = id group by id)"
detail = lambda t: store.with_pages(docs(t), pages(t).withColumns({"id": F.lit(None).cast("long"), "raw_ocr_text": F.col("ocr_text")}))
query("j01_doc_detail", f"with {D}, {G} {DETAIL}")(lambda t: detail(t).select("id", F.size("pages").cast("long").alias("n_pages"), F.md5(F.array_join(F.transform("pages", lambda p: F.concat(p["page_no"].cast("string"), F.lit(":"), p["ocr_text"])), "|")).alias("h")))
query("p03_document_view", f"with {D}, {G} select id, filename as file_name, status, count(page_no) as n_pages from docs left join pages on pages.doc_id = id group by all")(lambda t: detail(t).select("id", F.col("filename").alias("file_name"), "status", F.size("pages").cast("long").alias("n_pages")))
query("p04_page_view", f"with {G} select doc_id, page_no as page, md5(ocr_text) as text_md5, display_text is null as no_display from pages")(lambda t: pages(t).select("doc_id", F.col("page_no").alias("page"), F.md5("ocr_text").alias("text_md5"), F.col("display_text").isNull().alias("no_display")))
ORDERS = "select o_orderkey doc_id, l_linenumber id, l_partkey page_no, '{\"id\":\"t-' || l_linenumber || '\",\"rows\":[[\"' || l_partkey || '\",' || l_linenumber || '],5,[[1],null]]}' table_json from orders join lineitem on l_orderkey = o_orderkey"
tables = lambda t: t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("doc_id"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("page_no"), F.concat(F.lit('{"id":"t-'), F.col("l_linenumber").cast("string"), F.lit('","rows":[["'), F.col("l_partkey").cast("string"), F.lit('",'), F.col("l_linenumber").cast("string"), F.lit("],5,[[1],null]]}")).alias("table_json"), F.lit(None).cast("string").alias("table_markdown"))
query("j02_doc_tables", "select o_orderkey as id, count(l_linenumber) as n from orders left join lineitem on l_orderkey = o_orderkey group by 1")(lambda t: store.with_tables(t.orders.select(F.col("o_orderkey").alias("id")), tables(t)).select("id", F.size("tables").cast("long").alias("n")))
query("j06_tables_of_page", "select l_orderkey as doc_id, l_linenumber as page, count(*) as n from lineitem group by 1, 2")(lambda t: tables(t).groupBy("doc_id", F.col("id").alias("page")).agg(F.size(F.collect_list("table_json")).cast("long").alias("n")))
query("p05_table_view", f"select doc_id, page_no, 't-' || id as id, page_no || ' ' || id || '|[1] ' as rows from ({ORDERS})")(lambda t: tables(t).select("doc_id", "page_no", store.table_view(F.col("id"), F.col("page_no"), F.col("table_json"), F.col("table_markdown")).alias("v")).select("doc_id", "page_no", "v.id", F.array_join(F.transform("v.rows", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(F.when(c != "null", c), F.lit(""))), " ")), "|").alias("rows")))
VIEW = Fixture("id int, j string", [(1, '[["a",1],"x",[true]]'), (2, "{}"), (3, '{"rows":[]}'), (4, '{"rows":[[{"k":1}]]}'), (5, None)])
scalar("p06_rows_node", VIEW, "select id, case id when 1 then 'a 1|true' when 4 then '{\"k\":1}' end as v from {t}", v=lambda id, j: F.array_join(F.transform(store.view_rows(F.coalesce(F.get_json_object(j, "$.rows"), F.when(j.startswith("["), j))), lambda r: F.array_join(r, " ")), "|"))
query("f03_resolve_table", "select l_orderkey as doc_id, 2 as id from lineitem where l_linenumber = 2 group by 1")(lambda t: store.resolve_table(tables(t).dropDuplicates(["doc_id", "id"]), " t-2 ").select("doc_id", "id"))
query("x29_json_field", "select event_id, json_extract_string(props, '$.k') as k from events")(lambda t: t.events.select("event_id", F.get_json_object("props", "$.k").alias("k")))
query("o01_newest_first", "select row_number() over (order by doc_id desc) as n, doc_id from documents")(lambda t: t.documents.select(F.row_number().over(Window.orderBy(F.desc("doc_id"))).cast("long").alias("n"), "doc_id"))
query("o02_pages_in_order", "select conv_id, row_number() over (partition by conv_id order by turn) as n, turn from conversations")(lambda t: t.conversations.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("n"), "turn"))
query("o03_tables_in_order", "select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as n, l_linenumber from lineitem")(lambda t: t.lineitem.select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long").alias("n"), "l_linenumber"))
query("p14_table_list", "select l_orderkey as doc_id, l_linenumber as id, l_partkey as page_no from lineitem")(lambda t: tables(t).select("doc_id", "id", "page_no"))
query("p15_page_text", "select d.doc_id, coalesce(text_, '') as text from documents d left join (select conv_id, max(text) text_ from conversations where turn = 0 group by 1) c on c.conv_id = d.doc_id")(lambda t: t.documents.select("doc_id").join(t.conversations.where("turn = 0").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("text").alias("x")), "doc_id", "left").select("doc_id", F.coalesce("x", F.lit("")).alias("text")))
query("p22_first_document", "select max(doc_id) as doc_id from documents")(lambda t: t.documents.orderBy(F.desc("doc_id")).limit(1).select("doc_id"))
query("a17_name_map", f"with {D} select id::varchar doc_id, filename doc_name from docs where trim(filename) <> ''")(lambda t: store.names(docs(t)))
query("a17_named_hits", f"with {D} select conv_id doc_id, turn, coalesce(d.filename, conv_id::varchar) doc_name from conversations c left join docs d on d.id = c.conv_id and d.id % 3 <> 0")(lambda t: store.with_names(t.conversations.select(F.col("conv_id").alias("doc_id"), "turn"), docs(t).where("id % 3 <> 0")))
query("w10_page_numbers", "select conv_id, turn, row_number() over (partition by conv_id order by turn) as page from conversations")(lambda t: files.number_pages(t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list("turn")).alias("images"))).select(F.col("doc_id").alias("conv_id"), F.col("image").alias("turn"), F.col("page").cast("long").alias("page")))
query("w09_table_numbers", "select l_orderkey, l_partkey, l_linenumber, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey, l_quantity) as seq from lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long").alias("seq")))
query("w04_gap_blocks", "with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 1 hour then 1 else 0 end b from events) select event_id, sum(b) over (partition by user_id order by ts, event_id)::bigint as block from g")(
    lambda t: t.events.withColumn("b", F.coalesce((F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")) > F.expr("interval 1 hour")).cast("int"), F.lit(0))).select("event_id", F.sum("b").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("block"))
)
STATES = Fixture("id int, chunks int, fallback int, err string", [(1, 3, None, None), (2, 0, 5, None), (3, None, None, None), (4, 3, None, "boom"), (5, 0, 0, "boom"), (6, None, 2, "boom"), (7, 3, None, " ")])
scalar("k08_index_state", STATES, "select id, case when id in (1, 2, 6, 7) then 1 else 2 end as status, id in (1, 2, 6, 7) as indexed from {t}", status=lambda id, c, f, e: store.index_state(c, f, e)["status"], indexed=lambda id, c, f, e: store.index_state(c, f, e)["indexed"])
STATUS = Fixture("id int, n int, source string, pdf boolean, lib boolean", [(1, 2, "pdf", True, True), (2, 0, "image", False, True), (3, 0, "pdf", True, False), (4, 0, "pdf", True, True), (5, 0, "pdf", False, False)], same_over("documents", "doc_id as id", "cast(doc_id % 3 as int) as n", "case when doc_id % 2 = 0 then 'image' else 'pdf' end as source", "lang = 'en' as pdf", "doc_id % 5 <> 0 as lib"))
scalar("a20_extract_status", STATUS, "select id, case when n > 0 then 'extracted' when source = 'image' or not pdf then 'no_table_found' when not lib then 'library_unavailable' else 'no_table_found' end as v from {t}", v=lambda id, n, s, p, l: store.extract_status(n, s, p, l))
LABELS = Fixture("id int, s string, v int, st int", [(1, "not_applicable", None, 1), (2, "library_unavailable", 3, 0), (3, "no_table_found", 3, 2), (4, "no_table_found", None, 1), (5, None, None, None)], same_over("documents", "doc_id as id", "case doc_id % 5 when 0 then 'not_applicable' when 1 then 'library_unavailable' when 2 then 'no_table_found' when 3 then lang end as s", "case when doc_id % 7 < 3 then cast(doc_id + 1 as int) end as v", "case when doc_id % 4 < 3 then cast(doc_id % 4 as int) end as st"))
scalar("p18_empty_tables", LABELS, "select id, case s when 'not_applicable' then '当前文档类型不适用表格提取' when 'library_unavailable' then '表格提取依赖未安装' when 'no_table_found' then case when v is not null then '向量已入库；当前文档未识别到可提取表格，因此没有 CSV 可下载' else '未识别到可提取表格' end else '暂无结构化表格结果' end as t from {t}", t=lambda id, s, v, st: store.empty_table_text(s, v))
scalar("p21_status_label", LABELS, "select id, case when st = 1 then case when v is not null then '已入库' else '已解析' end when st = 0 then '处理中' else '失败' end as t from {t}", t=lambda id, s, v, st: store.status_label(st, v.isNotNull()))
scalar("p19_current_document", LABELS, "select id, coalesce(st, 1) as status from {t}", status=lambda id, s, v, st: F.coalesce(st, F.lit(1)))
query("p13_text_views", f"with {G} select doc_id, page_no, md5(coalesce(nullif(display_text, ''), nullif(ocr_text, ''), '')) as shown, md5(coalesce(clean_text_for_rag, '')) as rag from pages")(lambda t: pages(t).select("doc_id", "page_no", F.md5(F.coalesce(F.nullif("display_text", F.lit("")), F.nullif("ocr_text", F.lit("")), F.lit(""))).alias("shown"), F.md5(F.coalesce("clean_text_for_rag", F.lit(""))).alias("rag")))
query("p20_page_accessors", f"with {G} select doc_id, page_no, length(coalesce(display_text, ocr_text, '')) as shown, length(coalesce(clean_text_for_rag, '')) as rag from pages")(lambda t: pages(t).select("doc_id", "page_no", F.length(F.coalesce("display_text", "ocr_text", F.lit(""))).cast("long").alias("shown"), F.length(F.coalesce("clean_text_for_rag", F.lit(""))).cast("long").alias("rag")))
PARSED = Fixture("doc_id int, pages_json string, tables_json string", [(1, '[{"page":1,"text":"a","lines":[{"t":1}]},{"page_no":"2","text":" ","ocr_text":"b","display_text":"d"},{"page":"x","page_no":7}]', '[{"id":"t1","page":1,"title":null,"markdown":" ","table_markdown":"m","html":"<p>\\"q\\"</p>","rows":[["a",null]]}]'), (2, None, "[]"), (3, "bad", None)])
query("p01_parse_pages", "select * from (values (1, 0, 1, 'a', null, '[{\"t\":1}]'), (1, 1, 2, 'b', 'd', null), (1, 2, 7, null, null, null)) x(doc_id, pos, page_no, ocr_text, display_text, ocr_lines_json)")(lambda t: store.parse_pages(PARSED.df(t)).select("doc_id", "pos", "page_no", "ocr_text", "display_text", "ocr_lines_json"))
query("p02_parse_tables", """select 1 as doc_id, 0 as pos, 1 as page_no, 'm' as table_markdown, '{"id":"t1","title":null,"html":"<p>\\"q\\"</p>","rows":[["a",null]]}' as table_json""")(lambda t: store.parse_tables(PARSED.df(t)))
query("x26_json_encode", "select doc_id, to_json({'source': source, 'lang': lang})::varchar as j from documents")(lambda t: t.documents.select("doc_id", F.to_json(F.struct("source", "lang")).alias("j")))


def parse_results(t):
    """A parse result for each document: its first two lines are its pages; some have a display text, an OCR text, or a table."""
    d, text = t.documents, F.col("text")
    none = F.lit(None).cast("string")
    pages = F.transform(F.slice(F.split("text", "\n"), 1, 2), lambda l, i: F.struct((i + 1).alias("page"), F.when(l != "", l).alias("text")))
    some = F.col("doc_id") % 5 == 0
    tables = F.when(some, F.array(F.struct(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("id"), F.array(F.array(F.col("doc_id").cast("string"), none)).alias("rows"))))
    pages = F.transform(pages, lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text"), none.alias("ocr_text")))
    return d.select("doc_id", F.lit(" ").alias("raw_ocr_text"), F.when(F.col("doc_id") % 4 == 1, text).alias("ocr_text"), F.when(F.col("doc_id") % 4 == 0, text).otherwise("").alias("display_text"), none.alias("text"), none.alias("clean_text_for_rag"), F.when(some, "extracted").alias("table_extract_status"), pages.alias("pages"), tables.alias("tables"))


query(
    "k06_document_row",
    r"""with p as (select doc_id, text, doc_id % 4 = 0 shown, string_split(text, chr(10))[1:2] ls from documents),
    r as (select doc_id, case when shown then text end display, case when doc_id % 4 = 1 then text end raw, list_transform(ls, lambda l, i: {'page': i::integer, 'text': nullif(l, ''), 'ocr_text': null}) pages, case when doc_id % 5 = 0 then [{'id': 't' || doc_id, 'rows': [[doc_id::varchar, null]]}] end tables from p)
    select doc_id, md5(raw) raw, md5(display) display, md5(coalesce(display, raw, trim(array_to_string(list_transform(list_filter(pages, lambda g: trim(coalesce(g.text, '')) <> ''), lambda g: g.text), chr(10))))) ocr, case when doc_id % 5 = 0 then 'extracted' end status, md5(to_json(pages)::varchar) pages, to_json(tables)::varchar tables, case when tables is not null then '{"tables":' || to_json(tables)::varchar || '}' end wrapped from r""",
)(lambda t: store.document_row(parse_results(t)).select("doc_id", F.md5("raw_ocr_text").alias("raw"), F.md5("display_text").alias("display"), F.md5("ocr_text").alias("ocr"), F.col("table_extract_status").alias("status"), F.md5("pages_json").alias("pages"), F.col("tables_json").alias("tables"), F.col("table_json").alias("wrapped")))
query("a14_legacy_text", "select conv_id, md5(trim(string_agg(text, chr(10) order by turn))) as h from conversations where trim(coalesce(text, '')) <> '' group by 1")(lambda t: t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("text"), F.lit(None).cast("string").alias("ocr_text"))).alias("p")).select("conv_id", F.md5(store.legacy_text(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("p"))).alias("h")))
LISTED = Fixture("pos int, doc_id string", [(0, "1"), (1, " 2 "), (2, "1"), (3, "")])
FOLDERS = Fixture("doc_id string, file string", [("3", "index.faiss"), ("3", "meta.json"), ("4", "meta.json"), ("2", "index.faiss"), ("2", "meta.json")])
for _n in ("s08_registry", "a10_registry_distinct", "u03_registry_union", "o15_folders_in_order"):
    query(_n, "select * from (values ('1', 0::bigint), ('2', 1::bigint), ('3', 2::bigint)) x(doc_id, pos)")(lambda t: store.registry(LISTED.df(t), FOLDERS.df(t)))
# the registry over tables: labelled documents are listed, some twice and with blanks; folders hold one index file, or both
LISTED_SQL = "listed as (select toxic * 1000000 + doc_id pos, ' ' || doc_id || case when quality = 1 then chr(10) else '' end doc_id from labels union all select 5000000 - doc_id, case when doc_id % 10 = 0 then ' ' else doc_id::varchar end from documents where doc_id % 5 = 0)"
FILES_SQL = "own_files as (select doc_id::varchar doc_id from documents where doc_id % 2 = 0 and doc_id % 3 = 0)"
REGISTRY = LISTED_SQL + ", " + FILES_SQL + r""", every as (select regexp_replace(doc_id, '^\s+|\s+$', '', 'g') doc_id, 0 kind, pos, '' "name" from listed union all select doc_id, 1, 0, doc_id from own_files),
  first_place as (select doc_id, min({'kind': kind, 'pos': pos, 'name': "name"}) place from every where doc_id <> '' group by 1)"""


def listed(t):
    own = t.labels.select((F.col("toxic") * 1000000 + F.col("doc_id")).alias("pos"), F.concat(F.lit(" "), F.col("doc_id").cast("string"), F.when(F.col("quality") == 1, "\n").otherwise("")).alias("doc_id"))
    return own.unionAll(t.documents.where("doc_id % 5 = 0").select(5000000 - F.col("doc_id"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.col("doc_id").cast("string"))))


def index_files(t):
    d = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"))
    return d.where("n % 2 = 0").select("doc_id", F.lit("index.faiss").alias("file")).unionAll(d.where("n % 3 = 0").select("doc_id", F.lit("meta.json")))


PLACES = "select doc_id, row_number() over (order by place) - 1 pos from first_place"
query("s08_registry_of_documents", f"with {REGISTRY} {PLACES}")(lambda t: store.registry(listed(t), index_files(t)))
query("u03_registry_with_folders", f"with {REGISTRY} select doc_id, place.kind = 1 from_folder from first_place")(lambda t: store.registry(listed(t), index_files(t)).join(listed(t).select(tx.strip(F.col("doc_id")).alias("doc_id")).distinct().withColumn("in_list", F.lit(True)), "doc_id", "left").select("doc_id", F.col("in_list").isNull().alias("from_folder")))
query("a10_listed_once", f"with {REGISTRY} {PLACES} where place.kind = 0")(lambda t: store.registry(listed(t), index_files(t).limit(0)))
query("o15_folders_by_name", "select doc_id::varchar doc_id, row_number() over (order by doc_id::varchar) - 1 pos from documents where doc_id % 6 = 0")(lambda t: store.registry(listed(t).limit(0), index_files(t)))
query("s09_index_files", "select * from (values ('3'), ('2')) x(doc_id)")(lambda t: FOLDERS.df(t).where("file = 'index.faiss'").join(FOLDERS.df(t).where("file = 'meta.json'"), "doc_id", "left_semi").select("doc_id"))
query("k02_register", "select * from (values ('1'), ('2'), ('9')) x(doc_id)")(lambda t: files.register(LISTED.df(t), t.spark.createDataFrame([("9",), ("1",), (" ",)], "doc_id string")).select("doc_id"))
UP = Fixture("filename string, length long", [("a.PNG", 3), ("b", 0), ("c.tar.GZ", 1)])
query("s01_uploads", "select * from (values ('a.PNG', '.png', 36), ('c.tar.GZ', '.gz', 35)) x(filename, ext, n)")(lambda t: files.named_uploads(UP.df(t).where("length > 0")).select("filename", "ext", F.length("stored").alias("n")))
query("s03_valid_lines", "select * from (values (1), (4)) x(n)")(lambda t: files.valid_lines(t.spark.createDataFrame([(1, "a", "0.5", [["1", "2"]]), (2, "b", "x", [["1", "2"]]), (3, "c", "1", [["q", "2"]]), (4, "d", "1", [])], "n int, text string, score string, bbox array<array<string>>")).select("n"))
query("s11_stored_files", f"with {D} select id from docs where id % 4 <> 0")(lambda t: files.stored_files(docs(t), docs(t).where("id % 4 = 0").select(F.col("id").alias("doc_id"), "filename", F.lit("p").alias("path")))[1].select("id"))
query("s13_page_images", "select conv_id, turn, '/d/pages/' || conv_id || '/page_' || turn || '.png' as path from conversations")(lambda t: t.conversations.select("conv_id", "turn", files.page_image_path("/d", F.col("conv_id"), F.col("turn")).alias("path")))
query("s19_settings", "select 900 as chunk_size, 120 as chunk_overlap, 5 as top_k, 3 as per_document")(lambda t: t.spark.createDataFrame([(Settings.load({}).chunk_size, Settings.load({}).chunk_overlap, Settings.load({}).top_k, Settings.load({}).per_document)], "chunk_size int, chunk_overlap int, top_k int, per_document int"))
ASKS = Fixture("id int, isolated boolean, doc_id string, n int", [(1, True, "3", 0), (2, True, None, 0), (3, False, None, 2), (4, None, "3", 0), (5, False, "3", 1)], same_over("orders", "o_orderkey as id", "case o_orderkey % 3 when 0 then true when 1 then false end as isolated", "case when o_custkey % 2 = 0 then cast(o_custkey as string) end as doc_id", "cast(o_custkey % 3 as int) as n"))
scalar("f26_valid_requests", ASKS, "select id, case when isolated then doc_id is not null else n > 0 end as ok from {t}", ok=lambda id, i, d, n: F.when(i, d.isNotNull()).otherwise(n > 0))

# chunks
WINDOWS = r"""s as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') t from documents), w as (select doc_id, i, regexp_replace(substring(t, i * 780 + 1, 900), '^\s+|\s+$', '', 'g') piece from (select doc_id, t, unnest(range(0, greatest(0, ceil((length(t) - 900) / 780.0)::integer) + 1)) i from s where t <> '')),
v as (select doc_id, i, piece from w where piece <> '')"""
query("w05_chunks", f"with {WINDOWS} select doc_id, i::integer as chunk_index, md5(piece) as h from v")(lambda t: chunk.split(t.documents, "text").select("doc_id", F.posexplode("pieces").alias("chunk_index", "p")).select("doc_id", "chunk_index", F.md5("p").alias("h")))
query("w06_chunk_ordinals", f"with {WINDOWS} select doc_id, count(*) as n, max(i) as last from v group by 1")(lambda t: chunk.split(t.documents, "text").select("doc_id", F.posexplode("pieces").alias("i", "p")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("i").cast("long").alias("last")))
as_pages = lambda t: t.documents.select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("page"), F.lit(1).alias("page_no"), F.when(F.col("doc_id") % 3 != 2, F.col("text")).alias("clean_text_for_rag"), F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" raw"))).alias("raw_ocr_text"), F.col("text").alias("display_text"), F.col("text"))
CHUNKS = r"""src as (select doc_id, 'page_body' k, 0 f, '正文/RAG链路程式化' head, text t from documents where doc_id % 3 <> 2 union all select doc_id, 'page_ocr', 1, 'OCR原始文本', text || ' raw' from documents where doc_id % 3 = 1 union all select doc_id, 'page_display', 2, '展示文本', text from documents where doc_id % 3 = 2),
s as (select doc_id, k, f, head, regexp_replace(t, '^\s+|\s+$', '', 'g') t from src), w as (select doc_id, k, f, head, i, regexp_replace(substring(t, i * 780 + 1, 900), '^\s+|\s+$', '', 'g') piece from (select *, unnest(range(0, greatest(0, ceil((length(t) - 900) / 780.0)::integer) + 1)) i from s where t <> '')),
c as (select doc_id, k, f, i, '【第1页·' || head || '】' || chr(10) || piece content from w where piece <> ''),
o as (select *, row_number() over (partition by doc_id, substring(content, 1, 200) order by f, i) n from c)"""
query("u02_build_chunks", f"with {CHUNKS} select doc_id, k as source_type, i::integer as chunk_index, md5(content) as h from o where n = 1")(lambda t: chunk.build_chunks(as_pages(t)).select("doc_id", "source_type", "chunk_index", F.md5("content").alias("h")))
query("x17_chunk_headers", f"with {CHUNKS} select k as source_type, count(*) as n, min(substring(content, 1, 10)) as head from o where n = 1 group by 1")(lambda t: chunk.build_chunks(as_pages(t)).groupBy("source_type").agg(F.count("*").alias("n"), F.min(F.substring("content", 1, 10)).alias("head")))
query("k03_indexed_chunks", f"with {CHUNKS} select doc_id, count(*) as n from o where n = 1 group by 1")(lambda t: chunk.build_chunks(as_pages(t)).groupBy("doc_id").agg(F.count("*").alias("n")))
query("a08_prefix_dedup", "select doc_id from (select doc_id, row_number() over (partition by md5(substring(text, 1, 200)) order by doc_id) n from documents) where n = 1")(lambda t: chunk.first_by_prefix(t.documents.select("doc_id", F.col("text").alias("content")), "doc_id").select("doc_id"))
query("k09_fallback_documents", f"with {REG} select doc_id from documents where doc_id not in (select doc_id from reg)")(lambda t: t.documents.join(reg(t), "doc_id", "left_anti").select("doc_id"))

# retrieval
V = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings), q as (select vec_id qid, e q from v where vec_id % 50 = 0), s as (select qid, label doc_id, vec_id ord, round(list_dot_product(e, q), 6) score from v, q)"
index = lambda t: t.embeddings.select(F.col("label").alias("doc_id"), F.col("vec_id").alias("ord"), "embedding")
questions = lambda t: t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
scored = lambda t: retrieve.score(index(t), questions(t))
query("j07_scores", f"with {V} select qid, ord, score from s")(lambda t: scored(t).select("qid", "ord", "score"))
query("g05_inner_products", f"with {V} select qid, round(sum(score), 3) as total from s group by 1")(lambda t: scored(t).groupBy("qid").agg(F.round(F.sum("score"), 3).alias("total")))
query("g06_normalised", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 5) as n from embeddings")(lambda t: t.embeddings.select("vec_id", F.round(geo.dot(geo.normalised(F.col("embedding")), geo.normalised(F.col("embedding"))), 5).alias("n")))
query("o04_topk", f"with {V} select qid, rank, ord, score from (select *, row_number() over (partition by qid order by score desc, doc_id, ord)::integer rank from s) where rank <= 5")(lambda t: retrieve.top(index(t), questions(t)).select("qid", "rank", "ord", "score"))
query("w07_top_per_document", f"with {V} select qid, doc_id, rank, ord from (select *, row_number() over (partition by qid, doc_id order by score desc, ord)::integer rank from s) where rank <= 3")(lambda t: retrieve.top_in_document(index(t), questions(t), 3).select("qid", "doc_id", "rank", "ord"))
TWO_STAGE = f"{V}, r as (select *, row_number() over (partition by qid, doc_id order by score desc, ord) k from s), f as (select *, row_number() over (partition by qid order by score desc, doc_id, k)::integer rank from r where k <= 3)"
query("o05_two_stage_topk", f"with {TWO_STAGE} select qid, rank, doc_id, ord, score from f where rank <= 5")(lambda t: retrieve.top_across(index(t), questions(t)).select("qid", "rank", "doc_id", "ord", "score"))
query("f30_short_results", f"with {V} select qid, least(count(*), 100000) as n from s group by 1")(lambda t: retrieve.best(index(t), questions(t), 100000).groupBy("qid").agg(F.count("*").alias("n")))
hits = lambda t: retrieve.top_across(index(t), questions(t)).withColumns({"content": F.concat(F.lit(" chunk "), F.col("ord").cast("string")), "doc_name": retrieve.document_label(F.col("doc_id"), F.create_map(F.lit("0"), F.lit("zero.pdf"), F.lit("1"), F.lit(" ")))})
LABEL = "case when doc_id = 0 then 'zero.pdf' else doc_id::varchar end"
query("j05_document_labels", f"with {TWO_STAGE} select qid, rank, {LABEL} as doc_name from f where rank <= 5")(lambda t: hits(t).select("qid", "rank", "doc_name"))
query("a15_numbered_context", f"with {TWO_STAGE} select qid, string_agg('[片段' || rank || ']' || chr(10) || 'chunk ' || ord, chr(10) || chr(10) order by rank) as context from f where rank <= 5 group by 1")(lambda t: retrieve.context_block(hits(t), across=False))
query("a16_named_context", f"with {TWO_STAGE} select qid, string_agg('[文件 ' || {LABEL} || ' · 片段]' || chr(10) || 'chunk ' || ord, chr(10) || chr(10) order by rank) as context from f where rank <= 5 group by 1")(lambda t: retrieve.context_block(hits(t), across=True))
query("x22_prompts", f"with {TWO_STAGE} select qid, '问题：q' || qid || chr(10) || chr(10) || '检索上下文：' || chr(10) || string_agg('[片段' || rank || ']' || chr(10) || 'chunk ' || ord, chr(10) || chr(10) order by rank) as prompt from f where rank <= 5 group by 1")(lambda t: retrieve.context_block(hits(t), across=False).select("qid", retrieve.prompt(F.concat(F.lit("q"), F.col("qid").cast("string")), F.col("context")).alias("prompt")))
query("o17_length_caps", "select doc_id, length(substring(text, 1, 8000)) as n from documents")(lambda t: t.documents.select("doc_id", F.length(retrieve.shown_content(F.lit(""), F.col("text"))).cast("long").alias("n")))
query("p07_response_contexts", f"""with {TWO_STAGE} select qid, rank, '{{"content":" chunk ' || ord || '","page_no":' || rank || ',"doc_id":"' || doc_id || '","doc_name":"' || {LABEL} || '"}}' as j from f where rank <= 5""")(lambda t: hits(t).select("qid", "rank", retrieve.response_context(F.col("content"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("rank"), F.lit(None).cast("string"), F.col("doc_id").cast("string"), F.col("doc_name")).alias("j")))
ROUTE = Fixture("qid int, isolated boolean, doc_id string", [(1, True, "3"), (2, True, None), (3, False, None), (4, True, "none"), (5, None, "3")])
INDEXED = Fixture("doc_id string", [("3",), ("4",)])
query("x23_degraded_answers", "select qid, case qid when 1 then 'isolated' when 4 then 'degraded' else 'across' end as mode from " + ROUTE.sql)(lambda t: retrieve.route(ROUTE.df(t), INDEXED.df(t)).select("qid", "mode"))
query("x35_nothing_indexed", f"select qid, case when qid in (1, 4) then null else '{retrieve.NOTHING_INDEXED}' end as answer from " + ROUTE.sql)(lambda t: retrieve.route(ROUTE.df(t), INDEXED.df(t).limit(0)).select("qid", "answer"))
