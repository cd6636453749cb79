"""Operators whose fixtures are small, over whole tables: what they read is derived from these by Spark, and computed anew in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import tables as tb
from quire.operators import infer, retrieve, search, store, textlayer
from quire.plans import store_queries, textlayer_queries
from quire.plans.registry import query
from quire.sources import files


def none():
    return F.lit(None).cast("string")


# hits in the boxes of lines: a document's lines as JSON, every third without a whole box, every seventh document's JSON broken


def box_pages(t) -> DataFrame:
    points = lambda *ps: F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ps))
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.struct(l.alias("text"), F.when(i % 3 == 1, points((0, 0))).otherwise(points((0, 0), (9, 0), (9, 2), (0, 2))).alias("box")))
    whole = F.when(F.col("doc_id") % 7 == 0, F.lit("no JSON")).otherwise(F.to_json(lines))
    return t.documents.select("doc_id", F.lit(1).alias("page_no"), whole.alias("ocr_lines_json"))


BOXED = r"l as (select doc_id, i, regexp_replace(string_split(text, chr(10))[i + 1], '^\s+|\s+$', '', 'g') text from documents, unnest(range(0, len(string_split(text, chr(10))))) u(i) where doc_id % 7 <> 0), h as (select doc_id, 1 page_no, i::integer n, text from l where contains(text, 'tion') and i % 3 <> 1)"
ROUND = "r as (select *, row_number() over (partition by doc_id order by n)::integer - 1 hit, count(*) over (partition by doc_id)::integer total from h)"
box_hits = lambda t: search.box_hits(box_pages(t), " tion ")
around = lambda t: search.neighbours(box_hits(t), ["page_no", "n"], ["doc_id"])
query("f28_box_hits_of_documents", f"with {BOXED} select * from h")(lambda t: box_hits(t).select("doc_id", "page_no", "n", "text"))
query("w11_circular_hits_of_documents", f"with {BOXED}, {ROUND} select doc_id, n, hit, (hit + total - 1) % total prev, (hit + 1) % total \"next\" from r")(lambda t: around(t).select("doc_id", "n", "hit", "prev", "next"))
query("j12_local_index_of_documents", f"with {BOXED}, {ROUND} select doc_id, n, hit \"local\" from r")(lambda t: around(t).select("doc_id", "n", "local"))
query("x31_defensive_lines_of_documents", "select doc_id, case when doc_id % 7 = 0 then 0 else len(string_split(text, chr(10))) end::integer n from documents")(lambda t: box_pages(t).select("doc_id", F.greatest(F.coalesce(F.size(F.from_json("ocr_lines_json", "array<struct<text:string>>")), F.lit(0)), F.lit(0)).alias("n")))

# states, requests, questions

ITEMS = "case when quality = 1 then 3 when toxic = 1 then 0 end chunks, case when doc_id % 3 = 0 then 5 when doc_id % 3 = 1 then 0 end fallback, case doc_id % 4 when 0 then 'boom' when 1 then ' ' end err"
query("k08_index_state_of_labels", f"select doc_id, case when ok then 1 else 2 end status, ok indexed from (select doc_id, case when coalesce(chunks, 0) > 0 then trim(coalesce(err, '')) = '' else coalesce(fallback, 0) > 0 end ok from (select doc_id, {ITEMS} from labels))")(
    lambda t: t.labels.selectExpr("doc_id", *ITEMS.split(", ")).select("doc_id", store.index_state(F.col("chunks"), F.col("fallback"), F.col("err")).alias("s")).select("doc_id", "s.status", "s.indexed")
)


def routed(t, indexed: DataFrame) -> DataFrame:
    asked = t.orders.selectExpr("o_orderkey as qid", "case o_orderkey % 3 when 0 then true when 1 then false end as isolated", "case when o_orderkey % 4 > 0 then cast(o_custkey as string) end as doc_id")
    return retrieve.route(asked, indexed)


def customers(t) -> DataFrame:
    return t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("doc_id"))


ALONE = "o_orderkey % 3 = 0 and o_orderkey % 4 > 0"
query("x23_degraded_answers_of_orders", f"select o_orderkey qid, case when {ALONE} then case when exists (select 1 from customer where c_custkey = o_custkey and c_custkey % 2 = 0) then 'isolated' else 'degraded' end else 'across' end \"mode\" from orders")(lambda t: routed(t, customers(t)).select("qid", "mode"))
query("x35_nothing_indexed_for_orders", f"select o_orderkey qid, case when not ({ALONE}) then '{retrieve.NOTHING_INDEXED}' end answer from orders")(lambda t: routed(t, customers(t).limit(0)).select("qid", "answer"))

# parse results as JSON; a page number with a blank before it is none


def parsed_pages(t) -> DataFrame:
    page = F.struct("turn", F.struct(F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).alias("page"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" "), F.col("turn").cast("string"))).alias("page_no"), F.when(F.col("turn") % 3 != 0, F.col("text")).otherwise(" ").alias("text"), F.col("role").alias("ocr_text"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("display_text")).alias("p"))
    own = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(page)).alias("l"))
    return own.select("doc_id", F.to_json(F.transform("l", lambda x: x["p"])).alias("pages_json"))


query("p01_pages_of_conversations", "select conv_id doc_id, row_number() over (partition by conv_id order by turn)::integer - 1 pos, case when turn % 2 = 0 then turn::integer end page_no, case when turn % 3 <> 0 and trim(text) <> '' then text else role end ocr_text, case when turn % 2 = 0 then text end display_text from conversations")(
    lambda t: store.parse_pages(parsed_pages(t)).select("doc_id", "pos", "page_no", "ocr_text", "display_text")
)


def item_rows(t, *cells) -> DataFrame:
    """An order's items as rows of these cells."""
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array(*cells).alias("c"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(one)).alias("l")).select("doc_id", F.transform("l", lambda x: x["c"]).alias("rows"))


ORDER = "order by l_linenumber, l_partkey, l_suppkey, l_quantity"


def flags(t) -> DataFrame:
    return item_rows(t, F.col("l_linenumber").cast("string"), F.concat("l_returnflag", F.lit(","), "l_linestatus"))


def parsed_tables(t) -> DataFrame:
    table = F.struct(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("id"), F.lit("3").alias("page_no"), F.lit(" ").alias("markdown"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("table_markdown"), F.col("rows"))
    return flags(t).select("doc_id", F.to_json(F.array(table)).alias("tables_json"))


AS_JSON = f"'[' || string_agg('[\"' || l_linenumber || '\",\"' || l_returnflag || ',' || l_linestatus || '\"]', ',' {ORDER}) || ']'"
query("p02_tables_of_orders", f"select l_orderkey doc_id, 0 pos, 3 page_no, 'm' || l_orderkey table_markdown, '{{\"id\":\"t' || l_orderkey || '\",\"title\":null,\"html\":null,\"rows\":' || {AS_JSON} || '}}' table_json from lineitem group by 1")(lambda t: store.parse_tables(parsed_tables(t)))
query("p06_rows_of_orders", f"select l_orderkey doc_id, string_agg(l_linenumber || ' ' || l_returnflag || ',' || l_linestatus, '|' {ORDER}) v from lineitem group by 1")(
    lambda t: flags(t).select("doc_id", F.array_join(F.transform(store.view_rows(F.regexp_replace(F.to_json("rows"), r"^\[", '["no row",')), lambda r: F.array_join(r, " ")), "|").alias("v"))
)

# CSV: an order's table as JSON, as JSON in a wrapper, as Markdown, or as something else

CSV = f"string_agg(l_linenumber || ',\"' || l_returnflag || ',' || l_linestatus || '\"' || chr(10), '' {ORDER})"


def stored_tables(t) -> DataFrame:
    """doc_id, j and m."""
    rows = flags(t)
    objects = F.transform("rows", lambda r: F.struct(F.get(r, 0).alias("no"), F.get(r, 1).alias("flags")))
    plain, wrapped = F.to_json(F.struct("rows")), F.to_json(F.struct(F.struct(F.array(F.lit("no"), F.lit("flags")).alias("columns"), objects.alias("rows")).alias("table_json")))
    kind = F.col("doc_id") % 4
    return rows.select("doc_id", F.when(kind == 0, plain).when(kind == 1, wrapped).when(kind == 3, "neither").alias("j"), F.when(kind == 2, tb.markdown(F.concat(F.array(F.array(F.lit("no"), F.lit("flags"))), "rows"))).alias("m"))


BODY = f"case l_orderkey % 4 when 3 then 'neither' when 0 then '' else 'no,flags' || chr(10) end || case when l_orderkey % 4 < 3 then {CSV} else '' end"
query("x40_csv_of_orders", f"select l_orderkey doc_id, {BODY} v from lineitem group by 1")(lambda t: stored_tables(t).select("doc_id", tb.to_csv(F.col("j"), F.col("m")).alias("v")))
query("x43_json_csv_of_orders", f"select l_orderkey doc_id, 'no,flags' || chr(10) || {CSV} v from lineitem where l_orderkey % 4 = 1 group by 1")(lambda t: stored_tables(t).where("doc_id % 4 = 1").select("doc_id", tb.json_csv(F.col("j")).alias("v")))
query("x41_json_rows_of_orders", "select l_orderkey doc_id, case when l_orderkey % 4 = 0 then count(*) end::integer n from lineitem group by 1")(lambda t: stored_tables(t).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.size(tb.json_rows(F.col("j")))).alias("n")))
query("k07_exports_of_orders", f"select l_orderkey doc_id, 'doc-' || l_orderkey || '-table-t_' || l_orderkey || '.csv' \"name\", chr(65279) || {BODY} body from lineitem group by 1")(
    lambda t: stored_tables(t).select("doc_id", store.csv_export(F.col("doc_id"), F.concat(F.lit("t:"), F.col("doc_id").cast("string")), F.col("j"), F.col("m")).alias("e")).select("doc_id", "e.name", "e.body")
)

# tables of two sources: every order's, those of even ones again with blanks around, and one of all orders' first items


def merged(t) -> DataFrame:
    first = flags(t).select("doc_id", F.lit(0).alias("ord"), F.lit(1).alias("page"), "rows")
    again = first.where("doc_id % 2 = 0").withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda c: F.concat(F.lit(" "), c, F.lit("\t")))))
    other = first.withColumns({"ord": F.lit(1), "rows": F.array(F.array(F.lit("order"), F.col("doc_id").cast("string")))})
    named = lambda df, source: df.withColumns({"id": F.concat_ws("-", F.lit(source), "ord"), "markdown": F.lit(""), "html": none(), "title": none(), "source": F.lit(source)})
    return infer.merge_tables(named(first, "pdf"), named(again.unionByName(other), "ocr"))


query("u01_merged_tables_of_orders", f"select l_orderkey doc_id, 'pdf-0' id, string_agg(l_linenumber || ' ' || l_returnflag || ',' || l_linestatus, '|' {ORDER}) v from lineitem group by 1 union all select distinct l_orderkey, 'ocr-1', 'order ' || l_orderkey from lineitem")(
    lambda t: merged(t).select("doc_id", "id", F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "|").alias("v"))
)

# strategies over the laid-out pages: which find a table at all, and which of these need a caption


def by_strategy(t) -> DataFrame:
    found = textlayer.find_in_pages(textlayer_queries.laid_out(t))
    return found.where("failed is null").select("doc_id", "strategy").distinct()


FINDS = "case l_orderkey % 6 when 0 then [0, 1, 2, 3, 4] when 1 then [1, 2, 3, 4] when 3 then [2, 3] when 4 then [2, 4] else [2] end"
query("s05_strategies_that_find", f"select distinct l_orderkey doc_id, s::integer strategy from (select l_orderkey, unnest({FINDS}) s from lineitem)")(by_strategy)


def wanting_captions(t) -> DataFrame:
    rules = t.spark.createDataFrame(infer.STRATEGIES, "seq int, vertical string, horizontal string").select(F.col("seq").alias("strategy"), infer.requires_caption(F.col("vertical"), F.col("horizontal")).alias("needs"))
    return by_strategy(t).join(F.broadcast(rules), "strategy").groupBy("doc_id").agg(F.count_if("needs").alias("n"), F.count("*").alias("strategies"))  # five rules


query("f23_captions_wanted", f"select l_orderkey doc_id, 1::bigint n, len(any_value({FINDS})) strategies from lineitem group by 1")(wanting_captions)


def captioned(t) -> DataFrame:
    bare = textlayer.find_in_pages(textlayer_queries.laid_out(t)).where("strategy = 2 and failed is null")
    return textlayer.captioned(bare, textlayer_queries.heights(t)).select("doc_id")


query("j10_captioned_pages", "select distinct l_orderkey doc_id from lineitem where l_orderkey % 6 = 2")(captioned)

# files, lines and the registry


@query("s01_uploads_of_pages", r"select page_id, lower(ext) ext, 32 + length(ext) n from (select page_id, case page_id % 3 when 0 then '.HTML' when 1 then '.Gz' else '' end ext, html from pages) where length(html) > 0 and page_id % 5 <> 0")
def s01(t):
    """Every fifth upload is empty; a name without a dot has no extension."""
    ext = F.when(F.col("page_id") % 3 == 0, ".HTML").when(F.col("page_id") % 3 == 1, ".tar.Gz").otherwise("")
    up = t.pages.select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string"), ext).alias("filename"), F.when(F.col("page_id") % 5 == 0, 0).otherwise(F.length("html")).alias("length"))
    return files.named_uploads(up.where("length > 0")).select("page_id", "ext", F.length("stored").alias("n"))


@query("s03_valid_lines_of_events", "select event_id from events where event_id % 7 <> 0 and event_id % 5 <> 0 and event_type is not null")
def s03(t):
    """Recognised lines as text: scores of every seventh and a corner of every fifth are no numbers."""
    score = F.when(F.col("event_id") % 7 == 0, "high").otherwise(F.col("value").cast("string"))
    corner = F.when(F.col("event_id") % 5 == 0, "left").otherwise(F.col("user_id").cast("string"))
    raw = t.events.select("event_id", F.col("event_type").alias("text"), score.alias("score"), F.array(F.array(corner, F.lit("2")), F.array(F.lit("3"), F.lit("4.5"))).alias("bbox"))
    return files.valid_lines(raw).select("event_id")


query("s09_index_files_of_documents", "select doc_id::varchar doc_id from documents where doc_id % 6 = 0")(lambda t: store.registry(store_queries.listed(t).limit(0), store_queries.index_files(t)).select("doc_id"))
query("k02_registered_documents", f"with {store_queries.REGISTRY} select doc_id, true known from first_place where place.kind = 0 union all select doc_id::varchar, false from documents where doc_id::varchar not in (select doc_id from first_place where place.kind = 0)")(
    lambda t: files.register(store_queries.listed(t), t.documents.select("doc_id").unionAll(t.documents.select("doc_id"))).select("doc_id", (F.col("g") == 0).alias("known"))
)
