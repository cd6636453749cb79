"""Queries of table functions: rows to Markdown, HTML and CSV, shape, keys, merging, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import tables as tb
from quire.functions import text as tx
from quire.operators import infer, store
from quire.plans.registry import Fixture, query, same_over, scalar

ROWS = [
    (1, [["h1", "h|2"], ["x"], ["y", "z", "extra"]]),
    (2, [[None, " a ", ""], ["", "", ""], ["b", None]]),
    (3, [["name", "qty", "price"], ["apple", "1", "2.5"], ["pear", "2", "3.5"]]),
    (4, [["k:", "v1"], ["key two", "value"], ["c", "d"]]),
    (5, [["one", "two"], ["a", "b"]]),
    (6, []),
    (7, [["a", "b,c"], ['d"e', "f\ng"], ["<b>&'", "ü"]]),
    (8, [["x" * 60, "sentence, with marks. " * 4, "y" * 70], ["z" * 60, "more; text " * 5, "w" * 60], ["p" * 80, "q" * 90, "r" * 58]]),
    (9, [["", ""], ["", ""]]),
    (10, [["2020", "long text " * 8, "1"], ["2021", "long text " * 8, "2"], ["2022", "s", ""]]),
]
# an order's items with cells of many kinds, and a column that is always blank
ITEMS = (
    lambda t: t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array(F.col("l_linenumber").cast("string"), F.concat(F.lit(" part|"), F.col("l_partkey").cast("string")), F.when(F.col("l_linestatus") == "O", F.col("l_linestatus")), F.lit(" "), F.when(F.col("l_quantity") > 25, F.lit("a long note, with marks; on <this> & \"that\" item's way")).otherwise("")).alias("c")))).alias("l")).select("id", F.concat(F.array(F.array(*map(F.lit, ("no", "part", "status", "", "note")))), F.transform("l", lambda x: x["c"])).alias("r")),
    "select l_orderkey as id, list_prepend(['no', 'part', 'status', '', 'note'], list([l_linenumber::varchar, ' part|' || l_partkey, case when l_linestatus = 'O' then l_linestatus end, ' ', case when l_quantity > 25 then 'a long note, with marks; on <this> & \"that\" item''s way' else '' end] order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus)) as r from lineitem group by 1",
)
R = Fixture("id int, r array<array<string>>", ROWS, ITEMS)
LINES = (lambda t: t.documents.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("c")), "select doc_id as id, unnest(string_split(text, chr(10))) as c from documents")
STRIP = r"regexp_replace(coalesce(c, ''), '^\s+|\s+$', '', 'g')"
NORMAL = f"""n0 as (select id, list_filter(list_transform(r, lambda x: list_transform(x, lambda c: {STRIP})), lambda x: len(list_filter(x, lambda c: c <> '')) > 0) r from {{t}}),
n1 as (select id, r, coalesce(list_max(list_transform(r, lambda x: len(x))), 0) w from n0),
n2 as (select id, list_transform(r, lambda x: list_transform(list_filter(range(1, w + 1), lambda i: len(list_filter(r, lambda y: coalesce(y[i], '') <> '')) > 0), lambda i: coalesce(x[i], ''))) r from n1)"""
TEXT = "array_to_string(list_transform(r, lambda x: array_to_string(x, chr(9))), chr(10))"
show = lambda c: F.array_join(F.transform(c, lambda x: F.array_join(x, "\t")), "\n")
scalar("x48_normalise_rows", R, f"with {NORMAL} select id, {TEXT} as v from n2", v=lambda id, r: show(tb.normalise_rows(r)))
scalar("a19_widths", R, f"with {NORMAL} select id, coalesce(list_max(list_transform(r, lambda x: len(x))), 0)::integer as v from n2", v=lambda id, r: F.coalesce(F.array_max(F.transform(tb.normalise_rows(r), F.size)), F.lit(0)))
CELL = r"regexp_replace(replace(replace(coalesce(c, ''), '|', '\|'), chr(10), ' '), '^\s+|\s+$', '', 'g')"
scalar("x46_markdown", R, f"select id, case when len(r) = 0 then '' else '| ' || array_to_string(list_transform(r[1], lambda c: {CELL}), ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(r[1], lambda c: '---'), ' | ') || ' |' || array_to_string(list_transform(r[2:], lambda x: chr(10) || '| ' || array_to_string(list_transform(range(1, len(r[1]) + 1), lambda i: {CELL.replace('coalesce(c,', 'coalesce(x[i],')}), ' | ') || ' |'), '') end as v from {{t}}", v=lambda id, r: tb.markdown(r))
HTML_CELL = "replace(replace(replace(replace(replace(coalesce(c, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
scalar("x47_html", R, f"select id, case when len(r) = 0 then '<table></table>' else '<table><tr>' || array_to_string(list_transform(r[1], lambda c: '<th>' || {HTML_CELL} || '</th>'), '') || '</tr>' || array_to_string(list_transform(r[2:], lambda x: '<tr>' || array_to_string(list_transform(x, lambda c: '<td>' || {HTML_CELL} || '</td>'), '') || '</tr>'), '') || '</table>' end as v from {{t}}", v=lambda id, r: tb.html(r))
V = "replace(replace(coalesce(c, ''), chr(13), ' '), chr(10), ' ')"
CSV_CELL = f"case when contains({V}, ',') or contains({V}, '\"') then '\"' || replace({V}, '\"', '\"\"') || '\"' else {V} end"
scalar("x42_csv_rows", R, f"select id, array_to_string(list_transform(r, lambda x: array_to_string(list_transform(x, lambda c: {CSV_CELL}), ',') || chr(10)), '') as v from {{t}}", v=lambda id, r: tb.csv_rows(r))
scalar("x45_csv_cell", Fixture("id int, c string", [(1, "a"), (2, "b,c"), (3, 'd"e'), (4, "f\ng\r"), (5, None)], LINES), f"select id, {CSV_CELL} as v from {{t}}", v=lambda id, c: tb.csv_cell(c))
PROSE = "(length(c) >= 36 and (regexp_matches(c, '[。；，、.!?;,:]') or len(regexp_extract_all(c, '[一-鿿]')) >= 24))"
SHAPE = f"""{NORMAL},
k as (select id, r, coalesce(list_max(list_transform(r, lambda x: len(x))), 0) cols, list_filter(r, lambda x: len(list_filter(x, lambda c: c <> '')) >= 2) kept from n2),
c as (select *, list_filter(flatten(kept), lambda c: c <> '') cells from k),
s as (select id, len(r) n_rows, cols, len(kept) kept, len(list_filter(kept, lambda x: len(list_filter(x, lambda c: c <> '')) >= 3)) three, len(cells) / nullif(len(kept) * cols, 0) density,
  list_sum(list_transform(cells, lambda c: length(c))) / nullif(len(cells), 0) avg_chars, len(list_filter(cells, lambda c: length(c) <= 32)) / nullif(len(cells), 0) short_, len(list_filter(cells, lambda c: length(c) >= 56)) / nullif(len(cells), 0) long_,
  len(list_filter(cells, lambda c: regexp_matches(c, '\\d'))) / nullif(len(cells), 0) numeric_, len(list_filter(cells, lambda c: {PROSE})) / nullif(len(cells), 0) prose,
  len(list_filter(kept, lambda x: length(x[1]) <= 28 or x[1] like '%:' or x[1] like '%：')) / nullif(len(kept), 0) first_, list_sum(list_transform(cells, lambda c: length(c))) / nullif(len(kept), 0) row_chars from c)"""
shape = lambda f: lambda stats: F.round(F.try_add(stats[f].cast("double"), F.lit(0.0)), 6)
SOME = Fixture("id int, r array<array<string>>", [x for x in ROWS if x[0] not in (6, 9, 2, 1)], ITEMS)
scalar("a06_table_stats", SOME, f"with {SHAPE} select id, round(n_rows::double, 6) as n_rows, round(kept::double, 6) as kept, round(density, 6) as density, round(avg_chars, 6) as avg_chars, round(short_, 6) as short, round(long_, 6) as long, round(numeric_, 6) as numeric, round(prose, 6) as prose from s", once=lambda id, r: tb.shape(tb.normalise_rows(r)), **{f: shape(f) for f in ("n_rows", "kept", "density", "avg_chars", "short", "long", "numeric", "prose")})
PROBABLE = """coalesce(case when n_rows < 2 or cols < 2 or kept < 2 then false
  when cols >= 3 then kept >= 3 and three >= greatest(2, floor(kept * 0.35)) and density >= 0.55 and not (short_ < 0.45 and numeric_ < 0.18) and not (long_ > 0.45 and numeric_ < 0.18) and not (prose > 0.45 and numeric_ < 0.18) and not (avg_chars > 70 and numeric_ < 0.20)
  else kept >= 3 and density >= 0.65 and first_ >= 0.6 and row_chars <= 130 and (long_ <= 0.35 or numeric_ >= 0.15) and prose <= 0.5 end, false)"""
scalar("f18_probable_table", R, f"with {SHAPE} select id, {PROBABLE} as v from s", v=lambda id, r: tb.is_probable(r))
CELLS = Fixture("id int, c string", [(1, "x" * 40), (2, "a sentence, that is long enough to count here"), (3, "short."), (4, "中" * 36), (5, None), (6, "y" * 35 + ".")], (lambda t: LINES[0](t).withColumn("c", tx.strip(F.col("c"))), rf"select id, regexp_replace(c, '^\s+|\s+$', '', 'g') as c from ({LINES[1]})"))
scalar("f19_prose_cell", CELLS, f"select id, {PROSE.replace('length(c)', 'length(coalesce(c, chr(32)))')} is true as v from {{t}}", v=lambda id, c: tb.is_prose(c))
scalar("a09_table_key", R, f"with {NORMAL} select id, '7:' || md5({TEXT}) as v from n2", v=lambda id, r: tb.key(F.lit(7), tb.normalise_rows(r)))
scalar("x52_md5", CELLS, "select id, md5(c) as v from {t}", v=lambda id, c: F.md5(c))
scalar("x49_table_struct", R, "select id, 'ocr-table-3-' || id as v, 3 as page from {t}", v=lambda id, r: tb.table_struct(F.lit(3), id, r, F.lit("ocr"))["id"], page=lambda id, r: tb.table_struct(F.lit(3), id, r, F.lit("ocr"))["page"])
scalar("x51_body_text", R, "select id, case when id % 2 = 0 then 'md' when len(r) > 0 then array_to_string(list_transform(r, lambda x: array_to_string(list_transform(x, lambda c: coalesce(c, '')), chr(9))), chr(10)) end as v from {t}", v=lambda id, r: tb.body_text(F.when(id % 2 == 0, " md "), r))
MD = Fixture("id int, j string, m string", [(1, None, "| a | b |\n| --- | --- |\n| 1 | x\\|y |\nnot a row\n| , | \"q\" |"), (2, '{"rows":[["a","b,c"],[null,"d"]],"columns":["x"]}', None), (3, '{"table_json":{"columns":["p","q"],"rows":[{"q":"2","p":"1"},{"p":"3"}]}}', None), (4, '{"columns":["x"],"rows":[{"x":"1,5"}]}', "| z |"), (5, "not json", "|only|\n|:---:|"), (6, "raw", ""), (7, None, None), (8, '{"rows":[]}', None)])
MD_SQL = "array_to_string(list_transform(list_filter(list_transform(list_filter(list_transform(string_split(m, chr(10)), lambda x: trim(x)), lambda x: contains(x, '|')), lambda x: list_transform(string_split(regexp_replace(regexp_replace(x, '^\\|', ''), '\\|$', ''), '|'), lambda c: trim(c))), lambda x: len(list_filter(x, lambda c: not regexp_full_match(c, ':?-{3,}:?'))) > 0), lambda x: array_to_string(list_transform(x, lambda c: " + CSV_CELL + "), ',') || chr(10)), '')"
MARKDOWN = Fixture("id int, j string, m string", MD.rows, same_over("orders", "o_orderkey as id", "cast(null as string) as j", "concat('| key | st,atus |', chr(10), '|---|:---:|', chr(10), ' | ', cast(o_orderkey as string), ' | ', o_orderstatus, ' |', chr(10), 'no row', chr(10), '| \"', o_orderpriority, '\" |') as m"))
scalar("x44_markdown_csv", MARKDOWN, f"select id, case when coalesce(trim(m), '') = '' then '' else {MD_SQL} end as v from {{t}}", v=lambda id, j, m: tb.markdown_csv(m))
JSON_OUT = {2: 'a,"b,c"\n,d\n', 3: "p,q\n1,2\n3,\n", 4: 'x\n"1,5"\n'}
JSON_SQL = "case id " + " ".join(f"when {k} then '{v}'" for k, v in JSON_OUT.items()) + " else '' end"
scalar("x43_json_csv", MD, f"select id, {JSON_SQL} as v from {{t}}", v=lambda id, j, m: tb.json_csv(j))
scalar("x41_json_rows", MD, "select id, case id when 2 then 2 end as n from {t}", n=lambda id, j, m: F.when(id == 2, F.size(tb.json_rows(j))))
CSV_SQL = f"case when {JSON_SQL} <> '' then {JSON_SQL} when coalesce(trim(m), '') <> '' and {MD_SQL} <> '' then {MD_SQL} else coalesce(j, '') end"
scalar("x40_to_csv", MD, f"select id, {CSV_SQL} as v from {{t}}", v=lambda id, j, m: tb.to_csv(j, m))
scalar("k07_csv_export", MD, f"select id, 'doc-' || id || '-table-a_b.csv' as name, chr(65279) || {CSV_SQL} as body from {{t}}", name=lambda id, j, m: store.csv_export(id, F.lit("a/b"), j, m)["name"], body=lambda id, j, m: store.csv_export(id, F.lit("a/b"), j, m)["body"])

CELLS_OF = "[l_linenumber::varchar, l_returnflag, l_linestatus, l_quantity::integer::varchar]"
query("x42_csv_lineitem", "select l_orderkey, string_agg(l_linenumber || ',' || l_returnflag || ',' || l_quantity::integer || chr(10), '' order by l_linenumber, l_partkey, l_suppkey, l_quantity) as csv from lineitem group by l_orderkey")(
    lambda t: t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.array(F.col("l_linenumber").cast("string"), "l_returnflag", F.col("l_quantity").cast("int").cast("string")).alias("r")))).alias("l")).select("l_orderkey", tb.csv_rows(F.transform("l", lambda x: x["r"])).alias("csv"))
)
query("x46_markdown_orders", "select o_custkey, '| id | status |' || chr(10) || '| --- | --- |' || string_agg(chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || ' |', '' order by o_orderkey) as md from orders group by o_custkey")(
    lambda t: t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.array(F.lpad(F.col("o_orderkey").cast("string"), 20, "0"), F.col("o_orderkey").cast("string"), "o_orderstatus"))).alias("l")).select("o_custkey", tb.markdown(F.concat(F.array(F.array(F.lit("id"), F.lit("status"))), F.transform("l", lambda x: F.slice(x, 2, 2)))).alias("md"))
)
A, B = Fixture("doc_id int, ord int, page int, rows array<array<string>>", [(1, 0, 1, [["a", "b"], ["c", "d"]]), (1, 1, 1, [["x", ""], ["y", ""]])]), Fixture("doc_id int, ord int, page int, rows array<array<string>>", [(1, 0, 1, [[" a", "b "], ["c", "d"]]), (1, 1, 2, [["a", "b"], ["c", "d"]]), (2, 0, 1, [["", ""]]), (1, 2, 1, [["x"], ["y"]])])
as_tables = lambda df, source: df.withColumns({"id": F.concat_ws("-", F.lit(source), "ord"), "markdown": F.lit(""), "html": F.lit(None).cast("string"), "title": F.lit(None).cast("string"), "source": F.lit(source)})
query("u01_merge_tables", "select * from (values (1, 1, 'pdf-0', 'a b|c d'), (1, 1, 'pdf-1', 'x|y'), (1, 2, 'ocr-1', 'a b|c d')) t(doc_id, page, id, v)")(
    lambda t: infer.merge_tables(as_tables(A.df(t), "pdf"), as_tables(B.df(t), "ocr")).select("doc_id", "page", "id", F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "|").alias("v"))
)
query("f27_tables_of_page", "select l_orderkey, count(*) as n from lineitem where l_linenumber = 2 group by 1")(lambda t: t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("tables")).select("l_orderkey", F.size(F.filter("tables", lambda x: x["l_linenumber"] == 2)).cast("long").alias("n")).where("n > 0"))
STRAT = Fixture("seq int, v string, h string", [(s["seq"], s["vertical"], s["horizontal"]) for s in infer.STRATEGIES])
scalar("f23_requires_caption", STRAT, "select seq, coalesce(v = 'text' and h = 'text', false) as r from {t}", r=lambda s, v, h: infer.requires_caption(v, h))
query("s05_strategies", "select * from (values (0, null, null), (1, 'lines', 'lines'), (2, 'text', 'text'), (3, 'lines', 'text'), (4, 'text', 'lines')) t(seq, vertical, horizontal)")(lambda t: t.spark.createDataFrame(infer.STRATEGIES, "seq int, vertical string, horizontal string"))
FOUND = Fixture("doc_id int, page int, table_no int, top double, bottom double", [(1, 1, 1, 200.0, 300.0), (1, 1, 2, 500.0, 600.0), (1, 2, 1, 50.0, 90.0), (2, 1, 1, 10.0, 20.0)])
WORDS = Fixture("doc_id int, page int, text string, top double, bottom double", [(1, 1, "表 3 数据", 180.0, 195.0), (1, 1, "Table 4", 650.0, 656.0), (1, 2, "Table x", 60.0, 70.0), (2, 1, " table 12", 22.0, 30.0)])
query(
    "j10_near_caption",
    rf"select doc_id, page, table_no, top, bottom from {FOUND.sql} f where exists (select 1 from {WORDS.sql} w where w.doc_id = f.doc_id and w.page = f.page and regexp_matches(w.text, '(?im)^\s*(表|table)\s*[\d一二三四五六七八九十]+') and ((w.top >= greatest(0, f.top - 90) and w.bottom <= least(800, f.top + 18)) or (w.top >= greatest(0, f.bottom - 8) and w.bottom <= least(800, f.bottom + 55))))",
)(lambda t: infer.near_caption(FOUND.df(t), WORDS.df(t), FOUND.df(t).select("doc_id", "page", F.lit(800.0).alias("height")).distinct()))


def grid_lines(t):
    """Lines of invented pages: every order is a document whose items are rows of four cells, jittered by a few points."""
    cell = lambda text, x, i: F.struct(F.lit(i).alias("i"), text.cast("string").alias("text"), F.lit(float(x)).alias("x"))
    cells = F.array(cell(F.col("l_linenumber"), 20, 0), cell(F.col("l_returnflag"), 200, 1), cell(F.col("l_quantity").cast("int"), 380, 2), cell(F.col("l_linestatus"), 560, 3))
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.explode(cells).alias("c"))
    y = F.col("n") * 30 + (F.col("doc_id") % 5)
    x = F.col("c.x") + F.col("n") % 3
    box = F.array(F.array(x, y), F.array(x + 60, y), F.array(x + 60, y + 14), F.array(x, y + 14))
    return rows.select("doc_id", F.lit(1).alias("page_no"), (F.col("n") * 4 + F.col("c.i")).alias("line_no"), F.col("c.text").alias("text"), F.lit(0.9).alias("score"), box.alias("bbox"))


def inferred(t):
    return infer.infer_tables(grid_lines(t)).select("doc_id", "id", "page", F.size("rows").alias("n_rows"), F.md5("markdown").alias("markdown_md5"))


# The grid's rows lie 30 apart and its columns 180, so a row is a line number and an anchor a column; what is left to follow are
# the blocks, which end where the step down is far over the usual.
GRID = """g as (select l_orderkey doc_id, l_linenumber n, [string_agg(l_linenumber::varchar, ' ' order by l_linenumber::varchar), string_agg(l_returnflag, ' ' order by l_returnflag),
    string_agg(l_quantity::integer::varchar, ' ' order by l_quantity::integer::varchar), string_agg(l_linestatus, ' ' order by l_linestatus)] cells from lineitem group by 1, 2),
  s as (select *, 30.0 * (n - lag(n) over (partition by doc_id order by n)) step from g),
  m as (select doc_id, greatest(45, least(100, 2.6 * coalesce(median(step), 30))) most from s group by 1),
  b as (select s.*, sum(case when step > most then 1 else 0 end) over (partition by s.doc_id order by n) block from s join m on m.doc_id = s.doc_id),
  tables as (select doc_id, block, count(*)::integer n_rows, list('| ' || array_to_string(cells, ' | ') || ' |' order by n) md from b group by 1, 2 having count(*) > 2),
  found as (select *, row_number() over (partition by doc_id order by block) seq from tables)"""
query("x50_infer_tables", f"with {GRID} select doc_id, 'ocr-table-1-' || seq id, 1 page, n_rows, md5(md[1] || chr(10) || '| --- | --- | --- | --- |' || chr(10) || array_to_string(md[2:], chr(10))) markdown_md5 from found")(inferred)


def wide_lines(t):
    """Lines of invented pages: a row for each item of an order with up to twelve cells, some left out, each moved to one of four places."""
    place = lambda i: i * 75.0 + ((F.col("l_partkey") + i) % 4) * 9
    cells = F.transform(F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: (F.col("l_suppkey") + i) % 4 != 0), lambda i: F.struct(i.alias("i"), place(i).alias("x")))
    rows = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.explode(cells).alias("c"))
    x, y = F.col("c.x"), F.col("n") * 30.0
    box = F.array(F.array(x, y), F.array(x + 40, y), F.array(x + 40, y + 14), F.array(x, y + 14))
    return rows.select("doc_id", F.lit(1).alias("page_no"), (F.col("n") * 12 + F.col("c.i")).alias("line_no"), F.concat(F.lit("v"), F.col("c.i").cast("string")).alias("text"), F.lit(0.9).alias("score"), box.alias("bbox"))


# anchors are moving means of the places from left to right, so SQL goes through them one by one
ANCHORS = """c as (select l_orderkey doc_id, l_linenumber n, i * 75.0::double + ((l_partkey + i) % 4) * 9 x from lineitem, unnest(range(0, 12)) u(i) where (l_suppkey + i) % 4 <> 0),
  g as (select distinct doc_id, n from c),
  s as (select *, 30.0 * (n - lag(n) over (partition by doc_id order by n)) step from g),
  m as (select doc_id, greatest(45, least(100, 2.6 * coalesce(median(step), 30))) most from s group by 1),
  b as (select s.doc_id, n, sum(case when step > most then 1 else 0 end) over (partition by s.doc_id order by n) part from s join m on m.doc_id = s.doc_id),
  k as (select doc_id, part, row_number() over (partition by doc_id order by part) - 1 block from (select doc_id, part from b group by 1, 2 having count(*) > 2)),
  xs as (select c.doc_id, k.block, list(x::double order by x) xs from c join b on b.doc_id = c.doc_id and b.n = c.n join k on k.doc_id = b.doc_id and k.part = b.part group by 1, 2),
  r as (select doc_id, block, xs, greatest(28, least(60, 0.05 * (xs[-1] - xs[1]))) tol, 1 i, [xs[1]] means, [1] size from xs
    union all select doc_id, block, xs, tol, i + 1,
      case when hit then list_transform(means, lambda a, j: case when j = p then a + (v - a) / (size[j] + 1) else a end) else list_append(means, v) end,
      case when hit then list_transform(size, lambda z, j: case when j = p then z + 1 else z end) else list_append(size, 1) end
    from (select *, list_position(d, list_min(d)) p, list_min(d) <= tol hit from (select *, xs[i + 1] v, list_transform(means, lambda a: abs(xs[i + 1] - a)) d from r where i < len(xs)))),
  best as (select doc_id, block, list_sort(list_transform(list_reverse_sort(list_transform(means, lambda a, j: {'n': size[j], 'x': a}))[1:8], lambda e: e.x)) e from r where i = len(xs))"""
query("o14_anchors", f"with recursive {ANCHORS} select doc_id, block::integer block, len(e)::integer n, array_to_string(list_transform(e, lambda x: (round(x * 1000))::bigint), ',') anchors from best")(
    lambda t: infer.block_anchors(wide_lines(t)).select("doc_id", "block", F.size("anchors").alias("n"), F.array_join(F.transform("anchors", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("anchors"))
)
query("j11_row_clusters", "select l_orderkey as doc_id, count(distinct l_linenumber) as n_rows from lineitem group by 1 having count(distinct l_linenumber) >= 3 and count(*) = count(distinct l_linenumber) and max(l_linenumber) = count(*)")(
    lambda t: infer.infer_tables(grid_lines(t).join(t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_distinct("l_linenumber").alias("d"), F.count("*").alias("n"), F.max("l_linenumber").alias("m")).where("d = n and d >= 3 and m = n"), "doc_id", "left_semi")).groupBy("doc_id").agg(F.sum(F.size("rows")).alias("n_rows"))
)
query("j09_cells_by_anchor", "select l_orderkey as doc_id, string_agg(l_linenumber || ' ' || l_returnflag || ' ' || l_quantity::integer || ' ' || l_linestatus, '|' order by l_linenumber) as cells from lineitem group by 1 having count(distinct l_linenumber) >= 3 and count(*) = count(distinct l_linenumber) and max(l_linenumber) = count(*)")(
    lambda t: infer.infer_tables(grid_lines(t).join(t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count_distinct("l_linenumber").alias("d"), F.count("*").alias("n"), F.max("l_linenumber").alias("m")).where("d = n and d >= 3 and m = n"), "doc_id", "left_semi")).select("doc_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, " ")), "|").alias("cells"))
)
query("u06_tables_of_all_pages", f"with {GRID} select doc_id, count(*) n from found group by 1")(lambda t: infer.infer_tables(grid_lines(t)).groupBy("doc_id").agg(F.count("*").alias("n")))
query("a13_column_anchors", f"with {GRID} select doc_id, len(cells) n_cols from (select doc_id, (select any_value(cells) from g where g.doc_id = found.doc_id) cells from found)")(lambda t: infer.infer_tables(grid_lines(t)).select("doc_id", F.size(F.get("rows", 0)).cast("long").alias("n_cols")))
query("g03_table_boxes", "select l_orderkey as doc_id, count(*) * 4 as n, sum(l_linenumber * 30 + l_orderkey % 5)::double as top from lineitem group by 1")(lambda t: infer.boxes(grid_lines(t)).groupBy("doc_id").agg(F.count("*").alias("n"), (F.sum("y0") / 4).alias("top")))
