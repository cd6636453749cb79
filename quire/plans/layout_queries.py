"""Queries of page layout: geometry, columns, order, filters, stitching, page texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import text as tx
from quire.operators import layout
from quire.plans.registry import Fixture, query, scalar
from quire.plans.text_queries import CLEAN, DROP_SQL, RAG, RAG_GENERAL, RAG_NOTICE

BOXES_OF_ITEMS = (
    lambda t: t.lineitem.select(F.col("l_orderkey").alias("id"), F.array(*(F.array(x, y) for x, y in ((F.col("l_quantity") / 4, F.col("l_linenumber") * 1.5), (F.col("l_quantity") / 4 + F.col("l_linenumber") % 3, F.col("l_linenumber") * 1.5 + 7), (-F.col("l_quantity") / 2, F.lit(2.5))))).alias("b")),
    "select l_orderkey as id, [[l_quantity / 4, l_linenumber * 1.5::double], [l_quantity / 4 + l_linenumber % 3, l_linenumber * 1.5::double + 7], [-l_quantity / 2, 2.5::double]] as b from lineitem",
)
BOXES = Fixture("id int, b array<array<double>>", [(1, [[1.0, 2.0], [5.0, 2.0], [5.0, 8.0], [1.0, 8.0]]), (2, [[0.5, 1.5], [2.5, 1.5], [2.5, 1.5], [0.5, 1.5]]), (3, [[-1.0, 0.0], [3.0, 4.0], [0.0, 9.5], [2.0, 2.0]])], BOXES_OF_ITEMS)
XS, YS = "list_transform(b, lambda p: p[1])", "list_transform(b, lambda p: p[2])"
scalar("g01_rect", BOXES, f"select id, list_min({XS}) as l, list_min({YS}) as t, list_max({XS}) as r, list_max({YS}) as bt from {{t}}", l=lambda id, b: geo.rect(b)["left"], t=lambda id, b: geo.rect(b)["top"], r=lambda id, b: geo.rect(b)["right"], bt=lambda id, b: geo.rect(b)["bottom"])
_line = lambda b: layout.with_geometry(F.struct(F.lit(1).alias("line_no"), F.lit("t").alias("text"), F.lit(1.0).alias("score"), b.alias("bbox")))
scalar("g02_line_geometry", BOXES, f"select id, greatest(1.0, list_max({XS}) - list_min({XS}))::double as w, greatest(1.0, list_max({YS}) - list_min({YS}))::double as h, (list_max({XS}) + list_min({XS})) / 2 as cx, (list_max({YS}) + list_min({YS})) / 2 as cy from {{t}}", w=lambda id, b: _line(b)["width"], h=lambda id, b: _line(b)["height"], cx=lambda id, b: _line(b)["center_x"], cy=lambda id, b: _line(b)["center_y"])
scalar("p12_rounded_boxes", BOXES, f"select id, array_to_string(list_transform(flatten(b), lambda v: round_even(v, 0)::integer::varchar), ',') as v from {{t}}", v=lambda id, b: F.array_join(F.flatten(geo.rounded_box(b)).cast("array<string>"), ","))
scalar("f12_degenerate_boxes", BOXES, f"select id, list_max({XS}) > list_min({XS}) and list_max({YS}) > list_min({YS}) as v from {{t}}", v=lambda id, b: (geo.rect(b)["right"] > geo.rect(b)["left"]) & (geo.rect(b)["bottom"] > geo.rect(b)["top"]))
scalar("g07_scaled_rects", BOXES, f"select id, list_min({XS}) * 0.5 as l, list_min({YS}) * 2 as t, (list_max({XS}) - list_min({XS})) * 0.5 as w, (list_max({YS}) - list_min({YS})) * 2 as h from {{t}}", l=lambda id, b: geo.scaled_rect(b, F.lit(0.5), F.lit(2.0))["left"], t=lambda id, b: geo.scaled_rect(b, F.lit(0.5), F.lit(2.0))["top"], w=lambda id, b: geo.scaled_rect(b, F.lit(0.5), F.lit(2.0))["width"], h=lambda id, b: geo.scaled_rect(b, F.lit(0.5), F.lit(2.0))["height"])
query("g08_clamp", "select l_orderkey, l_linenumber, greatest(5.0, least(20.0, l_quantity))::double as v from lineitem")(lambda t: t.lineitem.select("l_orderkey", "l_linenumber", geo.clamp(F.col("l_quantity"), 5.0, 20.0).alias("v")))
query("g04_tolerances", "select l_partkey, greatest(8.0, least(24.0, median(l_quantity) * 0.75))::double as v from lineitem group by 1")(lambda t: t.lineitem.groupBy("l_partkey").agg(geo.clamp(F.median("l_quantity") * 0.75, 8.0, 24.0).alias("v")))
query("a05_median", "select l_suppkey, median(l_quantity) as v from lineitem group by 1")(lambda t: t.lineitem.groupBy("l_suppkey").agg(F.median("l_quantity").alias("v")))

# Pages of invented lines: a document's lines one below the other, in one or (every third document) two columns.



def page_lines(t):
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    two = (F.col("doc_id") % 3 == 0) & (F.col("i") % 2 == 1)
    left = F.when(two, 420.0).otherwise(20.0)
    top = F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("i") / 2) * 30.0).otherwise(F.col("i") * 30.0).cast("double")
    box = F.array(F.array(left, top), F.array(left + 340, top), F.array(left + 340, top + 16), F.array(left, top + 16))
    return rows.select(F.col("doc_id"), F.lit(1).alias("page_no"), F.col("i").alias("line_no"), "text", (0.1 + (F.col("i") % 10) / 10).alias("score"), box.alias("bbox"))


P = r"""lines as (select doc_id, i, regexp_replace(ls[i + 1], '^\s+|\s+$', '', 'g') text, case when doc_id % 3 = 0 and i % 2 = 1 then 420.0 else 20.0 end::double x, case when doc_id % 3 = 0 then floor(i / 2) * 30.0 else i * 30.0 end::double y, 0.1 + (i % 10) / 10 score
  from (select doc_id, string_split(text, chr(10)) ls, unnest(range(0, len(string_split(text, chr(10))))) i from documents)),
f as (select *, x + 170 cx, y + 8 cy from lines where text <> '')"""
pages = lambda t: layout.detect(layout.gather(page_lines(t)))
in_one = lambda t: layout.single(pages(t), "lines", "one")
by_mode = lambda t, mode: layout.order(layout.gather(page_lines(t)).withColumn("mode", F.lit(mode)))
query("f11_lines_with_text", f"with {P} select doc_id, count(*) as n from f group by 1")(lambda t: pages(t).select("doc_id", F.size("lines").cast("long").alias("n")).where("n > 0"))
query("a07_line_counts", f"with {P} select doc_id, count(*) as lines, count(*) filter (text <> '') as kept from lines group by 1")(lambda t: pages(t).select("doc_id", F.col("line_count").alias("lines"), F.size("lines").cast("long").alias("kept")))
query("x02_raw_text", f"with {P} select doc_id, md5(string_agg(text, chr(10) order by i)) as h from f group by 1")(lambda t: pages(t).where("raw_text <> ''").select("doc_id", F.md5("raw_text").alias("h")))
query("a02_page_metrics", f"with {P} select doc_id, min(x) as l, max(x + 340) as r, greatest(1.0, max(x + 340) - min(x))::double as w, 16.0::double as mh, 340.0::double as mw from f group by 1")(lambda t: pages(t).where(F.size("lines") > 0).select("doc_id", *(F.col("m")[a].alias(b) for a, b in (("page_left", "l"), ("page_right", "r"), ("page_width", "w"), ("median_height", "mh"), ("median_width", "mw")))))
query("a03_page_extents", f"with {P} select doc_id, min(y) as t, max(y + 16) as b from f group by 1")(lambda t: pages(t).where(F.size("lines") > 0).select("doc_id", F.array_min(F.transform("lines", lambda x: x["top"])).alias("t"), F.array_max(F.transform("lines", lambda x: x["bottom"])).alias("b")))
TWO = f"""{P}, w as (select doc_id, greatest(1.0, max(x + 340) - min(x)) pw, count(*) n from f group by 1),
g as (select f.doc_id, cx, n, pw, lead(cx) over (partition by f.doc_id order by cx) - cx gap, row_number() over (partition by f.doc_id order by cx) k, count(*) over (partition by f.doc_id) m from f join w on w.doc_id = f.doc_id where 340 between 0.18 * pw and 0.65 * pw),
b as (select doc_id, n, pw, m, max(gap) gap, arg_min(k, (-gap, k)) k from g where gap is not null group by all),
two as (select w.doc_id, coalesce(b.n >= 12 and m >= 8 and gap >= pw_ * 0.12 and k >= 3 and m - k >= 3, false) v from (select doc_id, pw pw_ from w) w left join b on b.doc_id = w.doc_id)"""
query("f21_two_columns", f"with {TWO} select doc_id, v from two")(lambda t: pages(t).where(F.size("lines") > 0).select("doc_id", F.col("two").alias("v")))
query("f22_two_column_pages", f"with {TWO} select v, count(*) as n from two group by 1")(lambda t: pages(t).where(F.size("lines") > 0).groupBy(F.col("two").alias("v")).agg(F.count("*").alias("n")))
query("w01_center_gaps", f"with {P} select doc_id, max(gap) as gap from (select doc_id, lead(cx) over (partition by doc_id order by cx) - cx gap from f) group by 1 having max(gap) is not null")(lambda t: pages(t).select("doc_id", layout.widest_gap(F.array_sort(F.transform("lines", lambda x: x["center_x"])))["gap"].alias("gap")).where("gap is not null"))
query("a12_widest_gap", f"with {P}, g as (select doc_id, cx, lead(cx) over (partition by doc_id order by cx) n from f) select doc_id, max(n - cx) as gap, arg_max((n + cx) / 2, n - cx) as split from g where n is not null group by 1 having max(n - cx) > 0")(lambda t: pages(t).select("doc_id", layout.widest_gap(F.array_sort(F.transform("lines", lambda x: x["center_x"]))).alias("g")).where("g.gap > 0").select("doc_id", "g.gap", "g.split"))
joined = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x["line_no"].cast("string")), ","))
query("o06_single_column", f"with {P} select doc_id, md5(string_agg(i::varchar, ',' order by y, x, i)) as h from f group by 1")(lambda t: in_one(t).where(F.size("lines") > 0).select("doc_id", joined(F.col("one")).alias("h")))
query("o09_notice_order", f"with {P} select doc_id, md5(string_agg(i::varchar, ',' order by y, x, i)) as h from f group by 1")(lambda t: by_mode(t, "notice").where(F.size("lines") > 0).select("doc_id", joined(F.col("in_order")).alias("h")))
query("w03_row_groups", f"with {P} select doc_id, count(distinct y) as n from f group by 1")(lambda t: in_one(t).where(F.size("lines") > 0).select("doc_id", (F.array_max("one_rows") + 1).cast("long").alias("n")))
query("a04_row_means", f"with {P} select doc_id, max(c) as n from (select doc_id, y, count(*) c from f group by 1, 2) group by 1")(lambda t: in_one(t).where(F.size("lines") > 0).select("doc_id", F.explode("one_rows").alias("r")).groupBy("doc_id", "r").count().groupBy("doc_id").agg(F.max("count").alias("n")))
BANDS = f"{P}, e as (select doc_id, min(y) t, max(y + 16) b from f group by 1), z as (select f.*, y + 16 <= t + greatest(1.0, b - t) * 0.18 header, y >= b - greatest(1.0, b - t) * 0.12 footer from f join e on e.doc_id = f.doc_id)"


def bands(t):
    top, bottom = F.array_min(F.transform("lines", lambda x: x["top"])), F.array_max(F.transform("lines", lambda x: x["bottom"]))
    h = F.greatest(F.lit(1.0), bottom - top)
    rows = pages(t).where(F.size("lines") > 0).select("doc_id", top.alias("t"), bottom.alias("b"), h.alias("h"), F.explode("lines").alias("x"))
    return rows.select("doc_id", (F.col("x.bottom") <= F.col("t") + F.col("h") * 0.18).alias("header"), (F.col("x.top") >= F.col("b") - F.col("h") * 0.12).alias("footer"))


query("o10_header_footer", f"with {BANDS} select doc_id, count(*) filter (header) as header, count(*) filter (footer) as footer, count(*) filter (not header and not footer) as body from z group by 1")(lambda t: bands(t).groupBy("doc_id").agg(F.count_if("header").alias("header"), F.count_if("footer").alias("footer"), F.count_if(~F.col("header") & ~F.col("footer")).alias("body")))
query("u05_body_lines", f"with {BANDS} select doc_id, count(*) as n from z where not header and not footer group by 1")(lambda t: bands(t).where(~F.col("header") & ~F.col("footer")).groupBy("doc_id").agg(F.count("*").alias("n")))
query("o11_full_width", f"with {P} select doc_id, count(*) filter (340 >= 0.72 * w) as full, count(*) filter (340 < 0.72 * w) as narrow from (select *, greatest(1.0, max(x + 340) over (partition by doc_id) - min(x) over (partition by doc_id)) w from f) group by 1")(lambda t: pages(t).where(F.size("lines") > 0).select("doc_id", F.col("m.page_width").alias("w"), F.explode("lines").alias("x")).groupBy("doc_id").agg(F.count_if(F.col("x.width") >= 0.72 * F.col("w")).alias("full"), F.count_if(F.col("x.width") < 0.72 * F.col("w")).alias("narrow")))
query("o12_column_split", f"with {P}, c as (select *, max(x) over (partition by doc_id) - min(x) over (partition by doc_id) d, (max(cx) over (partition by doc_id) + min(cx) over (partition by doc_id)) / 2 s from f) select doc_id, count(*) filter (cx <= s) as l, count(*) filter (cx > s) as r from c where d > 0 group by 1")(
    lambda t: pages(t).select("doc_id", layout.widest_gap(F.array_sort(F.transform("lines", lambda x: x["center_x"]))).alias("g"), "lines").where("g.gap > 0").select("doc_id", F.size(F.filter("lines", lambda x: x["center_x"] <= F.col("g.split"))).cast("long").alias("l"), F.size(F.filter("lines", lambda x: x["center_x"] > F.col("g.split"))).cast("long").alias("r"))
)
COLUMNS = f"{TWO}, e2 as (select doc_id, min(y) t, max(y + 16) b from f group by 1), r as (select f.doc_id, i, x, y, case when y + 16 <= t + greatest(1.0, b - t) * 0.18 then 0 when y >= b - greatest(1.0, b - t) * 0.12 then 3 when x < 400 then 1 else 2 end region from f join e2 on e2.doc_id = f.doc_id join two on two.doc_id = f.doc_id where two.v)"
query("o07_two_columns", f"with {COLUMNS} select doc_id, md5(string_agg(i::varchar, ',' order by region, y, x, i)) as h from r group by 1")(lambda t: layout.two_columns(pages(t).where("two"), "both").select("doc_id", joined(F.col("both")).alias("h")))
query("o08_reading_order", f"with {COLUMNS} select doc_id, md5(string_agg(i::varchar, ',' order by region, y, x, i)) as h from r group by 1 union all select f.doc_id, md5(string_agg(i::varchar, ',' order by y, x, i)) from f join two on two.doc_id = f.doc_id where not two.v group by 1")(lambda t: by_mode(t, "general").where(F.size("lines") > 0).select("doc_id", joined(F.col("in_order")).alias("h")))
query("f06_score_threshold", f"with {P} select doc_id, count(*) filter (score >= 0.35) as paper, count(*) filter (score >= 0.15) as general from f group by 1")(lambda t: pages(t).select("doc_id", F.explode("lines").alias("x")).groupBy("doc_id").agg(F.count_if(F.col("x.score") >= F.lit(layout.MIN_SCORE)).alias("paper"), F.count_if(F.col("x.score") >= F.least(F.lit(layout.MIN_SCORE), F.lit(layout.GENERAL_SCORE))).alias("general")))
NOISE = ", ".join("'" + g.replace("'", "''") + "'" for g in tx.NOISE_GLYPHS)
query("f05_filter_lines", rf"with {P} select doc_id, count(*) as n from f where score >= 0.15 and not regexp_full_match(text, '[-·\s]*\d+[-·\s]*') and not (text in ({NOISE})) and not (regexp_matches(text, '(?i)^https?://\S+$') and length(text) > 30) group by 1")(lambda t: pages(t).select("doc_id", F.size(F.filter("lines", lambda x: layout.keeps_line(x, F.lit("general")))).cast("long").alias("n")).where("n > 0"))
query("w02_stitch", f"with {P} select doc_id, md5(regexp_replace(string_agg(case when i = first_ then '' when y = prev then ' ' when y - (prev + 16) > 19.2 then chr(10) || chr(10) else chr(10) end || text, '' order by y, x, i), '^\\s+|\\s+$', '', 'g')) as h from (select *, lag(y) over (partition by doc_id order by y, x, i) prev, first_value(i) over (partition by doc_id order by y, x, i) first_ from f) group by 1")(lambda t: in_one(t).where(F.size("lines") > 0).select("doc_id", F.md5(layout.stitch(F.col("one"))).alias("h")))
modes = lambda t: t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "general").otherwise("notice").alias("clean_mode"))
parsed = lambda t: layout.parse_pages(page_lines(t), modes(t))
query("p09_page_results", f"with {P} select doc_id, 1 as page, case when doc_id % 2 = 0 then 'general' else 'notice' end as clean_mode, count(*) as ocr_line_count from lines group by 1")(lambda t: parsed(t).select("doc_id", "page", "clean_mode", "ocr_line_count"))
# the whole way of a page: order, filter, stitching, then the texts of text_queries
PARSED = rf"""{COLUMNS}, d as (select f.*, case when f.doc_id % 2 = 0 then 'general' else 'notice' end mode from f),
  o as (select d.*, case when mode = 'notice' then 0 else coalesce(r.region, 0) end region from d left join r on r.doc_id = d.doc_id and r.i = d.i),
  kept as (select *, row_number() over (partition by doc_id order by region, y, x, i) k, lag(y) over (partition by doc_id order by region, y, x, i) prev from (
    select o.*, text s, mode m from o) q where score >= case when mode = 'general' then 0.15 else 0.35 end and not regexp_full_match(text, '[-·\s]*\d+[-·\s]*') and not (text in ({NOISE})) and not ({DROP_SQL})),
  t as (select doc_id id, case when doc_id % 2 = 0 then 'general' else 'notice' end as mode, n,
    regexp_replace(replace(coalesce(s, ''), chr(10) || chr(10) || chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') as t
    from (select distinct doc_id from lines) left join (select doc_id, count(*) n, string_agg(case when k = 1 then '' when y = prev then ' ' when y - (prev + 16) > 19.2 then chr(10) || chr(10) else chr(10) end || text, '' order by k) s from kept group by 1) using (doc_id)),
  shown as (select id, {CLEAN} v from t),
  rag as (select id, {RAG} v from (select id, case when mode = 'general' then {RAG_GENERAL} else {RAG_NOTICE} end r from (select id, mode, {CLEAN} c from t)))"""
query("p08_parse_payload", f"with {PARSED} select t.id doc_id, md5(shown.v) display, md5(rag.v) rag, t.mode <> 'notice' and coalesce(two.v, false) is_two_column, coalesce(n, 0) filtered_line_count from t join shown on shown.id = t.id join rag on rag.id = t.id left join two on two.doc_id = t.id")(lambda t: parsed(t).select("doc_id", F.md5("display_text").alias("display"), F.md5("clean_text_for_rag").alias("rag"), "is_two_column", "filtered_line_count"))
query("x05_display_of_lines", f"with {PARSED} select id doc_id, length(v)::integer n, md5(v) h from shown")(lambda t: parsed(t).select("doc_id", F.length("display_text").alias("n"), F.md5("display_text").alias("h")))
query("x06_rag_of_lines", f"with {PARSED} select id doc_id, length(v)::integer n, md5(v) h from rag")(lambda t: parsed(t).select("doc_id", F.length("clean_text_for_rag").alias("n"), F.md5("clean_text_for_rag").alias("h")))
query("a01_merge_pages", "select conv_id, md5(regexp_replace(coalesce(string_agg(s, chr(10) || chr(10) order by turn, s) filter (s <> ''), ''), '^\\s+|\\s+$', '', 'g')) as h from (select conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') s from conversations) group by 1")(
    lambda t: layout.merge_pages(t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("text").alias("display_text"))).select(F.col("doc_id").alias("conv_id"), F.md5("text").alias("h"))
)
