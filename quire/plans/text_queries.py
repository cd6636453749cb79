"""Queries of the text, metadata and small scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import meta as mt
from quire.functions import text as tx
from quire.plans.registry import Fixture, query, same_over, scalar

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
strip_sql = lambda x: STRIP.replace("{x}", x)
sub = lambda x, pattern, to: f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
NL = "' || chr(10) || '"
tidy = lambda x: strip_sql(sub(sub(x, r"\n{3,}", NL * 2), r"[ \t]+\n", NL))

TEXTS = [
    (1, "  Computer Era 2024\n基于深度学习的文档分析方法\n张三 李四\n摘要：这是摘要内容。\n关键词：甲；乙\n\n\n\n正文ABC测试1 infor-\n mation here.  \n- 12 -\n图 3 架构\nFig. 2 shows\n第1章 引言\n一、背景说明\n***\n1234\n", "paper"),
    (2, "关于开展工作的通知\nhttps://example.org/a/b\n教务处\n2024/1/2 发布\n国办发〔2024〕 5号\n附件 1：名单\n--==--\n12a\n", "notice"),
    (3, "plain text   \n\n\n\nwith gaps  \nhttp://x.example.org\nDOI: 10.1/2\nend\t\n", "general"),
    (4, "", "general"),
    (5, "doi: 10.5\nvol. 3 no. 4\nAPI\nTCP/IP\na/b/c\nReferences\n[1] Some one\n2. [3] x\nWeb浏览器\n移动客户端\n表 1 数据。更多\n中图分类号：TP3\nlong enough English sentence that must stay here because it is long\n", "paper"),
    (6, "a\n\n\n\nb  \nc", "general"),
    (7, "copyright 2020\n计算机时代\n正常的一行\n第 3 卷 第 4 期\nMar., 2020\nJournal of Things\n1. 中文标题\n上文\n2、小标题\n", "paper"),
    (8, "https://a.example/very/long/path/that/goes/beyond/thirty\nshort\n通知正文\n", "notice"),
]
# whole texts in all three modes, and their lines
_MODE = "case doc_id % 3 when 0 then 'paper' when 1 then 'notice' else 'general' end as mode"
WHOLE = (
    lambda t: t.documents.selectExpr("doc_id as id", "text as t", _MODE),
    f"select doc_id as id, text as t, {_MODE} from documents",
)
BY_LINE = (
    lambda t: t.documents.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("t")),
    "select doc_id as id, unnest(string_split(text, chr(10))) as t from documents",
)
T = Fixture("id int, t string, mode string", TEXTS, WHOLE)
ONE = Fixture("id int, t string", [(i, t) for i, t in enumerate(["", " ", "口", "a", "7", "ab", ",", "—", "□", "-", "- 12 -", "·3·", "12a", "中", "  x  ", "!!", "12", "Computer Era", "doi: 1", "中图分类号：TP", "某某编辑部", "https://example.org", "https://example.org/" + "x" * 40, "关键词：doi 处理", "****", "--------------"])], BY_LINE)

scalar("x01_safe_text", ONE, f"select id, {strip_sql('t')} as v from {{t}}", v=lambda id, t: tx.safe_text(t))
scalar("f09_meaningful_token", ONE, f"""select id, s <> '' and (s in ({", ".join(f"'{g}'" for g in tx.KEPT_GLYPHS)}) or regexp_full_match(s, '[一-鿿]|[A-Za-z0-9]') or length(s) > 1) as v from (select id, {strip_sql('t')} s from {{t}})""", v=lambda id, t: tx.is_meaningful(t))
scalar("f10_kept_glyphs", ONE, f"""select id, {strip_sql('t')} in ({", ".join(f"'{g}'" for g in tx.KEPT_GLYPHS)}) as v from {{t}}""", v=lambda id, t: tx.strip(t).isin(tx.KEPT_GLYPHS))
scalar("f08_page_number_line", ONE, rf"select id, regexp_full_match({strip_sql('t')}, '[-·\s]*\d+[-·\s]*') as v from {{t}}", v=lambda id, t: tx.is_page_number(t))
scalar("f13_symbol_line", ONE, f"select id, s <> '' and length(s) <= 12 and not regexp_matches(s, '[一-鿿0-9A-Za-z]') as v from (select id, {strip_sql('t')} s from {{t}})", v=lambda id, t: tx.is_symbol_line(t))
DROP_SQL = r"""case when m = 'paper' then case when regexp_matches(s, '(?i)(cnki|doi:|doi\s|http|www\.|计算机时代|computer era|收稿日期|修回日期|基金项目|作者简介|版权声明|copyright)') then true
  when regexp_matches(s, '(?i)^\s*(中图分类号|文献标志码|文章编号|关键词|key words)\s*[:：]') then false
  else regexp_matches(s, '^(.*编辑部|.*杂志社)\s*$') and length(s) < 48 end
  when m = 'notice' then regexp_matches(s, '(?i)^https?://\S+$') else regexp_matches(s, '(?i)^https?://\S+$') and length(s) > 30 end"""
for _m in ("paper", "notice", "general"):
    scalar(f"f07_dropped_in_{_m}", ONE, f"select id, {DROP_SQL} as v from (select id, {strip_sql('t')} s, '{_m}' m from {{t}})", v=lambda id, t, m=_m: tx.dropped_by_mode(t, F.lit(m)))

DISPLAY = tidy(strip_sql("t"))
NUMBERS = sub(strip_sql("t"), r"(?m)^\s*[-·]?\s*\d+\s*[-·]?\s*$", "")
PAPER = NUMBERS
for _p in (
    r"(?im)^.*(cnki|doi|http|www\.|计算机时代|computer era|journal of|现代情报|收稿日期|修回日期|基金项目|作者简介|copyright).*$",
    r"(?im)^.*(第\s*\d+\s*卷|第\s*\d+\s*期|vol\.\s*\d+|no\.\s*\d+|mar\.,\s*\d{4}).*$",
    r"(?im)^\s*(图|表|Fig\.|FIG\.)\s*\d+.*$",
    r"(?im)^\s*[A-Z][A-Za-z0-9 ./-]{0,30}\s*$",
):
    PAPER = sub(PAPER, _p, "")
NOTICE = sub(NUMBERS, r"(?im)^https?://\S+$", "")
HEADINGS = lambda x: sub(sub(x, r"([^\n])\n(第[0-9一二三四五六七八九十百零两]+[章节编]\s)", r"\1" + NL * 2 + r"\2"), r"([^\n])\n((?:\d+|[一二三四五六七八九十]+)[、.．]\s*[一-龥])", r"\1" + NL * 2 + r"\2")
HYPHENS = lambda x: sub(x, r"([a-zA-Z])-\s*\n\s*([a-zA-Z])", r"\1\2")
SPACED = lambda x: f"array_to_string(list_transform(string_split({sub(sub(x, '([一-鿿])([A-Za-z0-9])', chr(92) + '1 ' + chr(92) + '2'), '([A-Za-z0-9])([一-鿿])', chr(92) + '1 ' + chr(92) + '2')}, chr(10)), lambda x: {sub(strip_sql('x'), ' +', ' ')}), chr(10))"


def _symbol(y: str) -> str:
    s = strip_sql(y)
    return f"{s} <> '' and length({s}) <= 12 and not regexp_matches({s}, '[一-鿿0-9A-Za-z]')"


def _clean(x: str) -> str:
    kept = f"array_to_string(list_transform(list_filter(string_split({x}, chr(10)), lambda y: not ({_symbol('y')})), lambda y: regexp_replace(y, '\\s+$', '')), chr(10))"
    return tidy(SPACED(HEADINGS(HYPHENS(sub(kept, r"\n{3,}", NL * 2)))))


CLEAN = f"case when mode = 'general' then {DISPLAY} when mode = 'paper' then {_clean(PAPER)} else {_clean(NOTICE)} end"
scalar("x03_display_general", T, f"select id, {DISPLAY} as v from {{t}}", v=lambda id, t, m: tx.display_general(t))
scalar("x07_clean_page", T, f"select id, {CLEAN} as v from {{t}}", v=lambda id, t, m: tx.clean_page(t, m))
scalar("x04_display_by_mode", T, f"select id, {CLEAN} as v from {{t}}", v=lambda id, t, m: tx.display_text(t, m))
scalar("x08_hyphens_fixture", T, f"select id, {HYPHENS('t')} as v from {{t}}", v=lambda id, t, m: tx.merge_hyphens(t))
scalar("x09_space_scripts", T, f"select id, {SPACED('t')} as v from {{t}}", v=lambda id, t, m: tx.space_scripts(t))
scalar("x10_heading_gaps", T, f"select id, {HEADINGS('t')} as v from {{t}}", v=lambda id, t, m: tx.heading_gaps(t))
JOURNAL = r"(?im)^.*(cnki|doi\s*:|http|www\.|计算机时代|computer era|收稿日期|修回日期|基金项目|作者简介|版权声明|copyright).*$"
scalar("x11_journal_lines", T, f"select id, {sub('t', JOURNAL, '')} as v from {{t}}", v=lambda id, t, m: tx.strip_journal_lines(t))


def _diagram(x: str, paper: bool) -> str:
    s = strip_sql("y")
    labels = ", ".join(f"'{g}'" for g in tx.DIAGRAM_LABELS)
    stays = rf"({s} = '' or regexp_matches({s}, '(?i)(参考文献|references|引用文献)\s*$') or regexp_matches({s}, '^\s*\[\d+\]') or regexp_matches({s}, '^\s*\d+[\.\s]+\[?\d+\]?'))"
    token = rf"(length({s}) <= 24 and regexp_matches({s}, '^\s*[A-Za-z0-9./\-–—]{{1,24}}\s*$') and (regexp_full_match({s}, '(?i)(json|tcp/ip|tcp|ip|http|https|xml|html|sql|api|web|mysql|oracle)') or (contains({s}, '/') and length({s}) <= 16)))"
    latin = rf"(length({s}) <= 18 and regexp_matches({s}, '^[A-Za-z./\-]+$'))"
    goes = f"not {stays} and ({s} in ({labels})" + (f" or {token} or {latin})" if paper else ")")
    return f"array_to_string(list_transform(list_filter(string_split({x}, chr(10)), lambda y: not ({goes})), lambda y: regexp_replace(y, '\\s+$', '')), chr(10))"


RAG_PAPER = sub(sub("c", r"(?im)^.*(中图分类号|文献标志码|文章编号|图表索引).*$", ""), r"(?im)^\s*(图|表|Fig\.|FIG\.)\s*\d+[^。]*$", "")
scalar("f14_diagram_lines", T, f"select id, case when mode = 'paper' then {_diagram('t', True)} else {_diagram('t', False)} end as v from {{t}}", v=lambda id, t, m: tx.strip_diagram_lines(t, m))
scalar("f15_diagram_labels", ONE, f"""select id, {strip_sql('t')} in ({", ".join(f"'{g}'" for g in tx.DIAGRAM_LABELS)}) as v from {{t}}""", v=lambda id, t: tx.strip(t).isin(tx.DIAGRAM_LABELS))
RAG, RAG_GENERAL, RAG_NOTICE = tidy("r"), _diagram(sub("c", JOURNAL, ""), False), _diagram("c", False)
scalar("x12_rag_text", T, f"select id, {RAG} as v from (select id, case when mode = 'general' then {RAG_GENERAL} when mode = 'paper' then {_diagram(RAG_PAPER, True)} else {RAG_NOTICE} end r from (select id, mode, {CLEAN} c from {{t}}))", v=lambda id, t, m: tx.rag_text(t, m))
MODES = Fixture("id int, v string, w string", [(1, " Paper ", None), (2, None, "notice"), (3, "", " "), (4, "other", "paper"), (5, "GENERAL", ""), (6, "yes", "x"), (7, "On", None), (8, "0", None), (9, " 1 ", None)], same_over("documents", "doc_id as id", "case doc_id % 6 when 0 then ' Paper ' when 1 then 'NOTICE' when 2 then lang when 3 then '' when 4 then 'yes' end as v", "case doc_id % 4 when 0 then ' ' when 1 then source when 2 then 'notice' end as w"))
scalar("x14_clean_mode", MODES, f"select id, case when lower({strip_sql('v')}) in ('paper', 'notice', 'general') then lower({strip_sql('v')}) else 'general' end as m from {{t}}", m=lambda id, v, w: tx.clean_mode(v))
scalar("x15_truthy", MODES, f"select id, coalesce(lower({strip_sql('v')}) in ('1', 'true', 'yes', 'on'), false) as m from {{t}}", m=lambda id, v, w: tx.truthy(v))
scalar("x24_first_non_blank", MODES, f"select id, case when {strip_sql('v')} <> '' then v when {strip_sql('w')} <> '' then w end as m from {{t}}", m=lambda id, v, w: tx.first_non_blank(v, w))
scalar("x32_effective_mode", MODES, f"select id, case when {strip_sql('v')} <> '' then trim(v) when {strip_sql('w')} <> '' then w else 'general' end as m from {{t}}", m=lambda id, v, w: tx.effective_mode(v, w))
PAIRS = Fixture("id int, a string, b string", [(1, "a b\nc", "abc"), (2, "ab", "a c"), (3, "", " "), (4, "中 文", "中文")], same_over("documents", "doc_id as id", "case when doc_id % 5 = 0 then '' else substring(text, 1, 60) end as a", "case when doc_id % 2 = 0 then replace(substring(text, 1, 60), ' ', '') else substring(text, 2, 60) end as b"))
scalar("x16_same_but_space", PAIRS, r"select id, regexp_replace(a, '\s+', '', 'g') = regexp_replace(b, '\s+', '', 'g') as v from {t}", v=lambda id, a, b: tx.same_but_space(a, b))
NUMBERED = Fixture("id int, page string, page_no string", [(1, "3", None), (2, None, "4"), (3, "x", "5"), (4, None, None), (5, " 7 ", None), (6, "3.9", None), (7, "-2", "1")], same_over("orders", "o_orderkey as id", "case o_orderkey % 5 when 0 then cast(o_orderkey as string) when 1 then ' 7 ' when 2 then 'x' when 3 then concat('-', cast(o_custkey as string), '.5') end as page", "case when o_orderkey % 3 = 0 then cast(o_custkey as string) end as page_no"))
scalar("x18_page_number", NUMBERED, f"select id, coalesce(case when regexp_full_match({strip_sql('coalesce(page, page_no)')}, '[+-]?[0-9]+') then {strip_sql('coalesce(page, page_no)')}::integer end, 0) as v from {{t}}", v=lambda id, p, n: tx.page_number(p, n))
scalar("x25_to_integer", NUMBERED, r"select id, case when regexp_full_match(page, '[+-]?[0-9]+') then page::integer when regexp_full_match(page, '[+-]?[0-9]+\.[0-9]*') then regexp_extract(page, '^([+-]?[0-9]+)', 1)::integer end as v from {t}", v=lambda id, p, n: tx.to_integer(p))
KEYED = same_over("documents", "doc_id as id", "text as t", "case doc_id % 4 when 0 then 'THE' when 1 then 'tion' when 2 then lang else 'nowhere' end as k")
SNIPPETS = Fixture("id int, t string, k string", [(1, "x" * 40 + "KEY" + "y" * 40, "key"), (2, "short key", "key"), (3, "z" * 130, "key"), (4, None, "key"), (5, "  ", "key"), (6, "<a> & key <b>", "a"), (7, "no", ""), (8, "中文关键词中文", "关键词"), (9, "aXbXc", "X")], KEYED)
SNIPPET = "case when t is null or trim(t) = '' then '' when instr(lower(t), lower(k)) = 0 then substring(t, 1, 100) || case when length(t) > 100 then '...' else '' end else case when p > 30 then '...' else '' end || substring(t, greatest(0, p - 30) + 1, least(length(t), p + length(k) + 30) - greatest(0, p - 30)) || case when p + length(k) + 30 < length(t) then '...' else '' end end"
scalar("x19_snippet", Fixture("id int, t string, k string", [r for r in SNIPPETS.rows if r[2]], KEYED), f"select id, {SNIPPET} as v from (select *, instr(lower(t), lower(k)) - 1 p from {{t}})", v=lambda id, t, k: tx.snippet(t, k))
scalar("f04_contains_keyword", SNIPPETS, "select id, coalesce(trim(t) <> '' and trim(k) <> '' and contains(lower(t), lower(k)), false) as v from {t}", v=lambda id, t, k: tx.contains_keyword(t, k))
scalar("x20_highlight", SNIPPETS, "select id, '<pre>' || case when trim(k) = '' then e else replace(e, trim(k), '<mark>' || trim(k) || '</mark>') end || '</pre>' as v from (select *, replace(replace(replace(coalesce(t, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') e from {t})", v=lambda id, t, k: tx.highlight(t, k))
scalar("x21_excerpt", PAIRS, f"select id, {strip_sql('case when length(a) > 0 then a else coalesce(b, chr(32)) end')} as v from {{t}}", v=lambda id, a, b: tx.excerpt(a, b))
NAMES = Fixture("id int, name string, kind string", [(1, "a.PNG", "image"), (2, "b.jpeg", None), (3, "c.gif", "x"), (4, "d.webp", ""), (5, "e.pdf", "image"), (6, 'x/y:z*"q"<>|?.csv', "PDF"), (7, None, "pdf"), (8, " ", None), (9, "f.bmp", "image")], same_over("documents", "doc_id as id", "case doc_id % 7 when 0 then null when 1 then ' ' else concat(source, '/', cast(doc_id as string), case doc_id % 5 when 0 then '.PDF' when 1 then '.jpeg' when 2 then '.png' when 3 then '?.gif' else ':x.webp' end) end as name", "case doc_id % 3 when 0 then 'pdf' when 1 then 'image' end as kind"))
scalar("x27_content_type", NAMES, r"select id, case when lower(name) like '%.png' then 'image/png' when regexp_matches(lower(name), '\.jpe?g$') then 'image/jpeg' when lower(name) like '%.gif' then 'image/gif' when lower(name) like '%.webp' then 'image/webp' else 'application/octet-stream' end as v from {t}", v=lambda id, n, k: tx.content_type(n))
scalar("x28_safe_filename", NAMES, r"""select id, regexp_replace(name, '[\\/:*?"<>|\r\n]', '_', 'g') as v from {t}""", v=lambda id, n, k: tx.safe_filename(n))
scalar("x33_is_pdf", NAMES, "select id, coalesce(lower(kind) = 'pdf', false) or coalesce(lower(name) like '%.pdf', false) as v from {t}", v=lambda id, n, k: tx.is_pdf(k, n))
scalar("f25_file_gates", NAMES, r"select id, coalesce(regexp_matches(name, '(?i)\.(png|jpg|jpeg|bmp)$'), false) as image, coalesce(lower(name) like '%.pdf', false) as pdf from {t}", image=lambda id, n, k: tx.is_image(n), pdf=lambda id, n, k: tx.is_pdf(F.lit(None).cast("string"), n))
scalar("x34_upload_name", NAMES, "select id, case when trim(coalesce(name, '')) <> '' then name when kind = 'pdf' then 'upload.pdf' else 'upload.bin' end as v from {t}", v=lambda id, n, k: tx.upload_name(n, k == "pdf"))
URLS = Fixture("id int, u string", [(1, None), (2, ""), (3, "http://a/b"), (4, "/static/x"), (5, "y z"), (6, "https://q"), (7, "/data/uploads/f.png"), (8, "/data/pages/d/page_1.png"), (9, "/else/where"), (10, "a b&c/d(e)'!~é")], same_over("pages", "page_id as id", "case page_id % 5 when 0 then url when 1 then concat('/data/uploads/', cast(page_id as string), '.png') when 2 then concat('/data/pages/', cast(page_id as string), '/page 1.png') when 3 then substring(url, 9, 100) end as u"))
scalar("p16_absolute_url", URLS, "select id, case when coalesce(u, '') = '' then '' when u like 'http://%' or u like 'https://%' then u else 'http://127.0.0.1:8001' || case when u like '/%' then '' else '/' end || u end as v from {t}", v=lambda id, u: tx.absolute_url(u, "http://127.0.0.1:8001"))
scalar("p17_image_url", URLS, "select id, case when u like '/data/uploads/%' then '/static/uploads/' || substring(u, 15) when u like '/data/pages/%' then '/static/pages/' || substring(u, 13) end as v from {t}", v=lambda id, u: tx.image_url(u, "/data/uploads", "/data/pages"))
scalar("x36_url_templates", URLS, "select id, '/api/docs/' || id || '/tables/' || replace(replace(replace(replace(replace(url_encode(u), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~') || '/csv' as v from {t}", v=lambda id, u: F.concat(F.lit("/api/docs/"), id.cast("string"), F.lit("/tables/"), tx.url_component(u), F.lit("/csv")))
scalar("x37_json_string", PAIRS, "select id, to_json(a)::varchar as v from {t}", v=lambda id, a, b: F.regexp_extract(F.to_json(F.array(a)), r"(?s)^\[(.*)\]$", 1))
LISTS = Fixture("id int, l array<string>", [(1, ["标题", "第一行", "接着", "结束。", "新段", "继续：", "最后"]), (2, []), (3, ["only"]), (4, [" ", "a", " ", "b！", "c"])])
query("x13_paragraphs")(lambda t: LISTS.df(t).select("id", tx.paragraphs(F.col("l")).alias("v")))
# a mark at a line's end closes its paragraph, so what stands between two lines is known from the first of them
REST = f"list_filter(list_transform(string_split(text, chr(10))[2:], lambda x: {strip_sql('x')}), lambda x: x <> '')"
query("x13_paragraphs_of_documents", f"select doc_id, md5({strip_sql('h || chr(10) || b')}) h from (select doc_id, {strip_sql('string_split(text, chr(10))[1]')} h, array_to_string(list_transform(r, lambda x, i: case when i > 1 and regexp_matches(r[i - 1], '[。！？；:：]$') then chr(10) else '' end || x), '') b from (select doc_id, text, {REST} r from (select doc_id, replace(text, '. ', ':' || chr(10)) text from documents)))")(
    lambda t: t.documents.select("doc_id", F.md5(tx.paragraphs(F.split(F.replace("text", F.lit(". "), F.lit(":\n")), "\n"))).alias("h"))
)
query("x30_doc_ids", "select doc_id, 32 as n from documents")(lambda t: t.documents.select("doc_id", F.length(F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("n")))

# metadata
LINES_SQL = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def _header(x: str) -> str:
    return rf"(length({x}) < 4 or regexp_matches({x}, '(?i)(computer era|cnki\.net|doi\s*:|^doi\s|journal of|vol\.|issue\s|press|编辑部|杂志社|期刊名|中图分类号|文献标志码|文章编号)') or (regexp_matches({x}, '(?i)\bno\.\s*\d+') and regexp_matches({x}, '\b20\d{{2}}\b')) or regexp_matches({x}, '\d{{4}}\s*年\s*\d+\s*卷\s*\d+\s*期') or (not regexp_matches({x}, '[一-鿿]') and length({x}) < 90))"


TITLE_SQL = f"coalesce(list_filter(l[1:50], lambda x: not {_header('x')} and regexp_matches(x, '[一-鿿]') and length(x) >= 6)[1], list_filter(l[1:50], lambda x: not {_header('x')})[1], l[1])"
META = f"(select *, {LINES_SQL} l from {{t}})"
scalar("f20_header_line", ONE, f"select id, {_header('s')} as v from (select id, {strip_sql('t')} s from {{t}})", v=lambda id, t: mt.is_header(t))
scalar("m02_title", T, f"select id, {TITLE_SQL} as v from {META}", v=lambda id, t, m: mt.title(mt.text_lines(t)))
ABS = r"(?i)摘要\s*[:：]?\s*((?s:.)*?)(?:关键词|关键字|Key\s*words|KEY\s*WORDS)"
KW = r"(?i)(?:关键词|关键字)\s*[:：]?\s*([^\n]+)"
pick = lambda p, g: f"case when regexp_matches(t, '{p}') then regexp_extract(t, '{p}', {g}) end"
scalar("m03_abstract", T, f"select id, substring({strip_sql(pick(ABS, 1))}, 1, 4000) as v from {{t}}", v=lambda id, t, m: mt.abstract(t))
scalar("m04_keywords", T, f"select id, substring({strip_sql(pick(KW, 1))}, 1, 800) as v from {{t}}", v=lambda id, t, m: mt.keywords(t))
scalar("m05_authors", T, f"select id, case when length(n) < 120 and not {_header('n')} then n end as v from (select id, l[list_position(l, ti) + 1] n from (select id, l, {TITLE_SQL} ti from {META}))", v=lambda id, t, m: mt.authors(mt.text_lines(t), mt.title(mt.text_lines(t))))
scalar("m06_notice_title", T, f"select id, coalesce(list_filter(l[1:15], lambda x: regexp_matches(x, '(关于|通知|公告|决定|通报|意见|方案|办法)') and length(x) between 6 and 200)[1], list_filter(l[1:10], lambda x: length(x) = list_max(list_transform(l[1:10], lambda y: length(y))))[1]) as v from {META}", v=lambda id, t, m: mt.notice_title(mt.text_lines(t)))
scalar("a11_longest_line", T, f"select id, list_filter(l[1:10], lambda x: length(x) = list_max(list_transform(l[1:10], lambda y: length(y))))[1] as v from {META}", v=lambda id, t, m: F.array_max(F.transform(F.slice(mt.text_lines(t), 1, 10), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"])
ORG = r"^[一-鿿（）()]{2,30}(?:学院|办公室|处|委员会|中心|党委|党组|人民政府|司|局|署|部|组)\s*$"
scalar("m07_organisation", T, f"select id, list_filter(l, lambda x: regexp_matches(x, '{ORG}'))[1] as v from {META}", v=lambda id, t, m: mt.organisation(mt.text_lines(t)))
NDATE, GDATE, NUM = r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/年]\d{1,2}[-/月]\d{1,2}", r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"[一-鿿]{0,6}?〔\d{4}〕\s*\d+号|[一-鿿]{0,4}第\s*\d+\s*号"
scalar("m08_notice_date", T, f"select id, replace({pick(NDATE, 0)}, '/', '-') as v from {{t}}", v=lambda id, t, m: mt.notice_date(t))
scalar("m09_document_number", T, rf"select id, regexp_replace({pick(NUM, 0)}, '\s+', '', 'g') as v from {{t}}", v=lambda id, t, m: mt.document_number(t))
scalar("m10_attachments", T, r"select id, case when regexp_matches(t, '附件\s*\d*\s*[:：]?') then true end as v from {t}", v=lambda id, t, m: mt.attachments(t))
scalar("m11_general_date", T, f"select id, {pick(GDATE, 0)} as v from {{t}}", v=lambda id, t, m: mt.general_date(t))
scalar("m01_document_meta", T, f"select id, case when trim(t) = '' then null when mode = 'notice' then coalesce(list_filter(l[1:15], lambda x: regexp_matches(x, '(关于|通知|公告|决定|通报|意见|方案|办法)') and length(x) between 6 and 200)[1], list_filter(l[1:10], lambda x: length(x) = list_max(list_transform(l[1:10], lambda y: length(y))))[1]) else {TITLE_SQL} end as title, case when mode = 'notice' then replace({pick(NDATE, 0)}, '/', '-') when mode = 'general' then {pick(GDATE, 0)} end as publish_date, id || '.pdf' as filename from {META}", title=lambda id, t, m: mt.document_meta(t, F.lit("f"), m)["title"], publish_date=lambda id, t, m: mt.document_meta(t, F.lit("f"), m)["publish_date"], filename=lambda id, t, m: mt.document_meta(t, F.concat(id.cast("string"), F.lit(".pdf")), m)["filename"])
scalar("p10_info", T, f"select id, case when trim(t) <> '' then {TITLE_SQL} end as title, 0 as n_names from {META}", title=lambda id, t, m: mt.info(mt.document_meta(t, F.lit("f"), F.lit("general")))["title"], n_names=lambda id, t, m: F.size(mt.info(mt.document_meta(t, F.lit("f"), m))["names"]))
scalar("p11_structured_info", T, f"select id, case when trim(t) <> '' then {TITLE_SQL} end as title, {pick(GDATE, 0)} as v from {META}", title=lambda id, t, m: mt.info(mt.document_meta(t, F.lit(None).cast("string"), F.lit("general")))["title"], v=lambda id, t, m: mt.info(mt.document_meta(t, F.lit(None).cast("string"), F.lit("general")))["time"])
scalar("o13_line_prefixes", T, f"select id, len(l[1:50]) as a, len(l[1:15]) as b, len(l[1:10]) as c from {META}", a=lambda id, t, m: F.size(F.slice(mt.text_lines(t), 1, 50)).cast("long"), b=lambda id, t, m: F.size(F.slice(mt.text_lines(t), 1, 15)).cast("long"), c=lambda id, t, m: F.size(F.slice(mt.text_lines(t), 1, 10)).cast("long"))
scalar("w08_next_line", T, f"select id, l[2] as v from {META}", v=lambda id, t, m: F.get(mt.text_lines(t), 1))
query("m02_html_title", r"select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title from pages")(lambda t: t.pages.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title")))
query("x08_hyphen_merge", r"select doc_id, md5(regexp_replace(text, '([a-zA-Z])-\s*\n\s*([a-zA-Z])', '\1\2', 'g')) as h from documents")(lambda t: t.documents.select("doc_id", F.md5(tx.merge_hyphens(F.col("text"))).alias("h")))
query("x11_strip_lines", r"select doc_id, md5(regexp_replace(text, '(?im)^.*(cnki|doi\s*:|http|www\.|copyright).*$', '', 'g')) as h from documents")(lambda t: t.documents.select("doc_id", F.md5(tx.strip_journal_lines(F.col("text"))).alias("h")))
query("x03_display_documents", f"select doc_id, md5({tidy(strip_sql('text'))}) as h from documents")(lambda t: t.documents.select("doc_id", F.md5(tx.display_general(F.col("text"))).alias("h")))
query("x20_escape_pages", "select page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as h from pages")(lambda t: t.pages.select("page_id", F.md5(tx.escape_html(F.col("html"))).alias("h")))
