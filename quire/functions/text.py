"""Text functions, Column in, Column out. All run in the JVM; none is a UDF.

White space, digits and letter case follow Unicode, a line ends at "\\n" only, and lengths count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\u4e00-\u9fff"

# Vocabulary and patterns of the document modes.
KEPT_GLYPHS = ["一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "口", "日", "目", "田", "〇", "○", "□", "■", "①", "②", "③", "㈠", "㈡", "㈢"]
NOISE_GLYPHS = [",", ".", ";", ":", "'", '"', "|", "\\", "/", "·", "•", "-", "—"]
DIAGRAM_LABELS = ["移动客户端", "Web浏览器环境", "Web浏览器", "浏览器环境", "数据库1", "数据库2", "问题分析", "问题转换", "输出SQL语句", "输出 SQL 语句"]
PAPER_DROP = r"(?iu)(cnki|doi:|doi\s|http|www\.|计算机时代|computer era|收稿日期|修回日期|基金项目|作者简介|版权声明|copyright)"
PAPER_KEEP = r"(?iuU)^\s*(中图分类号|文献标志码|文章编号|关键词|key words)\s*[:：]"
PAPER_EDITORS = r"(?iudU)^(.*编辑部|.*杂志社)\s*$"
URL_LINE = r"(?iuU)^https?://\S+$"
PAPER_NOISE_LINES = r"(?imud)^.*(cnki|doi|http|www\.|计算机时代|computer era|journal of|现代情报|收稿日期|修回日期|基金项目|作者简介|copyright).*$"
PAPER_ISSUE_LINES = r"(?imudU)^.*(第\s*\d+\s*卷|第\s*\d+\s*期|vol\.\s*\d+|no\.\s*\d+|mar\.,\s*\d{4}).*$"
PAPER_CAPTIONS = r"(?imudU)^\s*(图|表|Fig\.|FIG\.)\s*\d+.*$"
PAPER_LATIN_LINES = r"(?imudU)^\s*[A-Z][A-Za-z0-9 ./-]{0,30}\s*$"
JOURNAL_LINES = r"(?imudU)^.*(cnki|doi\s*:|http|www\.|计算机时代|computer era|收稿日期|修回日期|基金项目|作者简介|版权声明|copyright).*$"
RAG_PAPER_LINES = r"(?imud)^.*(中图分类号|文献标志码|文章编号|图表索引).*$"
RAG_PAPER_CAPTIONS = r"(?imudU)^\s*(图|表|Fig\.|FIG\.)\s*\d+[^。]*$"
REFERENCES_LINE = r"(?iuU)(参考文献|references|引用文献)\s*$"
PROTOCOL_WORDS = r"(?iu)^(json|tcp/ip|tcp|ip|http|https|xml|html|sql|api|web|mysql|oracle)$"
PAGE_NUMBER_LINE = r"(?U)^[-·\s]*\d+[-·\s]*$"
NUMBER_LINES = r"(?mdU)^\s*[-·]?\s*\d+\s*[-·]?\s*$"
CHAPTER = r"([^\n])\n(第[0-9一二三四五六七八九十百零两]+[章节编](?U:\s))"
NUMBERED_HEADING = r"([^\n])\n((?:(?U:\d)+|[一二三四五六七八九十]+)[、.．](?U:\s)*[一-龥])"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def stripped(c: Column) -> Column:
    """strip() of a column or an element of an array: most have no white space at an end, and of these only two characters are looked at."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), strip(c)).otherwise(c)


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def safe_text(c: Column) -> Column:
    """Stripped, null as empty."""
    return F.coalesce(stripped(c.cast("string")), F.lit(""))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.when(~is_blank(c), c) for c in columns))


def clean_mode(c: Column) -> Column:
    """paper, notice or general; anything else is general."""
    m = F.lower(strip(c))
    return F.when(m.isin("paper", "notice", "general"), m).otherwise("general")


def effective_mode(asked: Column, stored: Column) -> Column:
    """The mode that was asked for, else the stored one, else general."""
    return F.coalesce(F.when(~is_blank(asked), F.trim(asked)), F.when(~is_blank(stored), stored), F.lit("general"))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "on"), F.lit(False))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def is_meaningful(c: Column) -> Column:
    """A token worth keeping even alone: a kept glyph, one CJK character, letter or digit, or anything longer."""
    t = strip(c)
    return (t != "") & (t.isin(KEPT_GLYPHS) | t.rlike(rf"^(?:[{CJK}]|[A-Za-z0-9])$") | (F.length(t) > 1))


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(PAGE_NUMBER_LINE)


def dropped_by_mode(c: Column, mode: Column) -> Column:
    """Whether a line goes because of the document's mode."""
    t = strip(c)
    paper = F.when(t.rlike(PAPER_DROP), True).when(t.rlike(PAPER_KEEP), False).otherwise(t.rlike(PAPER_EDITORS) & (F.length(t) < 48))
    return F.when(mode == "paper", paper).when(mode == "notice", t.rlike(URL_LINE)).when(mode == "general", t.rlike(URL_LINE) & (F.length(t) > 30)).otherwise(False)


def is_symbol_line(c: Column, most: int = 12) -> Column:
    """A short line without any CJK character, letter or digit."""
    t = strip(c)
    return (t != "") & (F.length(t) <= most) & ~t.rlike(rf"[{CJK}0-9A-Za-z]")


def _tidy(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n"))


def display_general(c: Column) -> Column:
    """White space only: runs of blank lines are closed up before trailing blanks go, in this order."""
    return F.coalesce(_tidy(strip(c)), F.lit(""))


def merge_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, r"([a-zA-Z])-(?U:\s)*\n(?U:\s)*([a-zA-Z])", "$1$2")


def space_scripts(c: Column) -> Column:
    """A blank between CJK and Latin letters or digits; blanks closed up and lines stripped."""
    c = F.regexp_replace(c, rf"([{CJK}])([A-Za-z0-9])", "$1 $2")
    c = F.regexp_replace(c, rf"([A-Za-z0-9])([{CJK}])", "$1 $2")
    return F.array_join(F.transform(lines(c), lambda x: F.regexp_replace(strip(x), " +", " ")), "\n")


def heading_gaps(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, CHAPTER, "$1\n\n$2"), NUMBERED_HEADING, "$1\n\n$2")


def clean_page(c: Column, mode: Column) -> Column:
    """Display text of a page by its mode."""
    s = F.regexp_replace(strip(c), NUMBER_LINES, "")
    paper = s
    for pattern in (PAPER_NOISE_LINES, PAPER_ISSUE_LINES, PAPER_CAPTIONS, PAPER_LATIN_LINES):
        paper = F.regexp_replace(paper, pattern, "")
    s = F.when(mode == "paper", paper).when(mode == "notice", F.regexp_replace(s, r"(?imudU)^https?://\S+$", "")).otherwise(s)
    kept = F.transform(F.filter(lines(s), lambda x: ~is_symbol_line(x)), rstrip)
    s = F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")
    s = _tidy(space_scripts(heading_gaps(merge_hyphens(s))))
    return F.coalesce(F.when(mode == "general", display_general(c)).otherwise(s), F.lit(""))


def display_text(preclean: Column, mode: Column) -> Column:
    return clean_page(preclean, mode)


def strip_journal_lines(c: Column) -> Column:
    return F.regexp_replace(c, JOURNAL_LINES, "")


def strip_diagram_lines(c: Column, mode: Column) -> Column:
    """Lines that look like labels of figures go; references and their numbers stay."""
    paper = mode == "paper"

    def goes(x: Column) -> Column:
        s = strip(x)
        stays = (s == "") | s.rlike(REFERENCES_LINE) | s.rlike(r"(?U)^\s*\[\d+\]") | s.rlike(r"(?U)^\s*\d+[.\s]+\[?\d+\]?")
        token = s.rlike(r"(?U)^\s*[A-Za-z0-9./\-–—]{1,24}\s*$") & (F.length(s) <= 24)
        label = token & (s.rlike(PROTOCOL_WORDS) | (s.contains("/") & (F.length(s) <= 16) & ~has_cjk(s)))
        latin = (F.length(s) <= 18) & s.rlike(r"^[A-Za-z./\-]+$")
        return ~stays & (s.isin(DIAGRAM_LABELS) | (paper & (label | latin)))

    return F.array_join(F.transform(F.filter(lines(c), lambda x: ~goes(x)), rstrip), "\n")


def rag_text(c: Column, mode: Column) -> Column:
    """Text for retrieval: the display text with journal, caption and diagram lines taken out by mode."""
    t = clean_page(c, mode)
    paper = F.regexp_replace(F.regexp_replace(t, RAG_PAPER_LINES, ""), RAG_PAPER_CAPTIONS, "")
    t = F.when(mode == "general", strip_journal_lines(t)).when(mode == "paper", paper).otherwise(t)
    return F.coalesce(_tidy(strip_diagram_lines(t, mode)), F.lit(""))


def paragraphs(texts: Column) -> Column:
    """OCR lines joined to paragraphs: the first stands alone, others run on until a mark that ends a sentence."""
    rest = F.filter(F.transform(F.slice(texts, 2, F.greatest(F.size(texts), F.lit(1))), strip), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    runs_on = lambda p: (p != "") & ~p.rlike("[。！？；:：]$")
    step = lambda acc, x: F.when(runs_on(acc["open"]), F.struct(acc["done"].alias("done"), F.concat(acc["open"], x).alias("open"))).otherwise(F.struct(F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), x.alias("open")))
    body = F.aggregate(rest, start, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    first = strip(F.get(texts, 0))
    return F.when(F.size(texts) > 0, strip(F.array_join(F.concat(F.filter(F.array(first), lambda x: x != ""), body), "\n"))).otherwise("")


def same_but_space(a: Column, b: Column) -> Column:
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return bare(a) == bare(b)


def contains_keyword(text: Column, keyword: Column) -> Column:
    """Whatever the case; a blank text or keyword contains, or is contained in, nothing. The keyword isn't trimmed."""
    return F.coalesce(~is_blank(text) & ~is_blank(keyword) & F.contains(F.lower(text), F.lower(keyword)), F.lit(False))


def snippet(text: Column, keyword: Column) -> Column:
    """30 characters on either side of the keyword's first place; without one the first 100."""
    at = F.instr(F.lower(text), F.lower(keyword)) - 1
    dots = lambda c: F.when(c, "...").otherwise("")
    none = F.concat(F.substring(text, 1, 100), dots(F.length(text) > 100))
    return F.when(is_blank(text), "").when(at < 0, none).otherwise(snippet_at(text, keyword, at))


def snippet_at(text: Column, keyword: Column, at: Column) -> Column:
    """30 characters on either side of a keyword's place, from 0."""
    start, end = F.greatest(F.lit(0), at - 30), F.least(F.length(text), at + F.length(keyword) + 30)
    dots = lambda c: F.when(c, "...").otherwise("")
    return F.concat(dots(start > 0), F.substring(text, start + 1, end - start), dots(end < F.length(text)))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(text: Column, keyword: Column) -> Column:
    """Escaped text with every place of the (trimmed, not escaped) keyword marked; case matters."""
    safe, k = escape_html(F.coalesce(text, F.lit(""))), strip(F.coalesce(keyword, F.lit("")))
    return F.concat(F.lit("<pre>"), F.when(k == "", safe).otherwise(F.replace(safe, k, F.concat(F.lit("<mark>"), k, F.lit("</mark>")))), F.lit("</pre>"))


def to_integer(c: Column) -> Column:
    """An integer literal as such, a number truncated, anything else null."""
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("int")).when(c.rlike(r"^[+-]?[0-9]+\.[0-9]*$"), F.regexp_extract(c, r"^([+-]?[0-9]+)", 1).try_cast("int"))


def page_number(page: Column, page_no: Column) -> Column:
    """page, or page_no where page is null, as an integer; 0 where that is none."""
    v = F.coalesce(page, page_no)
    return F.coalesce(F.when(strip(v).rlike(r"^[+-]?[0-9]+$"), strip(v).try_cast("int")), F.lit(0))


def content_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.endswith(".png"), "image/png").when(n.rlike(r"\.jpe?g$"), "image/jpeg").when(n.endswith(".gif"), "image/gif").when(n.endswith(".webp"), "image/webp").otherwise("application/octet-stream")


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r'[\\/:*?"<>|\r\n]', "_")


def is_pdf(file_type: Column, name: Column) -> Column:
    return F.coalesce(F.lower(file_type) == "pdf", F.lit(False)) | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def is_image(name: Column) -> Column:
    return F.coalesce(name.rlike(r"(?i)\.(png|jpg|jpeg|bmp)$"), F.lit(False))


def upload_name(name: Column, pdf: Column) -> Column:
    return F.when(~is_blank(name), name).otherwise(F.when(pdf, "upload.pdf").otherwise("upload.bin"))


def absolute_url(url: Column, base: str) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit(base), F.when(url.startswith("/"), "").otherwise("/"), url))


def image_url(path: Column, uploads: str, pages: str) -> Column:
    """Where a file under one of the two folders is served; null elsewhere."""
    below = lambda root, mount: F.when(path.startswith(root + "/"), F.concat(F.lit(mount + "/"), F.substring(path, F.lit(len(root) + 2), F.length(path))))
    return F.coalesce(below(uploads, "/static/uploads"), below(pages, "/static/pages"))


def url_component(c: Column) -> Column:
    """Percent-encoded as a component of a URL."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def excerpt(content: Column, text: Column) -> Column:
    some = lambda c: F.when(c != "", c)
    return strip(F.coalesce(some(content), some(text), F.lit("")))
