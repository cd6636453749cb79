"""Metadata of a document from its text and mode: title, authors, abstract, dates, numbers. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import clean_mode, has_cjk, is_blank, let, lines, strip, stripped

# Patterns that tell titles, organisations, dates and numbers.
HEADER_WORDS = r"(?iuU)(computer era|cnki\.net|doi\s*:|^doi\s|journal of|vol\.|issue\s|press|编辑部|杂志社|期刊名|中图分类号|文献标志码|文章编号)"
ISSUE_NUMBER, ISSUE_YEAR = r"(?iuU)\bno\.\s*\d+", r"(?U)\b20\d{2}\b"
CJK_ISSUE = r"(?U)\d{4}\s*年\s*\d+\s*卷\s*\d+\s*期"
ABSTRACT = r"(?iuU)摘要\s*[:：]?\s*([\s\S]*?)(?=关键词|关键字|Key\s*words|KEY\s*WORDS)"
KEYWORDS = r"(?iuU)(?:关键词|关键字)\s*[:：]?\s*([^\n]+)"
NOTICE_TITLE = "(关于|通知|公告|决定|通报|意见|方案|办法)"
ORGANISATION = r"(?U)^[一-鿿（）()]{2,30}(?:学院|办公室|处|委员会|中心|党委|党组|人民政府|司|局|署|部|组)\s*$"
NOTICE_DATE = r"(?U)\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/年]\d{1,2}[-/月]\d{1,2}"
GENERAL_DATE = r"(?U)\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
DOCUMENT_NUMBER = r"(?U)[一-鿿]{0,6}?〔\d{4}〕\s*\d+号|[一-鿿]{0,4}第\s*\d+\s*号"
ATTACHMENT = r"(?U)附件\s*\d*\s*[:：]?"

_extract = lambda c, pattern, group: F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def text_lines(text: Column) -> Column:
    """Stripped lines that aren't empty."""
    return F.filter(F.transform(lines(text), stripped), lambda x: x != "")


def is_header(line: Column) -> Column:
    """A line that is no title: too short, of a journal or issue, or short without CJK characters."""
    s = stripped(F.coalesce(line, F.lit("")))
    short = (F.length(s) < 4) | ((F.length(s) < 90) & ~has_cjk(s))  # what is soonest told comes first
    return short | s.rlike(HEADER_WORDS) | (s.rlike(ISSUE_NUMBER) & s.rlike(ISSUE_YEAR)) | s.rlike(CJK_ISSUE)


def title(lines_: Column) -> Column:
    """The first of 50 lines that is no header, with CJK characters and six characters at least; else the first that is none, else the first."""

    def of(l: Column) -> Column:
        named = lambda c: F.get(F.filter(c, lambda x: (F.length(stripped(x)) >= 6) & has_cjk(stripped(x))), 0)
        return let(F.filter(F.slice(l, 1, 50), lambda x: ~is_header(x)), lambda c: strip(F.coalesce(named(c), F.get(c, 0), F.get(l, 0))))

    return let(lines_, of)


def authors(lines_: Column, title_: Column) -> Column:
    """The line behind the first that equals the title, if it is short and no header."""
    at = F.array_position(F.transform(lines_, strip), title_)
    second = F.get(lines_, at.cast("int"))
    return F.when((at > 0) & (F.length(second) < 120) & ~is_header(second), second)


def abstract(text: Column) -> Column:
    return F.substring(strip(_extract(text, ABSTRACT, 1)), 1, 4000)


def keywords(text: Column) -> Column:
    return F.substring(strip(_extract(text, KEYWORDS, 1)), 1, 800)


def notice_title(lines_: Column) -> Column:
    """The first of 15 lines with a title's word and 6 to 200 characters, else the longest of 10, the first of several."""
    named = F.filter(F.slice(lines_, 1, 15), lambda x: x.rlike(NOTICE_TITLE) & F.length(x).between(6, 200))
    longest = F.array_max(F.transform(F.slice(lines_, 1, 10), lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    return F.coalesce(F.get(named, 0), longest)


def organisation(lines_: Column) -> Column:
    return strip(F.get(F.filter(lines_, lambda x: x.rlike(ORGANISATION)), 0))


def notice_date(text: Column) -> Column:
    return F.replace(_extract(text, NOTICE_DATE, 0), F.lit("/"), F.lit("-"))


def general_date(text: Column) -> Column:
    return _extract(text, GENERAL_DATE, 0)


def document_number(text: Column) -> Column:
    return F.regexp_replace(_extract(text, DOCUMENT_NUMBER, 0), r"(?U)\s+", "")


def attachments(text: Column) -> Column:
    """True or null, never false."""
    return F.when(text.rlike(ATTACHMENT), True)


def document_meta(text: Column, filename: Column, mode: Column) -> Column:
    """struct<title, source_org, publish_date, doc_no, filename, authors, abstract, keywords, attachments>; of a blank text only the file name."""
    mode, l, some = clean_mode(mode), text_lines(text), ~is_blank(text)
    paper, notice = some & (mode == "paper"), some & (mode == "notice")
    general = some & (mode == "general")
    name = F.when(paper | general, title(l)).when(notice, notice_title(l))
    return F.struct(
        name.alias("title"),
        F.when(notice, organisation(l)).alias("source_org"),
        F.when(notice, notice_date(text)).when(general, general_date(text)).alias("publish_date"),
        F.when(notice, document_number(text)).alias("doc_no"),
        F.when(filename != "", filename).alias("filename"),
        F.when(paper, authors(l, title(l))).alias("authors"),
        F.when(paper, abstract(text)).alias("abstract"),
        F.when(paper, keywords(text)).alias("keywords"),
        F.when(notice, attachments(text)).alias("attachments"),
    )


def info(meta: Column) -> Column:
    """The older, shorter form; names are always empty."""
    return F.struct(meta["title"].alias("title"), F.array().cast("array<string>").alias("names"), meta["publish_date"].alias("time"), meta["source_org"].alias("organization"))
