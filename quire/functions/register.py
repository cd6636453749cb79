"""SQL names for the engine's functions: clean_page_text, rag_text, snippet, dot, and the table functions split_text and find_tables.

The others are Column functions. The SQL functions of page texts take a mode as users write it; anything that is no mode is general.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quire.functions import text as tx
from quire.operators import textlayer
from quire.operators.chunk import check, split_at_marks


@udtf(returnType="chunk_index int, piece string")
class SplitText:
    def eval(self, text: str, size: int, overlap: int):
        check(size, overlap)
        for i, p in enumerate(split_at_marks(text or "", size, overlap)):
            yield i, p


def _gone(text: str, *patterns: str) -> str:
    """SQL for a text without what the patterns match, one after another."""
    for p in patterns:
        text = f"regexp_replace({text}, r'{p}', '')"
    return text


def _strip(text: str) -> str:
    return _gone(text, r"(?U)^\s+|\s+\z")


def _tidy(text: str) -> str:
    closed = rf"regexp_replace({text}, r'\n{{3,}}', '\n\n')"
    return _strip(rf"regexp_replace({closed}, r'[ \t]+\n', '\n')")


def _kept_lines(text: str, goes: str) -> str:
    """SQL for the lines x of a text of which goes isn't true, without blanks behind them."""
    rstrip = _gone("x", r"(?U)\s+\z")
    return rf"array_join(transform(filter(split({text}, '\n'), x -> not ({goes})), x -> {rstrip}), '\n')"


def _clean_page() -> str:
    """The body of text.clean_page over t and m, a mode."""
    s = _gone(_strip("t"), tx.NUMBER_LINES)
    paper = _gone(s, tx.PAPER_NOISE_LINES, tx.PAPER_ISSUE_LINES, tx.PAPER_CAPTIONS, tx.PAPER_LATIN_LINES)
    s = f"case m when 'paper' then {paper} else {_gone(s, '(?imudU)^https?://' + chr(92) + 'S+$')} end"
    x = _strip("x")
    s = _kept_lines(s, f"{x} <> '' and length({x}) <= 12 and not {x} rlike r'[{tx.CJK}0-9A-Za-z]'")
    s = rf"regexp_replace({s}, r'\n{{3,}}', '\n\n')"
    s = rf"regexp_replace({s}, r'([a-zA-Z])-(?U:\s)*\n(?U:\s)*([a-zA-Z])', '$1$2')"
    for p in (tx.CHAPTER, tx.NUMBERED_HEADING):
        s = rf"regexp_replace({s}, r'{p}', '$1\n\n$2')"
    for p in (f"([{tx.CJK}])([A-Za-z0-9])", f"([A-Za-z0-9])([{tx.CJK}])"):
        s = f"regexp_replace({s}, r'{p}', '$1 $2')"
    s = rf"array_join(transform(split({s}, '\n'), x -> regexp_replace({x}, ' +', ' ')), '\n')"
    return f"coalesce(case when m = 'general' then {_tidy(_strip('t'))} else {_tidy(s)} end, '')"


def _rag_text() -> str:
    """The body of text.rag_text over t, the display text, and m."""
    t = f"case m when 'general' then {_gone('t', tx.JOURNAL_LINES)} when 'paper' then {_gone('t', tx.RAG_PAPER_LINES, tx.RAG_PAPER_CAPTIONS)} else t end"
    x = _strip("x")
    stays = rf"{x} = '' or {x} rlike r'{tx.REFERENCES_LINE}' or {x} rlike r'(?U)^\s*\[\d+\]' or {x} rlike r'(?U)^\s*\d+[.\s]+\[?\d+\]?'"
    token = rf"{x} rlike r'(?U)^\s*[A-Za-z0-9./\-–—]{{1,24}}\s*$' and length({x}) <= 24 and ({x} rlike r'{tx.PROTOCOL_WORDS}' or contains({x}, '/') and length({x}) <= 16 and not {x} rlike r'[{tx.CJK}]')"
    latin = rf"length({x}) <= 18 and {x} rlike r'^[A-Za-z./\-]+$'"
    labels = ", ".join(f"'{g}'" for g in tx.DIAGRAM_LABELS)
    return f"coalesce({_tidy(_kept_lines(t, f'not ({stays}) and ({x} in ({labels}) or m = {chr(39)}paper{chr(39)} and ({token} or {latin}))'))}, '')"


MODE = f"case when lower({_strip('mode')}) in ('paper', 'notice', 'general') then lower({_strip('mode')}) else 'general' end"


def register(spark: SparkSession) -> None:
    """Registers the table functions, and SQL functions for page texts, the inner product of two vectors and snippets."""
    spark.udtf.register("split_text", SplitText)
    textlayer.register(spark)
    for name, body in (("_clean_page", _clean_page()), ("_rag_text", _rag_text())):
        spark.sql(f"create or replace temporary function {name}(t string, m string) returns string return {body}")
    spark.sql(f"create or replace temporary function clean_page_text(t string, mode string) returns string return _clean_page(t, {MODE})")
    spark.sql(f"create or replace temporary function rag_text(t string, mode string) returns string return _rag_text(_clean_page(t, {MODE}), {MODE})")
    spark.sql("create or replace temporary function dot(a array<double>, b array<double>) returns double return aggregate(zip_with(a, b, (x, y) -> x * y), 0d, (s, v) -> s + v)")
    spark.sql("create or replace temporary function snippet(t string, k string) returns string return case when t is null or trim(t) = '' then '' when instr(lower(t), lower(k)) = 0 then concat(substring(t, 1, 100), if(length(t) > 100, '...', '')) else concat(if(instr(lower(t), lower(k)) > 31, '...', ''), substring(t, greatest(1, instr(lower(t), lower(k)) - 30), least(length(t), instr(lower(t), lower(k)) + length(k) + 29) - greatest(1, instr(lower(t), lower(k)) - 30) + 1), if(instr(lower(t), lower(k)) + length(k) + 29 < length(t), '...', '')) end")
