"""Queries that store what they read: the vector index, pages that are put in and replaced, a relational database, a keyword index.

Each keeps its tables in a new shared folder, made from the whole table of the driver's folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.keyword_index import KeywordIndex
from quire.plans.registry import query
from quire.plans.store_queries import D, G, docs
from quire.plans.store_queries import pages as conversation_pages
from quire.sources import relational
from quire.sources.index import VectorIndex
from quire.sources.shared import shared_folder
from quire.sources.versioned import Store

# the index: labels are documents, of which a tenth is built again from half of its vectors, turned around


def chunks(t) -> DataFrame:
    return t.embeddings.select(F.col("label").cast("long").alias("doc_id"), F.col("vec_id").alias("ord"), "embedding")


def rebuilt_index(t) -> VectorIndex:
    index = VectorIndex(Store(t.spark, shared_folder(t.spark, "index")))
    index.build(chunks(t))
    index.build(chunks(t).where("doc_id % 10 = 3 and ord % 2 = 0").withColumn("embedding", F.reverse("embedding")))
    return index


def shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "ord", F.size("embedding").alias("n"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 6).alias("last"))


UNIT = "u as (select label::bigint doc_id, vec_id ord, list_transform(embedding, lambda x: x::double) v from embeddings), n as (select doc_id, ord, list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::float) v from u)"
NOW = f"{UNIT}, i as (select doc_id, ord, v from n where doc_id % 10 <> 3 union all select doc_id, ord, list_reverse(v) from n where doc_id % 10 = 3 and ord % 2 = 0)"
SHOWN = 'doc_id, ord, len(v)::integer n, round(v[1]::double, 6) "first", round(v[-1]::double, 6) "last"'


@query("k01_index_versions", f"with {NOW} select 1 version, {SHOWN} from n union all select 2, {SHOWN} from i")
def k01(t):
    """The index as it was built, and as it is after the change."""
    store = rebuilt_index(t).store
    both = [shown(store.read("chunks", v)).select(F.lit(v).alias("version"), "*") for v in (1, 2)]
    return both[0].unionAll(both[1])


query("s07_index_of_all", f"with {NOW} select {SHOWN} from i")(lambda t: shown(rebuilt_index(t).load()))


@query("s07_index_of_documents", f"with {NOW} select {SHOWN} from i where doc_id in (3, 4)")
def s07(t):
    """Two documents, each from its own bucket: one that was built again, one that wasn't."""
    index = rebuilt_index(t)
    return shown(index.load(3)).unionAll(shown(index.load(4)))


# pages: a document is cut into pages of so many characters

PAGE, LONGER = 2000, 3000
PAGES = "doc_id long, page_no int, text string"


def pages(documents: DataFrame, size: int) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(size)))
    numbers = F.sequence(F.lit(1), n.cast("int"))
    return documents.select("doc_id", F.explode(numbers).alias("page_no"), "text").withColumn("text", F.substring("text", (F.col("page_no") - 1) * size + 1, F.lit(size)))


def pages_sql(size: int, where: str = "true") -> str:
    return f"select doc_id, p::integer page_no, substring(text, ((p - 1) * {size} + 1)::bigint, {size}) text from documents, unnest(range(1, greatest(1, ceil(length(text) / {size}.0))::bigint + 1)) u(p) where {where}"


def outlines(documents: DataFrame) -> DataFrame:
    """A table of lines of each document: how many it has, and its characters."""
    return documents.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), F.length("text").alias("n_chars"))


def reparsed(t) -> Store:
    """Pages and outlines of all documents; then a tenth is parsed again, into longer pages and outlines of their first halves."""
    store = Store(t.spark, shared_folder(t.spark, "pages"))
    with store.change() as c:
        c.create("pages", PAGES, "doc_id")
        c.create("outlines", "doc_id long, n_lines int, n_chars int", "doc_id")
        c.replace("pages", pages(t.documents, PAGE))
        c.replace("outlines", outlines(t.documents))
    again = t.documents.where("doc_id % 10 = 3")
    with store.change() as c:
        c.replace("pages", pages(again, LONGER))
        c.replace("outlines", outlines(again.withColumn("text", F.substring("text", F.lit(1), (F.length("text") / 2).cast("int")))))
    return store


OLD, NEW = "doc_id % 10 <> 3", "doc_id % 10 = 3"


@query("k05_reparsed_pages", f"with a as ({pages_sql(PAGE)}), b as ({pages_sql(PAGE, OLD)} union all {pages_sql(LONGER, NEW)}) select 1 version, doc_id, page_no, md5(text) page from a union all select 2, doc_id, page_no, md5(text) from b")
def k05_pages(t):
    store = reparsed(t)
    both = [store.read("pages", v).select(F.lit(v).alias("version"), "doc_id", "page_no", F.md5("text").alias("page")) for v in store.versions()]
    return both[0].unionAll(both[1])


LINES = "len(string_split({t}, chr(10)))::integer n_lines, length({t})::integer n_chars"
HALF = "substring(text, 1, length(text) // 2)"
query("k05_reparsed_tables", f"select doc_id, {LINES.format(t='text')} from documents where {OLD} union all select doc_id, {LINES.format(t=HALF)} from documents where {NEW}")(lambda t: reparsed(t).read("outlines"))


@query("k04_persisted_pages", f"with a as ({pages_sql(PAGE)}) select doc_id, page_no, md5(text) page from a")
def k04(t):
    """Uploads that are sent again: a whole batch, a part of it, and one that holds every row twice."""
    store = Store(t.spark, shared_folder(t.spark, "uploads"))
    even, odd = (pages(t.documents.where(F.col("doc_id") % 2 == r), PAGE) for r in (0, 1))
    with store.change() as c:
        c.create("pages", PAGES, "doc_id")
    for batch, rows in (("first", even.where("page_no % 3 <> 1")), ("first", even), ("second", odd.unionAll(odd)), ("second", odd.where("doc_id % 4 = 1")), ("first", even)):
        with store.change() as c:
            c.append("pages", rows, batch, ["doc_id", "page_no"])
    return store.read("pages").select("doc_id", "page_no", F.md5("text").alias("page"))


# a relational database


@query("s10_relational_source", "select doc_id, lang, source, n_chars, md5(text) text from documents where lang = 'en' and doc_id >= 10")
def s10(t):
    """All documents put into a database, and those read from it that pass filters which the database works out."""
    path = shared_folder(t.spark, "documents").removeprefix("file://") + ".db"
    relational.write_table(t.documents.select("doc_id", "text", "lang", "source", "n_chars"), path, "documents", "doc_id")
    found = relational.read_table(t.spark, path, "documents", "doc_id")
    return found.where("lang = 'en' and doc_id >= 10").select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text"))


# keyword search by trigrams: the rows that a scan of documents and their pages gives, for several keywords

KEYWORDS = ("tion", "THE ", "nd, th", "e", "of", "the quality of", "is not there", " ")


def _snippet(t: str, k: str) -> str:
    at, n = f"(instr(lower({t}), lower({k})) - 1)", f"length({k})"
    start, end = f"greatest(0, {at} - 30)", f"least(length({t}), {at} + {n} + 30)"
    return f"case when {start} > 0 then '...' else '' end || substring({t}, {start} + 1, {end} - {start}) || case when {end} < length({t}) then '...' else '' end"


def _hits() -> str:
    has = lambda x: f"contains(lower({x}), lower(k.keyword))"
    first = lambda *xs: "case " + " ".join(f"when {has(x)} then {x}" for x in xs) + " end"
    return (
        f"{D}, {G}, k as (select unnest({list(KEYWORDS)}) keyword), "
        f"a as (select keyword, 0 \"level\", id doc_id, filename file_name, null::integer page, {first('display_text', 'clean_text_for_rag')} t from docs, k), "
        f"b as (select keyword, 1 \"level\", p.doc_id, d.filename file_name, page_no page, {first('p.display_text', 'p.clean_text_for_rag', 'ocr_text')} t from pages p join docs d on d.id = p.doc_id, k), "
        f"h as (select * from a union all select * from b) select keyword, \"level\", doc_id, file_name, page, {_snippet('t', 'keyword')} snippet from h where t is not null and trim(keyword) <> ''"
    )


@query("j08_indexed_search", f"with {_hits()}")
def j08(t):
    index = KeywordIndex(Store(t.spark, shared_folder(t.spark, "keywords")))
    index.build(docs(t), conversation_pages(t))
    return index.search(t.spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string"))
