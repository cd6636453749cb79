"""The trigram index gives what a scan gives, and looks at fewer texts."""

import pytest
from pyspark.sql import functions as F

from quire.operators import keyword_index, search
from quire.operators.keyword_index import KeywordIndex
from quire.sources.versioned import Store

DOCS = "id long, filename string, display_text string, clean_text_for_rag string"
PAGES = "doc_id long, page_no int, display_text string, clean_text_for_rag string, ocr_text string"
WORDS = ["alpha", "beta", "gamma", "Delta", "日本語", "naïve", "a-b", "x\ny"]
KEYWORDS = ["alpha", "ALPHA B", "gamma delta", "本語", "日本語", "ÏVE", "x\ny", "a", "-b", "none of it", "", "  ", "gam\x00ma", "delta 13 "]


@pytest.fixture(scope="module")
def tables(spark):
    text = lambda i: " ".join(WORDS[(i * k + k) % len(WORDS)] for k in range(1, 5)) + f" {i} " + ("rare" * 30 if i == 77 else "")
    docs = [(i, f"f{i}.pdf" if i % 9 else None, text(i) if i % 2 else None, text(i + 1) if i % 3 else "") for i in range(200)] + [(None, "none", "alpha", None), (500, "blank", " \n", None)]
    pages = [(i % 210, n, text(i + n) if n % 2 else None, None, text(i) if n != 1 else None) for i in range(300) for n in range(3)]
    return spark.createDataFrame(docs, DOCS).cache(), spark.createDataFrame(pages, PAGES).dropDuplicates(["doc_id", "page_no"]).cache()


@pytest.fixture(scope="module")
def index(spark, tables, tmp_path_factory):
    i = KeywordIndex(Store(spark, str(tmp_path_factory.mktemp("keywords"))), buckets=8)
    i.build(*tables)
    return i


def rows(df):
    return sorted(str(tuple(r)) for r in df.select("level", "doc_id", "file_name", "page", "snippet").collect())


def asked(spark, keywords):
    return spark.createDataFrame([(k,) for k in keywords], "keyword string")


def test_same_rows_as_the_scan(spark, tables, index):
    found = index.search(asked(spark, [*KEYWORDS, None, "alpha"])).cache()
    for k in KEYWORDS:
        assert rows(found.where(F.col("keyword") == k)) == rows(search.search(*tables, k)), k
    assert rows(index.search(asked(spark, ["alpha"]), doc_id=3)) == rows(search.search(*tables, "alpha", doc_id=3))


def test_many_ids_are_joined(spark, tables, index, monkeypatch):
    monkeypatch.setattr(keyword_index, "SENT_IDS", 0)
    assert rows(index.search(asked(spark, ["beta"]))) == rows(search.search(*tables, "beta"))


def test_pruned_rows(spark, tables, index):
    """Of a rare keyword the index names nearly only the rows that hold it; of one that is nowhere, none."""
    every = index.store.read("texts").count()
    named = index.candidates(asked(spark, ["rarerare", "zzz", "alpha"]))
    n = {r["keyword"]: r["count"] for r in named.groupBy("keyword").count().collect()}
    holding = index.search(asked(spark, ["rarerare"])).count()
    assert every > 700 and holding <= n["rarerare"] < 20 and "zzz" not in n and n["alpha"] < every
    # only buckets of the keyword's trigrams are read
    read = index.store.read_keys("grams", asked(spark, ["rar"])).inputFiles()
    assert len(read) < len(index.store.read("grams").inputFiles())


def test_documents_that_change(spark, tables, tmp_path):
    index = KeywordIndex(Store(spark, str(tmp_path / "k")), buckets=4)
    docs, pages = tables
    index.build(docs, pages)
    index.remove(spark.createDataFrame([(7,), (8,)], "doc_id long"))
    new = spark.createDataFrame([(7, "new.pdf", "omega alpha", None)], DOCS)
    index.build(new, pages.limit(0))
    now = docs.where("id is null or id not in (7, 8)").unionAll(new), pages.where("doc_id not in (7, 8)")
    for k in ("omega", "alpha", "delta"):
        assert rows(index.search(asked(spark, [k]))) == rows(search.search(*now, k)), k


def test_nothing_indexed(spark, tables, tmp_path):
    index = KeywordIndex(Store(spark, str(tmp_path / "k")))
    index.build(tables[0].limit(0), tables[1].limit(0))
    assert index.search(asked(spark, KEYWORDS)).collect() == []


def test_blocks_name_every_row_of_a_trigram(spark, monkeypatch):
    """Short blocks, rows longer than what is taken at a time, texts that are null, short, twice there, and code points beyond 16 bits."""
    texts = [["Abc abc", None, "xbc"], ["ab", "", None], [None, None, None], ["日本語 😀bc", "日本語 😀bc", None], ["long " * 40, "a\nb", None], *[[f"abc {i}", None, None] for i in range(20)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, texts array<string>").coalesce(1)
    expected = {(t.lower()[i : i + 3], k) for k, own in enumerate(texts) for t in own if t for i in range(len(t) - 2)}
    for block, chars in ((7, 60), (4096, 1 << 21)):
        monkeypatch.setattr(keyword_index, "BLOCK", block)
        monkeypatch.setattr(keyword_index, "CHARS", chars)
        blocks = [r for b in keyword_index._posted(iter(rows.select("id", F.transform(F.filter("texts", lambda t: t.isNotNull()), lambda t: F.lower(t).cast("binary")).alias("texts")).toArrow().to_batches())) for r in b.to_pylist()]
        assert {(r["gram"], i) for r in blocks for i in r["ids"]} == expected
        assert all(len(set(r["ids"])) == len(r["ids"]) <= block for r in blocks)
    found = {(r["gram"], i) for r in keyword_index.postings(rows).collect() for i in r["ids"]}
    assert found == expected
    own = spark.createDataFrame([("😀bcd",), ("ab",), ("ABCA",)], "t string").select(keyword_index.grams(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in own] == [["😀bc", "bcd"], [], ["abc", "bca"]]


def test_texts_are_worked_out_once(spark, tmp_path):
    """the build read and cut its texts four times."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"some text {i}"

    docs = spark.range(50).select("id", F.lit("f").alias("filename"), text("id").alias("display_text"), F.lit(None).cast("string").alias("clean_text_for_rag"))
    index = KeywordIndex(Store(spark, str(tmp_path / "k")), buckets=4)
    index.build(docs, spark.createDataFrame([], PAGES))
    assert seen.value == 50
    assert index.search(asked(spark, ["text 4"])).count() == 11
