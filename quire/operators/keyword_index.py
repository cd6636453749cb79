"""Keyword search by a stored index of trigrams: the same hits as operators.search.search, without a scan of all texts.

Every text row (a document, or one of its pages) is stored with its texts under a hashed id; and for each trigram of its
lower-cased texts the ids, in blocks of bounded length: a task takes some rows at a time and gives one block for each of
their trigrams, so that a place in a text never becomes a row. A keyword's rarest trigrams name the rows that may contain it; only
these are fetched, and only there is the text looked at. So hits are exact, whatever the index names too much. Keywords of
fewer than three characters have no trigram and go through the stored texts as a scan.

A document that changes is replaced in the texts; what its old trigrams name is no longer found or no longer contains the
keyword.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.sources.shared import kept
from quire.sources.versioned import BUCKETS, Store

#: Ids in one row of a trigram, at most, and characters of the texts that are taken at a time (a longer row is taken alone).
BLOCK, CHARS = 4096, 1 << 21
#: Of a keyword, so many trigrams are looked up, the rarest.
LOOKED_UP = 4
#: Rows named by the index that are sent to every task to fetch their texts; more are joined by a shuffle.
SENT_IDS = 1 << 20

TEXTS = "id long, level int, doc_id long, file_name string, page int, texts array<string>"
GRAMS = "gram string, block long, ids array<long>"


def grams(text: Column) -> Column:
    """The distinct trigrams of a text in lower case, by code points; meant for keywords, as its time grows with the square of the length."""
    low = F.lower(text)
    return F.when(F.length(low) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def _blocks(ids: list[int], texts: list[list[str]]) -> pa.RecordBatch:
    """gram, block and ids for the trigrams of some rows: each trigram once, with the rows' ids."""
    flat = [t for own in texts for t in own]
    length = np.fromiter(map(len, flat), np.int64, len(flat))
    row = np.repeat(np.arange(len(ids)), np.fromiter(map(len, texts), np.int64, len(texts)))
    codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, code = np.unique(codes, return_inverse=True) if len(codes) < 1 << 16 else _ranked(codes)
    of = np.repeat(np.arange(len(flat)), length)
    at = np.flatnonzero(of[:-2] == of[2:])  # not across the end of a text
    n = len(letters)
    gram = (code[at] * n + code[at + 1]) * n + code[at + 2]  # n**3 is below 2**63: there are 0x110000 code points
    known = None
    if n**3 * len(ids) >= 1 << 63:
        known, gram = np.unique(gram, return_inverse=True)
    both = gram * len(ids) + row[of[at]]
    both.sort()
    both = both[np.diff(both, prepend=-1) > 0]
    gram, named = both // len(ids), np.array(ids, np.int64)[both % len(ids)]
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    gram = gram[starts] if known is None else known[gram[starts]]
    names = letters[np.stack([gram // n // n, gram // n % n, gram % n], 1)].tobytes().decode("utf-32-le", "surrogatepass")
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(named)), pa.int32()), pa.array(named))
    return pa.RecordBatch.from_arrays([pa.array([names[i : i + 3] for i in range(0, len(names), 3)], pa.string()), pa.array(np.full(len(starts), ids[0])), lists], ["gram", "block", "ids"])


def _ranked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What np.unique gives with the places, for many code points: by a table of all."""
    used = np.zeros(0x110000, bool)
    used[codes] = True
    return np.flatnonzero(used).astype(np.uint32), (np.cumsum(used) - 1)[codes]


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    texts: list[list[str]] = []
    held = 0
    for batch in batches:
        for id_, own in zip(batch.column("id").to_pylist(), batch.column("texts"), strict=True):
            own = [t.as_buffer().to_pybytes().decode("utf-8", "replace") for t in own.values]
            n = sum(map(len, own))
            if ids and (held + n > CHARS or len(ids) == BLOCK):
                yield _blocks(ids, texts)
                ids, texts, held = [], [], 0
            ids.append(id_)
            texts.append(own)
            held += n
    if ids:
        yield _blocks(ids, texts)


def postings(rows: DataFrame) -> DataFrame:
    """gram, block, ids: where the trigrams of rows (id, texts) are. An id stands in a block once for each trigram of its row."""
    low = F.array_distinct(F.transform(F.filter("texts", lambda t: F.length(t) > 0), lambda t: F.lower(t).cast("binary")))
    return rows.select("id", low.alias("texts")).where(F.size("texts") > 0).mapInArrow(_posted, GRAMS)


def text_rows(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows that search looks through: documents by display and retrieval text, pages of known documents by OCR text as well."""
    docs = documents.select(F.lit(0).alias("level"), F.col("id").cast("long").alias("doc_id"), F.col("filename").alias("file_name"), F.lit(None).cast("int").alias("page"), F.array("display_text", "clean_text_for_rag", F.lit(None).cast("string")).alias("texts"))
    own = pages.join(documents.select(F.col("id").alias("doc_id"), "filename"), "doc_id")
    inner = own.select(F.lit(1), F.col("doc_id").cast("long"), "filename", F.col("page_no").cast("int"), F.array("display_text", "clean_text_for_rag", "ocr_text"))
    rows = docs.unionAll(inner)
    return rows.select(F.xxhash64("level", "doc_id", "page").alias("id"), *rows.columns)


class KeywordIndex:
    """The tables texts and grams of a store."""

    def __init__(self, store: Store, buckets: int = BUCKETS):
        self.store, self.buckets = store, buckets

    def build(self, documents: DataFrame, pages: DataFrame) -> int:
        """Puts documents(id, filename, display_text, clean_text_for_rag) and their pages in, in place of what they had. Returns the version.

        Rows of a document that aren't there any more stay in the texts unless remove() takes the document out first.
        """
        with self.store.change() as c:
            c.create("texts", TEXTS, "id", self.buckets)
            c.create("grams", GRAMS, "gram", self.buckets)
            new = c.replace("texts", text_rows(documents, pages))
            c.add("grams", postings(new))
        return self.store.version

    def remove(self, doc_ids: DataFrame) -> int:
        """Takes documents (doc_id) and their pages out."""
        with self.store.change() as c:
            gone = self.store.read("texts", c.base).join(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
            c.delete("texts", gone.select("id"))
        return self.store.version

    def candidates(self, keywords: DataFrame) -> DataFrame:
        """keyword and id of the rows that have a keyword's rarest trigrams; keywords of three characters at least."""
        asked = keywords.select("keyword").distinct().select("keyword", F.explode(grams(F.col("keyword"))).alias("gram"))
        wanted = asked.select("gram").distinct()
        held = kept(self.store.read_keys("grams", wanted).join(F.broadcast(wanted), "gram").select("gram", "ids"), "held")
        numbers = held.groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
        # a trigram that no text has rules its keyword out
        rarest = F.row_number().over(Window.partitionBy("keyword").orderBy(F.coalesce("n", F.lit(0)), "gram"))
        asked = asked.join(F.broadcast(numbers), "gram", "left").withColumn("r", rarest).where(F.col("r") <= LOOKED_UP)
        asked = asked.select("keyword", "gram", F.expr("shiftleft(1, r - 1)").alias("bit"), F.count("*").over(Window.partitionBy("keyword")).alias("needed"))
        named = held.join(F.broadcast(asked), "gram").select("keyword", "bit", "needed", F.explode("ids").alias("id"))
        # an id may stand in several blocks of a trigram
        return named.groupBy("keyword", "id", "needed").agg(F.bit_or("bit").alias("bits")).where("bit_count(bits) = needed").select("keyword", "id")

    def search(self, keywords: DataFrame, doc_id: int | None = None) -> DataFrame:
        """keyword, level, doc_id, file_name, page, snippet for each keyword (a column keyword), as search gives them.

        Blank and null keywords hit nothing, equal ones are asked once.
        """
        asked = keywords.select("keyword").where(~tx.is_blank(F.col("keyword"))).distinct()
        short = F.length(F.lower("keyword")) < 3
        named = kept(self.candidates(asked.where(~short)).groupBy("id").agg(F.collect_list("keyword").alias("keywords")), "named")
        scanned = asked.where(short)
        # a row is looked at once, for all its keywords
        ids = F.broadcast(named) if named.count() <= SENT_IDS else named.hint("shuffle_hash")
        if scanned.isEmpty():
            rows = self.store.read_keys("texts", named.select("id")).join(ids, "id")
        else:  # a stated set of keywords against all rows
            every = F.broadcast(scanned.agg(F.collect_list("keyword").alias("every")))
            rows = self.store.read("texts").join(ids, "id", "left").crossJoin(every).withColumn("keywords", F.concat(F.coalesce("keywords", F.array().cast("array<string>")), "every"))
        rows = rows if doc_id is None else rows.where(F.col("doc_id") == doc_id)
        own = ["level", "doc_id", "file_name", "page"]
        low = F.transform("texts", lambda t: F.when(~tx.is_blank(t), F.lower(t)))
        rows = rows.select(*own, "texts", low.alias("_low"), F.explode("keywords").alias("keyword"))
        at = [F.coalesce(F.instr(F.get("_low", F.lit(i)), F.lower("keyword")), F.lit(0)) for i in range(3)]
        hits = rows.select("keyword", *own, "texts", *(a.alias(f"_{i}") for i, a in enumerate(at))).where("_0 > 0 or _1 > 0 or _2 > 0")
        first = lambda x: F.coalesce(*(F.when(F.col(f"_{i}") > 0, x(i)) for i in range(3)))
        hits = hits.select("keyword", *own, first(lambda i: F.get("texts", F.lit(i))).alias("_t"), first(lambda i: F.col(f"_{i}") - 1).alias("_at"))
        return hits.select("keyword", *own, tx.snippet_at(F.col("_t"), F.col("keyword"), F.col("_at")).alias("snippet"))
