"""Incremental indexing as a stream of pages. An extension: the engine's operators are batch operators.

New page files are read as a stream; each micro-batch goes through the batch chunker and replaces its documents' part of
the stored chunk table in one change, so a batch that is run again leaves the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.chunk import build_chunks
from quire.sources.versioned import Store

PAGES = "doc_id string, ord int, page int, page_no int, clean_text_for_rag string, raw_ocr_text string, display_text string, text string"


CHUNKS = "doc_id string, ord int, content string, source_type string, page_no int, chunk_index int, table_id string"


def index_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream over JSON page files under source; chunks go to the table "chunks" of the store in target, by doc_id."""
    store = Store(spark, target)

    def write(batch: DataFrame, _: int) -> None:
        with store.change() as c:
            c.create("chunks", CHUNKS, "doc_id")
            c.replace("chunks", build_chunks(batch))

    pages = spark.readStream.schema(PAGES).json(source)
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
