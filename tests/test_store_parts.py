"""Pages and tables of a document are gathered in parts of bounded size."""

import pytest
from pyspark.sql import functions as F

from quire.operators import store


@pytest.mark.parametrize("gather, rest", [(store.with_tables, ["table_json", "table_markdown"]), (store.with_pages, ["ocr_text", "display_text", "clean_text_for_rag", "raw_ocr_text"])])
def test_parts_grow_with_the_rows(spark, monkeypatch, gather, rest):
    """all rows were gathered where they are read and in a fixed number of partitions, however many there are."""
    monkeypatch.setattr(store, "PART_ROWS", 50)
    rows = spark.range(2000).select((F.col("id") % 700).alias("doc_id"), "id", (F.col("id") % 3).cast("int").alias("page_no"), *(F.lit("x").alias(c) for c in rest))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        out = gather(spark.range(705).select("id"), rows)
        column = out.columns[-1]
        parts = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.sum(F.size(column)).alias("n")).select("n").collect()]
        got = {r["id"]: sorted(x["id"] for x in r[column]) for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 30 and max(parts) < 200  # 8 partitions of about 250 before
    assert got == {i: [x for x in range(2000) if x % 700 == i] for i in range(705)}
