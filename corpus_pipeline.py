"""From raw documents to packed training sequences: the stages, and run() over the documents table.

Stages tell rows apart by a hash of doc_id and text, not by doc_id: rows that share a doc_id, or have none, are judged each
by their own text, and rows that agree in both are treated alike. Columns besides doc_id, text, n_chars, source and lang are
carried along, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard, lines, packing, quality
from quire.llm.components import folder, fresh, small

#: Keys of up to so many rows that go are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 1 << 20


def _keyed(docs: DataFrame, *more: str) -> tuple[DataFrame, str]:
    """docs with a column of row keys, and its name."""
    key = fresh(docs, "_row")
    return docs.withColumn(key, F.xxhash64("doc_id", "text", *more)), key


def _without(docs: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose keys are in gone's column doc_id, and without the key."""
    gone = gone.select(F.col("doc_id").alias(key)).distinct().checkpoint()
    return docs.join(small(gone, BROADCAST_KEYS), key, "left_anti").drop(key)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. A null or empty text is judged by its site and its shares of characters."""
    folder(spark)
    keyed, key = _keyed(docs, "source", "lang")
    judged = quality.classify(keyed, spark.read.parquet(f"{sf_dir}/labels.parquet"), row=key)
    return _without(keyed, key, judged.where("not keep")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; one that loses all its lines with a letter or digit goes. n_chars follows the text.

    Null texts and texts without letters or digits stay as they are. Long texts are judged whole.
    """
    n_lines, dropped = fresh(docs, "_n_lines"), fresh(docs, "_dropped")
    deduped = lines.dedup_lines(docs, names=(n_lines, dropped)).where((F.size(dropped) == 0) | F.col("text").rlike(r"[\p{L}\p{N}]"))
    chars = {"n_chars": F.when(F.size(dropped) == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)).alias("n_chars")} if "n_chars" in docs.columns else {}
    return deduped.select(*(chars.get(c, F.col(f"`{c}`")) for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones, that with the smallest doc_id (no doc_id comes last); rows without words stay.

    Of rows that tie, the one with the smaller key stays, and of equal rows one.
    """
    folder(spark)
    keyed, key = _keyed(docs)
    linked = jaccard.link_components(keyed.select(F.col(key).alias("doc_id"), "text"), k=5, percent=80).where("n_shingles > 0").select("doc_id", "component_id").checkpoint()
    # groups of several rows; equal rows are one key
    groups = linked.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    several = linked.distinct().join(groups, "component_id")
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("id")).distinct()
    placed = several.join(ids, several["doc_id"] == ids["row"]).select("component_id", "row", "id").checkpoint()
    kept = placed.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("kept")).select(F.col("kept.row").alias("row"))
    gone = placed.join(kept, "row", "left_anti")
    left = _without(keyed, key, gone.select(F.col("row").alias("doc_id"))).select(docs.columns)
    # equal rows whose key stays
    again = linked.groupBy("doc_id").count().where("count > 1").select("doc_id").checkpoint()
    if again.isEmpty():
        return left
    left, key = _keyed(left)
    again = again.withColumnRenamed("doc_id", key)
    repeated = left.join(small(again, BROADCAST_KEYS), key, "left_semi").dropDuplicates([key])
    return left.join(small(again, BROADCAST_KEYS), key, "left_anti").unionByName(repeated).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Texts without words hold none."""
    folder(spark)
    keyed, key = _keyed(docs)
    found = decontamination.find_contamination(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(keyed, key, found.where("n_hit > 0")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. A null or empty text is its end alone; equal rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The classifier, SimHash and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage reads its input several times, so what one keeps is written before the next."""
    folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = docs.checkpoint()
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
