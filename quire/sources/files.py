"""Files in and out: uploads, page images, the registry, CSV exports. Paths may be any that Spark can open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length, filename and a generated name with the extension in lower case; empty files go."""
    files = spark.read.format("binaryFile").load(path)
    return named_uploads(files.where("length > 0").withColumn("filename", F.element_at(F.split("path", "/"), -1)))


def named_uploads(files: DataFrame) -> DataFrame:
    ext = F.lower(F.regexp_extract("filename", r"[^.](\.[^.]+)$", 1))
    return files.withColumn("ext", ext).withColumn("doc_id", F.replace(F.uuid(), F.lit("-"), F.lit(""))).withColumn("stored", F.concat("doc_id", "ext"))


def stored_files(documents: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with the stored file to parse again (by id and filename), and those whose file is missing."""
    found = documents.join(files.select(F.col("doc_id").alias("id"), "filename", "path"), ["id", "filename"])
    return found, documents.join(files.select(F.col("doc_id").alias("id"), "filename"), ["id", "filename"], "left_anti")


def page_image_path(base: str, doc_id, page_no):
    return F.concat(F.lit(f"{base}/pages/"), doc_id.cast("string"), F.lit("/page_"), page_no.cast("string"), F.lit(".png"))


def number_pages(documents: DataFrame, images: str = "images") -> DataFrame:
    """doc_id, page (from 1) and image of an array of page images."""
    return documents.select("doc_id", F.posexplode(images).alias("n", "image")).select("doc_id", (F.col("n") + 1).alias("page"), "image")


def valid_lines(raw: DataFrame) -> DataFrame:
    """Recognised lines whose score and points are numbers; others are skipped, one by one."""
    box = F.transform("bbox", lambda p: F.transform(p, lambda v: v.try_cast("double").cast("int")))
    rows = raw.withColumn("score", F.col("score").try_cast("double")).withColumn("bbox", box)
    return rows.where(F.col("score").isNotNull() & F.col("text").isNotNull() & F.forall("bbox", lambda p: F.forall(p, lambda v: v.isNotNull())))


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """The registry (pos, doc_id) with new doc_ids behind; blank ones are ignored, known ones keep their place."""
    both = registry.select(F.lit(0).alias("g"), F.col("pos").cast("long").alias("pos"), "doc_id").unionAll(new.select(F.lit(1), F.monotonically_increasing_id(), F.col("doc_id").cast("string")))
    rows = both.withColumn("doc_id", tx.strip(F.col("doc_id"))).where("doc_id <> ''")
    return rows.groupBy("doc_id").agg(F.min(F.struct("g", "pos")).alias("at")).select("at.g", "at.pos", "doc_id")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """pos and doc_id of a JSON array; none if the file is missing or no array."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("ids"))
    return text.select(F.posexplode("ids").alias("pos", "doc_id"))


def write_csv_exports(exports: DataFrame, path: str) -> None:
    """body of each export as text by name; Spark's CSV writer quotes differently and isn't used."""
    exports.select("name", F.col("body").alias("value")).write.mode("overwrite").partitionBy("name").text(path)
