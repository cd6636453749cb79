"""Reading order of recognised lines, page by page.

A page's lines are gathered into one array (a page is a bounded unit) and every step is a higher-order function on it:
geometry, column detection, ordering, filtering, stitching. One shuffle by (doc_id, page_no) serves all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.geometry import rect

ROW_TOLERANCE = 18.0
MIN_SCORE = 0.35
GENERAL_SCORE = 0.15


def gather(lines: DataFrame) -> DataFrame:
    """doc_id, page_no and lines, in line order: those with a text and four points at least, with their geometry."""
    own = lines.select("doc_id", "page_no", F.struct(F.col("line_no"), tx.safe_text(F.col("text")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.col("bbox")).alias("l"))
    pages = own.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return pages.select("doc_id", "page_no", F.size("l").cast("long").alias("line_count"), F.array_join(F.filter(F.transform("l", lambda x: x["text"]), lambda t: t != ""), "\n").alias("raw_text"), F.transform(F.filter("l", lambda x: (x["text"] != "") & (F.size(x["bbox"]) >= 4)), with_geometry).alias("lines"))


def with_geometry(line: Column) -> Column:
    r = rect(line["bbox"])
    return F.struct(
        line["line_no"].alias("line_no"),
        line["text"].alias("text"),
        line["score"].alias("score"),
        line["bbox"].alias("bbox"),
        *(r[c].alias(c) for c in ("left", "top", "right", "bottom")),
        F.greatest(F.lit(1.0), r["right"] - r["left"]).alias("width"),
        F.greatest(F.lit(1.0), r["bottom"] - r["top"]).alias("height"),
        ((r["left"] + r["right"]) / 2).alias("center_x"),
        ((r["top"] + r["bottom"]) / 2).alias("center_y"),
    )


def median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def metrics(l: Column) -> Column:
    """struct<page_left, page_right, page_width, median_height, median_width>."""
    of = lambda c: F.transform(l, lambda x: x[c])
    left, right = F.array_min(of("left")), F.array_max(of("right"))
    return F.struct(F.coalesce(left, F.lit(0.0)).alias("page_left"), F.coalesce(right, F.lit(0.0)).alias("page_right"), F.coalesce(F.greatest(F.lit(1.0), right - left), F.lit(0.0)).alias("page_width"), F.coalesce(median(of("height")), F.lit(20.0)).alias("median_height"), F.coalesce(median(of("width")), F.lit(100.0)).alias("median_width"))


def widest_gap(centers: Column) -> Column:
    """struct<gap, at, split> between neighbours in a sorted array, the first of equal ones; null for fewer than two."""

    def widest(c: Column) -> Column:  # of one array, worked out once, not again for every gap
        gap = F.transform(F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda x, i: F.struct((x - F.get(c, i)).alias("gap"), (-i).alias("minus"), ((x + F.get(c, i)) / 2).alias("split")))
        shown = lambda best: F.when(best.isNotNull(), F.struct(best["gap"].alias("gap"), (-best["minus"]).alias("at"), best["split"].alias("split")))
        return tx.let(F.array_max(gap), shown)

    return tx.let(centers, widest)


def bind(pages: DataFrame, name: str, value: Column) -> DataFrame:
    """pages with a column that the optimizer doesn't write out again wherever it is used: one element, exploded."""
    return pages.withColumn(name, F.explode(F.array(value)))


def detect(pages: DataFrame) -> DataFrame:
    """pages with m (metrics) and two: 12 lines, 8 of column width, and between their centres a gap of 12 % of the page with three lines on either side.

    Each step is a column of its own, so no expression is worked out, or written down, more than once.
    """
    pages = pages.withColumn("m", metrics(F.col("lines"))).withColumn("page_width", metrics(F.col("lines"))["page_width"]).withColumn("median_height", metrics(F.col("lines"))["median_height"])
    width, n, g = F.col("page_width"), F.size("_centers"), F.col("_gap")
    pages = pages.transform(bind, "_centers", F.array_sort(F.transform(F.filter("lines", lambda x: (x["width"] >= width * 0.18) & (x["width"] <= width * 0.65)), lambda x: x["center_x"])))
    pages = pages.transform(bind, "_gap", widest_gap(F.col("_centers")))
    two = (F.size("lines") >= 12) & (n >= 8) & (g["gap"] >= width * 0.12) & (g["at"] + 1 >= 3) & (n - g["at"] - 1 >= 3)
    return pages.transform(bind, "two", F.coalesce(two, F.lit(False))).drop("_centers", "_gap")


def row_numbers(l: Column, tolerance: float = ROW_TOLERANCE) -> Column:
    """For lines sorted by (center_y, left) the row of each: a line further than the tolerance from the mean of the row so far starts a new one."""
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        fits = (acc["n"] > 0) & (F.abs(x["center_y"] - acc["sum"] / F.greatest(acc["n"], F.lit(1))) <= tolerance)
        row = F.when(fits, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(row.alias("row"), (F.when(fits, acc["sum"]).otherwise(0.0) + x["center_y"]).alias("sum"), (F.when(fits, acc["n"]).otherwise(0) + 1).alias("n"), F.array_append(acc["rows"], row).alias("rows"))

    return F.aggregate(l, start, step, lambda acc: acc["rows"])


def sorted_by(l: Column, *fields: str) -> Column:
    """Lines by some of their fields; equal ones keep their order."""
    keyed = F.transform(l, lambda x, i: F.struct(*(x[f].alias(f"k{n}") for n, f in enumerate(fields)), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def single(pages: DataFrame, lines: str, to: str) -> DataFrame:
    """pages with the lines of a column in one-column order: rows from top to bottom, each from left to right. Also <to>_rows, the row of each line by height."""
    pages = pages.transform(bind, "_sorted", sorted_by(F.col(lines), "center_y", "left")).transform(bind, f"{to}_rows", row_numbers(F.col("_sorted")))
    keyed = F.zip_with("_sorted", f"{to}_rows", lambda x, r: F.struct(r.alias("row"), x["left"].alias("left"), x.alias("x")))
    return pages.transform(bind, "_keyed", sorted_by(keyed, "row", "left")).transform(bind, to, F.transform("_keyed", lambda k: k["x"])).drop("_sorted", "_keyed")


def two_columns(pages: DataFrame, to: str) -> DataFrame:
    """pages (with m) with their lines in two-column order: header, full-width lines above the columns, left column, right column, other full-width lines, footer."""
    pages = pages.transform(bind, "_top", F.array_min(F.transform("lines", lambda x: x["top"]))).transform(bind, "_bottom", F.array_max(F.transform("lines", lambda x: x["bottom"])))
    height = F.greatest(F.lit(1.0), F.col("_bottom") - F.col("_top"))
    pages = pages.transform(bind, "_low", F.col("_top") + height * 0.18).transform(bind, "_high", F.col("_bottom") - height * 0.12)
    is_header, is_footer = (lambda x: x["bottom"] <= F.col("_low")), (lambda x: x["top"] >= F.col("_high"))
    wide = lambda x: x["width"] >= F.col("page_width") * 0.72
    body = F.filter("lines", lambda x: ~is_header(x) & ~is_footer(x))
    pages = pages.transform(bind, "_header", F.filter("lines", is_header)).transform(bind, "_footer", F.filter("lines", is_footer)).transform(bind, "_body", body)
    pages = pages.transform(bind, "_full", sorted_by(F.filter("_body", wide), "top", "left")).transform(bind, "_narrow", sorted_by(F.filter("_body", lambda x: ~wide(x)), "top", "left"))
    pages = pages.transform(bind, "_centers", F.array_sort(F.transform("_narrow", lambda x: x["center_x"]))).transform(bind, "_split", widest_gap(F.col("_centers"))["split"])
    is_left = lambda x: F.coalesce(x["center_x"] <= F.col("_split"), F.lit(True))
    pages = pages.transform(bind, "_left", F.filter("_narrow", is_left)).transform(bind, "_right", F.filter("_narrow", lambda x: ~is_left(x)))
    pages = pages.transform(bind, "_anchor", F.array_min(F.transform("_narrow", lambda x: x["top"])) + F.greatest(F.lit(12.0), F.col("median_height") * 1.5))
    for part in ("_header", "_left", "_right", "_footer"):
        pages = single(pages, part, f"{part}_in_order")
    leads = lambda x: F.coalesce(x["bottom"] <= F.col("_anchor"), F.lit(True))
    whole = F.concat("_header_in_order", F.filter("_full", leads), "_left_in_order", "_right_in_order", F.filter("_full", lambda x: ~leads(x)), "_footer_in_order")
    pages = pages.transform(bind, to, whole)
    return pages.drop(*(c for c in pages.columns if c.startswith("_")))


def order(pages: DataFrame, to: str = "in_order") -> DataFrame:
    """pages (with mode) in reading order. Notices have one column always; other pages are looked at."""
    pages = two_columns(single(detect(pages), "lines", "one"), "both")
    return pages.transform(bind, to, F.when((F.col("mode") != "notice") & F.col("two"), F.col("both")).otherwise(F.col("one"))).drop("one", "one_rows", "both")


def keeps_line(line: Column, mode: Column, min_score: float = MIN_SCORE, min_length: int = 1) -> Column:
    t = line["text"]
    threshold = F.when(mode == "general", F.least(F.lit(min_score), F.lit(GENERAL_SCORE))).otherwise(F.lit(min_score))
    short = F.length(t) < min_length
    return (t != "") & ~F.when(mode == "general", ~tx.is_meaningful(t) & short).otherwise(short) & (line["score"] >= threshold) & ~(t.isin(tx.NOISE_GLYPHS) & ~tx.is_meaningful(t)) & ~tx.is_page_number(t) & ~tx.dropped_by_mode(t, mode)


def stitch(l: Column) -> Column:
    """Lines to text: a blank on the same row, a blank line over a wide gap, else a line break."""
    def part(x: Column, i: Column) -> Column:
        p = F.get(l, i - 1)
        tall = F.greatest(p["height"], x["height"])
        gap = F.when(F.abs(x["center_y"] - p["center_y"]) <= tall * 0.6, " ").when(x["top"] - p["bottom"] > tall * 1.2, "\n\n").otherwise("\n")
        return F.concat(F.when(i > 0, gap).otherwise(""), x["text"])

    return tx.strip(F.replace(F.array_join(F.transform(l, part), ""), F.lit("\n\n\n"), F.lit("\n\n")))


def parse_pages(lines: DataFrame, modes: DataFrame) -> DataFrame:
    """A row for each page of lines(doc_id, page_no, line_no, text, score, bbox): texts for display and retrieval, order and counts.

    modes has doc_id and clean_mode; documents without one are general. A page whose lines have no text has empty texts.
    """
    pages = gather(lines).join(modes.select("doc_id", tx.clean_mode(F.col("clean_mode")).alias("mode")), "doc_id", "left")
    pages = order(pages.withColumn("mode", F.coalesce("mode", F.lit("general")))).withColumn("ordered", F.filter("in_order", lambda x: keeps_line(x, F.col("mode"))))
    pages = pages.withColumn("preclean_text", stitch(F.col("ordered")))
    return pages.select(
        "doc_id",
        F.col("page_no").alias("page"),
        F.col("raw_text").alias("raw_ocr_text"),
        "preclean_text",
        tx.display_text(F.col("preclean_text"), F.col("mode")).alias("display_text"),
        tx.rag_text(F.col("preclean_text"), F.col("mode")).alias("clean_text_for_rag"),
        F.col("mode").alias("clean_mode"),
        ((F.col("mode") != "notice") & F.col("two")).alias("is_two_column"),
        F.col("line_count").alias("ocr_line_count"),
        F.size("ordered").cast("long").alias("filtered_line_count"),
        F.transform("ordered", lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"), x["score"].alias("score"), x["bbox"].alias("bbox"))).alias("lines"),
    )


def merge_pages(pages: DataFrame, column: str = "display_text") -> DataFrame:
    """doc_id and text: a document's pages in order with a blank line between, empty ones left out."""
    some = pages.select("doc_id", "page", tx.safe_text(F.col(column)).alias("t"))
    whole = some.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("t") != "", F.struct("page", "t")))).alias("p"))
    return whole.select("doc_id", tx.strip(F.array_join(F.transform("p", lambda p: p["t"]), "\n\n")).alias("text"))
