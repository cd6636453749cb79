"""Tables as array<array<string>>: normalising, judging, rendering to Markdown, HTML and CSV. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import CJK, is_blank, let, strip, stripped

_EMPTY = "array<array<string>>"


def normalise_rows(rows: Column) -> Column:
    """Cells stripped (null as empty), empty rows dropped, rows padded to the widest, columns that are empty throughout dropped."""
    some = lambda r: F.exists(r, lambda c: c != "")
    clean = F.filter(F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, lambda c: stripped(F.coalesce(c, F.lit(""))))), some)

    def squared(r: Column) -> Column:
        kept = F.filter(F.sequence(F.lit(0), F.array_max(F.transform(r, F.size)) - 1), lambda i: F.exists(r, lambda x: F.coalesce(F.get(x, i), F.lit("")) != ""))
        padded = let(kept, lambda k: F.transform(r, lambda x: F.transform(k, lambda i: F.coalesce(F.get(x, i), F.lit("")))))
        return F.when(F.size(r) > 0, padded).otherwise(F.array().cast(_EMPTY))

    return let(clean, squared)


def is_prose(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    # most cells are too short even before they are stripped
    return (F.length(F.coalesce(c, F.lit(""))) >= 36) & (F.length(s) >= 36) & (s.rlike("[。；，、.!?;,:]") | (F.regexp_count(s, F.lit(f"[{CJK}]")) >= 24))


def shape(rows: Column) -> Column:
    """Statistics of normalised rows, over rows with two filled cells at least."""
    return let(rows, _shape)


def _shape(rows: Column) -> Column:
    filled = lambda r: F.filter(r, lambda c: c != "")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    is_short = lambda c: (F.length(c) <= 28) | c.endswith(":") | c.endswith("：")

    def of(kept: Column, cells: Column, cols: Column) -> Column:
        share = lambda test: F.size(F.filter(cells, test)) / F.size(cells)
        return F.struct(
            F.size(rows).alias("n_rows"),
            cols.alias("n_cols"),
            F.size(kept).alias("kept"),
            F.size(F.filter(kept, lambda r: F.size(filled(r)) >= 3)).alias("three"),
            F.size(cells).alias("cells"),
            (F.size(cells) / (F.size(kept) * cols)).alias("density"),
            (total(F.transform(cells, F.length)) / F.size(cells)).alias("avg_chars"),
            share(lambda c: F.length(c) <= 32).alias("short"),
            share(lambda c: F.length(c) >= 56).alias("long"),
            share(lambda c: c.rlike(r"(?U)\d")).alias("numeric"),
            share(is_prose).alias("prose"),
            (F.size(F.filter(kept, lambda r: is_short(F.get(r, 0)))) / F.size(kept)).alias("short_first"),
            (total(F.transform(cells, F.length)) / F.size(kept)).alias("row_chars"),
        )

    some = lambda kept: let(F.flatten(F.transform(kept, filled)), lambda cells: F.when(F.size(cells) > 0, of(kept, cells, F.array_max(F.transform(rows, F.size)))))
    return let(F.filter(rows, lambda r: F.size(filled(r)) >= 2), some)


def judge(stats: Column) -> Column:
    """Whether statistics from shape() are a table's."""
    return F.coalesce(let(stats, _judged), F.lit(False))


def _judged(s: Column) -> Column:
    wide = (
        (s["kept"] >= 3)
        & (s["three"] >= F.greatest(F.lit(2), F.floor(s["kept"] * F.lit(0.35))))
        & (s["density"] >= 0.55)
        & ~((s["short"] < 0.45) & (s["numeric"] < 0.18))
        & ~((s["long"] > 0.45) & (s["numeric"] < 0.18))
        & ~((s["prose"] > 0.45) & (s["numeric"] < 0.18))
        & ~((s["avg_chars"] > 70) & (s["numeric"] < 0.20))
    )
    pairs = (s["kept"] >= 3) & (s["density"] >= 0.65) & (s["short_first"] >= 0.6) & (s["row_chars"] <= 130) & ((s["long"] <= 0.35) | (s["numeric"] >= 0.15)) & (s["prose"] <= 0.50)
    basic = (s["n_rows"] >= 2) & (s["n_cols"] >= 2) & (s["kept"] >= 2)
    return F.when(~F.coalesce(basic, F.lit(False)), False).otherwise(F.when(s["n_cols"] >= 3, wide).otherwise(pairs))


def is_probable(rows: Column) -> Column:
    return F.coalesce(let(normalise_rows(rows), lambda r: judge(shape(r))), F.lit(False))


def probable(tables: DataFrame) -> DataFrame:
    """tables with their rows normalised, those that are judged to be tables. The rows are worked out once, for the filter and for what follows."""
    return tables.withColumn("rows", F.explode(F.filter(F.array(normalise_rows(F.col("rows"))), lambda r: judge(shape(r)))))


def markdown(rows: Column) -> Column:
    """First row as header; cells padded or cut to its width, pipes escaped, line breaks as blanks."""
    cell = lambda c: strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    head = F.get(rows, 0)
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: line(F.transform(head, lambda _, i: cell(F.get(r, i)))))
    out = F.concat(F.array(line(F.transform(head, cell)), line(F.transform(head, lambda _: F.lit("---")))), body)
    return F.when(F.size(rows) > 0, F.array_join(out, "\n")).otherwise("")


def html(rows: Column) -> Column:
    def cell(c: Column) -> Column:
        c = F.coalesce(c, F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    row = lambda r, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<"), tag, F.lit(">"), cell(c), F.lit("</"), tag, F.lit(">"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(rows, lambda r, i: row(r, F.when(i == 0, "th").otherwise("td"))), "")
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table>"), body, F.lit("</table>"))).otherwise("<table></table>")


def csv_cell(c: Column) -> Column:
    """Line breaks as blanks; quoted only for a comma or a quote."""
    v = F.translate(F.coalesce(c, F.lit("")), "\r\n", "  ")
    return F.when(v.rlike('[,"]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_rows(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(F.array_join(F.transform(r, csv_cell), ","), F.lit("\n"))), "")


def _json_rows(json: Column) -> Column:
    return F.from_json(json, "array<array<string>>")


def json_rows(json: Column) -> Column:
    """The rows of a table's JSON: of the array, of its object's rows, or of those of its table_json; null if there are none."""
    rows = F.coalesce(F.get_json_object(json, "$.rows"), F.get_json_object(json, "$.table_json.rows"), F.when(F.trim(json).startswith("["), json))
    return F.nullif(_json_rows(rows), F.array().cast(_EMPTY))


def json_csv(json: Column) -> Column:
    """CSV of a table's JSON whose rows are arrays or objects; empty if it has none."""
    columns = F.coalesce(F.get_json_object(json, "$.columns"), F.get_json_object(json, "$.table_json.columns"))

    def of(rows: Column) -> Column:  # what is parsed is parsed once
        objects = F.from_json(rows, "array<map<string,string>>")
        names = F.coalesce(F.from_json(columns, "array<string>"), F.json_object_keys(F.get_json_object(rows, "$[0]")))
        by_name = lambda n: F.concat(F.array(n), F.transform(objects, lambda o: F.transform(n, lambda x: F.try_element_at(o, x))))
        arrays = csv_rows(F.filter(_json_rows(rows), lambda r: r.isNotNull()))
        named = let(names, lambda n: F.when(F.size(n) > 0, csv_rows(by_name(n))))
        return F.coalesce(F.when(rows.rlike(r"^\s*\[\s*\["), arrays).when(rows.rlike(r"^\s*\[\s*\{"), named), F.lit(""))

    return let(F.coalesce(F.get_json_object(json, "$.rows"), F.get_json_object(json, "$.table_json.rows")), of)


def markdown_csv(md: Column) -> Column:
    """CSV of a Markdown table; escaped pipes split cells all the same, rows of dashes go."""
    line = F.filter(F.transform(F.split(md, r"\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]"), lambda x: F.trim(x)), lambda x: x.contains("|"))
    bare = F.transform(line, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\|", ""), r"\|\z", ""))
    cells = F.transform(bare, lambda x: F.transform(F.split(x, r"\|"), lambda c: F.trim(c)))
    rows = F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-{3,}:?$")))
    return F.when(is_blank(md), "").otherwise(csv_rows(rows))


def to_csv(json: Column, md: Column) -> Column:
    """CSV from the JSON, else from the Markdown, else the JSON itself."""
    some = lambda c: let(c, lambda x: F.when(~is_blank(x), x))
    return F.when(is_blank(json) & is_blank(md), "").otherwise(F.coalesce(some(json_csv(json)), some(markdown_csv(md)), json, F.lit("")))


def key(page: Column, rows: Column) -> Column:
    """What two copies of a table on a page share."""
    text = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, stripped), "\t")), "\n")
    return F.concat(page.cast("string"), F.lit(":"), F.md5(text))


def table_struct(page: Column, seq: Column, rows: Column, source: Column) -> Column:
    return F.struct(F.concat_ws("-", source, F.lit("table"), page.cast("string"), seq.cast("string")).alias("id"), page.alias("page"), F.lit(None).cast("string").alias("title"), markdown(rows).alias("markdown"), html(rows).alias("html"), rows.alias("rows"), source.alias("source"))


def body_text(md: Column, rows: Column) -> Column:
    """Markdown, else rows with tabs, else null."""
    tsv = F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), "\t")), "\n")
    return F.coalesce(F.when(strip(md) != "", strip(md)), F.when(F.size(rows) > 0, tsv))
