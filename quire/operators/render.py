"""Lists and tables as markup, ruleless tables, links over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markup import escape_xml
from .classify import MARKER

#: The marker of a list item, without the first character of its text.
ITEM_MARKER = MARKER.removesuffix(r"[^ \t\n]")
LEAST_ROWS, LEAST_SHARED, COLUMN_TOLERANCE, ROW_TOLERANCE = 3, 2, 2.0, 1.0


def list_html(items: Column, ordered: Column, start: Column) -> Column:
    """An array of item texts; ``start`` is written only where it is over 1."""
    rows = F.array_join(F.transform(items, lambda t: F.concat(F.lit("<li>"), escape_xml(t), F.lit("</li>"))), "")
    opening = F.when(ordered, F.concat(F.lit("<ol"), F.when(start > 1, F.concat(F.lit(' start="'), start.cast("string"), F.lit('"'))).otherwise(""), F.lit(">"))).otherwise("<ul>")
    return F.concat(opening, rows, F.when(ordered, "</ol>").otherwise("</ul>"))


#: What goes around the text of a block.
TAGS = {
    "code": ("<pre><code>", "</code></pre>\n"),
    "blockquote": ("<blockquote><p>", "</p></blockquote>\n"),
    "caption": ('<p class="caption">', "</p>\n"),
}


def block_html(rows: DataFrame) -> DataFrame:
    """Blocks (``doc_id, chapter, ord, kind, level, text, block_id``) with ``html``; blank ones go.

    Headings and footnotes carry their ids. A paragraph that follows anything else, or
    opens its chapter, is a first one. List blocks that follow each other with the same
    ordering are one list, without their markers: the first opens it, the last closes it.
    """
    order = W.partitionBy("doc_id", "chapter").orderBy("ord")
    rows = rows.where(F.trim("text") != "")
    ordered = F.when(F.col("kind") == "list", ~F.col("text").rlike(r"^[•◦▪‣*-]"))
    rows = rows.withColumn("ordered", ordered)
    rows = rows.withColumns({"kind_before": F.lag("kind").over(order), "ordered_before": F.lag("ordered").over(order), "ordered_after": F.lead("ordered").over(order)})
    text, ident = escape_xml(F.col("text")), escape_xml(F.col("block_id"))
    depth = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(6)).cast("string")
    number = F.regexp_extract("text", r"^\(?([0-9]{1,3})[.)\]]", 1).try_cast("int")
    begin = F.when(number > 1, F.concat(F.lit('<ol start="'), number.cast("string"), F.lit('">\n'))).otherwise("<ol>\n")
    opening = F.when(F.col("ordered").eqNullSafe(F.col("ordered_before")), "").when(F.col("ordered"), begin).otherwise("<ul>\n")
    closing = F.when(F.col("ordered").eqNullSafe(F.col("ordered_after")), "").when(F.col("ordered"), "</ol>\n").otherwise("</ul>\n")
    item = escape_xml(F.trim(F.regexp_replace("text", ITEM_MARKER, "")))
    first = F.when(F.col("kind_before").eqNullSafe("paragraph"), "").otherwise(' class="first"')
    html = F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), depth, F.lit(' id="'), ident, F.lit('">'), text, F.lit("</h"), depth, F.lit(">\n")))
    html = html.when(F.col("kind") == "footnote", F.concat(F.lit('<aside epub:type="footnote" id="'), ident, F.lit('">\n  <p>'), text, F.lit("</p>\n</aside>\n")))
    html = html.when(F.col("kind") == "list", F.concat(opening, F.lit("  <li>"), item, F.lit("</li>\n"), closing))
    for kind, (before, after) in TAGS.items():
        html = html.when(F.col("kind") == kind, F.concat(F.lit(before), text, F.lit(after)))
    html = html.otherwise(F.concat(F.lit("<p"), first, F.lit(">"), text, F.lit("</p>\n")))
    return rows.withColumn("html", html).drop("ordered", "kind_before", "ordered_before", "ordered_after")


def chapter_bodies(rendered: DataFrame) -> DataFrame:
    """``(doc_id, chapter, body)``: the markup of each chapter's blocks, in order. A group is one chapter of one document."""
    parts = F.sort_array(F.collect_list(F.struct("ord", "html")))
    return rendered.groupBy("doc_id", "chapter").agg(F.array_join(F.transform(parts, lambda x: x["html"]), "").alias("body"))


def table_html(rows: Column) -> Column:
    """An array of rows, each an array of ``(text, colspan)``."""
    def cell(c: Column) -> Column:
        return F.concat(F.lit("<td"), F.when(c["colspan"] > 1, F.concat(F.lit(' colspan="'), c["colspan"].cast("string"), F.lit('"'))).otherwise(""), F.lit(">"), escape_xml(c["text"]), F.lit("</td>"))

    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))), ""), F.lit("</table>"))


def table_text(rows: Column) -> Column:
    """The same rows as padded columns of plain text, two spaces apart."""
    widths = F.aggregate(rows, F.array().cast("array<int>"), lambda acc, r: F.zip_with(acc, F.transform(r, lambda c: F.length(c["text"])), lambda a, b: F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))))
    line = lambda r: F.rtrim(F.array_join(F.zip_with(r, F.slice(widths, 1, F.size(r)), lambda c, w: F.rpad(c["text"], w, " ")), "  "))
    return F.array_join(F.transform(rows, line), "\n")


def aligned_tables(pieces: DataFrame) -> DataFrame:
    """``(doc_id, page, first_row, n_rows, shared)``: runs of rows whose pieces start at common places.

    Pieces (``doc_id, page, ord, baseline, min_x``) on one baseline form a row. A run of
    three rows or more with two pieces each is a table if at least two starts, within two
    points, are shared by all its rows. Starts go to cells of the tolerance's width and to
    the next one, so the comparison is an equi-join and not one of all pairs.
    """
    key = ["doc_id", "page"]
    order = W.partitionBy(*key).orderBy("baseline", "ord")
    rows = pieces.withColumn("opens", F.coalesce(F.col("baseline") - F.lag("baseline").over(order) > ROW_TOLERANCE, F.lit(True)).cast("int"))
    rows = rows.withColumn("row", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    wide = rows.groupBy(*key, "row").agg(F.count("*").alias("n")).where("n >= 2")
    run = F.col("row") - F.row_number().over(W.partitionBy(*key).orderBy("row"))
    wide = wide.withColumn("run", run)
    long = wide.groupBy(*key, "run").agg(F.min("row").alias("first_row"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= LEAST_ROWS)
    starts = rows.join(wide.select(*key, "row", "run"), [*key, "row"]).join(long, [*key, "run"])
    place = F.floor(F.col("min_x") / COLUMN_TOLERANCE)
    first = starts.where("row = first_row").select(*key, "run", F.col("min_x").alias("x0"), F.explode(F.array(place - 1, place, place + 1)).alias("place")).distinct()
    near = starts.withColumn("place", place).join(first, [*key, "run", "place"]).where(F.abs(F.col("min_x") - F.col("x0")) <= COLUMN_TOLERANCE)
    shared = near.groupBy(*key, "run", "x0", "n_rows", "first_row").agg(F.countDistinct("row").alias("seen")).where("seen = n_rows")
    return shared.groupBy(*key, "first_row", "n_rows").agg(F.count("*").alias("shared")).where(F.col("shared") >= LEAST_SHARED)


def link_spans(links: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``(doc_id, page, ord, link, start, end)``: the glyphs of each line whose centre lies in a link's rectangle, first to last.

    An equi-join on the page, then the containment test.
    """
    order = W.partitionBy("doc_id", "page", "ord").orderBy("x", "seq")
    rows = glyphs.withColumn("at", F.row_number().over(order) - 1).withColumn("cx", F.col("x") + F.col("advance") / 2).withColumn("cy", F.col("y") - 0.25 * F.col("size"))
    hit = rows.join(links, ["doc_id", "page"]).where((F.col("cx") >= F.col("min_x")) & (F.col("cx") <= F.col("max_x")) & (F.col("cy") >= F.col("min_y")) & (F.col("cy") <= F.col("max_y")))
    return hit.groupBy("doc_id", "page", "ord", "link").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"))
