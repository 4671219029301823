"""Synthetic typesetter: documents to positioned lines, blocks and glyphs.

The driver tables hold plain text. These views lay it out on 612 x 792 pages, eight words
a line and forty lines a page, on a quarter-point grid (so medians and sums are exact),
and put in what the layout operators look for: headings, quotes, lists, footnotes, code,
running heads, folios, hyphens, rotated and invisible glyphs. Features follow from line
numbers, never from chance. The same SQL styles the views here and in the test database;
the dialect differs, and here a document (``doc_id`` is its key) is cut into lines in its own row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators import batches, stream

WORDS_PER_LINE, LINES_PER_PAGE = 8, 40

SPARK = {
    "more": "last_line, ",
    "lines_joined": "listagg(text, ' ') WITHIN GROUP (ORDER BY ord)",
    "div": "div",
    "chars": "LATERAL VIEW posexplode(split(text, '')) AS i, rune",
    "chars_from": "lines",
}
DUCK = {
    "words": r"SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS w, unnest(p) AS word FROM (SELECT doc_id, string_split_regex(trim(text, E' \n\t'), '[ \n\t]+') AS p FROM documents WHERE text IS NOT NULL)",
    "joined": "string_agg(word, ' ' ORDER BY w)",
    "more": "",
    "lines_joined": "string_agg(text, ' ' ORDER BY ord)",
    "div": "//",
    "chars": "",
    "chars_from": "(SELECT *, unnest(generate_series(0, length(text) - 1)) AS i, unnest(string_split(text, '')) AS rune FROM lines)",
}

_PLACED = """
raw_words AS ({words}),
raw_lines AS (SELECT doc_id, w {div} 8 AS line_no, {joined} AS plain FROM raw_words GROUP BY doc_id, w {div} 8),
placed AS (SELECT doc_id, line_no, CAST(line_no {div} 40 AS INT) AS page, CAST(line_no % 40 AS INT) AS row_no, plain FROM raw_lines),"""
#: A text is cut where it lies, so laying out moves no rows: its words are an array, its lines slices of it.
_SPARK_PLACED = r"""
raw_docs AS (SELECT doc_id, split(trim(BOTH ' \n\t' FROM text), '[ \n\t]+') AS p FROM {{documents}}),
raw_lines AS (SELECT doc_id, line_no, line_no = (size(p) - 1) div 8 AS last_line, array_join(slice(p, CAST(line_no * 8 + 1 AS INT), 8), ' ') AS plain
  FROM raw_docs LATERAL VIEW explode(sequence(0L, (size(p) - 1) div 8)) AS line_no),
placed AS (SELECT doc_id, line_no, last_line, CAST(line_no div 40 AS INT) AS page, CAST(line_no % 40 AS INT) AS row_no, plain FROM raw_lines),"""

_STYLED = """
classed AS (
  SELECT *, CASE WHEN row_no = 0 AND page % 5 = 0 THEN 'head1'
                 WHEN row_no = 20 AND page % 3 = 1 THEN 'head2'
                 WHEN row_no = 39 THEN 'note'
                 WHEN line_no % 23 IN (7, 8, 9) THEN 'item'
                 WHEN line_no % 37 = 5 THEN 'code'
                 WHEN line_no % 77 BETWEEN 28 AND 33 THEN 'quote'
                 ELSE 'text' END AS cls
  FROM placed),
styled AS (
  SELECT doc_id, page, row_no, line_no, {more}cls,
         CASE cls WHEN 'note' THEN concat('1 ', plain) WHEN 'item' THEN concat(CAST(line_no % 23 - 6 AS VARCHAR(4)), '. ', plain) ELSE plain END AS text,
         CASE cls WHEN 'head1' THEN 18.0 WHEN 'head2' THEN 14.0 WHEN 'note' THEN 8.0 ELSE 11.0 END AS size_,
         CASE WHEN cls = 'code' THEN 'mono' ELSE 'serif' END AS family,
         cls = 'head1' OR cls = 'head2' AND page % 2 = 1 AS bold, cls = 'code' AS fixed,
         CASE WHEN cls = 'quote' THEN 108.0 ELSE 72.0 END AS x0, 96.0 + 14.0 * row_no AS y0
  FROM classed),"""

_EVERYTHING = """
body AS (
  SELECT doc_id, page, line_no * 4 + 1 AS ord, cls, text, size_, family, bold, fixed, x0, y0 FROM styled),
heads AS (
  SELECT doc_id, page, min(line_no) * 4 AS ord, 'running' AS cls, concat('Running head no. ', CAST(doc_id % 7 AS VARCHAR(20))) AS text,
         9.0 AS size_, 'serif' AS family, false AS bold, false AS fixed, 72.0 AS x0, 30.0 AS y0 FROM styled GROUP BY doc_id, page),
folios AS (
  SELECT doc_id, page, max(line_no) * 4 + 3 AS ord, 'folio' AS cls, CAST(page + 1 AS VARCHAR(20)) AS text,
         9.0 AS size_, 'serif' AS family, false AS bold, false AS fixed, 300.0 AS x0, 780.0 AS y0 FROM styled GROUP BY doc_id, page),
everything AS (SELECT * FROM body UNION ALL SELECT * FROM heads UNION ALL SELECT * FROM folios),"""
#: A page's first line brings the running head, its last one the folio; in reading order.
_SPARK_EVERYTHING = """
everything AS (
  SELECT doc_id, page, e.* FROM (SELECT doc_id, page, explode(array(
    CASE WHEN row_no = 0 THEN named_struct('ord', line_no * 4, 'cls', 'running', 'text', concat('Running head no. ', CAST(doc_id % 7 AS STRING)),
      'size_', 9.0D, 'family', 'serif', 'bold', false, 'fixed', false, 'x0', 72.0D, 'y0', 30.0D) END,
    named_struct('ord', line_no * 4 + 1, 'cls', cls, 'text', text, 'size_', CAST(size_ AS DOUBLE), 'family', family, 'bold', bold, 'fixed', fixed, 'x0', CAST(x0 AS DOUBLE), 'y0', CAST(y0 AS DOUBLE)),
    CASE WHEN last_line OR row_no = 39 THEN named_struct('ord', line_no * 4 + 3, 'cls', 'folio', 'text', CAST(page + 1 AS STRING),
      'size_', 9.0D, 'family', 'serif', 'bold', false, 'fixed', false, 'x0', 300.0D, 'y0', 780.0D) END)) AS e FROM styled) WHERE e IS NOT NULL),"""

_TAIL = """
lines AS (
  SELECT doc_id, page, CAST(ord AS BIGINT) AS ord, cls, text, CAST(size_ AS DOUBLE) AS size, family, bold, fixed, CAST(length(text) AS BIGINT) AS n_glyphs, CAST(y0 AS DOUBLE) AS baseline,
         CAST(x0 AS DOUBLE) AS min_x, CAST(CASE WHEN cls = 'quote' THEN 430.0 WHEN cls = 'text' THEN 540.0 ELSE x0 + 0.25 * size_ * length(text) END AS DOUBLE) AS max_x,
         CAST(y0 - 0.75 * size_ AS DOUBLE) AS min_y, CAST(y0 + 0.25 * size_ AS DOUBLE) AS max_y
  FROM everything)"""

_BLOCKS = """,
flagged AS (
  SELECT *, CASE WHEN cls IN ('text', 'quote', 'code') AND cls = lag(cls) OVER (PARTITION BY doc_id ORDER BY ord)
                  AND page = lag(page) OVER (PARTITION BY doc_id ORDER BY ord) AND (ord {div} 4) % 6 <> 0 THEN 0 ELSE 1 END AS opens
  FROM lines),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block_no FROM flagged),
blocks AS (
  SELECT doc_id, CAST(block_no AS BIGINT) AS ord, min(page) AS page, min(cls) AS cls, {lines_joined} AS text, max(size) AS size, min(family) AS family,
         min(CASE WHEN bold THEN 1 ELSE 0 END) = 1 AS bold, min(CASE WHEN fixed THEN 1 ELSE 0 END) = 1 AS fixed, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(n_glyphs) AS BIGINT) AS n_glyphs,
         min(min_x) AS min_x, max(max_x) AS max_x, min(min_y) AS min_y, max(max_y) AS max_y
  FROM numbered GROUP BY doc_id, block_no)"""

_GLYPHS = """,
glyphs AS (
  SELECT doc_id, page, ord, CAST(i AS INT) AS seq, min_x + 0.5 * size * i + CASE WHEN i % 9 = 8 THEN 1.5 ELSE 0.0 END AS x, baseline AS y, 0.5 * size AS advance,
         size, CASE WHEN cls = 'text' AND i % 41 = 17 THEN 0.25 * size ELSE 0.0 END AS rise,
         CASE WHEN ord % 31 = 5 THEN 90.0 ELSE 0.0 END AS rotation, rune, CASE WHEN fixed THEN 2 WHEN bold THEN 1 ELSE 0 END AS font_id,
         CASE WHEN ord % 29 = 13 AND i % 2 = 0 THEN 3 WHEN page % 17 = 16 THEN 3 ELSE 0 END AS render_mode, page % 19 = 3 AND i % 50 = 49 AS missing
  FROM {chars_from} {chars}
  WHERE rune <> '')"""


def _sql(dialect: dict, *parts: str) -> str:
    return "WITH " + "".join(parts).format(**dialect)


def duck(name: str) -> str:
    """The common table expressions up to lines, blocks or glyphs, for the test database."""
    return _sql(DUCK, _PLACED, _STYLED, _EVERYTHING, _TAIL, *({"lines": (), "blocks": (_BLOCKS,), "glyphs": (_GLYPHS,)}[name]))


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    parts = {"lines": (), "blocks": (_BLOCKS,), "glyphs": (_GLYPHS,)}[name]
    sql = _sql(SPARK, _SPARK_PLACED, _STYLED, _SPARK_EVERYTHING, _TAIL, *parts)
    return spark.sql(sql.replace("VARCHAR(4)", "STRING").replace("VARCHAR(20)", "STRING") + f" SELECT * FROM {name}", documents=documents)


def lines(spark: SparkSession, sf_dir: str, keep: bool = True) -> DataFrame:
    """Kept in memory or on disk unless told otherwise, since most queries read them in several branches."""
    found = _view(spark, sf_dir, "lines")
    return found.persist() if keep else found


def blocks(spark: SparkSession, sf_dir: str, keep: bool = True) -> DataFrame:
    """Kept like the lines. Glyphs, of which there are hundreds a line, are not."""
    found = _view(spark, sf_dir, "blocks")
    return found.persist() if keep else found


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "glyphs")


#: What ``spread`` needs of a line.
SPREAD = ("doc_id", "page", "ord", "cls", "text", "n_glyphs", "size", "min_x", "baseline", "bold", "fixed")


def spread(batch: pa.RecordBatch) -> stream.Glyphs:
    """The glyphs of a batch of lines, as the view ``glyphs`` has them."""
    number = lambda name: batches.numbers(batch, name)
    n, size, order, page = number("n_glyphs"), number("size"), number("ord"), number("page")
    code = np.frombuffer("".join(batch.column("text").to_pylist()).encode("utf-32-le"), "<u4")
    line = np.repeat(np.arange(batch.num_rows), n)
    seq = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    each = lambda values: values[line]
    first = np.zeros(batch.num_rows, np.int64)
    first[batches.starts(batch, stream.PAGE)] = 1
    x = each(number("min_x")) + each(0.5 * size) * seq + np.where(seq % 9 == 8, 1.5, 0.0)
    rise = each(np.where(np.array(batch.column("cls").to_pylist()) == "text", 0.25 * size, 0.0)) * (seq % 41 == 17)
    font = np.where(number("fixed"), 2, np.where(number("bold"), 1, 0)).astype(np.int32)
    hidden = each(order % 29 == 13) & (seq % 2 == 0) | each(page % 17 == 16)
    return stream.Glyphs(line, each(np.cumsum(first) - 1), seq, x, each(number("baseline")), each(0.5 * size), each(size), rise, each(np.where(order % 31 == 5, 90.0, 0.0)), code, each(font), np.where(hidden, 3, 0))
