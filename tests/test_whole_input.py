"""Queries whose own SQL there is none for: no page and no line of the input may be left out."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_catalog import canonical

from quire.operators import glyphs, runs, stream
from quire.plans import catalog
from quire.sources import typeset

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_every_line_gets_a_hyphen_decision(spark):
    got = {(r.doc_id, r.ord): r for r in catalog.QUERIES["hyphen_decisions"](spark, SF).collect()}
    want = {(r.doc_id, r.ord): r.text.split(" ")[-1] for r in typeset.lines(spark, SF).select("doc_id", "ord", "text").collect()}
    assert {k: r.word for k, r in got.items()} == want
    assert all(r.decision for r in got.values())
    assert {r.decision for r in got.values() if len(r.word) < 2} <= {"keep: empty fragment"}


def test_gutters_read_every_page(spark, monkeypatch):
    seen = []
    real = catalog.glyphs.gutters
    monkeypatch.setattr(catalog.glyphs, "gutters", lambda rows: seen.append(rows) or real(rows))
    found = catalog.QUERIES["gutters"](spark, SF)
    count = lambda df: sorted(map(tuple, df.groupBy("doc_id", "page", "ord").agg(F.count("*")).collect()))
    assert count(seen[0]) == count(typeset.glyphs(spark, SF))
    # every fourth page is opened between x 180 and 300, and keeps the gutter put there
    assert found.where("page % 4 = 1 AND min_x < 250 AND max_x > 250").count()


def made(tmp_path, *texts):
    """A folder with such documents."""
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    return str(tmp_path)


def against_sql(spark, name, folder):
    """Rows of a query and of its SQL, over the documents of a folder."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    return canonical(catalog.QUERIES[name](spark, folder).toPandas()), canonical(con.sql(catalog.ORACLE_SQL[name]).df())


def test_raised_glyphs_stay_on_the_only_line_of_a_page(spark, tmp_path):
    """18 glyphs of a line among 19 of a running head and a folio: the median size is theirs, and the tolerance under the rise."""
    folder = made(tmp_path, "w " * 640 + "abcd efgh ijkl mno", "abcd efgh ijkl mno")
    got, want = against_sql(spark, "line_clusters", folder)
    assert got == want


ODD = ("", " \n\t ", "x", "# ~ .", "naïve façade 𝒳𝒴 日本語 " * 9, "a b ​c\rd " * 40, "w " * (17 * 320 + 3), "a " * 700 + "z" * 3000, None, "b-c " * 1300)


@pytest.mark.parametrize("name", ["line_text", "split_lines", "typeset_lines", "typeset_blocks", "paragraph_starts", "paragraph_text", "line_clusters"])
def test_odd_documents_give_the_rows_of_the_sql(spark, tmp_path, name):
    got, want = against_sql(spark, name, made(tmp_path, *ODD))
    assert got == want


@pytest.mark.parametrize("name", ["line_text", "split_lines"])
def test_glyphs_are_never_moved(spark, tmp_path, name):
    plan = catalog.QUERIES[name](spark, made(tmp_path, *ODD))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Sort", "InMemoryTableScan"))


def test_streams_say_what_operators_on_rows_say(spark, monkeypatch):
    """Glyphs of mixed sizes, fonts, advances and order, in small batches."""
    monkeypatch.setattr(stream, "GLYPHS", 50)
    rng = np.random.default_rng(7)
    made_rows = []
    for page in range(6):
        for line in range(9):
            for k in range(int(rng.integers(1, 14))):
                size = float(rng.choice([8.0, 10.0, 12.0, 0.0]))
                made_rows.append((1, page, line, k, float(rng.integers(0, 60)) * 4, 20.0 * line, float(rng.choice([4.0, 5.0])), size, float(rng.choice([0, 0, 0, 2])), float(rng.choice([0, 0, 90])), str(rng.choice(list("ab c"))), int(rng.integers(0, 3)), 3 if page == 5 else int(rng.choice([0, 3, 7]))))
    names = "doc_id long, page int, ord long, seq int, x double, y double, advance double, size double, rise double, rotation double, rune string, font_id int, render_mode int"
    df = spark.createDataFrame(made_rows, names)
    lines = sorted({r[:3] for r in made_rows})
    number, column = {r: k for k, r in enumerate(lines)}, lambda k, kind: np.array([r[k] for r in made_rows], kind)
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "page": p, "ord": o, "mids": [60.0, 130.0] if p % 2 else None} for d, p, o in lines], pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("ord", pa.int64()), ("mids", pa.list_(pa.float64()))]))
    code = np.array([ord(r[10]) for r in made_rows], np.uint32)
    g = stream.Glyphs(np.array([number[r[:3]] for r in made_rows]), column(1, int), *(column(k, float) for k in range(3, 10)), code, column(11, np.int32), column(12, int)).ordered()
    out = lambda columns, names: sorted(map(repr, zip(*(columns[c].to_pylist() for c in names), strict=True)))
    names = ["page", "ord", "text", "has_superscript", "size", "baseline", "min_x", "max_x", "min_y", "max_y", "n_glyphs", "font_id"]
    rows = glyphs.line_text(glyphs.visible(glyphs.upright(df)), "ord").select(*names).collect()
    assert out(stream.line_text(batch, stream.visible(stream.upright(g))), names) == sorted(map(repr, map(tuple, rows)))
    cuts = df.where("page % 2 = 1").select("doc_id", "page").distinct().selectExpr("*", "explode(array(60.0D, 130.0D)) m").selectExpr("doc_id", "page", "m min_x", "m max_x")
    rows = runs.split_at_gutters(df, cuts).groupBy("page", "ord", "segment").agg(F.count("*").alias("n"), F.min("x").alias("min_x")).collect()
    assert out(stream.split_at_gutters(batch, g), ["page", "ord", "segment", "n", "min_x"]) == sorted(map(repr, map(tuple, rows)))


def test_gutters_of_a_stream_are_those_of_the_rows(spark, tmp_path):
    """Rows without the mark go the way of rows; the stream moves no glyph."""
    folder = made(tmp_path, *ODD, "one  two three four five six seven eight " * 400)
    of = lambda found: sorted((r.doc_id, r.page, round(r.min_x, 4), round(r.max_x, 4), round(r.strength, 4)) for r in found.collect())
    marked = catalog._with_columns(spark, folder)
    streamed = glyphs.gutters(marked)
    assert "Exchange" not in streamed._jdf.queryExecution().executedPlan().toString()
    assert of(streamed) == of(glyphs.gutters(marked.select("*"))) != []
