from __future__ import annotations

from xml.etree import ElementTree

from pyspark.sql import functions as F

from quire.operators import links, render, runs
from quire.plans import catalog
from quire.sources import container


def test_lists_and_tables_render(spark):
    df = spark.createDataFrame([(["a<b", "c"], True, 3)], "items array<string>, ordered boolean, start int")
    assert df.select(render.list_html(F.col("items"), F.col("ordered"), F.col("start"))).collect()[0][0] == '<ol start="3"><li>a&lt;b</li><li>c</li></ol>'
    df = spark.createDataFrame([([[("head", 2)], [("x", 1), ("long", 1)]],)], "rows array<array<struct<text:string,colspan:int>>>")
    html, text = df.select(render.table_html(F.col("rows")), render.table_text(F.col("rows"))).collect()[0]
    assert html == '<table><tr><td colspan="2">head</td></tr><tr><td>x</td><td>long</td></tr></table>'
    assert text == "head\nx     long"


def test_ruleless_tables_need_shared_starts(spark):
    rows = [(1, 0, 10 * r + c, 100.0 + 14 * r, x + (0.5 if r % 2 else 0.0)) for r in range(4) for c, x in enumerate((72.0, 200.0, 300.0 + 40 * r))]
    rows += [(1, 1, 10 * r + c, 100.0 + 14 * r, x) for r in range(4) for c, x in enumerate((72.0, 200.0 + 30 * r))]
    rows += [(1, 2, 10 * r + c, 100.0 + 14 * r, x) for r in range(2) for c, x in enumerate((72.0, 200.0))]
    out = render.aligned_tables(spark.createDataFrame(rows, "doc_id long, page int, ord long, baseline double, min_x double")).collect()
    assert [(r.page, r.n_rows, r.shared) for r in out] == [(0, 4, 2)]


def test_links_map_to_glyphs(spark):
    glyphs = spark.createDataFrame([(1, 0, 5, k, 72.0 + 6 * k, 100.0, 6.0, 12.0) for k in range(10)], "doc_id long, page int, ord long, seq int, x double, y double, advance double, size double")
    links = spark.createDataFrame([(1, 0, 7, 84.0, 108.0, 90.0, 103.0), (1, 0, 8, 84.0, 108.0, 300.0, 310.0)], "doc_id long, page int, link long, min_x double, max_x double, min_y double, max_y double")
    assert [tuple(r) for r in render.link_spans(links, glyphs).collect()] == [(1, 0, 5, 7, 2, 6)]


def test_metadata_precedence(spark):
    rows = [(1, "asked", "own", None, "de", None, None, None), (2, " ", "own", None, None, None, None, None), (3, None, None, "fr", "de", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, asked_title string, title string, asked_language string, language string, asked_modified timestamp, modified timestamp, created timestamp")
    got = {r.doc_id: (r.title, r.language, r.modified.year) for r in runs.metadata(df).collect()}
    assert got == {1: ("asked", "de", 1970), 2: ("own", "en", 1970), 3: ("Untitled", "fr", 1970)}


def test_blocks_render_and_chapters_join(spark):
    kinds = [("heading", 1, "A & B"), ("paragraph", None, "one"), ("paragraph", None, "two"), ("list", None, "2. x<y"), ("list", None, "3. z"), ("list", None, "- dash"), ("paragraph", None, " "), ("footnote", None, "1 note"), ("code", None, "a < b"), ("blockquote", None, "said"), ("paragraph", None, "end")]
    rows = [(1, 0, k, kind, level, text, f"b{k}") for k, (kind, level, text) in enumerate(kinds)]
    df = spark.createDataFrame(rows, "doc_id long, chapter long, ord long, kind string, level int, text string, block_id string")
    body = render.chapter_bodies(render.block_html(df)).collect()[0].body
    assert body.split("\n") == [
        '<h1 id="b0">A &amp; B</h1>', '<p class="first">one</p>', "<p>two</p>", '<ol start="2">', "  <li>x&lt;y</li>", "  <li>z</li>", "</ol>", "<ul>", "  <li>dash</li>", "</ul>",
        '<aside epub:type="footnote" id="b7">', "  <p>1 note</p>", "</aside>", "<pre><code>a &lt; b</code></pre>", "<blockquote><p>said</p></blockquote>", '<p class="first">end</p>', "",
    ]


def test_books_are_well_formed():
    files = container.book_files("urn:x", 'T & "Q"', [("A < B\x01", "<p>a</p>"), ("C", "<p>c</p>")])
    for data in files.values():
        ElementTree.fromstring(data)
    assert "OEBPS/toc.ncx" in files and b"dcterms:modified" in files["OEBPS/content.opf"]
    assert b"<title>A &lt; B</title>" in files["OEBPS/ch001.xhtml"]


def test_links_without_target_stay_and_captions_follow_their_labels(spark):
    refs = spark.createDataFrame([(1, 1, 0, 5.0), (1, 2, 9, None)], "doc_id long, seq long, target_page int, target_y double")
    rows = [(1, 0, 3, "Plate IV", 12.0, 0.0, 50.0, 110.0, 120.0), (1, 0, 4, "table 1", 12.0, 0.0, 50.0, 101.0, 109.0), (1, 0, 5, " ", 6.0, 0.0, 50.0, 100.0, 101.0)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, ord long, text string, size double, min_x double, max_x double, min_y double, max_y double")
    assert {r.seq: r.target_ord for r in links.cross_references(refs, blocks).collect()} == {1: 5, 2: None}
    figs = spark.createDataFrame([(1, 0, 1, 0.0, 50.0, 50.0, 100.0, 12.0)], "doc_id long, page int, fig int, min_x double, max_x double, min_y double, max_y double, body_size double")
    assert [r.caption_ord for r in links.assign_captions(figs, blocks).collect()] == [3]


def test_captions_lay_pages_together_without_grouping_or_keeping(spark, tmp_path):
    figs = spark.createDataFrame([(1, 0, 2, 0.0, 50.0, 50.0, 100.0, 12.0), (1, 0, 1, 0.0, 50.0, 40.0, 98.0, 12.0), (2, 0, 1, 0.0, 50.0, 50.0, 100.0, 12.0)], "doc_id long, page int, fig int, min_x double, max_x double, min_y double, max_y double, body_size double")
    rows = [(1, 0, 7, "Figure 2", None, 0.0, 50.0, 110.0, 120.0), (1, 0, 3, "small", 8.0, 0.0, 50.0, 103.0, 109.0), (3, 0, 1, "Figure 1", 8.0, 0.0, 50.0, 103.0, 109.0)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, ord long, text string, size double, min_x double, max_x double, min_y double, max_y double")
    assert {(r.doc_id, r.fig): r.caption_ord for r in links.assign_captions(figs, blocks).collect()} == {(1, 1): 3, (1, 2): 7}
    assert links.assign_captions(figs.limit(0), blocks).collect() == [] == links.assign_captions(figs, blocks.limit(0)).collect()
    spark.createDataFrame([(1, "a b. c-\n" * 700)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = catalog.QUERIES["captions"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("FlatMap", "InMemoryTableScan"))
