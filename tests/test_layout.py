from __future__ import annotations

import io
import zipfile

import pytest

from quire.functions import pages
from quire.functions.hyphenation import Patterns
from quire.operators import assembly, classify, furniture, glyphs, links, tables
from quire.sources import container

GLYPH = "doc_id long, page int, seq int, x double, y double, advance double, size double, rise double, rotation double, rune string, font_id int, render_mode int, missing boolean"


def typed(text, x, y, size=12.0, seq=0, **more):
    """A run of glyphs, half a size wide each."""
    base = {"rise": 0.0, "rotation": 0.0, "font_id": 0, "render_mode": 0, "missing": False} | more
    return [(1, 0, seq + i, float(x + i * size / 2), float(y), size / 2, size, base["rise"], base["rotation"], c, base["font_id"], base["render_mode"], base["missing"]) for i, c in enumerate(text)]


def texts(df):
    return [r.text for r in glyphs.line_text(glyphs.cluster_lines(df)).orderBy("line").collect()]


def test_baselines_make_lines(spark):
    rows = typed("first", 72, 100) + typed("second", 72, 114, seq=10) + typed("third", 72, 128, seq=20)
    assert texts(spark.createDataFrame(rows, GLYPH)) == ["first", "second", "third"]


def test_jitter_stays_on_the_line(spark):
    rows = typed("abc", 72, 100) + typed("d", 90, 101.5, seq=5)
    assert texts(spark.createDataFrame(rows, GLYPH)) == ["abcd"]


def test_the_anchor_is_the_first_glyph_of_a_line(spark):
    rows = [r for k in range(4) for r in typed("a", 72 + 10 * k, 100 + 3.0 * k, seq=k)]
    out = glyphs.cluster_lines(spark.createDataFrame(rows, GLYPH)).orderBy("y").collect()
    assert [r.line for r in out] == [0, 0, 1, 1]  # 106 is 6 from 100, though 3 from 103


def test_gaps_make_spaces(spark):
    rows = typed("one", 72, 100) + typed("two", 72 + 18 + 8, 100, seq=5)
    assert texts(spark.createDataFrame(rows, GLYPH)) == ["one two"]
    assert texts(spark.createDataFrame(typed("together", 72, 100), GLYPH)) == ["together"]


def test_superscripts_are_bracketed(spark):
    rows = typed("word", 72, 100) + typed("1", 96, 96, seq=5, rise=4.0)
    out = glyphs.line_text(glyphs.cluster_lines(spark.createDataFrame(rows, GLYPH))).collect()[0]
    assert out.text == f"word{glyphs.OPEN}1{glyphs.CLOSE}" and out.has_superscript


@pytest.mark.parametrize(("modes", "kept"), [((0, 3), "seen"), ((3, 3), "seenhidden")])
def test_invisible_text(spark, modes, kept):
    rows = typed("seen", 72, 100, render_mode=modes[0]) + typed("hidden", 72, 114, seq=10, render_mode=modes[1])
    out = glyphs.visible(spark.createDataFrame(rows, GLYPH)).orderBy("seq").collect()
    assert "".join(r.rune for r in out) == kept


def test_two_columns_have_a_gutter_and_an_order(spark):
    rows = []
    for k in range(20):
        rows += typed("left text here in", 72, 100 + 12 * k, 10.0, seq=100 * k) + typed("right text here i", 320, 100 + 12 * k, 10.0, seq=100 * k + 50)
    found = glyphs.strongest(glyphs.gutters(spark.createDataFrame(rows, GLYPH))).collect()
    assert len(found) == 1 and 150 < found[0].min_x < found[0].max_x < 325
    cuts = spark.createDataFrame([(1, 0, 200.0, 300.0)], "doc_id long, page int, min_x double, max_x double")
    rows = [(1, 0, 0, 72.0, 500.0), (1, 0, 1, 72.0, 180.0), (1, 0, 2, 310.0, 480.0), (1, 0, 3, 72.0, 180.0), (1, 0, 4, 310.0, 480.0)]
    out = glyphs.reading_order(spark.createDataFrame(rows, "doc_id long, page int, ord long, min_x double, max_x double"), cuts).orderBy("position").collect()
    assert [r.ord for r in out] == [0, 1, 3, 2, 4]


def test_shuffled_glyphs_give_the_same_lines(spark):
    rows = [r for k in range(12) for r in typed(f"line number {k}", 72, 100 + 14 * k, seq=100 * k)]
    a = texts(spark.createDataFrame(rows, GLYPH).repartition(1))
    b = texts(spark.createDataFrame(rows[::-1], GLYPH).repartition(7))
    assert a == b and len(a) == 12


def test_wide_gaps_and_sizes_break_blocks(spark):
    rows = [(1, 0, k, y, size, "serif", 72.0, 472.0) for k, (y, size) in enumerate([(100.0, 10.0), (112.0, 10.0), (124.0, 10.0), (160.0, 10.0), (172.0, 14.0)])]
    out = glyphs.segment_blocks(spark.createDataFrame(rows, "doc_id long, page int, ord long, baseline double, size double, family string, min_x double, max_x double")).orderBy("ord").collect()
    assert [r.block for r in out] == [0, 0, 0, 1, 2]


def test_split_by_size_starts_anew(spark):
    rows = [(1, 0, k, s) for k, s in enumerate([400, 500, 300, 800, 200, 5000])]
    out = assembly.split_by_size(spark.createDataFrame(rows, "doc_id long, chapter long, ord long, size long"), 1000 + assembly.WRAPPER + 24).orderBy("ord").collect()
    assert [r.part for r in out] == [0, 0, 1, 2, 2, 3]


def test_nav_parents(spark):
    levels = [1, 2, 2, 3, 1, 3, 2]
    out = assembly.nav_tree(spark.createDataFrame([(1, k, v) for k, v in enumerate(levels)], "doc_id long, ord long, level int")).orderBy("ord").collect()
    assert [r.parent for r in out] == [None, 0, 0, 2, None, 4, 4]


def test_even_sample(spark):
    got = sorted(r.page for r in furniture.even_sample(spark.createDataFrame([(1, p) for p in range(100)], "doc_id long, page int")).collect())
    assert len(got) == 20 and got[0] == 0 and got[-1] == 99


def test_outline_binds_each_block_once(spark):
    marks = spark.createDataFrame([(1, 0, 1, 1, 100.0), (1, 0, 2, 2, 100.0), (1, 0, 3, 9, None)], "doc_id long, page int, seq long, depth int, y double")
    rows = spark.createDataFrame([(1, 0, 10, 90.0, 110.0), (1, 0, 11, 120.0, 130.0), (1, 0, 12, 20.0, 30.0)], "doc_id long, page int, ord long, min_y double, max_y double")
    out = links.reconcile_outline(marks, rows).orderBy("seq").collect()
    assert [(r.ord, r.level) for r in out] == [(10, 1), (11, 2), (12, 6)]


def test_overlapping_spans(spark):
    rows = [(1, 0, 10), (1, 5, 30), (1, 10, 12), (1, 0, 4), (1, 20, 25)]
    out = links.without_overlaps(spark.createDataFrame(rows, "key long, start long, end long")).orderBy("start").collect()
    assert [(r.start, r.end) for r in out] == [(0, 10), (10, 12), (20, 25)]


def test_ruled_table(spark):
    rules = [(1, 0, k, True, 70.0, 340.0, 180.0 + 28.0 * k, 180.5 + 28.0 * k) for k in range(3)] + [(1, 0, 9 + k, False, 70.0 + 90.0 * k, 70.5 + 90.0 * k, 180.0, 236.0) for k in range(3)]
    ruled = tables.regions(spark.createDataFrame(rules, "doc_id long, page int, seq int, horizontal boolean, min_x double, max_x double, min_y double, max_y double"))
    rows = typed("ab", 80, 200) + typed("cd", 170, 200, seq=5) + typed("ef", 80, 228, seq=10) + typed("gh", 170, 228, seq=15)
    glyph = spark.createDataFrame(rows, GLYPH).selectExpr("*", "0L AS ord")
    got = {(r.row, r.col): r.text for r in tables.cells(ruled, glyph).collect()}
    assert got == {(0, 0): "ab", (0, 1): "cd", (1, 0): "ef", (1, 1): "gh"}


def test_page_ranges():
    assert pages.parse("2-4,3-6,9,12-") == [(1, 5), (8, 8), (11, pages.OPEN)]
    assert pages.parse("1,2,3") == [(0, 2)]
    with pytest.raises(ValueError, match="bad page span"):
        pages.parse("5-2")


def test_hyphens():
    p = Patterns(["1ba", "a1c", "n1t"], ["ta-ble"])
    assert p.breaks("table") == [2]
    assert p.decision("con", "tent") == "drop: patterns permit"
    assert p.decision("Sachs", "Wolfe") == "keep: both capitalised"
    assert p.decision("COVID", "19") == "keep: digit at the edge"
    assert p.decision("foo", "Bar") == "keep: continuation not lowercase"
    assert p.decision("", "x") == "keep: empty fragment"
    assert Patterns.parse("\\patterns{1ba % note\n a1c}\\hyphenation{ta-ble}").exceptions == {"table": [2]}


def test_books_are_deterministic(spark):
    rows = spark.createDataFrame([(1, 1, "B", "<p>b</p>"), (1, 0, "A", "<p>a</p>")], "doc_id long, chapter long, title string, body string")
    first, again = (container.books(rows.repartition(n)).collect()[0].book for n in (1, 3))
    assert first == again
    with zipfile.ZipFile(io.BytesIO(bytes(first))) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED and z.testzip() is None


def test_markers_and_sentences(spark):
    rows = spark.createDataFrame([("1. one",), ("iv) four",), ("• dot",), ("plain text",), ("end.)",)], "text string")
    got = [(r[0], r[1]) for r in rows.select(rows.text.rlike(classify.MARKER), classify.ends_sentence(rows.text)).collect()]
    assert got == [(True, False), (True, False), (True, False), (False, False), (False, True)]


def test_stream(spark, tmp_path):
    from quire.streaming.watch import watch

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "in"))
    query = watch(spark, str(tmp_path / "in"), rows.schema, lambda df: df.selectExpr("doc_id", "upper(text) AS text"), str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B"]
