from __future__ import annotations

import pyarrow as pa

from quire.functions import hyphenation
from quire.operators import batches, glyphs, paragraphs
from quire.plans import catalog

LINE = "doc_id long, page int, block long, ord long, text string, baseline double, size double, min_x double, max_x double"


def lines(*rows, size=10.0):
    """(text, baseline, min_x, max_x)"""
    return [(1, 0, 0, k, t, float(y), size, float(a), float(b)) for k, (t, y, a, b) in enumerate(rows)]


def numbers(spark, rows):
    return [r.paragraph for r in sorted(paragraphs.paragraphs(spark.createDataFrame(rows, LINE)).collect(), key=lambda r: r.ord)]


def test_indents_gaps_and_short_ends_open_paragraphs(spark):
    assert numbers(spark, lines(("a", 0, 0, 100), ("b", 12, 0, 100), ("c", 24, 6, 100), ("d", 36, 0, 100))) == [0, 0, 1, 1]
    assert numbers(spark, lines(("a", 0, 0, 100), ("b", 12, 0, 100), ("c", 24, 0, 100), ("d", 40, 0, 100))) == [0, 0, 0, 1]
    assert numbers(spark, lines(("a.", 0, 0, 70), ("b", 12, 0, 100), ("c.", 24, 0, 90), ("d", 36, 0, 100))) == [0, 1, 1, 1]
    assert numbers(spark, lines(("a", 0, 0, 100), ("b", 0, 0, 100), ("c", 12, 0, 100))) == [0, 0, 0]  # a leading of 0 seeds anew


def test_markers_open_items_and_hanging_lines_stay(spark):
    rows = lines(("1. a", 0, 0, 100), ("b", 12, 20, 100), ("2. c", 24, 0, 100), ("d", 36, 20, 100), ("e", 48, 0, 100))
    assert numbers(spark, rows) == [0, 0, 1, 1, 1]


def test_lines_join_and_hyphens_go_where_patterns_permit(spark):
    rows = [(*r, 0.0, 9.0, 0) for r in lines((" the wa-", 0, 0, 9), ("ter ran", 12, 0, 9), ("", 24, 0, 9), ("x-", 36, 0, 9), ("9 b-", 48, 0, 9))]
    df = spark.createDataFrame(rows, LINE + ", min_y double, max_y double, paragraph int")
    kept = paragraphs.paragraph_text(df).collect()[0]
    assert (kept.text, kept.n_lines, kept.hyphens_kept, kept.hyphens_dropped) == ("the wa-ter ran x- 9 b-", 5, 1, 0)
    gone = paragraphs.paragraph_text(df, hyphenation.Patterns(["a1t"], [])).collect()[0]
    assert gone.hyphens_kept + gone.hyphens_dropped == 1 and gone.text in ("the water ran x- 9 b-", "the wa-ter ran x- 9 b-")
    assert paragraphs.paragraph_text(df.limit(0)).collect() == [] == paragraphs.paragraphs(df.limit(0)).collect()


def test_two_pieces_on_one_baseline_do_not_split_later_lines(spark):
    rows = [(1, 0, k, float(y), 10.0, "serif", 0.0, 100.0) for k, y in enumerate((0, 0, 12))]
    df = spark.createDataFrame(rows, "doc_id long, page int, ord long, baseline double, size double, family string, min_x double, max_x double")
    assert {r.block for r in glyphs.segment_blocks(df).collect()} == {0}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_paragraph_text_moves_rows_once(spark, tmp_path):
    """Lines are cut and folded where a document lies, then laid by paragraph; nothing is joined, kept or grouped block by block."""
    spark.createDataFrame([(1, "a b. c-\n" * 700), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = plan_of(catalog.QUERIES["paragraph_text"](spark, str(tmp_path)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert not any(x in plan for x in ("Join", "FlatMapGroups", "InMemoryTableScan"))


def test_paragraph_starts_move_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, "a b. c-\n" * 700)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = plan_of(catalog.QUERIES["paragraph_starts"](spark, str(tmp_path)))
    assert not any(x in plan for x in ("Exchange", "Join", "FlatMapGroups", "InMemoryTableScan"))


def test_groups_are_whole_however_batches_are_cut():
    keys = pa.array([1, 1, 1, 2, None, None, 3, 3, 3, 3, 4], pa.int64())
    rows = pa.RecordBatch.from_arrays([keys, pa.array(["x"] * 11), pa.array(range(11))], ["k", "s", "at"])
    for size in (1, 2, 3, 4, 11):
        cut = (rows.slice(a, size) for a in range(0, 11, size))
        got = [(b.column(0).to_pylist(), b.column(2).to_pylist()) for b in batches.whole_groups(cut, ["k", "s"])]
        assert [x for _, at in got for x in at] == list(range(11))
        ends = [(a[0][-1], b[0][0]) for a, b in zip(got, got[1:], strict=False)]
        assert all(a != b for a, b in ends)
