"""Glyph operators over streams: a batch of lines is spread into glyph arrays, worked on and let go.

There are hundreds of glyphs to a row of text, so they are never rows, sorted or moved.
Lines must come page by page, each page whole in one partition, as the typesetter gives
them. The operators of ``glyphs`` and ``runs`` take glyph rows in any order and say the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches as batches_of
from .fixed import BINS, CLEAR, CLOSE, LEAST_ROWS, OPEN, ROTATION, SPACE_RATIO, SUPER_RISE, SUPER_SIZE

PAGE = ["doc_id", "page"]
#: Glyphs, about, that are spread at once, and text rows whose bins are.
GLYPHS, ROWS = 1 << 18, 1 << 12
_OPEN, _CLOSE, _SPACE = ord(OPEN), ord(CLOSE), 32


@dataclass
class Glyphs:
    """Arrays of one length; ``line`` and ``page`` number rows and pages of the batch and never fall, x rises within a line, then ``seq``."""

    line: np.ndarray
    page: np.ndarray
    seq: np.ndarray
    x: np.ndarray
    y: np.ndarray
    advance: np.ndarray
    size: np.ndarray
    rise: np.ndarray
    rotation: np.ndarray
    code: np.ndarray
    font_id: np.ndarray
    render_mode: np.ndarray

    def where(self, keep: np.ndarray) -> Glyphs:
        return self if keep.all() else Glyphs(*(getattr(self, f.name)[keep] for f in fields(self)))

    def ordered(self) -> Glyphs:
        """By x and paint order within each line."""
        same = self.line[1:] == self.line[:-1]
        later = (self.x[1:] > self.x[:-1]) | (self.x[1:] == self.x[:-1]) & (self.seq[1:] > self.seq[:-1])
        if (later | ~same).all():
            return self
        at = np.lexsort((self.seq, self.x, self.line))
        return Glyphs(*(getattr(self, f.name)[at] for f in fields(self)))

    def moved(self, by: np.ndarray) -> Glyphs:
        return replace(self, x=self.x + by).ordered()


def parts(batches: Iterator[pa.RecordBatch], weight: str = "n_glyphs") -> Iterator[pa.RecordBatch]:
    """Batches of whole pages with some ``GLYPHS`` glyphs each."""
    for batch in batches_of.whole_groups(batches, PAGE):
        at = np.r_[batches_of.starts(batch, PAGE), batch.num_rows]
        upto = np.r_[0, np.cumsum(batches_of.numbers(batch, weight))][at]
        a = 0
        while a < len(at) - 1:
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + GLYPHS, "right")) - 1)
            yield batch.slice(int(at[a]), int(at[b] - at[a]))
            a = b


def also(rows: DataFrame, lines: DataFrame, spread: Callable) -> DataFrame:
    """Glyph rows marked as those that ``spread`` makes of ``lines``, for operators that can do without the rows."""
    rows.spread_from = (lines, spread)
    return rows


def over(lines: DataFrame, spread: Callable, work: Callable, schema: str) -> DataFrame:
    """``work(batch, glyphs)`` of each batch of lines and the glyphs ``spread`` makes of it; it returns columns by name."""

    def run(batches):
        for batch in parts(batches):
            columns = work(batch, spread(batch))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    batches_of.bounded(lines.sparkSession)
    return lines.mapInArrow(run, schema)


def firsts(group: np.ndarray) -> np.ndarray:
    """Where each group starts; groups lie together."""
    return np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)


def medians(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The median of each group of values that are no NaN; ``at`` is where groups start."""
    if not len(at):
        return np.zeros(0)
    low, high = np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)
    out = low.astype(float)
    n = np.diff(np.r_[at, len(values)])
    mixed = np.flatnonzero(low != high)
    short = mixed[n[mixed] <= 4 * max(1.0, np.median(n[mixed]))] if len(mixed) else mixed
    for g in np.setdiff1d(mixed, short).tolist():
        out[g] = np.median(values[at[g] : at[g] + n[g]])
    if len(short):
        width = int(n[short].max())
        k = np.arange(width)
        table = np.where(k < n[short, None], values[np.minimum(at[short, None] + k, len(values) - 1)], np.inf)
        table.sort(axis=1)
        rows = np.arange(len(short))
        out[short] = 0.5 * table[rows, (n[short] - 1) // 2] + 0.5 * table[rows, n[short] // 2]
    return out


def upright(g: Glyphs) -> Glyphs:
    return g.where(np.abs(g.rotation) <= ROTATION)


def visible(g: Glyphs) -> Glyphs:
    """Without render modes 3 and 7, unless a page has nothing else."""
    seen = (g.render_mode != 3) & (g.render_mode != 7)
    if seen.all():
        return g
    any_seen = np.bincount(g.page, seen, minlength=1) > 0
    return g.where(seen | ~any_seen[g.page])


def line_text(batch: pa.RecordBatch, g: Glyphs) -> dict:
    """Per line: text, geometry and dominant font, as ``glyphs.line_text`` says."""
    at = firsts(g.line)
    n = np.diff(np.r_[at, len(g.line)])
    each = np.repeat(np.arange(len(at)), n)
    step, baseline = medians(g.advance, at), medians(g.y + g.rise, at)
    sized = g.size > 0
    size = np.full(len(at), np.nan)
    inside = each[sized]
    size[inside[firsts(inside)]] = medians(g.size[sized], firsts(inside))
    first = np.zeros(len(each), bool)
    first[at] = True
    last = np.r_[first[1:], True] if len(first) else first
    blank = g.code == _SPACE
    end = g.x + g.advance
    space = np.zeros(len(each), bool)
    space[1:] = (g.x[1:] - end[:-1] > (SPACE_RATIO * step)[each[1:]]) & ~blank[1:] & ~blank[:-1]
    space &= ~first
    sup = (g.rise > 0) | (baseline[each] - g.y > (SUPER_RISE * size)[each]) & (g.size < (SUPER_SIZE * size)[each])
    opens, closes = sup.copy(), sup.copy()
    opens[1:] &= ~sup[:-1] | first[1:]
    closes[:-1] &= ~sup[1:] | last[:-1]
    upto = np.cumsum(1 + space.astype(np.int64) + opens + closes)
    codes = np.empty(int(upto[-1]) if len(upto) else 0, "<u4")
    own = upto - 1 - closes
    codes[own] = g.code
    codes[own[opens] - 1] = _OPEN
    codes[own[space] - 1 - opens[space]] = _SPACE
    codes[upto[closes] - 1] = _CLOSE
    whole = codes.tobytes().decode("utf-32-le")
    cuts = np.r_[0, upto[np.r_[at[1:], len(each)] - 1]].tolist() if len(at) else [0]
    texts = [whole[a:b].rstrip(" ") for a, b in zip(cuts, cuts[1:], strict=False)]
    kept = np.array([bool(t.strip(f" {OPEN}{CLOSE}")) for t in texts], bool)
    font = np.minimum.reduceat(g.font_id, at) if len(at) else g.font_id
    for k in np.flatnonzero(font != np.maximum.reduceat(g.font_id, at)).tolist() if len(at) else ():
        ids, counts = np.unique(g.font_id[at[k] : at[k] + n[k]], return_counts=True)
        font[k] = ids[np.argmax(counts)]
    per = lambda f, values: f.reduceat(values, at)[kept] if len(at) else np.zeros(0)
    rows = pa.array(g.line[at][kept])
    raised = per(np.logical_or, sup).astype(bool)
    return {
        **{c: batch.column(c).take(rows) for c in ("doc_id", "page", "ord")},
        "text": pa.array([t for t, k in zip(texts, kept.tolist(), strict=True) if k], pa.string()),
        "has_superscript": pa.array(raised, mask=np.isnan(size[kept]) & ~raised),  # unknown without a size
        "size": pa.array(size[kept], from_pandas=True),
        "baseline": pa.array(baseline[kept]),
        "min_x": pa.array(per(np.minimum, g.x)),
        "max_x": pa.array(per(np.maximum, end)),
        "min_y": pa.array(per(np.minimum, g.y - 0.75 * g.size - g.rise)),
        "max_y": pa.array(per(np.maximum, g.y + 0.25 * g.size - g.rise)),
        "n_glyphs": pa.array(n[kept], pa.int64()),
        "font_id": pa.array(font[kept], pa.int32()),
    }


LINE_TEXT = "doc_id long, page int, ord long, text string, has_superscript boolean, size double, baseline double, min_x double, max_x double, min_y double, max_y double, n_glyphs long, font_id int"


def split_at_gutters(batch: pa.RecordBatch, g: Glyphs) -> dict:
    """Per segment of a line its glyphs and left end; gutters' middles are the lines' ``mids``. As ``runs.split_at_gutters`` says."""
    at = firsts(g.line)
    step = medians(g.advance, at)
    n = np.diff(np.r_[at, len(g.line)])
    start = np.repeat(at, n)
    from_x = np.r_[np.nan, (g.x + g.advance)[:-1]] if len(at) else g.x
    from_x[at] = np.nan
    mids = batch.column("mids")
    sizes = mids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat, offsets = mids.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)]
    inside = np.zeros(len(g.x), bool)
    for k in range(int(sizes.max(initial=0))):
        one = np.full(len(sizes), np.nan)
        one[sizes > k] = flat[offsets[:-1][sizes > k] + k]
        one = one[g.line]
        inside |= (one > from_x) & (one < g.x)
    opens = inside & (g.x - from_x >= 2 * SPACE_RATIO * np.repeat(step, n))
    total = np.cumsum(opens)
    segment = total - total[start] if len(at) else total
    ends = np.flatnonzero(opens | (np.arange(len(g.x)) == start))
    rows = pa.array(g.line[ends])
    return {
        **{c: batch.column(c).take(rows) for c in ("doc_id", "page", "ord")},
        "segment": pa.array(segment[ends], pa.int64()),
        "n": pa.array(np.diff(np.r_[ends, len(g.x)]), pa.int64()),
        "min_x": pa.array(g.x[ends]),
    }


SEGMENTS = "doc_id long, page int, ord long, segment long, n long, min_x double"


def gutters(batch: pa.RecordBatch, g: Glyphs) -> dict:
    """Per page the strips that most text rows leave clear, as ``glyphs.gutters`` says."""
    at = firsts(g.page)
    each = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(g.page)]))
    end = g.x + g.advance
    x0, x1, y0 = (f.reduceat(v, at) if len(at) else np.zeros(0) for f, v in ((np.minimum, g.x), (np.maximum, end), (np.minimum, g.y)))
    mid = medians(g.size, at)
    used = (g.code != _SPACE) & ((x1 > x0) & (mid > 0))[each]
    page = each[used]
    row = np.floor((g.y[used] - y0[page]) / (1.2 * mid)[page]).astype(np.int64)
    bin_of = lambda v: np.clip(np.floor((v[used] - x0[page]) / (x1 - x0)[page] * BINS), 0, BINS - 1).astype(np.int64)
    b0, b1 = bin_of(g.x), bin_of(end)
    order = np.lexsort((row, page)) if ((page[1:] == page[:-1]) & (row[1:] < row[:-1])).any() else slice(None)
    page, row, b0, b1 = page[order], row[order], b0[order], b1[order]
    opens = np.r_[True, (page[1:] != page[:-1]) | (row[1:] != row[:-1])] if len(page) else np.zeros(0, bool)
    number, row_page = np.cumsum(opens) - 1, page[opens]
    n_rows = np.bincount(row_page, minlength=len(at))
    full = np.zeros((len(at), BINS), np.int64)
    for a in range(0, len(row_page), ROWS):  # a glyph adds one where it begins and takes one where it ends
        some = slice(*np.searchsorted(number, (a, a + ROWS)))
        own, pages = (number[some] - a) * (BINS + 1), row_page[a : a + ROWS]
        marks = np.bincount(own + np.minimum(b0[some], b1[some]), minlength=len(pages) * (BINS + 1))
        marks -= np.bincount(own + np.maximum(b0[some], b1[some]) + 1, minlength=len(marks))
        covered = np.cumsum(marks.reshape(len(pages), BINS + 1), axis=1)[:, :BINS] > 0
        first = firsts(pages)
        full[pages[first]] += np.add.reduceat(covered, first, axis=0, dtype=np.int64)
    clear = 1 - full / np.maximum(n_rows, 1)[:, None]
    edges = np.diff(np.pad(((clear >= CLEAR) & (n_rows >= LEAST_ROWS)[:, None]).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (p, low), after = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]
    width = (x1 - x0)[p] / BINS
    left, right = x0[p] + low * width, x0[p] + after * width
    kept = (low > 0) & (after < BINS) & (right - left >= 0.5 * mid[p])
    sums = [np.add.accumulate(clear[k, a:b])[-1] for k, a, b in zip(p[kept].tolist(), low[kept].tolist(), after[kept].tolist(), strict=True)]  # bin by bin, as the rows add
    strength = (right - left)[kept] * (np.array(sums, float) / (after - low)[kept])
    rows = pa.array(g.line[at][p][kept])
    return {
        **{c: batch.column(c).take(rows) for c in PAGE},
        "min_x": pa.array(left[kept]),
        "max_x": pa.array(right[kept]),
        "strength": pa.array(strength),
    }


GUTTERS = "doc_id long, page int, min_x double, max_x double, strength double"
