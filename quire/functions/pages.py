"""Page ranges: ``1-3,7,12-`` as merged spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN = 1 << 31


def parse(text: str) -> list[tuple[int, int]]:
    """Zero-based inclusive spans in order, overlapping and adjacent ones merged; a missing end is OPEN."""
    spans = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = part.partition("-")
        if not low.strip().isdigit() or (high.strip() and not high.strip().isdigit()):
            raise ValueError(f"bad page span {part!r}")
        a = int(low)
        b = int(high) if high.strip() else OPEN if dash else a
        if a < 1 or b < a:
            raise ValueError(f"bad page span {part!r}")
        spans.append((a - 1, b - 1 if b < OPEN else OPEN))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def contains(page: Column, text: str) -> Column:
    """Whether a zero-based page lies in the range; every page for an empty one. Comparisons reach the scan."""
    spans = parse(text)
    if not spans:
        return F.lit(True)
    out = F.lit(False)
    for a, b in spans:
        out = out | ((page >= a) & (page <= b) if b < OPEN else page >= a)
    return out
