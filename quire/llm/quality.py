"""Quality rules: compression bands.

zstandard ratios of the whole text and of fixed chunks, which leave no byte out, are held
against limits that depend on the length: below its band a text repeats itself, above it
no prose is in it.
The plain counts that usual filters use (words, symbols, repeated lines and windows)
come with it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import extended, slices, table

LEVEL = 3
#: Bytes of a chunk; of one in a text below CHUNK bytes, and the least a text's last chunk has.
CHUNK, SHORT_CHUNK = 2048, 512
WINDOW = 8
#: (bytes from, least ratio, greatest ratio). Short texts carry the frame's overhead, long ones find more to repeat.
#: The greatest lie between what clean labelled texts of sf0.1 reach (0.88, 0.87, 0.83, 0.75, 0.69, 0.58 and 0.48 from 64 to 4,096 bytes on) and
#: the least of 3,000 base64 texts as long as the band's end (1.01, 0.94, 0.89, 0.84, 0.79 and 0.76).
BANDS = ((0, 0.0, math.inf), (64, 0.45, 1.00), (128, 0.38, 0.925), (192, 0.38, 0.87), (256, 0.32, 0.82), (512, 0.28, 0.76), (1024, 0.25, 0.72), (4096, 0.22, 0.70), (16384, 0.20, 0.68), (65536, 0.18, 0.68))
#: Of a full chunk (clean ones reach 0.53, base64 0.77); others have the band of their length.
CHUNK_BAND = (0.22, 0.70)
#: Share of its chunks, by bytes, that may lie outside the chunk band.
CHUNK_SHARE = 0.25
LEAST_WORDS = 20
MOST_REPEATED = 30
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def band(n_bytes: int) -> tuple[float, float]:
    return next((low, high) for start, low, high in reversed(BANDS) if n_bytes >= start)


def cut(n_bytes: int) -> list[tuple[int, int]]:
    """Byte ranges of the chunks. What is left over is a chunk too, or, where too short, the last SHORT_CHUNK bytes. Below SHORT_CHUNK: none, the whole text is one."""
    size = CHUNK if n_bytes >= CHUNK else SHORT_CHUNK
    full = n_bytes // size * size
    out = [(k, k + size) for k in range(0, full, size)]
    if out and full < n_bytes:
        out.append((min(full, n_bytes - SHORT_CHUNK), n_bytes))
    return out


def ratios(raw: bytes, squeeze: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """Compressed over plain length of the whole text, and length and ratio of each chunk. An empty text has 0."""
    if not raw:
        return 0.0, []
    chunks = [(b - a, len(squeeze.compress(raw[a:b])) / (b - a)) for a, b in cut(len(raw))]
    return len(squeeze.compress(raw)) / len(raw), chunks


def verdict(n_bytes: int, whole: float, chunks: list[tuple[int, float]]) -> bool:
    """Whether a text lies in its bands."""
    low, high = band(n_bytes)
    outside = 0
    for size, ratio in chunks:
        least, most = CHUNK_BAND if size == CHUNK else band(size)
        outside += size * (not least <= ratio <= most)
    return low <= whole <= high and outside <= CHUNK_SHARE * sum(size for size, _ in chunks)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more. Rolling hashes find candidates, the words themselves decide."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = True
    maybe[order[:-1][same]] = True
    at: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():
        at.setdefault(b" ".join(words[i : i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for starts in at.values():
        if len(starts) > 1:
            np.add.at(edge, starts, 1)
            np.add.at(edge, np.array(starts) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def repeated_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            n += line in seen
            seen.add(line)
    return n


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def describe(text: str | None, squeeze: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n_repeat = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * len(words)
    whole, chunks = ratios(raw, squeeze)
    within = verdict(len(raw), whole, chunks)
    return (len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), repeated_lines(text), n_repeat, failed, not failed and within, whole, min((r for _, r in chunks), default=None), max((r for _, r in chunks), default=None))


def score(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns plus the counts, ``base_failed``, ``kept``, ``ratio``, ``chunk_ratio_min`` and ``chunk_ratio_max``.

    Null and empty texts have no words, ratio 0, and fail. The chunk ratios are null for
    texts below SHORT_CHUNK bytes. Existing columns of these names are replaced; rows are
    judged one by one, so repeated rows agree and an empty table stays empty.
    """
    added = [(c, pa.int64(), "long") for c in COUNTS] + [(c, pa.bool_(), "boolean") for c in ("base_failed", "kept")] + [(c, pa.float64(), "double") for c in ("ratio", "chunk_ratio_min", "chunk_ratio_max")]
    df = df.drop(*(name for name, _, _ in added))
    own = df.columns
    schema = extended(df, *((name, kind) for name, _, kind in added))

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches):
            cols = zip(*(describe(t, squeeze) for t in batch.column(text_col).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, (_, k, _) in zip(cols, added, strict=True))], [*own, *(name for name, _, _ in added)])

    return df.mapInArrow(run, schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
