"""Line dedup by content-defined chunks.

A rolling hash over the hashes of neighbouring lines chooses chunk boundaries, so the
same passage is cut alike wherever it stands in a text: an insertion above moves no
boundary below. Chunks of several lines that occur again anywhere are removed, except in
the document where they come first.

Chunks are grouped by their whole text, so equal means equal bytes; the hash that leads
the key spreads them over tasks. Counting happens before the shuffle, so a passage in a
third of all documents crosses it once per task.

A passage may be shorter than a chunk, or lie across boundaries. So, beside the chunks,
runs of whole lines of LEAST_WORDS words are held against each other: from each line the
shortest run onwards and the shortest run back. Any repeated passage of that many words
is the union of such runs, its first and last lines included. Only lines that several
documents have, by their bytes, can be in one, which leaves few.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, free_name, stage, table, text_slices

#: Lines whose hashes the rolling hash covers; a boundary follows on average every DIVISOR-th line.
WINDOW, DIVISOR = 2, 2
LEAST_LINES, MOST_LINES = 2, 16
#: Words from which a repeated run of whole lines is a passage, however few its lines.
LEAST_WORDS = 50
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_DROP = pow(_BASE, WINDOW, 1 << 64)


def cut(lines: list[str]) -> list[tuple[int, int]]:
    """Chunks as line ranges. A chunk ends where the rolling hash of its last WINDOW lines says so, once it has LEAST_LINES, or at MOST_LINES."""
    hashes = [xxhash.xxh64_intdigest(line.encode()) for line in lines]
    out, start, rolling = [], 0, 0
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h) & _MASK
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * _DROP) & _MASK
        n = i + 1 - start
        if n >= MOST_LINES or n >= LEAST_LINES and (rolling >> 32) % DIVISOR == 0:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def _chunks(text: str | None) -> list[tuple[str, str]]:
    """Each different chunk of several lines, with its 128-bit hash."""
    if not text or "\n" not in text:
        return []
    lines = text.split("\n")
    found = dict.fromkeys("\n".join(lines[a:b]) for a, b in cut(lines) if b - a >= LEAST_LINES)
    return [(xxhash.xxh3_128_hexdigest(c.encode()), c) for c in found if c.strip()]


def _lines(text: str | None) -> list[tuple[str, str]]:
    """Each different line that is not blank, with its 128-bit hash."""
    return [(xxhash.xxh3_128_hexdigest(c.encode()), c) for c in dict.fromkeys((text or "").split("\n")) if c.strip()]


def spans(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """The shortest ranges of lines that hold ``least`` words: from each line onwards and from each line back. ``sizes``: words of each line, none 0."""
    sums = list(accumulate(sizes, initial=0))
    on = ((a, bisect_left(sums, sums[a] + least)) for a in range(len(sizes)))
    back = ((bisect_right(sums, sums[b] - least) - 1, b) for b in range(1, len(sums)))
    return sorted({(a, b) for a, b in (*on, *back) if 0 <= a and b < len(sums)})


def _run_key(hashes: list[str]) -> str:
    """Names a run by the hashes of all its lines; they are unlike those of chunks."""
    return "w" + "".join(hashes)


#: Stands for a null id: one document, after all others.
NO_ID = (1 << 63) - 1


def _explode(df: DataFrame, id_col: str, text_col: str, pieces=_chunks) -> DataFrame:
    """``(__id, __name, __hash, __chunk)``: one row for each different chunk (or what ``pieces`` gives) of a row. ``__name`` tells texts apart that share an id."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(text_col).alias("__name"), F.col(text_col).alias("__text"))

    def run(batches):
        for batch in text_slices(batches, "__text"):
            at, hashes, chunks = [], [], []
            for row, text in enumerate(batch.column("__text").to_pylist()):
                for h, c in pieces(text):
                    at.append(row)
                    hashes.append(h)
                    chunks.append(c)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(take), batch.column("__name").take(take), pa.array(hashes, pa.string()), pa.array(chunks, pa.string())], ["__id", "__name", "__hash", "__chunk"])

    return rows.mapInArrow(run, "__id long, __name long, __hash string, __chunk string")


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces=_chunks) -> DataFrame:
    """``(__hash, __first)``: the chunks that more than one document has, and the least id among those.

    A hash under which two different chunks fall (bytes decide) is left out, so nothing is
    removed by a hash alone.
    """
    same = _explode(df, id_col, text_col, pieces).groupBy("__hash", "__chunk").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"))
    by_hash = same.groupBy("__hash").agg(F.count("*").alias("__texts"), F.min("__first").alias("__first"), F.max("__last").alias("__last"))
    return by_hash.where((F.col("__texts") == 1) & (F.col("__first") < F.col("__last"))).select("__hash", "__first")


def runs(df: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(__id, __name, __hash)``: the runs of at least ``least`` words (see ``spans``) of lines that other documents have too.

    Blank lines count for nothing. A run is named by its lines, each held against the
    others by its bytes, so equal names are equal lines.
    """
    shared = stage(repeated(df, id_col, text_col, _lines).select("__hash"))  # a table of its own, so that a very common line's rows can be split in the join
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), F.xxhash64(text_col).alias("__name"), F.col(text_col).alias("__text"))

    def skeleton(batches):
        for batch in text_slices(batches, "__text"):
            at, places, hashes, sizes = [], [], [], []
            for row, text in enumerate(batch.column("__text").to_pylist()):
                lines = [line for line in (text or "").split("\n") if line.strip()]
                at += [row] * len(lines)
                places += range(len(lines))
                hashes += [xxhash.xxh3_128_hexdigest(line.encode()) for line in lines]
                sizes += [len(line.split()) for line in lines]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(take), batch.column("__name").take(take), pa.array(places, pa.int32()), pa.array(hashes, pa.string()), pa.array(sizes, pa.int32())], ["__id", "__name", "place", "__hash", "words"])

    found = rows.mapInArrow(skeleton, "__id long, __name long, place int, __hash string, words int").join(shared, "__hash")
    texts = found.groupBy("__id", "__name").agg(F.sort_array(F.collect_set(F.struct("place", "__hash", "words"))).alias("__lines"), F.sum("words").alias("__words"))

    def name(batches):
        for batch in batches:
            at, keys = [], []
            for i, lines in enumerate(batch.column("__lines").to_pylist()):
                start, own = 0, set()
                for end in range(1, len(lines) + 1):
                    if end == len(lines) or lines[end]["place"] != lines[end - 1]["place"] + 1:
                        run = lines[start:end]
                        own.update(_run_key([x["__hash"] for x in run[a:b]]) for a, b in spans([x["words"] for x in run], least))
                        start = end
                at += [i] * len(own)
                keys += own
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(take), batch.column("__name").take(take), pa.array(keys, pa.string())], ["__id", "__name", "__hash"])

    return texts.where(F.col("__words") >= least).select("__id", "__name", "__lines").mapInArrow(name, "__id long, __name long, __hash string")


def prune(text: str, gone: set[str], least: int | None = None) -> tuple[str, int]:
    """The text without the chunks and runs in ``gone`` and without later copies of its own, and how many lines went. No ``least``: chunks only."""
    lines, seen = text.split("\n"), set()
    out = bytearray(len(lines))
    for a, b in cut(lines):
        chunk = "\n".join(lines[a:b])
        if b - a >= LEAST_LINES and chunk.strip():
            if chunk in seen or gone and xxhash.xxh3_128_hexdigest(chunk.encode()) in gone:
                out[a:b] = b"\1" * (b - a)
            seen.add(chunk)
    if least:
        at = [k for k, line in enumerate(lines) if line.strip()]
        full = [lines[k] for k in at]
        twice = len(set(full)) < len(full)
        if twice or gone:
            hashes = [xxhash.xxh3_128_hexdigest(line.encode()) for line in full] if gone else []
            ends: dict[str, int] = {}
            for a, b in spans([len(line.split()) for line in full], least):
                # a copy that overlaps the first one stays
                if gone and _run_key(hashes[a:b]) in gone or twice and ends.setdefault("\n".join(full[a:b]), b) <= a:
                    out[at[a] : at[b - 1] + 1] = b"\1" * (at[b - 1] + 1 - at[a])
    n = sum(out)
    return ("\n".join(line for line, o in zip(lines, out, strict=True) if not o), n) if n else (text, 0)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int | None = None) -> DataFrame:
    """The rows with repeated chunks cut from ``text_col``, plus ``removed_lines``.

    With ``least_words``, repeated passages of whole lines of that many words go too,
    those of one line and those across chunk boundaries included; without, only chunks.

    A chunk that several documents have stays in the one with the least id and goes from
    all others; within a text its first copy stays. Ids are whole numbers. Rows that share
    an id are one document, and so are all rows without an id, which come last. Null and
    empty texts stay as they are, and so do texts of one line without ``least_words``. A text of which nothing is left
    is empty. An existing column ``removed_lines`` is replaced, others stay. An empty table
    stays empty.

    Which chunks go from a document is worked out by hashes alone; texts meet those lists
    once, on the document's id.
    """
    df = df.drop("removed_lines")
    own = df.columns
    first = stage(repeated(df, id_col, text_col))
    gone = _explode(df, id_col, text_col).select("__id", "__name", "__hash").join(first, "__hash").where("__id != __first").select("__id", "__name", "__hash")
    if least_words:
        own_runs = stage(runs(df, least_words, id_col, text_col))
        known = stage(own_runs.groupBy("__hash").agg(F.min("__id").alias("__first"), F.max("__id").alias("__last")).where("__first < __last"))
        gone = gone.unionByName(own_runs.join(known, "__hash").where("__id != __first").select("__id", "__name", "__hash"))
    key, name, gone_col = free_name(own, "key", "name", "gone")
    gone = gone.groupBy("__id", "__name").agg(F.collect_set("__hash").alias("__gone"))  # chunks and runs of one text
    gone = gone.select(F.col("__id").alias(f"{key}_"), F.col("__name").alias(f"{name}_"), F.col("__gone").alias(gone_col))
    keyed = df.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), name: F.xxhash64(text_col)})
    joined = keyed.join(gone, (F.col(key) == F.col(f"{key}_")) & (F.col(name) == F.col(f"{name}_")), "left").select(*(F.col(f"`{c}`") for c in own), gone_col)

    def run(batches):
        for batch in text_slices(batches, text_col):
            both = [prune(t, set(g or ()), least_words) if t else (t, 0) for t, g in zip(batch.column(text_col).to_pylist(), batch.column(gone_col).to_pylist(), strict=True)]
            cols = [pa.array([t for t, _ in both], pa.string()) if c == text_col else batch.column(c) for c in own]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n for _, n in both], pa.int64())], [*own, "removed_lines"])

    return joined.mapInArrow(run, extended(df, ("removed_lines", "long")))


def op7_lines(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=LEAST_WORDS)
    return out.select("doc_id", "removed_lines", F.length("text").cast("long").alias("kept_chars"), "text")
