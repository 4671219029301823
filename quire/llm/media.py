"""Media columns: ISO base media files, read by their boxes.

``parse`` walks the nested boxes of a binary column and decodes the sample tables
(durations, sizes, chunk map, chunk offsets, sync samples) into codec, duration and
the byte ranges of samples and keyframes. Payload bytes are never decoded.
``wrap`` writes the plain form: one track of 8-bit samples in access units.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, slices, table

UNIT = 576
TIMESCALE = 8000
UNITS_PER_CHUNK = 16
KEY_EVERY = 8
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"mfra", b"udta"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def wrap(payload: bytes, unit: int = UNIT, codec: bytes = b"raw ", timescale: int = TIMESCALE, key_every: int = KEY_EVERY) -> bytes:
    """A file of one track: the payload's access units of ``unit`` bytes, every ``key_every``-th a keyframe."""
    if not payload or len(payload) % unit:
        raise ValueError(f"the payload needs a positive multiple of {unit} bytes")
    n = len(payload) // unit
    duration = n * unit
    chunks = -(-n // UNITS_PER_CHUNK)
    last = n - (chunks - 1) * UNITS_PER_CHUNK
    runs = [(1, UNITS_PER_CHUNK)] * (chunks > 1 or last == UNITS_PER_CHUNK) + [(chunks, last)] * (last != UNITS_PER_CHUNK)
    keys = range(1, n + 1, key_every)

    def moov(offsets: list[int]) -> bytes:
        wide = bool(offsets) and offsets[-1] >= 1 << 32
        entry = box(codec, bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, timescale << 16))
        table_of = [
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, unit)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, count, 1) for first, count in runs)),
            full(b"stsz", struct.pack(">II", unit, n)),
            full(b"co64" if wide else b"stco", struct.pack(f">I{len(offsets)}{'Q' if wide else 'I'}", len(offsets), *offsets)),
        ]
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), box(b"stbl", *table_of))
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, timescale, duration, 0x55C4, 0), version=1), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, timescale, duration), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    steps = [k * UNITS_PER_CHUNK * unit for k in range(chunks)]
    wide = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov([(1 << 40 if wide == 16 else 0)] * chunks))
    at = len(ftyp) + size + wide
    return b"".join((ftyp, moov([at + s for s in steps]), box(b"mdat", payload)))


def walk(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """``(type, body start, body end)`` of the boxes in a range, one level. A box that leaves its range raises ValueError."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        if end - at < 8:
            raise ValueError(f"{end - at} bytes left at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"box {kind!r} at {at} lacks its large size")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has size {size}")
        yield kind, at + head, at + size
        at += size


def _tree(data: memoryview, start: int, end: int, depth: int = 0) -> dict[bytes, list]:
    if depth > 16:
        raise ValueError("boxes are nested too deeply")
    found: dict[bytes, list] = {}
    for kind, a, b in walk(data, start, end):
        found.setdefault(kind, []).append(_tree(data, a, b, depth + 1) if kind in CONTAINERS else (a, b))
    return found


def _entries(data: memoryview, span: tuple[int, int], form: str, skip: int = 4) -> list[tuple]:
    """The rows of a counted table; ``skip`` bytes come before the count."""
    a, b = span
    (n,) = struct.unpack_from(">I", data, a + skip)
    a += skip + 4
    step = struct.calcsize(form)
    if n * step > b - a:
        raise ValueError(f"a table of {n} rows does not fit in {b - a} bytes")
    return list(struct.iter_unpack(form, data[a : a + n * step]))


def _times(data: memoryview, span: tuple[int, int]) -> tuple[int, int]:
    """Time scale and duration of mvhd or mdhd."""
    a, _ = span
    return struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)


def _compact_sizes(data: memoryview, span: tuple[int, int]) -> list[int]:
    """The sizes of stz2: fields of 4, 8 or 16 bits."""
    a, b = span
    bits, (n,) = data[a + 7], struct.unpack_from(">I", data, a + 8)
    if bits not in (4, 8, 16) or n * bits > 8 * (b - a - 12):
        raise ValueError(f"{n} sizes of {bits} bits do not fit in {b - a} bytes")
    raw = data[a + 12 : a + 12 + -(-n * bits // 8)]
    if bits == 4:
        return [x for byte in raw for x in (byte >> 4, byte & 15)][:n]
    return [x for (x,) in struct.iter_unpack(">H" if bits == 16 else ">B", raw)]


class _Fields:
    """Reads the fields of a full box one after another, those that its flags promise."""

    def __init__(self, data: memoryview, span: tuple[int, int]) -> None:
        self.data, (self.at, self.end) = data, span
        self.flags = self.take(">I") & 0xFFFFFF

    def take(self, form: str, flag: int = 0, default: int = 0) -> int:
        if flag and not self.flags & flag:
            return default
        size = struct.calcsize(form)
        if self.at + size > self.end:
            raise ValueError("a box ends before its fields")
        self.at += size
        return struct.unpack_from(form, self.data, self.at - size)[0]


def _fragments(data: memoryview, moov: dict) -> dict[int, list[tuple[int, int, int, bool]]]:
    """By track: offset, size, duration and whether it is a keyframe, of the samples in movie fragments."""
    defaults = {}
    for mvex in moov.get(b"mvex", []):
        for span in mvex.get(b"trex", []):
            box_ = _Fields(data, span)
            track, _, duration, size, flags = (box_.take(">I") for _ in range(5))
            defaults[track] = (duration, size, flags)
    out: dict[int, list[tuple[int, int, int, bool]]] = {}
    for kind, start, end in walk(data):
        if kind != b"moof":
            continue
        moof_at = start - (16 if struct.unpack_from(">I", data, start - 16)[0] == 1 and data[start - 12 : start - 8] == b"moof" else 8)
        after = moof_at  # where a run without an offset goes on
        for traf in _tree(data, start, end).get(b"traf", []):
            head = _Fields(data, traf[b"tfhd"][0])
            track = head.take(">I")
            base = head.take(">Q", 0x1, moof_at if head.flags & 0x20000 else after)
            head.take(">I", 0x2)
            duration, size, flags = (head.take(">I", flag, default) for flag, default in zip((0x8, 0x10, 0x20), defaults.get(track, (0, 0, 0)), strict=True))
            at = base
            for span in traf.get(b"trun", []):
                run = _Fields(data, span)
                n = run.take(">I")
                at = base + run.take(">i", 0x1) if run.flags & 0x1 else at
                first = run.take(">I", 0x4, -1)
                row = 4 * sum(bool(run.flags & f) for f in (0x100, 0x200, 0x400, 0x800))
                if n * row > run.end - run.at or not row and n * max(1, size) > len(data):
                    raise ValueError(f"a run of {n} samples does not fit")
                for k in range(n):
                    own_duration, own_size = run.take(">I", 0x100, duration), run.take(">I", 0x200, size)
                    own_flags = run.take(">I", 0x400, first if k == 0 and first >= 0 else flags)
                    run.take(">I", 0x800)
                    if at < 0 or at + own_size > len(data):
                        raise ValueError("a sample lies outside the file")
                    out.setdefault(track, []).append((at, own_size, own_duration, not own_flags & 0x10000))
                    at += own_size
            after = at
    return out


def _track(data: memoryview, trak: dict, fragments: dict[int, list[tuple[int, int, int, bool]]]) -> dict:
    mdia = trak[b"mdia"][0]
    stbl = mdia[b"minf"][0][b"stbl"][0]
    timescale, duration = _times(data, mdia[b"mdhd"][0])
    handler = bytes(data[mdia[b"hdlr"][0][0] + 8 :][:4]) if b"hdlr" in mdia else b""
    a, b = stbl[b"stsd"][0]
    codecs = [kind for kind, _, _ in walk(data, a + 8, b)]
    if b"stz2" in stbl:
        fixed, n, sizes = 0, 0, _compact_sizes(data, stbl[b"stz2"][0])
    else:
        fixed, n = struct.unpack_from(">II", data, stbl[b"stsz"][0][0] + 4)
        sizes = None
    if fixed * n > len(data):
        raise ValueError(f"{n} samples of {fixed} bytes do not fit in the file")
    if sizes is None:
        sizes = [fixed] * n if fixed else [x for (x,) in _entries(data, stbl[b"stsz"][0], ">I", 8)]
    if b"co64" in stbl:
        offsets = [x for (x,) in _entries(data, stbl[b"co64"][0], ">Q")]
    else:
        offsets = [x for (x,) in _entries(data, stbl[b"stco"][0], ">I")]
    runs = _entries(data, stbl[b"stsc"][0], ">III")
    ranges: list[tuple[int, int]] = []
    for k, (first, per, _) in enumerate(runs):
        upto = runs[k + 1][0] if k + 1 < len(runs) else len(offsets) + 1
        for chunk in range(first, upto):
            at = offsets[chunk - 1]
            for size in sizes[len(ranges) : len(ranges) + per]:
                ranges.append((at, size))
                at += size
    if len(ranges) != len(sizes) or any(at + size > len(data) for at, size in ranges):
        raise ValueError("the sample tables do not agree with the file")
    spent = sum(count * delta for count, delta in _entries(data, stbl[b"stts"][0], ">II"))
    keys = [x for (x,) in _entries(data, stbl[b"stss"][0], ">I")] if b"stss" in stbl else range(1, len(ranges) + 1)
    if any(not 1 <= k <= len(ranges) for k in keys):
        raise ValueError("a sync sample is outside the track")
    keyframes = [ranges[k - 1] for k in keys]
    a, _ = trak[b"tkhd"][0]
    more = fragments.get(struct.unpack_from(">I", data, a + (20 if data[a] == 1 else 12))[0], [])
    ranges += [(at, size) for at, size, _, _ in more]
    keyframes += [(at, size) for at, size, _, key in more if key]
    whole = spent + sum(d for _, _, d, _ in more) if more else duration or spent
    return {"codec": codecs[0].decode("latin-1") if codecs else "", "handler": handler.decode("latin-1"), "timescale": timescale, "duration": whole, "n_samples": len(ranges), "samples": ranges, "keyframes": keyframes}


def parse_file(blob: bytes | None) -> tuple[list[dict], str | None]:
    """Tracks, and why there are none. Null, empty and damaged files give no track and a reason, never an exception."""
    if not blob:
        return [], "empty"
    data = memoryview(blob)
    try:
        top = _tree(data, 0, len(data))
        return [_track(data, trak, _fragments(data, moov)) for moov in top.get(b"moov", []) for trak in moov.get(b"trak", [])], None
    except (ValueError, KeyError, IndexError, TypeError, struct.error) as e:
        return [], f"{type(e).__name__}: {e}"


RANGE = pa.struct([("offset", pa.int64()), ("length", pa.int64())])
TRACK = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(RANGE))])


def parse(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns plus ``tracks`` (codec, handler, timescale, duration, n_samples, keyframe byte ranges) and ``media_error``.

    Existing columns of those two names are replaced. Rows stay as they are, repeated
    ones too. See ``parse_file`` for null and damaged files.
    """
    df = df.drop("tracks", "media_error")
    own = df.columns

    def run(batches):
        for batch in slices(batches):
            tracks, errors = [], []
            for blob in batch.column(media_col).to_pylist():
                found, error = parse_file(blob)
                tracks.append([{k: [{"offset": a, "length": n} for a, n in v] if k == "keyframes" else v for k, v in t.items() if k != "samples"} for t in found])
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tracks, pa.list_(TRACK)), pa.array(errors, pa.string())], [*own, "tracks", "media_error"])

    from pyspark.sql.pandas.types import from_arrow_type

    schema = extended(df, ("tracks", from_arrow_type(pa.list_(TRACK))), ("media_error", "string"))
    return df.mapInArrow(run, schema)


def to_media(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """All columns plus the text as media: UTF-8, padded with bytes 255 to whole units, wrapped. Null counts as empty.

    ``n_bytes`` is the length before padding. Existing columns of these names are replaced.
    Rows are stored one by one, so repeated rows agree and an empty table stays empty.
    """
    df = df.drop(media_col, "n_bytes")
    own = df.columns

    def run(batches):
        for batch in slices(batches):
            media, sizes = [], []
            for text in batch.column(text_col).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(wrap(raw + b"\xff" * (-len(raw) % UNIT or UNIT * (not raw))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary()), pa.array(sizes, pa.int64())], [*own, media_col, "n_bytes"])

    return df.mapInArrow(run, extended(df, (media_col, "binary"), ("n_bytes", "long")))


def summarise(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Digests of the payload as read back through the sample tables, and a feature line of the first track.

    ``feature`` is codec, handler, timescale, duration, samples, keyframes and the CRC-32
    of the keyframes' byte ranges as text, joined by ``;``. A file without a track reads
    as an empty payload and its feature is the reason.
    """
    own = [c for c in df.columns if c != media_col]
    out = df.select(*own, media_col)

    def run(batches):
        for batch in slices(batches):
            rows = []
            for blob in batch.column(media_col).to_pylist():
                tracks, error = parse_file(blob)
                sha, tail, size = hashlib.sha256(), b"", 0
                for at, n in tracks[0]["samples"] if tracks else ():
                    part = blob[at : at + n]
                    sha.update(part)
                    size += n
                    tail = (tail + part)[-32:]
                feature = error
                if tracks:
                    t = tracks[0]
                    spans = ",".join(f"{a}:{n}" for a, n in t["keyframes"])
                    feature = ";".join(map(str, (t["codec"].strip(), t["handler"], t["timescale"], t["duration"], t["n_samples"], len(t["keyframes"]), zlib.crc32(spans.encode()))))
                rows.append((size, sha.hexdigest(), zlib.crc32(tail), len(blob or b""), hashlib.sha256(blob or b"").hexdigest(), feature))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(v, k) for v, k in zip(cols, kinds, strict=True))], [*own, *NAMES])

    schema = extended(df.select(*own), *zip(NAMES, ("long", "string", "long", "long", "string", "string"), strict=True))
    return out.mapInArrow(run, schema)


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_media(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = to_media(docs).select("doc_id", "n_bytes", "media")
    return summarise(stored)
