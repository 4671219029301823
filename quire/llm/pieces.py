"""SentencePiece encoding and decoding by streaming Viterbi.

A text's ids are its segmentation of greatest total piece score. The decoder grows pieces
from one position after another, reads no further ahead than the longest piece, and keeps
only what lies behind the last meeting of paths. When the backpointer paths of all
surviving positions meet in one boundary, everything before it is final and its ids are
committed.

Bytes stand for code points without a piece, and for a literal U+2581, so decoding gives
back the exact text.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, table, text_slices

MODEL = os.environ.get("QUIRE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SPACE = "▁"
#: Stands for a literal U+2581 while encoding; no valid text holds a lone surrogate.
_LITERAL = "\udbff"
#: Words whose ids a worker remembers, in two generations of this many.
MEMO = 120_000
#: Bytes of text that a worker turns into Python objects at once (one row at least).
TEXT_BYTES = 1 << 19


class Lexicon:
    """Pieces with ids and scores, as a trie, and the bytes each id decodes to."""

    def __init__(self, pieces: list[tuple[str, float, str]]) -> None:
        """``pieces``: (piece, score, kind) by id; kind is normal, byte, unknown or other."""
        self._trie: dict = {}
        self._steps: dict = {}
        self._normal = [(p, s, i) for i, (p, s, kind) in enumerate(pieces) if kind == "normal"]
        self.bytes: dict[int, int] = {}
        self.plain: list[bytes] = []
        self.unknown = next((i for i, p in enumerate(pieces) if p[2] == "unknown"), 0)
        normal = [(p, s) for p, s, kind in pieces if kind == "normal"]
        self.longest = max((len(p) for p, _ in normal), default=1)
        self.unknown_score = min((s for _, s in normal), default=0.0) - 10.0
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.bytes[int(piece[3:-1], 16)] = i
                self.plain.append(bytes([int(piece[3:-1], 16)]))
            elif kind == "normal":
                self.plain.append(piece.replace(SPACE, " ").encode())
            else:
                self.plain.append(b"")
        inside = re.compile(f"[^{SPACE}]{SPACE}|\n")
        #: Whether no piece crosses a space or holds a newline: all paths then meet before each word, and around newlines.
        self.by_word = not any(inside.search(p) for p, _ in normal)
        self.newline = self.bytes.get(10)

    @property
    def trie(self) -> dict:
        """Built when first asked for: decoding needs none."""
        if not self._trie:
            for piece, score, i in self._normal:
                node = self._trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (i, score)
        return self._trie

    @property
    def steps(self) -> dict:
        """The trie in the form the decoder walks, one lookup a code point: what follows, the id of the piece that ends there (-1: none), its score."""

        def flat(node: dict) -> dict:
            return {c: (flat(after), *after.get("", (-1, 0.0))) for c, after in node.items() if c}

        if not self._steps:
            self._steps = flat(self.trie)
        return self._steps

    @classmethod
    def load(cls, path: str = MODEL) -> Lexicon:
        return cls(read_model(path))

    def spell(self, c: str) -> list[int]:
        """Byte ids of a code point that has no piece; the unknown id where the model has no bytes."""
        return [self.bytes.get(b, self.unknown) for b in (SPACE if c == _LITERAL else c).encode()]


def read_model(path: str) -> list[tuple[str, float, str]]:
    """Pieces, scores and kinds by id.

    A merge model has ranks for scores: they say which merge comes first and mean nothing
    in a sum. They become log-probabilities by the Zipf-Mandelbrot law of ranks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "other" if model.is_control(i) or model.is_unused(i) else "normal"
    pieces = [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(len(model))]
    if all(score <= 0 and score == int(score) for _, score, of in pieces if of == "normal"):
        return [(piece, _mandelbrot(score) if of == "normal" else score, of) for piece, score, of in pieces]
    return pieces


#: Offset of the law by which merge ranks become log-probabilities.
RANK_OFFSET = 1000


def _mandelbrot(score: float) -> float:
    """The log-probability, but for a constant, of the piece of rank ``-score``, in steps of 1/1024 so that sums are exact."""
    return -round(1024 * math.log(RANK_OFFSET - score)) / 1024


#: Code points that enter the window at once.
BLOCK = 256


def viterbi(text: Iterable[str], lexicon: Lexicon) -> Iterator[int]:
    """Ids of the best segmentation, each as soon as it is certain.

    ``text`` comes in strings of any lengths. Of paths with equal scores the one whose
    last piece is longest wins. Pieces are grown from one position after another; the
    window holds the positions that a piece has reached and those read ahead, the longest
    piece at most. Where no piece that began earlier goes on, one position survives and
    all paths meet in it. Otherwise, once the window holds the longest piece, and again
    each time it has doubled, the paths of all surviving positions are walked back to
    where they meet. Whatever lies before a meeting is committed, and leaves the window
    once that is a block.
    """
    steps, unknown, longest, least = lexicon.steps, lexicon.unknown_score, lexicon.longest, float("-inf")
    parts = (part[k : k + BLOCK] for part in text for k in range(0, len(part), BLOCK))
    window, more = next(parts, ""), True
    size = len(window)
    score, back, via = [0.0] + [least] * size, [0] * (size + 1), [0] * (size + 1)  # by position in the window: best score, its piece's start, and the piece (-1: a code point without one)
    here = reach = base = 0  # next position to grow from, farthest a piece has reached, last meeting
    checked = longest

    def path(upto: int) -> list[int]:
        ids: list[int] = []
        at = upto
        while at > base:
            start, piece = back[at], via[at]
            if piece < 0:
                ids.extend(reversed(lexicon.spell(window[start])))
            else:
                ids.append(piece)
            at = start
        ids.reverse()
        return ids

    while True:
        while more and size - here < longest:  # a piece from here may need this much
            part = next(parts, None)
            if part is None:
                more = False
            else:
                window += part
                size = len(window)
                score += [least] * len(part)
                back += [0] * len(part)
                via += [0] * len(part)
        if here > base:
            meet = base
            if reach == here:
                meet = here
            elif here - base >= checked:
                alive = {p for p in range(here, reach + 1) if score[p] > least}
                while len(alive) > 1:
                    at = max(alive)
                    alive.remove(at)
                    alive.add(back[at])
                meet = alive.pop()
                checked = 2 * (here - base)  # paths that never meet cost a walk for each doubling
            if meet > base:
                yield from path(meet)
                base, checked = meet, longest
                if base >= BLOCK:  # what is committed leaves the window
                    window = window[base:]
                    score, via = score[base:], via[base:]
                    back = [0, *(b - base for b in back[base + 1 :])]
                    here, reach, size, base = here - base, reach - base, size - base, 0
        if here == size:
            return
        so_far = score[here]
        if so_far > least:
            inner, j, last = steps, here, here
            while j < size:
                entry = inner.get(window[j])
                if entry is None:
                    break
                j += 1
                inner, piece, gain = entry
                if piece >= 0:
                    if last == here:
                        first = j
                    last = j
                    total = so_far + gain
                    if total > score[j]:
                        score[j], back[j], via[j] = total, here, piece
            if last == here or first > here + 1:  # no piece is this code point
                if so_far + unknown > score[here + 1]:
                    score[here + 1], back[here + 1], via[here + 1] = so_far + unknown, here, -1
                if last == here:
                    last += 1
            if last > reach:
                reach = last
        here += 1


#: Code points above which a word's ids are not remembered.
LONG = 64


class Encoder:
    """Whole texts to ids by the streaming decoder.

    All paths meet at the ends of words (where the vocabulary says so), and what follows a
    meeting does not depend on what came before, so a word's ids are remembered; memory is
    bounded by the size of the memo.
    """

    def __init__(self, lexicon: Lexicon, memo: int = MEMO) -> None:
        self.lexicon, self.memo = lexicon, memo
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.newline = np.array([lexicon.newline], np.int32).tobytes() if lexicon.newline is not None else b""

    def word(self, text: str) -> bytes:
        ids = self.old.get(text)
        if ids is None:
            ids = array("i", viterbi((text,), self.lexicon)).tobytes()
            if len(text) > LONG:
                return ids
        if len(self.young) >= self.memo:
            self.old, self.young = self.young, {}
        self.young[text] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Packed int32 ids. Null and empty texts have none."""
        if not text:
            return b""
        text = text.replace(SPACE, _LITERAL)
        if not self.lexicon.by_word or not self.newline:
            return array("i", viterbi((SPACE + text.replace(" ", SPACE),), self.lexicon)).tobytes()
        out: list[bytes] = []
        known, word = self.young.get, self.word
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.newline)
            else:
                line = " " + line
            if "  " in line or line[-1:] == " ":  # pieces of several spaces: only before a word do paths meet
                words = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", line.replace(" ", SPACE))
            else:
                words = line.replace(" ", f" {SPACE}").split(" ")
            out += [known(w) or word(w) for w in words if w]
            known = self.young.get
        return b"".join(out)


def decode_ids(ids: Iterable[int] | None, lexicon: Lexicon) -> str:
    """The text of ids. Bytes that are no UTF-8 give U+FFFD; control ids and ids outside the model give nothing."""
    plain, n = lexicon.plain, len(lexicon.plain)
    ids = list(ids) if ids is not None else []
    if ids and (min(ids) < 0 or max(ids) >= n):
        ids = [i for i in ids if 0 <= i < n]
    text = b"".join(map(plain.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


_built: dict[str, Lexicon] = {}


def _shared(df: DataFrame, path: str):
    """A broadcast of the pieces (as large as the model, whatever the data) and how a worker builds its lexicon once."""
    pieces = df.sparkSession.sparkContext.broadcast(read_model(path))

    def get() -> Lexicon:
        if path not in _built:
            _built[path] = Lexicon(pieces.value)
        return _built[path]

    return get


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str = MODEL) -> DataFrame:
    """All columns plus ``ids``, an array of ints; an existing column of that name is replaced.

    Null and empty texts have an empty array. Rows are encoded one by one, so repeated
    rows agree and an empty table stays empty.
    """
    df = df.drop(ids_col)
    own = df.columns
    lexicon = _shared(df, path)

    def run(batches):
        encoder = Encoder(lexicon())
        for batch in text_slices(batches, text_col, TEXT_BYTES):
            packed = [encoder.encode(t) for t in batch.column(text_col).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*own, ids_col])

    return df.mapInArrow(run, extended(df, (ids_col, "array<int>")))


def _id_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = TEXT_BYTES // 4) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of no more ids than ``most`` (one row at least)."""
    for batch in batches:
        start, held = 0, 0
        for row, size in enumerate(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_pylist()):
            if row > start and held + size > most:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def decode(df: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str = MODEL) -> DataFrame:
    """All columns plus the decoded text; null ids give an empty text. An existing column of that name is replaced."""
    df = df.drop(text_col)
    own = df.columns
    lexicon = _shared(df, path)

    def run(batches):
        of = lexicon()
        for batch in _id_slices(batches, ids_col):
            column = batch.column(ids_col)
            flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            texts = [decode_ids(ids.tolist(), of) for ids in np.split(flat, ends[:-1])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*own, text_col])

    return df.mapInArrow(run, extended(df, (text_col, "string")))


def op10_pieces(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = decode(encode(docs))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


