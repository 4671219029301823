"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text gives, from any position, the longest
stretch that occurs in that text. Cutting a text greedily into such stretches (Ziv and
Merhav's cross-parsing) takes the fewer phrases the nearer the language. Phrases grow with
the logarithm of the sample's length, so their number times that logarithm estimates the
entropy, whatever the sample; the language with the least wins.

Workers build the automata from the sample texts, which are short, and parse many texts
in step: one lane per text and language, one table lookup per code point. Where few long
texts are left the rest goes code point by code point over the same table, so phrases
cross whole texts whatever their length.
"""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, held_out, table, text_slices

#: Code points of sample text: of one language, of all together.
LANGUAGE_CHARS, ALL_CHARS = 40_000, 400_000
#: Documents asked for from a language.
DOCUMENTS = 60
#: Letters with a symbol of their own, the most frequent of the sample. The sample's others are numbers of DIGITS more symbols.
LETTERS, DIGITS = 94, 32
#: Weight of one phrase in the score.
PHRASE = 0.5
#: Below this many lanes a step costs more than its texts' code points one by one.
FEW = 12
NONE = "und"


def normal(text: str) -> str:
    """Small letters; runs of anything else are one space."""
    return "".join(c if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc") else " " for c in text.lower())


class Automaton:
    """Suffix automaton of a string of symbol numbers, one state per class of end positions."""

    def __init__(self, symbols: bytes) -> None:
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class Parser:
    """Cross-parsing against all languages at once.

    ``table[state * width + symbol]`` is the next state (times width) with the phrases
    that end on the way in its two top bits: one if the current phrase cannot grow, one
    more if the symbol does not occur in the language at all.
    """

    SHIFT = 30

    def __init__(self, samples: dict[str, str]) -> None:
        self.languages = sorted(samples)
        texts = {k: " " + " ".join(normal(samples[k]).split()) + " " for k in self.languages}
        counts: dict[str, int] = {}
        for t in texts.values():
            for c in t:
                counts[c] = counts.get(c, 0) + 1
        counts.pop(" ", None)
        letters = sorted(sorted(counts), key=lambda c: -counts[c])
        letters, rare = letters[:LETTERS], letters[LETTERS:]
        self.n_digits = 1
        while DIGITS**self.n_digits < len(rare):
            self.n_digits += 1
        self.width = len(letters) + DIGITS * bool(rare) + 2  # 0: space; the last: a letter that no sample has
        self.symbol = {c: k + 1 for k, c in enumerate(letters)}
        other = self.width - 1
        self._first_digit = len(letters) + 1
        #: Symbol of each code point of the basic plane and beyond, small letters first.
        self.codes = np.zeros(0x110000, np.uint8)
        self.codes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        #: Number of each rare letter, -1 for all else.
        self._rare = np.full(0x110000, -1, np.int32)
        self._rare[[ord(c) for c in rare]] = np.arange(len(rare))
        self._known = np.zeros(0x110000, bool)
        self._known[[ord(c) for c in (*letters, *rare)]] = True
        self._known[[k for k in range(128) if not chr(k).isalpha()]] = True
        self._other = other
        tables, roots, base = [], [], 0
        for k in self.languages:
            states = Automaton(bytes(self._symbols(np.fromiter(map(ord, texts[k]), np.uint32)))).next
            width, root = self.width, base * self.width
            start = np.full(width, root | 1 << self.SHIFT, np.uint32)  # at the root an unknown symbol is a phrase
            for c, s in states[0].items():
                start[c] = (base + s) * width
            cut = start + np.uint32(1 << self.SHIFT)  # elsewhere the phrase before it ends too
            grid = np.tile(cut, (len(states), 1))
            grid[0] = start
            for s, edges in enumerate(states):
                for c, t in edges.items():
                    grid[s, c] = (base + t) * width
            tables.append(grid.ravel())
            roots.append(root)
            base += len(states)
        if base * self.width >= 1 << self.SHIFT:
            raise ValueError("the sample is too large for the table")
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.uint32)
        self.roots = np.array(roots, np.uint32)
        #: By language: the logarithm of its sample's size, in which the length of a phrase grows, over the greatest.
        self.norm = np.log([1 + len(texts[k]) for k in self.languages])
        self.norm /= self.norm.max(initial=1e-9)
        self._scalar = memoryview(self.table)

    def _symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; a rare letter takes several."""
        symbols, rare = self.codes[points], self._rare[points]
        for at in np.flatnonzero(~self._known[points]).tolist():
            c = chr(points[at])
            if c.isalpha() or unicodedata.category(c) in ("Mn", "Mc"):
                symbols[at] = self._other
        where = np.flatnonzero(rare >= 0)
        if not len(where):
            return symbols
        sizes = np.ones(len(points), np.int64)
        sizes[where] = self.n_digits
        out = np.repeat(symbols, sizes)
        start = (np.cumsum(sizes) - sizes)[where]
        for k in range(self.n_digits):
            out[start + k] = self._first_digit + rare[where] // DIGITS ** (self.n_digits - 1 - k) % DIGITS
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """Symbols of a text; runs of spaces are one, none at the ends; empty without a letter."""
        if not text:
            return np.zeros(0, np.uint8)
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        symbols = self._symbols(points)
        space = symbols == 0
        keep = ~space
        keep[1:] |= space[1:] & ~space[:-1]
        symbols = symbols[keep]
        return symbols if symbols.any() and any(map(str.isalpha, text)) else symbols[:0]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) in each language (column)."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        sizes = np.array([len(texts[k]) for k in order], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(order) else sizes
        flat = np.concatenate([texts[k] for k in order]) if len(order) else np.zeros(0, np.uint8)
        state = np.repeat(self.roots[:, None], len(order), 1)
        count = np.zeros(state.shape, np.int32)
        mask = np.uint32((1 << self.SHIFT) - 1)
        step, lanes = 0, int((sizes > 0).sum())
        while lanes > FEW:
            upto = int(sizes[lanes - 1])
            while step < upto:
                found = self.table.take(state[:, :lanes] + flat[starts[:lanes] + step])
                count[:, :lanes] += (found >> self.SHIFT).astype(np.int32)
                state[:, :lanes] = found & mask
                step += 1
            lanes = int((sizes > step).sum())
        walk, low = self._scalar, (1 << self.SHIFT) - 1
        for k in range(lanes):
            rest = flat[starts[k] + step : starts[k] + sizes[k]].tolist()
            for j in range(len(self.languages)):
                s, n = int(state[j, k]), 0
                for c in rest:
                    v = walk[s + c]
                    n += v >> 30
                    s = v & low
                state[j, k], count[j, k] = s, count[j, k] + n
        count += (state != self.roots[:, None]) & (sizes > 0)
        out = np.zeros((len(order), len(self.languages)), np.int64)
        out[order] = count.T
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score. Ties go to the language first by code point; no letter, or no language learnt: ``und`` and 0."""
        coded = [self.encode(t) for t in texts]
        if not self.languages:
            return [(NONE, 0.0)] * len(texts)
        phrases = self.phrases(coded) * self.norm
        out = []
        for symbols, row in zip(coded, phrases, strict=True):
            if not len(symbols):
                out.append((NONE, 0.0))
                continue
            best = int(row.argmin())
            out.append((self.languages[best], float(1 / np.exp(-PHRASE * (row - row[best])).sum())))
        return out


_built: dict[str, Parser] = {}


def _parser(samples: dict[str, str]) -> Parser:
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    if key not in _built:
        _built.clear()
        _built[key] = Parser(samples)
    return _built[key]


def learn(docs: DataFrame) -> dict[str, str]:
    """Sample text by language, from labelled rows outside the evaluation fold.

    A language's rows are counted first; rows whose hash lies below DOCUMENTS / count are
    its sample, so about DOCUMENTS rows of each reach the driver whatever the corpus, and the same
    ones each time. Every language is learnt. Its sample holds LANGUAGE_CHARS, or its share
    of ALL_CHARS: whole texts, in order of their hash, that fit in what is left of it. Of
    a text longer than that altogether a stretch from a place that its hash tells is drawn,
    which counts only where no whole text fits.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = own.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return {}
    hashed = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30))
    below = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, DOCUMENTS / r["count"]) * (1 << 30))))), F.col("lang"))
    most = max(1, min(LANGUAGE_CHARS, ALL_CHARS // len(counts)))
    rows = own.where(hashed < below).select("lang", hashed.alias("hash"), F.length("text").alias("size"), "text")
    place = 1 + F.pmod(F.col("hash"), F.greatest(F.lit(1), F.col("size") - most))
    rows = rows.withColumn("text", F.when(F.col("size") > most, F.substr("text", place.cast("int"), F.lit(most))).otherwise(F.col("text")))
    rows = rows.orderBy(F.col("size") > most, "hash", "text").limit(3 * DOCUMENTS * len(counts)).collect()
    out: dict[str, str] = {}
    for r in rows:
        held = out.setdefault(r["lang"], "")
        if len(held) + len(r["text"]) < most or not held:
            out[r["lang"]] = f"{held} {r['text']}"
    return out


def identify(df: DataFrame, samples: dict[str, str], text_col: str = "text") -> DataFrame:
    """All columns plus ``lang_pred`` and ``score``; see ``Parser.predict``.

    Null texts and texts without a letter are ``und``; letters that no language was learnt
    with are letters nonetheless. Existing columns of these names are replaced. Rows are
    read one by one, so repeated rows agree and an empty table stays empty.
    """
    df = df.drop("lang_pred", "score")
    own = df.columns

    def run(batches):
        parser = _parser(samples)
        for batch in text_slices(batches, text_col, 8 << 20):  # many lanes
            found = parser.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*own, "lang_pred", "score"])

    return df.mapInArrow(run, extended(df, ("lang_pred", "string"), ("score", "double")))


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = learn(docs)
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), samples).drop("text")
