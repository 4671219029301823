"""Toxicity by compression distance.

One zstandard dictionary holds fragments that toxic texts repeat, another as many that
ordinary texts repeat. A window that one of them shortens more lies nearer to its class.
Gains over thresholds, counted over a text's windows, go through a calibrated logistic
score.

zstandard's own trainer picks what is frequent, and nearly all of that is shared by both
classes; dictionaries from it, or from whole passages, told the classes apart far worse
(figures in the README). So the fragments are those whose frequency differs most, and a
window is a word: in wider ones chance matches drown what a fragment saves. Each window
starts with a carrier that both dictionaries hold: it pays for the headers of a
compressed block, below which zstandard would store a short window raw and show no
difference. A trailer closes it, since no match is looked for in the last bytes of a
block. Literals are not entropy coded, so lengths differ by matches alone.

Fragments are counted and windows measured where the texts lie, whole; counts of
fragments and one row of features for each labelled text reach the driver. Thresholds
are calibrated on texts that had no part in the dictionaries they are measured with: each
third of the texts by dictionaries from the other two.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, held_out, stage, table, text_slices

#: Labelled rows to learn from, by class; their texts are read whole.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2400
FOLDS = 3
CARRIER, TRAILER = b"0123456789ABCDEFGHIJKLMN", b"ZYXWVUTSRQ"
LEAST_MATCH = 4
#: Lengths of word beginnings that may be fragments, how many a dictionary takes, and how often a text counts.
FRAGMENT_BYTES, FRAGMENTS, PER_TEXT = range(4, 13), 64, 3
#: Texts of its class that must have a fragment, as a share, and times that its frequency must exceed the other class's.
LEAST_SHARE, LEAST_RATIO = 0.02, 3.0
#: Occurrences times the logarithm of the ratio that a fragment must reach, for each text of its class.
LEAST_WEIGHT = 0.2
#: Frequent fragments of ordinary texts to choose the ordinary dictionary from; about a hundred fill it.
USUAL = 4000
#: Bytes that the toxic dictionary must save over the ordinary one.
STEPS = (1, 2, 3, 4, 5, 6, 8)
THRESHOLD = 0.3
#: Windows whose gain a worker remembers, in two generations of this many.
MEMO = 100_000


def _fragments(text: str | None) -> dict[bytes, int]:
    """The word beginnings of a text and how often it has each, PER_TEXT at most."""
    own = Counter(w[:k] for w in (text or "").lower().encode().split() for k in FRAGMENT_BYTES if len(w) >= k)
    return {g: min(n, PER_TEXT) for g, n in own.items()}


@dataclass
class Counts:
    """Of one class: texts, their bytes, and for each fragment the texts that have it and its occurrences."""

    texts: int
    size: int
    having: Counter
    times: Counter


def distinctive(own: Counts, others: Counts) -> list[bytes]:
    """Fragments that one class has more often than the other, best first; of fragments within each other only the best."""
    size = own.size / max(1, others.size)
    weight = {}
    for g, n in own.times.items():
        ratio = n / ((others.times[g] + 1) * size)
        if own.having[g] >= max(3, LEAST_SHARE * own.texts) and ratio > LEAST_RATIO and n * math.log(ratio) >= LEAST_WEIGHT * own.texts:
            weight[g] = n * math.log(ratio)
    picked: list[bytes] = []
    for g in sorted(weight, key=lambda g: (-weight[g], -len(g), g)):
        if len(picked) < FRAGMENTS and not any(g in p or p in g for p in picked):
            picked.append(g)
    return picked


def usual(own: Counts, avoid: list[bytes], size: int) -> list[bytes]:
    """The most frequent fragments of a class, up to ``size`` bytes, none within those to avoid or the other way."""
    out: list[bytes] = []
    for g in sorted(own.times, key=lambda g: (-own.times[g], g)):
        if size <= 0:
            break
        if not any(g in p or p in g for p in (*avoid, *out)):
            out.append(g)
            size -= len(g) + 1
    return out


def content(fragments: list[bytes]) -> bytes:
    """Best fragments last, where offsets are shortest; the carrier closes."""
    return b" " + b" ".join(reversed(fragments)) + b" " + CARRIER


def dictionaries(toxic: Counts, clean: Counts) -> tuple[bytes, bytes]:
    """The contents of the toxic and of the ordinary dictionary, of like size."""
    picked = distinctive(toxic, clean)
    held = content(picked)
    return held, content(usual(clean, picked, len(held) - len(CARRIER)))


@dataclass
class Model:
    """Everything a worker needs; a few kilobytes whatever the corpus."""

    toxic: bytes
    ordinary: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]


class Gains:
    """Bytes that the toxic dictionary saves over the ordinary one, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.squeeze = []
        for data in (toxic, ordinary):
            how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=LEAST_MATCH, window_log=14, hash_log=14, chain_log=14, search_log=1, write_content_size=False, write_dict_id=False)
            prepared = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            prepared.precompute_compress(compression_params=how)
            self.squeeze.append(zstandard.ZstdCompressor(compression_params=how, dict_data=prepared).compress)
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def one(self, window: bytes) -> int:
        gain = self.old.get(window)
        if gain is None:
            toxic, ordinary = self.squeeze
            framed = CARRIER + b" " + window + b" " + TRAILER
            gain = len(ordinary(framed)) - len(toxic(framed))
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        if len(window) <= 64:
            self.young[window] = gain
        return gain

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().encode().split()
        known, one = self.young.get, self.one
        out = []
        for w in words:
            gain = known(w)
            if gain is None:
                gain = one(w)
                known = self.young.get
            out.append(gain)
        return np.asarray(out, np.int64)


def features(gains: np.ndarray) -> list[float]:
    n = max(1, len(gains))
    over = [int((gains >= k).sum()) for k in STEPS]
    return [*(math.log1p(x) for x in over), *(min(1.0, 20 * x / n) for x in over), min(12, int(gains.max(initial=0))), math.log(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (last: intercept) by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + ridge * np.r_[w[:-1], 0.0]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of labelled rows outside the evaluation fold; None where a class has no text.

    A document is toxic if any of its labels says so; null labels count for nothing. The
    sample are the SAMPLE_* ids of each class that come first by md5, so reruns agree; the
    classes' odds are counted over all labels. Of texts that share an id the least is read.
    """
    by_id = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in by_id.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    order = (F.md5(F.col("doc_id").cast("string")), F.col("doc_id"))
    picked = by_id.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(by_id.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    picked = picked.withColumnRenamed("doc_id", "id")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id"))  # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    rows = rows.where(F.col("text") != "").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("toxicity"), "id"), F.lit(FOLDS)).cast("int")
    rows = stage(rows.select("id", "toxic", fold.alias("fold"), "text"))

    def count(batches):
        for batch in text_slices(batches, "text"):
            at, fragments, times = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = _fragments(text)
                at += [row] * len(own)
                fragments += own
                times += own.values()
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()).take(take), batch.column("fold").take(take), pa.array(fragments, pa.binary()), pa.array(times, pa.int64())], ["toxic", "fold", "fragment", "times"])

    sizes = rows.groupBy("toxic", "fold").agg(F.count("*").alias("texts"), F.sum(F.length(F.lower("text").cast("binary"))).alias("size")).collect()
    folds = range(FOLDS)
    if len({r["toxic"] for r in sizes}) < 2:
        return None
    total = {y: sum(r["texts"] for r in sizes if r["toxic"] == y) for y in (0, 1)}
    each = rows.mapInArrow(count, "toxic int, fold int, fragment binary, times long")
    cells = [(f"{what}_{y}_{k}", F.sum(F.when((F.col("toxic") == y) & (F.col("fold") == k), amount).otherwise(0))) for y in (0, 1) for k in folds for what, amount in (("having", F.lit(1)), ("times", F.col("times")))]
    counted = stage(each.groupBy("fragment").agg(*(c.alias(name) for name, c in cells)))
    over = lambda what, y: sum((F.col(f"{what}_{y}_{k}") for k in folds), F.lit(0))
    # fragments that enough toxic texts have, even without a fold, and the most frequent ones of clean texts
    kept = counted.where(over("having", 1) >= max(3, LEAST_SHARE * total[1] / 2)).collect()
    kept += counted.orderBy(over("times", 0).desc(), "fragment").limit(USUAL).collect()
    kept = {bytes(r["fragment"]): r for r in kept}

    def of(y: int, without: int | None) -> Counts:
        use = [k for k in folds if k != without]
        add = lambda what: Counter({g: sum(r[f"{what}_{y}_{k}"] for k in use) for g, r in kept.items()})
        mine = [r for r in sizes if r["toxic"] == y and r["fold"] in use]
        return Counts(sum(r["texts"] for r in mine), sum(r["size"] for r in mine), add("having"), add("times"))

    apart = [dictionaries(of(1, k), of(0, k)) for k in folds]

    def measure(batches):
        gains: dict[int, Gains] = {}
        for batch in text_slices(batches, "text"):
            ids, marks, found = batch.column("id"), batch.column("toxic").cast(pa.int32()), []
            for k, text in zip(batch.column("fold").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if k not in gains:
                    gains[k] = Gains(*apart[k])
                found.append(features(gains[k].of(text)))
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(found, pa.list_(pa.float64()))], ["id", "toxic", "x"])

    measured = rows.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, toxic int, x array<double>").orderBy("id").collect()
    y = np.array([r["toxic"] for r in measured])
    mean, scale, w = fit_logistic(np.array([r["x"] for r in measured]), y)
    w[-1] += math.log(n[1] / n[0] * (y == 0).sum() / (y == 1).sum())  # the classes' odds in the population
    return Model(*dictionaries(of(1, None), of(0, None)), mean.tolist(), scale.tolist(), w.tolist())


def score(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns plus ``score`` (0 to 1) and ``predicted``.

    Null and empty texts get what the fit gives to a text without windows. Without a
    model every score is 0. Existing columns of these names are replaced; rows are
    scored one by one from their text alone, so repeated rows agree and an empty table
    stays empty.
    """
    df = df.drop("score", "predicted")
    own = df.columns

    def run(batches):
        if model is None:
            rate = lambda text: 0.0
        else:
            gains = Gains(model.toxic, model.ordinary)
            mean, scale, w = map(np.asarray, (model.mean, model.scale, model.weights))
            rate = lambda text: float(1 / (1 + np.exp(-np.clip((features(gains.of(text)) - mean) / scale @ w[:-1] + w[-1], -30, 30))))
        for batch in text_slices(batches, text_col):
            scores = [rate(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], [*own, "score", "predicted"])

    return df.mapInArrow(run, extended(df, ("score", "double"), ("predicted", "int")))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
