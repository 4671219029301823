"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints of word shingles are linked when they differ in at most ``RADIUS``
bits. The bits, correlated ones together, form partitions. For every fingerprint a
dynamic programme gives each partition its own threshold, from estimated candidate
counts: if thresholds t_i (-1: not probed) sum to RADIUS - partitions + 1, two linked
fingerprints are within t_i of each other in some partition i. Its values within t_i are
probed, candidates verified on all bits.

Candidates at threshold 0 are counted exactly, one count per partition value, by a
grouping that grows with the table; only what wider thresholds would add is estimated,
from densities. What a fingerprint expects by chance alone grows with the table too, and
the limit with it, so the same share of unlike texts is probed at any size.

A fingerprint over the limit lies in a crowd of near copies, where candidates would be
the pairs of a group. Such fingerprints go another exact way: two lie within two bits if
and only if a third value lies within one bit of both, so each is filed under the 65
values within one bit, and whatever shares a value is linked in a star. Work is bounded
by a constant times the fingerprints on either way.

``similar`` takes these links over fingerprints of different five-word shingles and adds
a wide form for pairs down to a similarity of 0.8: so many bits then differ that no
thresholds are both certain and selective. The wide form takes as many partitions, all
with threshold 0, as give a pair its wanted chance to agree on one.

Only fingerprints move, never texts; equal ones are one node. Links and components stay
distributed: labels are lowered and shortcut in rounds, each written to the shared folder.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, free_name, stage, table, text_slices, unstage

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints from which partitions are two (32 bits) instead of three: three would meet over 200 by chance.
WIDE_FROM = 1 << 27
#: Leading bits of a partition value by which densities are kept; what the driver holds is 2**BINS counts a partition.
BINS = 16
#: Candidates and probes, beyond four times those by chance, up to which a fingerprint is probed by thresholds.
LIGHT = 64
#: Bits whose links the second way finds without pairs: fingerprints within one bit of a common value.
_FLIPS = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)])


def _words(text: str | None) -> list[bytes]:
    """Bytes: only A-Z change, only ASCII spaces part."""
    return (text or "").encode().lower().split()


def _shingle_hashes(words: list[bytes], shingle: int, digest=xxhash.xxh64_intdigest) -> np.ndarray:
    """Repeats included; fewer words: the whole sequence."""
    joined = b" ".join(words)
    k = min(shingle, len(words))
    starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
    n = len(words) - k + 1
    return np.fromiter((digest(joined[starts[i] : starts[i + k] - 1], SEED) for i in range(n)), np.uint64, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is set; ``hashes`` has one row for each shingle. Sums of 255 rows fit in bytes."""
    total = np.zeros(64 * hashes.shape[1], np.int64)
    raw = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8)
    for at in range(0, len(raw), 255):
        total += np.unpackbits(raw[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return total


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes. No words: 0. Unsigned."""
    words = _words(text)
    if not words:
        return 0
    hashes = _shingle_hashes(words, shingle)
    return int(np.packbits(2 * _ones(hashes[:, None]) > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """All columns plus the fingerprint as a signed long. An existing column of that name is replaced.

    Null and empty texts and texts without words have fingerprint 0. Rows are read one by
    one, so repeated rows agree and an empty table stays empty.
    """
    df = df.drop(out_col)
    own = df.columns

    def run(batches):
        for batch in text_slices(batches, text_col):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(text_col).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], [*own, out_col])

    return df.mapInArrow(run, extended(df, (out_col, "long")))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(together: np.ndarray, n: int, partitions: int) -> list[list[int]]:
    """Partitions of near equal size that hold correlated bits, from the counts of bits set together.

    From the pair correlated most a partition takes the bit that correlates most with
    those it has, until it is full. Any grouping gives the same links; this one decides
    how many candidates they cost.
    """
    p = np.diag(together) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(together / max(1, n) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left = list(range(64))
    out = []
    for k in range(partitions):
        size = len(left) // (partitions - k)
        sub = corr[np.ix_(left, left)]
        group = [left[int(sub.sum(1).argmax())]]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].sum(1).argmax())])
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def value_of(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The fingerprints' bits of a partition, packed."""
    fps = fps.view(np.uint64)
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def variants(bits: int, radius: int) -> np.ndarray:
    """Masks that change at most ``radius`` bits (two at most)."""
    one = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    out = [np.zeros(1, np.uint64)]
    if radius >= 1:
        out.append(one)
    if radius >= 2:
        i, j = np.triu_indices(bits, 1)
        out.append(one[i] | one[j])
    return np.concatenate(out)


def allocate(cost: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of least total cost for each row.

    ``cost[row, partition, 1 + t]``: cost of threshold t from -1 up. The thresholds of a
    row sum to ``budget``; the programme runs over partitions and the sum so far.
    Returns thresholds (row, partition) and their cost.
    """
    rows, parts, kinds = cost.shape
    total = budget + parts  # thresholds counted from 0
    best = np.full((rows, total + 1), np.inf)
    best[:, 0] = 0
    via = np.zeros((rows, parts, total + 1), np.int8)
    for k in range(parts):
        new = np.full_like(best, np.inf)
        for t in range(min(kinds, total + 1)):
            offer = np.full_like(best, np.inf)
            offer[:, t:] = best[:, : total + 1 - t] + cost[:, k, t : t + 1]
            better = offer < new
            new[better] = offer[better]
            via[:, k][better] = t
        best = new
    out = np.zeros((rows, parts), np.int64)
    at = np.full(rows, total)
    for k in reversed(range(parts)):
        out[:, k] = via[np.arange(rows), k, at]
        at = at - out[:, k]
    return out - 1, best[:, total]


@dataclass
class Plan:
    """Partitions and the density of their values; bounded whatever the corpus."""

    groups: list[list[int]]
    density: np.ndarray
    n: int

    @property
    def limit(self) -> float:
        """Candidates up to which a fingerprint is probed: LIGHT, and four times what thresholds of 0 or 1 meet by chance."""
        chance = sum((1 if len(self.groups) > 2 else len(b) + 1) * self.n / 2 ** len(b) for b in self.groups)
        return LIGHT + 4 * chance

    def _near(self, value: np.ndarray, k: int, t: int) -> np.ndarray:
        """Estimated fingerprints at 1 to ``t`` bits from a value: each value of a bin has its share."""
        bits = len(self.groups[k])
        drop = max(0, bits - BINS)
        found = np.zeros(len(value))
        for mask in variants(bits, t)[1:]:
            found += self.density[k, ((value ^ mask) >> np.uint64(drop)).astype(np.int64)]
        return found / 2**drop

    def thresholds(self, fps: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds by row and partition, and estimated candidates. ``own``: how many fingerprints have the same partition value."""
        cost = np.empty((len(fps), len(self.groups), RADIUS + 2))
        for k, bits in enumerate(self.groups):
            value = value_of(fps, bits)
            cost[:, k, 0] = 0
            for t in range(RADIUS + 1):
                probes = len(variants(len(bits), t))
                cost[:, k, 1 + t] = own[:, k] + (self._near(value, k, t) if t else 0) + probes
        return allocate(cost, RADIUS - len(self.groups) + 1)

    def filed(self, fps: np.ndarray) -> pd.DataFrame:
        """A row for each fingerprint and partition."""
        return _rows([(fps, k, value_of(fps, bits)) for k, bits in enumerate(self.groups)])

    def probes(self, fps: np.ndarray, thresholds: np.ndarray) -> pd.DataFrame:
        """The partition values to look under: all within the threshold of the own one."""
        rows = []
        for k, bits in enumerate(self.groups):
            value = value_of(fps, bits)
            for t in range(RADIUS + 1):
                who = thresholds[:, k] == t
                if who.any():
                    masks = variants(len(bits), t)
                    rows.append((np.repeat(fps[who], len(masks)), k, (value[who][:, None] ^ masks).ravel()))
        return _rows(rows)


def _rows(rows: list[tuple[np.ndarray, int, np.ndarray]]) -> pd.DataFrame:
    empty = np.zeros(0, np.int64)
    fp = np.concatenate([empty, *(r[0].view(np.int64) for r in rows)])
    part = np.concatenate([empty, *(np.full(len(r[0]), r[1]) for r in rows)])
    return pd.DataFrame({"fp": fp, "part": part.astype(np.int32), "value": np.concatenate([empty, *(r[2].view(np.int64) for r in rows)])})


def plan(nodes: DataFrame, partitions: int | None = None) -> Plan:
    """Statistics over all fingerprints; 64 rows and 2**BINS counts a partition reach the driver."""

    def together(frames):
        total, n = np.zeros((64, 64), np.int64), 0
        for frame in frames:
            for at in range(0, len(frame), 1 << 14):
                x = _bits(frame["fp"].to_numpy()[at : at + (1 << 14)]).astype(np.float32)
                total += np.rint(x.T @ x).astype(np.int64)
                n += len(x)
        yield pd.DataFrame({"bit": np.arange(64), "n": n, "row": list(total)})

    per_task = nodes.select("fp").mapInPandas(together, "bit int, n long, row array<long>")
    summed = per_task.groupBy("bit").agg(F.sum("n").alias("n"), *(F.sum(F.col("row")[k]).alias(f"b{k}") for k in range(64))).collect()
    counts = np.zeros((64, 64))
    for r in summed:
        counts[r["bit"]] = [r[f"b{k}"] for k in range(64)]
    n = max((r["n"] for r in summed), default=0)
    groups = group_bits(counts, n, partitions or (3 if n < WIDE_FROM else 2))

    def bins(frames):
        total = np.zeros((len(groups), 1 << BINS), np.int64)
        for frame in frames:
            for k, bits in enumerate(groups):
                at = value_of(frame["fp"].to_numpy(), bits) >> np.uint64(max(0, len(bits) - BINS))
                total[k] += np.bincount(at.astype(np.int64), minlength=1 << BINS)
        k, b = np.nonzero(total)
        yield pd.DataFrame({"part": k.astype(np.int32), "bin": b.astype(np.int32), "n": total[k, b]})

    found = nodes.select("fp").mapInPandas(bins, "part int, bin int, n long").groupBy("part", "bin").agg(F.sum("n").alias("n")).toPandas()
    density = np.zeros((len(groups), 1 << BINS), np.int64)
    density[found["part"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
    return Plan(groups, density, n)


def links(nodes: DataFrame, how: Plan) -> DataFrame:
    """``(a, b)``: pairs of different fingerprints, a < b, whose components are those of all links.

    Values that more fingerprints have than the limit are joined with nothing: a
    fingerprint probed by thresholds meets no such value, by exact counts.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(how)  # 2**BINS counts a partition
    parts = len(how.groups)
    limit = how.limit

    def file(frames):
        for frame in frames:
            for at in range(0, len(frame), 1 << 14):
                yield shared.value.filed(frame["fp"].to_numpy()[at : at + (1 << 14)])

    def probe(frames):
        for frame in frames:
            for at in range(0, len(frame), 1024):
                rows = frame.iloc[at : at + 1024]
                fps = rows["fp"].to_numpy()
                thresholds, _ = shared.value.thresholds(fps, rows[[f"c{k}" for k in range(parts)]].to_numpy())
                yield shared.value.probes(fps, thresholds)

    kind = "fp long, part int, value long"
    filed = nodes.select("fp").mapInPandas(file, kind)
    counts = stage(filed.groupBy("part", "value").agg(F.count("*").alias("n")))
    known = stage(filed.join(counts, ["part", "value"]))
    own = known.groupBy("fp").agg(*(F.max(F.when(F.col("part") == k, F.col("n"))).alias(f"c{k}") for k in range(parts)))
    probes = stage(own.mapInPandas(probe, kind))  # chosen and listed in one pass, so a task has one Python worker
    met = probes.join(counts, ["part", "value"]).groupBy("fp").agg((F.sum("n") <= limit).alias("light"))
    met = stage(met)
    light = met.where("light").select("fp")
    thin = known.where(F.col("n") <= limit).select("part", "value", F.col("fp").alias("x"))
    near = probes.join(light, "fp").select("part", "value", F.col("fp").alias("y")).join(thin, ["part", "value"])
    near = near.where((F.col("x") != F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS))
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def flip(frames):
        for frame in frames:
            for at in range(0, len(frame), 4096):
                fps = frame["fp"].to_numpy()[at : at + 4096]
                yield pd.DataFrame({"fp": np.repeat(fps, 65), "value": (fps.view(np.uint64)[:, None] ^ _FLIPS).ravel().view(np.int64)})

    star = met.where("NOT light").select("fp").mapInPandas(flip, "fp long, value long").groupBy("value").agg(F.collect_list("fp").alias("fps"))  # 65 different ones at most
    star = star.where(F.size("fps") > 1).withColumn("a", F.array_min("fps")).select("a", F.explode("fps").alias("b")).where("a != b")
    return near.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(fp, root)`` for every fingerprint that has a link: the least fingerprint reachable.

    Each round a label falls to the least of the neighbours', and so does that of the
    fingerprint it names, so whole trees fall at once; then two steps go from label to
    label, so long chains quarter. Rounds end when no label changed.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stage(both.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("m")).select("fp", F.least("fp", "m").alias("root")))
    own = F.struct("fp", F.col("root").alias("was"), F.least("root", "near").alias("low"))
    named = F.struct(F.col("root").alias("fp"), F.lit(None).cast("long").alias("was"), F.col("near").alias("low"))
    while True:
        before = labels
        seen = both.join(labels.select(F.col("fp").alias("b"), "root"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        offers = labels.join(seen, "fp").select(F.explode(F.array(own, named)).alias("o")).select("o.*")
        lower = stage(offers.groupBy("fp").agg(F.max("was").alias("was"), F.min("low").alias("low")))
        jump = lower.select(F.col("fp").alias("low"), F.col("low").alias("beyond"))
        stepped = lower
        for _ in range(2):
            stepped = stepped.join(jump, "low").select("fp", "was", F.col("beyond").alias("low"))
        stepped = stage(stepped.withColumnRenamed("low", "root"))
        unstage(lower, before)
        labels = stepped
        if not stepped.where("root != was").limit(1).count():
            unstage(both)
            return labels.select("fp", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", fp_col: str = "fp") -> DataFrame:
    """All columns plus ``component_id``: the least id reachable over links, the own one included.

    ``df`` needs a fingerprint column (see ``with_fingerprints``) and is read more than
    once: stage it. Rows without words share fingerprint 0 and are linked like others.
    Repeated rows agree. Null ids count for nothing in a minimum; a component of null ids
    has a null ``component_id``. An empty table stays empty. An existing column of that
    name is replaced, others stay whatever their names.
    """
    df = df.drop("component_id")
    nodes = stage(df.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first")))
    roots = components(links(nodes, plan(nodes)))
    placed = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    name = free_name(df.columns, "node_fp")
    answer = placed.select("fp", "root").join(least, "root").select(F.col("fp").alias(name), "component_id")
    return df.join(answer, F.col(fp_col) == F.col(name)).drop(name)


@dataclass
class Wide:
    """How ``similar`` looks: ``parts`` partitions of ``bits`` bits each, and what may differ in a pair."""

    bits: int
    parts: int
    differ: float
    similarity: float

    @classmethod
    def of(cls, n: int, similarity: float, recall: float) -> Wide:
        """Partitions so wide that a text meets about one other by chance in each, and as many as give a pair of exactly ``similarity`` the chance ``recall``.

        Sets of equal size and Jaccard similarity s have the cosine 2s / (1 + s); a
        SimHash bit differs with the angle over pi. Both numbers follow from the size of
        the table alone: bits as its logarithm, partitions as its power 0.23.
        """
        differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
        bits = min(48, max(12, math.ceil(math.log2(max(2, n)))))
        return cls(bits, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** bits)), differ, similarity)

    @property
    def lanes(self) -> int:
        """Words of 64 bits: the partitions, 1,024 bits at least, and one that pairs are first held against."""
        return 1 + max(16, -(-self.bits * self.parts // 64))

    def most(self, bits: int, errors: float) -> int:
        """Bits of ``bits`` that a pair may differ in: the expected ones and so many standard errors."""
        return int(self.differ * bits + errors * math.sqrt(self.differ * (1 - self.differ) * bits))


def wide_fingerprint(words: list[bytes], shingle: int, lanes: int) -> np.ndarray:
    """``lanes`` words of 64 majority bits over the different shingles. No words: zeros."""
    if not words:
        return np.zeros(lanes, np.uint64)
    seeds = np.unique(_shingle_hashes(words, shingle))
    ones = np.zeros(64 * lanes, np.int64)
    steps = np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(seeds), 4080):  # 16 rows of sums; lanes come from a mixing function that is one to one
        x = seeds[at : at + 4080, None] + steps
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        ones += _ones(x ^ x >> np.uint64(31))
    return np.packbits(2 * ones > len(seeds), bitorder="little").view("<u8").astype(np.uint64)


def _node(words: list[bytes]) -> int:
    """Names a text up to case and spaces."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _naming(text_col: str, own: list[str], node: str):
    """Adds the node of each row's text."""

    def run(batches):
        for batch in text_slices(batches, text_col):
            nodes = [_node(_words(t)) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*own, node])

    return run


#: Rows of a partition value that are all held against each other; a later one goes to the first of them it is near to.
HEAD = 17


class Bucket:
    """The rows of one partition value, read one after another; holds only those that later rows are held against."""

    def __init__(self, most: int) -> None:
        self.most, self.seen = most, 0
        self.nodes, self.checks = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def _hold(self, node: np.int64, check: np.uint64) -> None:
        self.nodes, self.checks = np.append(self.nodes, node), np.append(self.checks, check)

    def add(self, nodes: np.ndarray, checks: np.ndarray, a: list[int], b: list[int]) -> None:
        """Appends the pairs found to ``a`` and ``b``. A row near none of those held is held too."""
        i = 0
        while i < len(nodes) and self.seen < HEAD:
            near = self.nodes[np.bitwise_count(self.checks ^ checks[i]) <= self.most]
            a += near.tolist()
            b += [int(nodes[i])] * len(near)
            self._hold(nodes[i], checks[i])
            i, self.seen = i + 1, self.seen + 1
        self.seen += len(nodes) - i
        nodes, checks, k = nodes[i:], checks[i:], 0
        while len(nodes):
            if k == len(self.nodes):
                self._hold(nodes[0], checks[0])
                nodes, checks = nodes[1:], checks[1:]
            near = np.bitwise_count(self.checks[k] ^ checks) <= self.most
            a += [int(self.nodes[k])] * int(near.sum())
            b += nodes[near].tolist()
            nodes, checks, k = nodes[~near], checks[~near], k + 1


def bucket_pairs(batches, most: int):
    """``(a, b)``: likely pairs, from rows (slot, node, check) sorted by slot and node.

    Short slots within a batch are done all at once, row against row; the first and the
    last slot of a batch, which may go on in another, and long ones by ``Bucket``.
    """
    slot, held = None, Bucket(most)
    for batch in batches:
        if not batch.num_rows:
            continue
        s, n, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        c = c.view(np.uint64)
        edges = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
        sizes = np.diff(edges)
        single = sizes > HEAD
        single[[0, -1]] = True
        a: list[int] = []
        b: list[int] = []
        for r in np.flatnonzero(single).tolist():
            if s[edges[r]] != slot:
                slot, held = s[edges[r]], Bucket(most)
            held.add(n[edges[r] : edges[r + 1]], c[edges[r] : edges[r + 1]], a, b)
        short = np.repeat(~single, sizes)
        s, n, c = s[short], n[short], c[short]
        for d in range(1, int(sizes[~single].max(initial=1))):
            near = np.flatnonzero((s[d:] == s[:-d]) & (np.bitwise_count(c[d:] ^ c[:-d]) <= most))
            a += n[near].tolist()
            b += n[near + d].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def within_radius(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: nodes (``node, print``) that equal or linked fingerprints join, those of the last 64 bits of the print.

    Pairs are of different nodes; the components are those of all links.
    """
    named = nodes.select(F.element_at("print", -1).alias("fp"), "node")
    prints = stage(named.groupBy("fp").agg(F.min("node").alias("first")))
    equal = named.join(prints, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    left, right = (prints.select(F.col("fp").alias(end), F.col("first").alias(f"n{end}")) for end in ("a", "b"))
    linked = links(prints, plan(prints)).join(left, "a").join(right, "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return equal.unionByName(linked)


def similar(df: DataFrame, how: Wide, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """``(node, first, n, root)``: texts up to case and spaces, and the group each is in, staged.

    ``first`` is the least id of the node, ``n`` the rows that have it (of all the
    node's, where no id is known), ``root`` the least node of the group. Texts whose
    64-bit fingerprints differ in at most ``RADIUS`` bits are linked as everywhere (see
    ``plan`` and ``links``), and none of these links is lost. Beside that, a pair of
    exactly the wanted similarity shares a partition value with the chance ``how`` was
    made for; closer ones are hardly ever missed. Pairs that all bits (1,024 at least)
    put more than three standard errors below it are dropped, the others are held
    against each other by their sets of shingles, which decide. Texts without words are
    one node.
    """
    lanes = how.lanes
    names = [f"f{k}" for k in range(lanes)]

    def read(batches):
        for batch in text_slices(batches, "text"):
            words = [_words(t) for t in batch.column("text").to_pylist()]
            nodes = pa.array([_node(w) for w in words], pa.int64())
            seen: dict[int, np.ndarray] = {}
            prints = [seen.setdefault(node, wide_fingerprint(w, shingle, lanes)) if node not in seen else seen[node] for node, w in zip(nodes.to_pylist(), words, strict=True)]
            flat = np.concatenate([*prints, np.zeros(0, np.uint64)]).view(np.int64)
            prints = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * lanes, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), nodes, prints], ["id", "node", "print"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = df.schema[id_col].dataType.simpleString()
    marked = rows.mapInArrow(read, f"id {id_type}, node long, print array<long>")
    by_id = marked.groupBy("node", "id").agg(F.first("print").alias("print"), F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "n")
    nodes = stage(by_id.groupBy("node").agg(F.first("print").alias("print"), F.min(order).alias("least")).select("node", "print", F.col("least.id").alias("first"), F.col("least.n").alias("n")))
    own = how.bits * how.parts

    def file(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            prints = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, lanes)
            for at in range(0, len(node), 1024):
                ids, words = node[at : at + 1024], prints[at : at + 1024]
                set_bits = np.unpackbits(np.ascontiguousarray(words[:, : lanes - 1].astype("<u8")).view(np.uint8), axis=1, bitorder="little")[:, :own].reshape(len(ids), how.parts, how.bits)
                packed = np.zeros((len(ids), how.parts, 64), np.uint8)
                packed[:, :, : how.bits] = set_bits
                value = np.packbits(packed, axis=2, bitorder="little").view("<i8").reshape(len(ids), how.parts)
                slot = value | np.arange(how.parts, dtype=np.int64) << how.bits
                check = np.repeat(words[:, -1], how.parts).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot.ravel()), pa.array(np.repeat(ids, how.parts)), pa.array(check)], ["slot", "node", "check"])

    likely = how.most(64, 3)
    filed = nodes.select("node", "print").mapInArrow(file, "slot long, node long, check long").repartition("slot").sortWithinPartitions("slot", "node")
    pairs = filed.mapInArrow(lambda batches: bucket_pairs(batches, likely), "a long, b long").distinct()
    left, right = nodes.select(F.col("node").alias("a"), F.col("print").alias("pa")), nodes.select(F.col("node").alias("b"), F.col("print").alias("pb"))
    apart = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    close = stage(pairs.join(left, "a").join(right, "b").where(apart <= how.most(64 * lanes, 3)).select("a", "b"))
    ends = close.select(F.col("a").alias("end")).union(close.select("b")).distinct()
    named = rows.mapInArrow(_naming("text", ["id", "text"], "node"), f"id {id_type}, text string, node long").select("node", "text")

    def sets(batches):
        for batch in text_slices(batches, "text"):
            found = [np.unique(_shingle_hashes(w, shingle)).view(np.int64) if w else [] for w in map(_words, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "set"])

    found = named.join(ends, F.col("node") == F.col("end"), "left_semi").mapInArrow(sets, "node long, set array<long>")
    found = stage(found.groupBy("node").agg(F.first("set").alias("set")))
    left, right = found.select(F.col("node").alias("a"), F.col("set").alias("sa")), found.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    wide = close.join(left, "a").join(right, "b").where(both >= how.similarity * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    roots = components(wide.unionByName(within_radius(nodes)))
    placed = nodes.select("node", "first", "n").join(roots.withColumnRenamed("fp", "node"), "node", "left")
    return stage(placed.withColumn("root", F.coalesce("root", "node")))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.9) -> DataFrame:
    """The rows without near copies: of each group of similar texts (see ``similar``) one row stays.

    It is the one with the least id; rows without an id come last. Of rows that agree in
    id and, up to case and spaces, in text, the one with the least hash over all columns
    stays. Rows that share an id but not a text are texts of their own, and so are rows
    without an id. Null and empty texts are one group. ``df`` is read three times: stage
    it. An empty table stays empty; columns stay whatever their names.
    """
    groups = similar(df, Wide.of(df.count(), similarity, recall), id_col, text_col, shingle)
    order = F.struct(F.col("first").isNull().alias("no_id"), "first", "node")
    keep = groups.groupBy("root").agg(F.min_by(F.struct("node", "first", "n"), order).alias("k")).select("k.*")
    node, known, first, n = free_name(df.columns, "node", "known", "first", "n")
    own = df.columns
    named = df.mapInArrow(_naming(text_col, own, node), extended(df, (node, "long")))
    keep = keep.select(F.col("node").alias(known), F.col("first").alias(first), F.col("n").alias(n))
    kept = named.join(keep, (F.col(node) == F.col(known)) & F.col(id_col).eqNullSafe(F.col(first)))
    row = F.struct(*(F.col(f"`{c}`") for c in own))
    twice = kept.where(F.col(n) > 1).groupBy(node).agg(F.min_by(row, F.xxhash64(*(F.col(f"`{c}`") for c in own))).alias("row")).select("row.*")
    return kept.where(F.col(n) == 1).select(*own).unionByName(twice)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(stage(with_fingerprints(docs).drop("text")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
