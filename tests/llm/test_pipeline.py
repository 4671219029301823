from __future__ import annotations

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as pipeline
from quire.llm import simhash
from quire.llm.common import stage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + min(k, len(words))]) for i in range(len(words) - min(k, len(words)) + 1)) if words else frozenset()


def groups(sets, least):
    """The first id of each document's group, by all pairs."""
    of = {i: i for i in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, j in itertools.combinations(sorted(sets, key=str), 2):
        a, b = sets[i], sets[j]
        if a == b or min(len(a), len(b)) >= least * max(len(a), len(b)) and len(a & b) >= least * len(a | b):
            of[find(j)] = find(i)
    return {i: find(i) for i in sets}


def repeated_passages(rows, least=50):
    """Runs of whole lines of that many words that two documents have, by all pairs of lines."""
    where = {}
    for r in rows:
        for line in set((r.text or "").split("\n")):
            if len(line.split()) >= least:
                where.setdefault(line, set()).add(r.doc_id)
    return [line for line, ids in where.items() if len(ids) > 1]


NEAR = "doc_id long, text string, __node string, n int"


def near_rows():
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(n)]
    rows, base = [], words(300)
    for k in range(40):  # a crowd of near copies, each with one word changed
        own = list(base)
        own[rng.randrange(300)] = f"changed{k}"
        rows.append((100 + k, " ".join(own)))
    rows += [(50 + k, " ".join(words(200))) for k in range(20)] + [(30, "one two"), (31, "One  two\n"), (32, "one two three"), (33, None), (34, ""), (35, " \n ")]
    rows += [(7, "same id " + " ".join(words(30))), (7, "same id " + " ".join(words(30)))] + [(None, " ".join(words(40))) for _ in range(3)] + [(None, " ".join(base))]
    rows += [(8, "twice in all columns"), (8, "twice in all columns"), (None, "no id twice"), (None, "no id twice"), (9, "long " + " ".join(words(30000)))]
    rng.shuffle(rows)
    return [(*r, "own", 5) for r in rows]


def test_near_copies_match_brute_force(spark):
    """Rows without an id and rows that share one are documents of their own; columns of the same names stay."""
    rows = near_rows()
    df = spark.createDataFrame(rows, NEAR)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    sets = {k: shingles(r[1]) for k, r in enumerate(rows)}
    group = groups(sets, 0.8)
    want = []
    for g in set(group.values()):
        members = [rows[k] for k in sets if group[k] == g]
        least = min(((r[0] is None, r[0] or 0) for r in members))
        want.append((g, least))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want)
    assert sorted((r[0] is None, r[0] or 0) for r in found) == sorted(least for _, least in want)
    assert {sets[k] for k in sets if rows[k] in found} >= {shingles(r[1]) for r in found} and all(r in rows for r in found)
    assert simhash.one_of_each(df.limit(0)).collect() == []


def test_fingerprints_within_two_bits_are_one_group(spark):
    """Links of the fingerprints hold whatever the wide partitions find; here one of 60 bits is all they have."""
    rng = random.Random(6)
    rows = []
    for k in range(0, 80, 2):
        own = ["".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(1500)]
        rows += [(k, " ".join(own)), (k + 1, " ".join([*own[:700], f"changed{k}", *own[701:]]))]
    how = simhash.Wide(60, 1, 0.15, 0.8)
    prints = [int(simhash.wide_fingerprint(simhash._words(t), 5, how.lanes)[-1]) for _, t in rows]
    root = {r.first: r.root for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()}
    near = [(i, j) for i, j in itertools.combinations(range(80), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert len(near) > 20
    assert all(root[i] == root[j] for i, j in near)


def test_ids_that_are_null_or_repeat_lose_nothing(spark):
    """Seven unlike texts, five without an id and one id twice, stay seven."""
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30)), "en", "s", 1) for i in (None, None, None, None, None, 3, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.text for r in pipeline.drop_near_copies(spark, docs, SF).collect()) == sorted(r[1] for r in rows)


def test_long_buckets_are_read_in_any_batches():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 4).astype(np.uint64)
    check = base[rng.integers(0, 4, 5000)] ^ (np.uint64(1) << rng.integers(0, 62, 5000).astype(np.uint64))
    slot = np.sort(np.where(rng.random(5000) < 0.5, 7, rng.integers(8, 900, 5000)))
    frame = pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(np.arange(5000)), pa.array(check.view(np.int64))], ["slot", "node", "check"])
    roots = []
    for size in (5000, 100, 7):
        batches = (frame.slice(at, size) for at in range(0, 5000, size))
        of = list(range(5000))

        def find(x):
            while of[x] != x:
                x = of[x]
            return x

        for found in simhash.bucket_pairs(batches, 2):
            for a, b in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
                assert slot[a] == slot[b] and int(check[a] ^ check[b]).bit_count() <= 2
                of[find(b)] = find(a)
        roots.append([find(k) for k in range(5000)])
    near = {k: (int(slot[k]), min(range(4), key=lambda j: int(check[k] ^ base[j]).bit_count())) for k in range(5000)}
    for found in roots:
        assert len(set(found)) == len(set(near.values())) == len({(near[k], found[k]) for k in range(5000)})


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, apply in pipeline.STAGES:
        before = docs.collect()
        docs = stage(apply(spark, docs, SF))
        seen[name] = (before, docs.collect())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone and sum(marks.get(i, 1) for i in gone) >= 0.5 * len(gone)
    assert sum(marks.get(r.doc_id) == 0 for r in after) >= 0.95 * sum(v == 0 for v in marks.values())
    before, after = seen["line_dedup"]
    texts = {r.doc_id: r.text for r in after}
    assert all(t is None or len(t) <= len(next(r.text for r in before if r.doc_id == i)) for i, t in texts.items())
    assert not repeated_passages(after)
    before, after = seen["simhash"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    kept = {r.doc_id for r in after}
    assert len(kept) == len(after)
    group = groups(sets, 0.8)
    assert all(any(group[j] == group[i] for j in kept) for i in sets)  # whatever goes has a near copy, or one of a near copy, that stays
    assert sum(len({i for i in kept if group[i] == g}) - 1 for g in set(group.values())) <= 0.1 * (len(sets) - len(set(group.values())))
    before, after = seen["mixing"]
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) < 0.1 * words(before)
    before, after = seen["sentencepiece"]
    assert len(before) == len(after) and all(r.round_trip and r.n_tokens == len(r.ids) for r in after)
