from __future__ import annotations

import hashlib

import pytest

from quire.llm import mixing


def brute(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Targets by resharing the excess round after round; rows taken one word after another."""
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in sources}
    weight = {s: weights[k % 3] for k, s in enumerate(sources)}
    left, open_, target = share * sum(size.values()), set(sources), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * size[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    out = []
    for s in sources:
        rows = sorted((d for d in docs if d[1] == s), key=lambda d: (hashlib.md5(f"mix-1:{'null' if d[0] is None else d[0]}".encode()).hexdigest(), d[2]))
        budget = int(target[s] + 1e-9)
        got = [0] * len(rows)
        while budget and size[s]:
            for k, d in enumerate(rows):
                take = min(d[2], budget)
                got[k] += take
                budget -= take
        out += [(d[0], d[2], round(target[s], 6), g) for d, g in zip(rows, got, strict=True)]
    return sorted(out, key=str)


CASES = [
    [(k, f"s{k % 5}", 10 + 7 * k % 40) for k in range(60)],
    [(k, "hot" if k % 3 else f"s{k % 7}", (k * 37) % 90) for k in range(80)],
    [(1, None, 5), (2, None, 0), (None, "a", 9), (None, "a", 9), (4, "b", 1), (4, "b", 1), (5, "", 3)],
    [(1, "a", 0), (2, "b", 0)],
    [(k, "one", 11) for k in range(5)],
]


@pytest.mark.parametrize("docs", CASES)
def test_mix_matches_brute_force(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, source string, size long").repartition(3)
    got = mixing.mix(df).collect()
    assert sorted(((r.doc_id, r["size"], round(r.target, 6), r.taken) for r in got), key=str) == brute(docs)
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_repeat_takes_whole_documents(spark):
    df = spark.createDataFrame([(1, "a", 10, 25), (2, "a", 10, 4), (3, "a", 10, 5), (4, "a", 0, 0)], "doc_id long, source string, size long, taken long")
    assert sorted(r.doc_id for r in mixing.repeat(df).collect()) == [1, 1, 1, 3, 4]


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, source string, size long, target string, taken string")
    out = mixing.mix(df)
    assert out.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert out.collect() == []
