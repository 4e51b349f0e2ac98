import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusrisk.llm import hard_negatives as hn


def brute(rows, positives=5, negatives=10, band=(30, 90), scale=256):
    """Anchors one by one, by the words of the contract."""
    ok = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(scale * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, v, label in ok:
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, m) for j, w, m in ok if j != i)
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            near = [x for x in scored if x[2] != label and band[0] * -s <= 100 * -x[0] <= band[1] * -s][:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k, _) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash")).withColumn("tile", F.lit("clash"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hn.hard_negatives(df, F.col("vec_id") % 100 == 0, label, **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def made(seed, n, width=8, labels=4):
    rnd = np.random.default_rng(seed)
    centre = rnd.standard_normal(width)
    return [(i, [float(np.float32(x)) for x in rnd.standard_normal(width) * 0.5 + centre * 0.4], int(rnd.integers(labels))) for i in range(n)]


def test_equals_brute_force_over_several_tiles_and_blocks(spark, monkeypatch):
    rows = made(1, 900)
    monkeypatch.setattr(hn, "TILE", 4)
    monkeypatch.setattr(hn, "STRIP", 3)
    monkeypatch.setattr(hn, "BLOCK", 100)
    monkeypatch.setattr(hn, "HELD", 50)
    got = run(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_nulls_ties_repeats_and_widths(spark):
    rows = made(2, 300)
    same = rows[5][1]
    rows += [(400 + i, same, 3) for i in range(60)]  # ties: one common vector
    rows += [(None, same, 1), (500, None, 1), (600, same, None), (700, [1.0, None], 1), (800, [float("nan")] * 8, 2), (900, [float("inf")] * 8, 2), (1000, [], 2), (1100, [0.5, 0.5], 1)]
    assert run(spark, rows) == brute(rows)


def test_repeated_anchor_is_answered_each_time(spark):
    rows = made(3, 250)
    once, twice = run(spark, rows), run(spark, rows + [rows[200]])
    pick = lambda found: [r for r in found if r[0] == 200]
    assert len(pick(twice)) == 2 * len(pick(once)) > 0


def test_empty_table(spark):
    assert run(spark, []) == []


def test_scores_are_exact_at_any_size():
    rnd = np.random.default_rng(5)
    for top, width in ((3, 5), (2000, 1500), (2**22, 2100)):
        a, b = (rnd.integers(-top, top + 1, (7, width)) for _ in range(2))
        bound = math.sqrt(float((a.astype(float) ** 2).sum(axis=1).max()) * float((b.astype(float) ** 2).sum(axis=1).max()))
        primes = hn.primes_for(bound)
        got = hn.exact_scores([hn.balanced(a, p) for p in primes], [hn.balanced(b, p) for p in primes], primes)
        assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


def test_scores_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="do not fit"):
        hn.primes_for(float(2**57))


def test_best_cells_against_sorting():
    rnd = random.Random(4)
    scores = np.array([[rnd.randrange(4) for _ in range(30)] for _ in range(50)])
    allowed = np.array([[rnd.random() < 0.6 for _ in range(30)] for _ in range(50)])
    x, y = hn.best_cells(scores, allowed, 5)
    for i in range(50):
        want = sorted(sorted((j for j in range(30) if allowed[i, j]), key=lambda j: (-scores[i, j], j))[:5])
        assert y[x == i].tolist() == want
