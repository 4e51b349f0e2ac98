import random
import re

import numpy as np
import xxhash
from helpers import awkward, empty, words

from corpusrisk.llm.components import connected_components
from corpusrisk.llm.simhash import fingerprint, links, simhash_near_dedup


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(values, near):
    """Smallest value reachable over pairs for which ``near`` holds."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint():
    w = words(1)
    for text in ("", " \n", "One", "one TWO", "A b c d", "Été ÉTÉ x y z", " ".join(w * 4)):
        assert fingerprint(text) == plain_fingerprint(text)


def test_links_connect_all_within_three_bits(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(2)]
    prints = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(0, 7))) for b in base for _ in range(250)} | {0, 7, (1 << 64) - 1}
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "fp long")
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    for block in (16, 1024):
        found = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links(df, 3, block).collect()]
        linked = {frozenset(x) for x in found}
        assert classes(prints, lambda a, b: frozenset((a, b)) in linked) == want


def test_the_index_of_variants_is_never_broadcast(spark):
    df = spark.range(100).withColumnRenamed("id", "fp")  # its size is known, and that of its 64 variants a print taken for the same
    plan = links(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_near_copies_form_components(spark):
    rnd = random.Random(5)
    w = words(6, 300)
    bases = [[rnd.choice(w) for _ in range(400)] for _ in range(6)]
    rows = []
    for i in range(90):
        t = list(rnd.choice(bases))
        for _ in range(rnd.randrange(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(w)
        rows.append((rnd.randrange(1000), " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [plain_fingerprint(t) for _, t in rows]
    root = classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), p in zip(rows, prints):
        least[root[p]] = min(d, least.get(root[p], d))
    got = simhash_near_dedup(df, block=8).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{p:016x}", least[root[p]]) for (d, _), p in zip(rows, prints))
    assert sum(r.kept for r in got) == len(least)
    assert any(r.component_size > 1 for r in got)


def test_awkward_rows_and_empty_table(spark):
    df = awkward(spark)
    got = simhash_near_dedup(df).collect()
    assert len(got) == df.count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, None} and {r.component_id for r in zero} == {3} and sum(r.kept for r in zero) == 1
    assert sum(r.kept for r in got if r.doc_id == 2) <= 1
    assert simhash_near_dedup(empty(spark)).collect() == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (5, 5), (200, 200)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, **{300 + i: 300 for i in range(50)}}
