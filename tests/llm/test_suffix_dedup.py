import hashlib
import random

import pytest
from helpers import awkward, empty, words

from corpusrisk.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for d, t in rows:
        o, b = (sd.NO_ID if d is None else d), (t or "").encode()
        for s in range(len(b) - 49):
            first[b[s : s + 50]] = min(o, first.get(b[s : s + 50], o))
    out = []
    for d, t in rows:
        o, b = (sd.NO_ID if d is None else d), (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < o:
                gone[s : s + 50] = b"\1" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d is None, d or 0, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def check(df, **kw):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.suffix_dedup(df, **kw).collect())
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    assert got == want
    return want


def corpus():
    rnd, w = random.Random(5), words(5)
    base = [" ".join(rnd.choice(w) for _ in range(rnd.randrange(0, 120))) for _ in range(25)]
    rows = []
    for _ in range(90):
        t = rnd.choice(base).split(" ")
        for _ in range(rnd.randrange(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(w)
        rows.append((rnd.randrange(150), " ".join(t)))
    rows += [(300, "a" * 400), (301, "a" * 300), (302, "ab" * 200), (5, "ab" * 100), (7, "x" * 49), (8, "x" * 49), (9, "y" * 50), (10, "y" * 50)]
    return rows + [(400, "Çch " * 100), (401, "Çch " * 80 + "zz" * 40), (None, base[0]), (None, base[0])]


@pytest.mark.parametrize("hot", [100_000, 2])
def test_brute_force(spark, hot):
    want = check(spark.createDataFrame(corpus(), "doc_id long, text string"), hot=hot)
    assert sum(x[3] for x in want) > 1000


def test_texts_longer_than_a_segment(spark, monkeypatch):
    w = words(8, 500, "abcdefghijklm")
    rnd = random.Random(9)
    body = " ".join(rnd.choice(w) for _ in range(1500))
    raw = [(body + " tail").encode(), body[900:4000].encode(), b"z" * 3000]
    segs = lambda n: [(i, s, k) for g in sd.segments(n) for i, s, k in g]
    monkeypatch.setattr(sd, "SEGMENT", 700)
    import numpy as np

    parts = segs(np.array([len(r) for r in raw]))
    for i, r in enumerate(raw):  # every window lies in exactly one part
        starts = sorted(x for j, s, k in parts if j == i for x in range(s, s + k - 49))
        assert starts == list(range(len(r) - 49))


def test_awkward_rows_and_empty_table(spark):
    check(awkward(spark))
    assert sd.suffix_dedup(empty(spark)).collect() == []


def test_texts_are_cut_at_whole_characters(spark):
    rows = [(1, "é" * 60 + "abc", 63), (2, "x" + "é" * 50 + "end", 54), (3, None, None), (4, "short", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in sd.without_repeats(df, length_col="n_chars").collect()}
    assert got == {1: ("é" * 60 + "abc", 63), 2: ("xend", 4), 3: (None, None), 4: ("short", 5)}
    assert sd.kept_text("aéb", []) == "aéb"
    assert sd.whole_characters("aéb".encode(), 2, 4) == (3, 4) and sd.whole_characters("aéb".encode(), 0, 2) == (0, 1)
    clash = awkward(spark)
    assert sd.without_repeats(clash, length_col="n_chars").columns == clash.columns


def test_ranges_are_even_although_smallest_identifiers_are_small():
    import numpy as np

    least = np.random.default_rng(0).integers(0, 1 << 63, size=(40_000, 35), dtype=np.uint64).min(1)
    for ranges in (5, 91):
        count = np.bincount(sd._range_of(least, ranges), minlength=ranges)
        assert count.max() < 1.3 * 40_000 / ranges
