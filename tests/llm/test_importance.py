import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from helpers import awkward, empty

from corpusrisk.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, percent, least, buckets, longest, seed=2024):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d for _, d in docs]), (t, target)):
        for x in texts:
            for f in features(x, longest)[1]:
                counts[crc(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        n, f = features(x, longest)
        weight = sum(gain[crc(g)] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able):
        r.append(k + 1 if k < len(able) * percent // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_equals_brute_force(spark, monkeypatch, longest):
    monkeypatch.setattr(im, "GROUP_BYTES", 300)
    monkeypatch.setattr(im, "LONG_WORD", 12)
    docs = awkward(spark)
    target = spark.createDataFrame([("the QUICK fox-trot naïve",), (None,), ("",), ("x" * 30000 + " brown fox",)], "text string")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [r[0] for r in target.collect()], 50, 3, 97, longest)
    assert got(im.importance_resample(docs, target, 50, 3, 97, longest)) == want
    assert any(r[5] for r in want) and any(r[5] is None for r in want)


def test_empty_tables(spark):
    none = empty(spark)
    assert got(im.importance_resample(none, none.select("text"))) == []
    rows = got(im.importance_resample(awkward(spark), none.select("text"), percent=100))
    assert sum(r[5] is not None for r in rows) == sum(r[1] >= 20 for r in rows)


def test_crc_of_runs_is_composed():
    rnd = np.random.default_rng(1)
    left, right = ([rnd.bytes(int(n)) for n in rnd.integers(0, 300, 200)] for _ in range(2))
    crc = lambda x: np.array([zlib.crc32(b) for b in x], np.uint32)
    made = im.composed(crc(left), crc(right), np.array([len(b) for b in right]))
    assert made.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right)]


def test_words_of_any_length_and_neighbours():
    texts = ["a a a  b-a", "", "A" * 500 + "." + "a" * 500 + " ß \x01 7", "\x010 \x010"]
    words, of, crc = im.feature_crcs([t.encode() for t in texts], 1)
    want = [features(t, 1) for t in texts]
    assert words.tolist() == [w for w, _ in want]
    assert [(i, zlib.crc32(f.encode())) for i, (_, fs) in enumerate(want) for f in fs] == list(zip(of.tolist(), crc.tolist()))
