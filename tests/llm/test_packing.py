import bisect
import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
from helpers import awkward, empty
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from corpusrisk.llm import packing
from corpusrisk.llm.packing import GAP, WordCoder, best_fit_packing, fitted, pack, sequences, successors

PATH = P.path("word_bpe_49k.json")


def best_fit_decreasing(lengths, size):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i < len(gaps):
            g = gaps.pop(i)
        else:
            g, n = size, n + 1
        if g > x:
            bisect.insort(gaps, g - x)
    return n


def check_places(rows, size):
    """Gapless sequences of at most ``size``; returns their number."""
    placed = collections.defaultdict(list)
    for seq, offset, n in rows:
        placed[seq].append((offset, n))
    for parts in placed.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= size
    return len(placed)


def test_runs_equal_best_fit_decreasing():
    rnd = random.Random(2)
    for _ in range(150):
        size = rnd.choice([5, 10, 64, 2048])
        lengths = sorted((rnd.randint(1, size) for _ in range(rnd.randrange(0, 300))), reverse=True)
        count, claims, rank = collections.Counter(lengths), [], 0
        for x in sorted(count, reverse=True):
            claims.append((x, rank, count[x]))
            rank += count[x]
        matched, left, _, opened = fitted(claims, [], size)
        assert not left and sorted(r for m in matched for r in range(m[0], m[0] + m[1])) == list(range(len(lengths)))
        assert all(lengths[m[0] + k] == m[2] for m in matched for k in range(m[1]))
        rows = [(m[3] + k // m[4], size - m[5] + k % m[4] * m[2], m[2]) for m in matched for k in range(m[1])]
        assert check_places(rows, size) == opened == best_fit_decreasing(lengths, size)


def test_conflicts_go_by_rank_and_what_is_left_waits():
    matched, left, gaps, opened = fitted([(9, 0, 1), (7, 1, 3), (4, 4, 1)], [(10, 5, 2)])
    assert matched == [(0, 1, 9, 5, 1, 10), (1, 1, 7, 6, 1, 10)] and left == [(7, 2, 2), (4, 4, 1)]
    assert sorted(gaps) == [(1, 5, 1), (3, 6, 1)] and opened == 0


def test_successors_over_range_borders(spark):
    rnd = random.Random(3)
    sizes = rnd.sample(range(1, 200), 60)
    rows = [(GAP if k % 3 == 0 else 0, s, 0, 1, None, None, None) for k, s in enumerate(sizes)]
    state = spark.createDataFrame(rows, packing._RUN_SQL)
    gaps = sorted(s for k, s, *_ in rows if k == GAP)
    for r in successors(state, 200).collect():
        i = bisect.bisect_left(gaps, r["size"])
        assert r["successor"] == (gaps[i] if i < len(gaps) else 201)


def test_rounds_equal_best_fit_decreasing(spark):
    rnd = random.Random(5)
    for size, n, most in ((64, 400, 64), (64, 300, 20), (2048, 300, 2048), (7, 50, 7)):
        lengths = [rnd.randint(1, most) for _ in range(n)]
        pieces = spark.createDataFrame([(i % 90, i, x) for i, x in enumerate(lengths)], "doc_id long, piece int, length long")
        got = pack(pieces, size).collect()
        assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == sorted((i % 90, i, x) for i, x in enumerate(lengths))
        assert check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], size) == best_fit_decreasing(lengths, size)


def test_hot_length(spark):
    pieces = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 > 0, 700).otherwise(F.col("id") % 2048 + 1).cast("long").alias("length"))
    got = [(r["sequence_id"], r["offset"], r["length"]) for r in pack(pieces).collect()]
    assert len(got) == 20_000 and check_places(got, 2048) == best_fit_decreasing([n for _, _, n in got], 2048)


def test_two_generations_of_words(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 2000)
    coder, public = WordCoder(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(6)
    for _ in range(12):
        texts = [" ".join(rnd.choice(["the", "of", "word%d" % rnd.randrange(300), "é" * rnd.randrange(1, 9) + "."]) for _ in range(40)) for _ in range(3)]
        assert coder.encode_many([t.encode() for t in texts]) == [np.array(public.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert len(coder.known) < 400 and len(coder.old) < 400


def test_words_one_by_one_equal_whole_texts():
    coder, public = WordCoder(PATH), Tokenizer.from_file(PATH)
    rnd = random.Random(4)
    texts = ["", "  \n\n x", "It's IT'S they'll", "a" * 300, "Été, été. İx ªº!", "<|endoftext|> a", "a <|endoftext|> b<|startoftext|>c", "<|ENDOFTEXT|>", "日本語" * 9, "x\x1cy\x85z\xa0q r", "é ́a", "(a) b), c?! d;: .", "0123456789"]
    texts += ["".join(chr(rnd.randrange(1, 0x2FFF)) for _ in range(2000)), "".join(rnd.choice("abCéß.,;!'\" \n") for _ in range(3000))]
    assert coder.encode_many([t.encode() for t in texts]) == [np.array(public.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_plain_words_are_remembered_by_their_letters():
    coder, public = WordCoder(PATH), Tokenizer.from_file(PATH)
    texts = ["Wording wording. WORDING, wording%%%", " wording;*** \n", "", "wording's wording"]
    want = [np.array(public.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert coder.encode_many([t.encode() for t in texts]) == want
    assert {k for k in coder.known if k} == {"wording", "wording's"}
    assert coder.encode_many([]) == [] and coder.encode_many([b""]) == [b""]


def test_operator(spark):
    df, size = awkward(spark), 64
    public = Tokenizer.from_file(PATH)
    got = best_fit_packing(df, PATH, size, with_ids=True).collect()
    want = []
    for r in df.collect():
        ids = np.array([*public.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        want += [(r.doc_id is None, r.doc_id or 0, n, s, len(p := ids[4 * s : 4 * (s + size)]) // 4, zlib.crc32(p), p) for n, s in enumerate(range(0, len(ids) // 4, size))]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= size
    assert len(by_sequence) == best_fit_decreasing([w[4] for w in want], size)
    whole = {r.sequence_id: r for r in sequences(best_fit_packing(df, PATH, size, with_ids=True)).collect()}
    assert all(len(bytes(r.ids)) == 4 * r.n_tokens for r in whole.values()) and len(whole) == len(by_sequence)


def test_empty_table(spark):
    assert best_fit_packing(empty(spark), PATH).collect() == []
