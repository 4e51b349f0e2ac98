"""Target-distribution importance resampling over hashed word features.

Features are runs of 1 to ``longest`` consecutive words; a feature's bucket is the CRC-32 of its words
joined by one space, modulo the number of buckets.  Words are found by an Aho-Corasick automaton: the
distinct words of a group of texts, each bounded by a delimiter on both sides, are its keys, and each
carries the CRC and the length of the word.  Scanning the group's texts emits these payloads in
order.  The CRC of a run is composed from adjacent payloads - the CRC of ``a b`` from those of ``a``,
of a space and of ``b`` and the length of ``b`` - so no run is ever written out as text.

One scan writes each document's distinct buckets with their numbers.  Buckets are counted over all
documents and over all target texts; a task sends one row per bucket.
A bucket's gain is a floored log-ratio of the two smoothed shares; a document's weight is the floored
mean gain of its features.  Weights with Gumbel noise drawn from the document's id are ranked by a
range sort, and the highest are drawn.

Long texts are scanned in parts that end between words.  Words of more than ``LONG_WORD`` bytes have
a short stand-in in the automaton, so its size is bounded by the text scanned and no word is lost.

Cases: null text has no words (weight 0); a null id draws its noise as the empty string and comes
last among ties; repeated rows are drawn one by one; extra columns are ignored; empty documents or an
empty target give counts of zero, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.llm.common import number_rows, stage

GROUP_BYTES = 1 << 20  # text scanned by one automaton
LONG_WORD = 64
# A-Z become a-z; all other ASCII characters but 0-9 and a-z separate words
_KEPT = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
_LONG = re.compile(rb"[^ ]{%d,}" % (LONG_WORD + 1))


@lru_cache(maxsize=4096)
def _shift_tables(length: int) -> np.ndarray:
    """Four tables of 256: what appending ``length`` bytes makes of each byte of a CRC-32."""
    if length == 0:
        return np.array([[b << 8 * i for b in range(256)] for i in range(4)], dtype=np.uint32)
    if length == 1:
        base = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]  # linear part of one step
        return np.array([base, *([b << 8 * i - 8 for b in range(256)] for i in (1, 2, 3))], dtype=np.uint32)
    half = _shift_tables(length // 2)
    out = shifted_by(half, half)
    return shifted_by(_shift_tables(1), out) if length % 2 else out


def shifted_by(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """CRC-32 values after the zero bytes that ``tables`` stand for."""
    out = tables[0][crc & 255]
    for i in (1, 2, 3):
        out = out ^ tables[i][crc >> np.uint32(8 * i) & 255]
    return out


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings side by side, from those of both and the length of the right one."""
    out = np.empty_like(left)
    order = np.argsort(length, kind="stable")
    lengths, first = np.unique(length[order], return_index=True)
    for n, at in zip(lengths.tolist(), np.split(order, first[1:])):
        out[at] = shifted_by(_shift_tables(n), left[at]) ^ right[at]
    return out


def _parts(text: bytes):
    """Parts of normalised text that end between words."""
    start = 0
    while len(text) - start > GROUP_BYTES:
        end = text.find(b" ", start + GROUP_BYTES)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _scanned(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Payloads of all words of some parts in order: which part, CRC, length."""
    import ahocorasick

    stand_in: dict[bytes, bytes] = {}

    def short(m: re.Match) -> bytes:  # \x01 separates nothing and is in no word
        return stand_in.setdefault(m.group(), b"\x01%d" % len(stand_in))

    if any(len(p) > LONG_WORD for p in parts):
        parts = [_LONG.sub(short, p) for p in parts]
    ends = np.cumsum([len(p) + 2 for p in parts])
    text = b"".join(b" %s " % p for p in parts)
    words = list(set(text.split(b" ")) - {b""})
    if not words:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    real = {v: k for k, v in stand_in.items()}
    whole = [real.get(w, w) for w in words]
    crc, length = np.array([zlib.crc32(w) for w in whole], np.uint32), np.array([len(w) for w in whole], np.int64)
    automaton = ahocorasick.Automaton()
    for i, w in enumerate(words):
        automaton.add_word(f" {w.decode('latin-1')} ", i)
    automaton.make_automaton()
    emitted = np.array(list(automaton.iter(text.decode("latin-1"))), dtype=np.int64).reshape(-1, 2)
    return np.searchsorted(ends, emitted[:, 0], side="right"), crc[emitted[:, 1]], length[emitted[:, 1]]


def feature_crcs(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and of every feature its text and its CRC-32."""
    parts, owner, found, size = [], [], [], 0
    for i, t in enumerate(texts):
        for p in _parts(t.translate(_KEPT)):
            parts.append(p)
            owner.append(i)
            size += len(p)
            if size >= GROUP_BYTES:
                at, crc, length = _scanned(parts)
                found.append((np.array(owner)[at], crc, length))
                parts, owner, size = [], [], 0
    if parts:
        at, crc, length = _scanned(parts)
        found.append((np.array(owner)[at], crc, length))
    doc, crc, length = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))
    runs, run, space = [(doc, crc)], crc, zlib.crc32(b" ")
    for n in range(1, longest):
        run = run[:-1]  # the run of n words that starts at each word but the last
        if not len(run):
            break
        right, size = crc[n:], length[n:]
        spaced = composed(run, np.full(len(run), space, np.uint32), np.ones(len(run), np.int64))
        run = composed(spaced, right, size)
        inside = doc[: len(run)] == doc[n:]
        runs.append((doc[: len(run)][inside], run[inside]))
    of, value = (np.concatenate(c) for c in zip(*runs))
    return np.bincount(doc, minlength=len(texts)), of, value


def _groups(batch: pa.RecordBatch, column: int):
    """(first row, texts as bytes) in groups of about ``GROUP_BYTES``."""
    raw, first, size = [], 0, 0
    for i, t in enumerate(batch.column(column).cast(pa.large_binary())):
        raw.append(t.as_py() or b"")
        size += len(raw[-1])
        if size >= GROUP_BYTES:
            yield first, raw
            raw, first, size = [], i + 1, 0
    if raw:
        yield first, raw


def bucketed(texts: DataFrame, buckets: int, longest: int, id_col: str | None = None, text_col: str = "text") -> DataFrame:
    """One scan of all texts: doc_id, n_words, n_features, and the distinct buckets of the features with
    their numbers, as packed unsigned 32-bit integers.  A row is bounded by the number of buckets."""
    one = texts.select((F.col(id_col) if id_col else F.lit(None).cast("long")).alias("doc_id"), F.col(text_col).alias("text"))
    kind = one.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, raw in _groups(batch, 1):
                words, of, crc = feature_crcs(raw, longest)
                n = np.bincount(of, minlength=len(raw))
                key, count = np.unique(of.astype(np.int64) * buckets + crc % np.uint32(buckets), return_counts=True)
                edges = np.searchsorted(key, np.arange(len(raw) + 1, dtype=np.int64) * buckets)
                packed = ((key % buckets).astype("<u4"), count.astype("<u4"))
                cells = [[c[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])] for c in packed]
                columns = [pa.array(words, pa.int64()), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in cells)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(raw)), *columns], names=["doc_id", "n_words", "n_features", "found", "times"])

    return stage(one.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, found binary, times binary"), "buckets", "zstd")


def bucket_counts(scanned: DataFrame, buckets: int) -> np.ndarray:
    """Occurrences of features by bucket, over all rows; a task and the driver get one row per bucket."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            found, times = (np.frombuffer(b"".join(c.to_pylist()), "<u4") for c in batch.columns)
            total += np.bincount(found, times, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in scanned.select("found", "times").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, unit: int = 1000) -> np.ndarray:
    """Floored ``unit * ln`` of each bucket's smoothed share in the target over that in the source."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(unit * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(seed: int, doc_id, unit: int = 1000) -> int:
    """Floored Gumbel noise from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-unit * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every document."""
    source = bucketed(docs, buckets, longest, id_col, text_col)
    wanted = bucketed(target, buckets, longest, None, target_text)
    gain = gains(bucket_counts(source, buckets), bucket_counts(wanted, buckets))
    kind = source.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            ids, words, n, found, times = batch.columns
            total = np.array([int((gain[np.frombuffer(f, "<u4")] * np.frombuffer(t, "<u4").astype(np.int64)).sum()) for f, t in zip(found.to_pylist(), times.to_pylist())], dtype=np.int64)
            features = n.to_numpy()
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            luck = np.array([noise(seed, i) for i in ids.to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([ids, words, n, pa.array(weight), pa.array(weight + luck)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    scored = stage(source.mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long, score long"), "importance")
    able = scored.filter(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # only the able documents are ranked; the sort is by ranges, the place a partition's offset and its own
    ranked = number_rows(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "importance-rank", "_place")
    ranked = ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_place") < drawn, F.col("_place") + 1).cast("long").alias("rank"))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)
