"""SimHash near-dedup with deletion-variant signatures.

Fingerprint: 64 bits over the XXH64 hashes of word shingles.  Links: fingerprints that differ in at
most ``MAX_BITS`` = 3 bits.  Cut into two segments of 32 bits, one segment of a linked pair differs
by at most one bit (3 = 1 + 2), so the pair shares a variant of that segment with one bit wildcarded.
Distinct fingerprints are indexed under their 64 one-wildcard variants, joined on equal variants
and verified by the distance of the whole fingerprints.

Work on a pair: where the wildcarded bit differs the pair meets in that variant only; where the
segments are equal it would meet in all 32, and only the first counts.  So variants other than the
first compare the two sides of their bit, and are dropped where one side is empty.

Hot variants: the members of a variant are spread by hash over blocks of about ``BLOCK`` and the
blocks are compared in pairs, each pair of blocks a group of its own; a group gives the links of
a spanning forest of what it verified, never all pairs, so components lose no link and output
stays linear.  Copies meet as one fingerprint from the start.

Cases: null and empty texts have no words and fingerprint zero, linked like any other; fewer words
than a shingle: the whole sequence is the shingle; repeated rows have one fingerprint; a null
doc_id is never a component's id unless all are null; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.llm.common import id_text_columns, row_number, shuffle_partitions, stage
from corpusrisk.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BLOCK = 1024
PART = 100_000  # shingles whose bits are counted at a time


def fingerprint(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    cut = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at the six ASCII spaces
    if not cut:
        return 0
    joined = b" ".join(cut)
    ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(cut))
    h = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, dtype=np.int64), len(cut) - k + 1
    a, b = starts[:total].tolist(), ends[k - 1 :].tolist()
    for s in range(0, total, PART):
        hashes = np.array([h(joined[x:y], seed) for x, y in zip(a[s : s + PART], b[s : s + PART])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """rid, doc_id and fp (the fingerprint's bits as a signed long) of each row."""
    one = docs.select(row_number(rid_col), *id_text_columns(id_col, text_col))
    kind = one.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], names=["rid", "doc_id", "fp"])

    return one.mapInArrow(run, f"rid long, doc_id {kind}, fp long")


def variants(prints: DataFrame) -> DataFrame:
    """(key, side, fp) under each of the 64 one-wildcard variants: ``key`` holds the number of the
    variant (segment and bit) and the segment without that bit, ``side`` the bit."""
    segment = F.expr("CASE WHEN k < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END")
    at = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).withColumn("seg", segment).withColumn("bit", F.expr("shiftleft(1L, k % 32)"))
    return at.select(F.expr("shiftleft(CAST(k AS bigint), 32) | (seg & ~bit)").alias("key"), F.expr("seg & bit <> 0").alias("side"), "fp")


def _near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= bits


def _forest(fp: np.ndarray, side: np.ndarray, first: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smallest of its component) among the members of one group."""
    near = _near(fp[:, None], fp[None, :], bits)
    if not first:
        near &= side[:, None] != side[None, :]
    label, n = np.arange(len(fp)), len(fp)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], n).min(1))
        np.minimum.at(low, label, low.copy())  # a member's new label reaches its old centre
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(n)
    return fp[moved], fp[label[moved]]


def links(prints: DataFrame, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect whatever differs in at
    most ``bits`` (0 to 3) bits."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments find distances up to 3")
    index = variants(prints)
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("side").alias("ones"))
    # 32 values of the bit number count as first: one per segment (variants 0 and 32)
    is_first = F.expr("shiftright(key, 32) % 32 = 0")
    sizes = sizes.filter((F.col("n") > 1) & (is_first | ((F.col("ones") > 0) & (F.col("ones") < F.col("n")))))
    sizes = sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # merged: Spark takes the 64 rows of a print for one, so it would broadcast the index of a small table
    dealt = (
        index.hint("merge").join(sizes, "key")
        .withColumn("mine", mine)
        .select("key", "side", "fp", "mine", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "side", "fp")
        .repartition(shuffle_partitions(prints.sparkSession), "key", "lo", "hi")
        .sortWithinPartitions("key", "lo", "hi")
    )

    def verify(frames):
        rest = None
        for pdf in _with_end(frames):
            if pdf is not None:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if rest is None or not len(rest):
                continue
            key, lo, hi = (rest[c].to_numpy() for c in ("key", "lo", "hi"))
            change = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            starts = np.concatenate([[0], change])
            stops = np.concatenate([change, [len(rest)]])
            if pdf is not None:  # the last group may go on in the next batch
                starts, stops = starts[:-1], stops[:-1]
            fp, side = rest["fp"].to_numpy().view(np.uint64), rest["side"].to_numpy()
            first = (key >> 32) % 32 == 0
            out = []
            two = starts[stops - starts == 2]
            ok = _near(fp[two], fp[two + 1], bits) & (first[two] | (side[two] != side[two + 1]))
            out.append((fp[two[ok]], fp[two[ok] + 1]))
            for s, e in zip(starts.tolist(), stops.tolist()):
                if e - s > 2:
                    out.append(_forest(fp[s:e], side[s:e], bool(first[s]), bits))
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
            if len(a):
                yield pd.DataFrame({"a": a, "b": b})
            rest = rest.iloc[stops[-1] if len(stops) else 0 :].reset_index(drop=True) if pdf is not None else None

    return dealt.mapInPandas(verify, "a long, b long")


def _with_end(frames):
    yield from frames
    yield None


def simhash_near_dedup(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """rid (the row number in ``rid_col``, or one of a single scan), doc_id, fingerprint (16 lowercase hex digits),
    component_id (smallest doc_id reachable over links), component_size and kept (one row of each
    component: the smallest doc_id, null ids last, the first of repeated rows)."""
    rows = stage(fingerprints(docs, words, id_col, text_col, rid_col), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    prints = stage(rows.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    found = connected_components(links(prints.select("fp"), bits, block)).withColumnRenamed("node", "fp")
    rooted = stage(prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    classes = rooted.groupBy("root").agg(F.min("first").alias("top"), F.sum("n").alias("component_size"))
    by_print = rooted.select("fp", "root").join(classes, "root").drop("root")
    return rows.join(by_print, "fp").select(
        "rid",
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("top.doc_id").alias("component_id"),
        "component_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"),
    )
