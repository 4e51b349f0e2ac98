"""Token arrays to ids without exploding them: one pass over the documents, no shuffle.

The vocabulary is shared with the tasks only when its bytes, measured first, are few; a larger one takes
the join of :func:`corpusrisk.operators.vocab.lookup_ids`.  A task goes through an Arrow batch in slices of
rows, so that what it holds besides the batch does not grow with the rows of a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.operators import vocab as vo
from corpusrisk.session import BROADCAST_BYTES, pin


SLICE = 1 << 18  # elements gone through at a time, unless one row has more


def _edges(lists: pa.Array) -> np.ndarray:
    """Where each row's elements start among all, and where the last one's end; a null row has none."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _ranges(edges: np.ndarray, most: int = SLICE):
    """Neighbouring rows (from, to) of at most ``most`` elements, or one row."""
    lo, n = 0, len(edges) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + most, side="right")) - 1)
        yield lo, hi
        lo = hi


def _shared(vocab: DataFrame, max_bytes: int):
    """The vocabulary as Arrow arrays in a broadcast variable, or None where it is too large."""
    size = vocab.agg(F.sum(F.octet_length("token") + 16)).first()[0] or 0
    if size > max_bytes:
        return None
    rows = vocab.select("token", F.col("id").cast("long").alias("id")).toArrow()
    return vocab.sparkSession.sparkContext.broadcast((rows.column(0).combine_chunks(), rows.column(1).combine_chunks().to_numpy()))


def _found(flat: pa.Array, tokens: pa.Array, ids: np.ndarray, unk: int) -> np.ndarray:
    """Ids of tokens by position, ``unk`` for those the vocabulary lacks."""
    if not len(ids):
        return np.full(len(flat), unk, dtype=np.int64)
    at = pc.fill_null(pc.index_in(flat.cast(tokens.type), value_set=tokens), -1).to_numpy(zero_copy_only=False)
    return np.where(at >= 0, ids[at], unk)


def token_ids(df: DataFrame, tokens: str, vocab: DataFrame, unk: int, out: str = "ids", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``jn_vocab`` on arrays: ``df`` with its token array replaced by ``out``, the ids in order; tokens that
    the vocabulary ``(token, id)`` lacks are ``unk``, a null array stays null."""
    shared = _shared(vocab, max_bytes)
    keep = [c for c in df.columns if c != tokens]
    if shared is None:
        return _joined(df, tokens, vocab, unk, out)

    def run(batches):
        known, ids = shared.value
        for batch in batches:
            lists = batch.column(len(keep))
            edges, missing = _edges(lists), ~lists.is_valid().to_numpy(zero_copy_only=False)
            # only a batch's different tokens are looked up
            coded = lists.flatten().dictionary_encode(null_encoding="encode")
            found, codes = _found(coded.dictionary, known, ids, unk), coded.indices.to_numpy()
            for lo, hi in _ranges(edges):
                offsets = pa.array((edges[lo : hi + 1] - edges[lo]).astype(np.int32), mask=np.append(missing[lo:hi], False))
                values = pa.ListArray.from_arrays(offsets, pa.array(found[codes[edges[lo] : edges[hi]]]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), values], names=[*keep, out])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*keep, tokens).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"{out} array<long>"]))


def _joined(df: DataFrame, tokens: str, vocab: DataFrame, unk: int, out: str) -> DataFrame:
    rows = pin(df.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", F.posexplode(tokens).alias("pos", "token"))
    ids = vo.regroup(vo.lookup_ids(each, vocab, unk), doc="_row", out=out)
    none = F.when(F.col(tokens).isNotNull(), F.array().cast("array<bigint>"))
    return rows.join(ids, "_row", "left").withColumn(out, F.coalesce(F.col(out), none)).drop("_row", tokens)


def term_counts(df: DataFrame, ids: str, doc: str, ignore: int = -1) -> DataFrame:
    """``agg_doc_terms`` / ``ft_bow``: ``(doc, idx, cnt)`` of each row's ids, counted inside the row; the id
    ``ignore`` (unknown) is left out."""
    kind = df.schema[doc].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            edges, flat = _edges(lists), lists.flatten()
            for lo, hi in _ranges(edges):
                row = np.repeat(np.arange(lo, hi), np.diff(edges[lo : hi + 1]))
                idx = flat.slice(edges[lo], edges[hi] - edges[lo]).to_numpy(zero_copy_only=False)
                order = np.lexsort((idx, row))
                row, idx = row[order], idx[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (idx[1:] != idx[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(row)))
                some = idx[first] != ignore
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first][some])), pa.array(idx[first][some].astype(np.int64)), pa.array(count[some].astype(np.int64))], names=[doc, "idx", "cnt"])

    return df.select(doc, ids).mapInArrow(run, f"{doc} {kind}, idx long, cnt long")
