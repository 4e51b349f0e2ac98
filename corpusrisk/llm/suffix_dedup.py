"""Removal of byte strings that an earlier document already has, by bucket-pointer refinement.

A string of ``SPAN`` = 50 bytes is named by buckets.  The identifier of a string's bucket comes
from the identifiers of its parts, one at its start and one at a later offset, and these in turn
from theirs (1, 2, 4, 8, 16, 32 and then 50 bytes): the updates are reused recursively, and one
pass over a text gives the identifiers of all its positions.

1. Initial buckets.  Every 50-byte string is put under the smallest identifier of the 16-byte
   strings in it, so that equal strings meet under equal identifiers while neighbouring strings
   share one (about one identifier per 19 bytes is sent).  Buckets that one document fills alone
   are settled: nothing in them repeats.
2. Refinement.  Of the live buckets, the maximal runs of strings are sent with their bytes, sorted
   by bucket, and refined by the identifiers at later offsets up to 50 bytes.  Each string then
   knows the smallest doc_id that has it.
3. A string is repeated where that doc_id is smaller than its own; the bytes covered by repeated
   strings go.

Skew.  Identifiers are exchanged in ranges, as packed arrays; the copies of a run that one task
holds are sent once, with the smallest doc_id, and the others are settled there.  A bucket with
very many members (``HOT`` groups of documents) is dealt one refinement deeper from the start, by
the identifier of each 50-byte string instead of the bucket's.  A range is as large as
``RANGE_ENTRIES`` whatever the input.

Identifiers are 64 bits; two different strings count as equal only if their bucket (initial
identifier) and their 50-byte identifier both agree, 128 bits in all.

Cases: null text is the empty text; a text below 50 bytes keeps everything; a null doc_id counts
as larger than any other; rows with one doc_id are no smaller than one another, so repeated rows
lose only what smaller ids have; extra columns are ignored; an empty table gives an empty result.
Rows are numbered once, in a staged copy that all later steps read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.llm.common import discard, forget_worker_tables, fresh_name, numbered, release_shuffles, row_number, shuffle_partitions, stage

SPAN = 50
GRAM = 16
WINDOW = SPAN - GRAM + 1  # 16-byte strings in a 50-byte string
SEGMENT = 1 << 19  # windows of a text that are taken up at a time
FLUSH = 1 << 19  # bucket identifiers a task gathers before it sends them
FLUSH_BYTES = 16 << 20  # and bytes of runs
CHUNK = 1 << 14  # runs that are refined together (or one bucket, where that has more)
RANGE_ENTRIES = 1_500_000
HOT = 100_000
GROUP_BITS = 4  # live buckets are reported to groups of 16 neighbouring rows
NO_ID = (1 << 63) - 1

_A, _B, _C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def refined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Identifier of a string from the identifiers of its first and its later part."""
    z = x * _A
    z += y * _B
    z ^= z >> np.uint64(31)
    z *= _C
    z ^= z >> np.uint64(28)
    return z


def bucket_ids(data: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Identifiers of the strings of 1, 2, 4 ... bytes at every position, for the wanted lengths."""
    first = refined(np.arange(256, dtype=np.uint64), np.full(256, 7, dtype=np.uint64))
    ids, n, out = first[data], 1, {}
    while True:
        if n in lengths:
            out[n] = ids
        if 2 * n > max(lengths):
            return out
        ids, n = refined(ids[:-n], ids[n:]), 2 * n


def span_ids(data: np.ndarray) -> np.ndarray:
    """Identifiers of the 50-byte strings at every position of ``data`` that has one."""
    g = bucket_ids(data, (2, 16, 32))
    m = len(data) - SPAN + 1
    return refined(refined(g[32][:m], g[16][32 : 32 + m]), g[2][48 : 48 + m])


def least_gram(data: np.ndarray) -> np.ndarray:
    """For every 50-byte string the smallest identifier among its 16-byte strings."""
    low, n = bucket_ids(data, (GRAM,))[GRAM], 1
    while 2 * n <= WINDOW:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    m = len(data) - SPAN + 1
    return np.minimum(low[:m], low[WINDOW - n : WINDOW - n + m])


def segments(lengths: np.ndarray):
    """Groups of (text, first byte, bytes) that hold about ``SEGMENT`` bytes together; a longer text
    is cut into parts that share 49 bytes, so that each window lies in one part."""
    group, total = [], 0
    for i, n in enumerate(lengths.tolist()):
        for s in range(0, n - SPAN + 1, SEGMENT):
            size = min(SEGMENT + SPAN - 1, n - s)
            group.append((i, s, size))
            total += size
            if total >= SEGMENT:
                yield group
                group, total = [], 0
    if group:
        yield group


class Group:
    """The windows of some text segments in one buffer."""

    def __init__(self, parts, data: np.ndarray, offsets: np.ndarray):
        self.text = np.array([p[0] for p in parts])
        self.first = np.array([p[1] for p in parts])
        size = np.array([p[2] for p in parts])
        self.data = np.concatenate([data[offsets[i] + s : offsets[i] + s + n] for i, s, n in parts])
        starts = np.cumsum(size) - size
        windows = size - SPAN + 1
        low = least_gram(self.data)
        self.part = np.repeat(np.arange(len(parts)), windows)
        within = np.arange(len(self.part)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = starts[self.part] + within  # place of each window in the buffer
        self.start = self.first[self.part] + within  # and in its text
        self.low = low[self.at]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Window numbers where runs of one bucket in one part begin and end."""
        change = np.flatnonzero((self.low[1:] != self.low[:-1]) | (self.part[1:] != self.part[:-1])) + 1
        return np.concatenate([[0], change]), np.append(change, len(self.low))


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _range_of(ids: np.ndarray, ranges: int) -> np.ndarray:
    """The range each identifier is sent to.  Smallest identifiers are small numbers, so they are
    mixed once more before the number line is cut into equal parts."""
    return ((refined(ids, ids) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted columns begin a new value."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(len(columns[0]), dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _initial_buckets(ranges: int):
    """(rid, text) batches -> packed (range, ids, groups, several): the buckets each group of rows
    has strings in; ``several`` marks those that more than one of its rows has."""

    def flush(parts):
        ids, group, several = (np.concatenate(x) for x in zip(*parts))
        at = _range_of(ids, ranges)
        order = np.argsort(at, kind="stable")
        ids, group, several, at = ids[order], group[order], several[order], at[order]
        first = _starts(at)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(at)]):
            by = a + np.argsort(group[a:b], kind="stable")  # equal group ids side by side compress well
            yield int(at[a]), ids[by].tobytes(), group[by].tobytes(), several[by].tobytes()

    def run(batches):
        forget_worker_tables()
        parts, held = [], 0
        for batch in batches:
            rid = batch.column(0).to_numpy()
            data, offsets = _buffer(batch.column(1))
            for seg in segments(np.diff(offsets)):
                g = Group(seg, data, offsets)
                begin, _ = g.runs()
                ids, row = g.low[begin], rid[g.text[g.part[begin]]]
                order = np.lexsort((row, ids, row >> GROUP_BITS))
                ids, row = ids[order], row[order]
                group = row >> GROUP_BITS
                first = _starts(group, ids)
                several = np.maximum.reduceat(row, first) != np.minimum.reduceat(row, first)
                parts.append((ids[first], group[first], several))
                held += len(first)
                if held >= FLUSH:
                    yield _table(flush(parts), _BUCKETS)
                    parts, held = [], 0
        if parts:
            yield _table(flush(parts), _BUCKETS)

    return run


_BUCKETS = pa.schema([("r", pa.int64()), ("ids", pa.binary()), ("groups", pa.binary()), ("several", pa.binary())])
_LIVE = pa.schema([("gid", pa.int64()), ("live", pa.binary()), ("hot", pa.binary())])
_RUNS = pa.schema([(c, pa.int64()) for c in ("r", "rid", "lo", "hi")] + [(c, pa.binary()) for c in ("keys", "rids", "ords", "starts", "counts", "data")])
_SPANS = pa.schema([(c, pa.int64()) for c in ("rid", "lo", "hi")])


def _table(rows, schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _by_range(batches, columns: list[str]):
    """Rows of packed arrays, gathered by ``r`` (rows of one range are neighbours)."""
    now, rows = None, []
    for batch in batches:
        for r, *cells in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ["r", *columns])):
            if r != now and rows:
                yield rows
                rows = []
            now = r
            rows.append(cells)
    if rows:
        yield rows


def _array(rows, i: int, kind, packed: bool = False) -> np.ndarray:
    return np.frombuffer(b"".join(zlib.decompress(x[i]) if packed else x[i] for x in rows), kind)


def _live_buckets(hot: int):
    """Packed buckets of a range -> (group, its live buckets, those of them that are hot)."""

    def run(batches):
        for rows in _by_range(batches, ["ids", "groups", "several"]):
            ids, group, several = _array(rows, 0, np.uint64), _array(rows, 1, np.int64), _array(rows, 2, bool)
            order = np.argsort(ids, kind="stable")
            ids, group, several = ids[order], group[order], several[order]
            first = _starts(ids)
            count = np.diff(np.append(first, len(ids)))
            live = np.repeat((count > 1) | np.maximum.reduceat(several, first), count)
            large = np.repeat(count > hot, count)[live]
            ids, group = ids[live], group[live]
            order = np.argsort(group, kind="stable")
            ids, group, large = ids[order], group[order], large[order]
            first = _starts(group)
            out = [(int(group[a]), ids[a:b].tobytes(), ids[a:b][large[a:b]].tobytes()) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ids)])]
            for s in range(0, len(out), 10_000):
                yield _table(out[s : s + 10_000], _LIVE)

    return run


def _among(ids: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(ids), dtype=bool)
    return some[np.minimum(np.searchsorted(some, ids), len(some) - 1)] == ids


def _gathered(data: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several stretches of ``data``, one after another."""
    total = np.cumsum(size)
    return data[np.repeat(place - total + size, size) + np.arange(total[-1] if len(total) else 0)]


def _packed_runs(ranges: int):
    """(rid, ord, text, live, hot) batches -> packed runs of live buckets by range, and settled
    spans (rows with ``rid``): copies of a run that a smaller doc_id has in the same task."""

    def flush(held):
        key, rid, ord_, start, count, data = (np.concatenate(x) for x in zip(*held))
        size = count + SPAN - 1
        place = np.cumsum(size) - size
        raw = data.tobytes()
        digest = np.array([xxhash.xxh3_64_intdigest(raw[a : a + n]) for a, n in zip(place.tolist(), size.tolist())], np.uint64)
        order = np.lexsort((ord_, digest, key))
        first = _starts(key[order], digest[order])
        owner = np.repeat(ord_[order][first], np.diff(np.append(first, len(order))))
        settled = np.zeros(len(order), dtype=bool)
        settled[order] = ord_[order] > owner
        at = _range_of(key, ranges)
        i = np.flatnonzero(settled)
        for r, d, a, n in zip(at[i].tolist(), rid[i].tolist(), start[i].tolist(), count[i].tolist()):
            yield r, d, a, a + n, *[None] * 6
        left = np.flatnonzero(~settled)
        left = left[np.argsort(at[left], kind="stable")]
        first = _starts(at[left])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(left)]):
            i = left[a:b]
            columns = (rid[i], ord_[i], start[i], count[i], _gathered(data, place[i], size[i]))
            yield int(at[i[0]]), None, None, None, key[i].tobytes(), *(zlib.compress(c.tobytes(), 1) for c in columns)

    def send(held):
        rows = []
        for row in flush(held):
            rows.append(row)
            if len(rows) == 5_000:
                yield _table(rows, _RUNS)
                rows = []
        if rows:
            yield _table(rows, _RUNS)

    def run(batches):
        forget_worker_tables()
        held, size = [], 0
        for batch in batches:
            rid, ord_ = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = _buffer(batch.column(2))
            known = lambda c, i: np.sort(np.frombuffer(b"".join(batch.column(c)[i].as_py()), np.uint64))
            for seg in segments(np.diff(offsets)):
                g = Group(seg, data, offsets)
                begin, end = g.runs()
                edges = np.searchsorted(g.part[begin], np.arange(len(seg) + 1))
                ids = g.low[begin]
                keep, large = np.zeros(len(begin), dtype=bool), np.zeros(len(begin), dtype=bool)
                for p, (i, _, _) in enumerate(seg):
                    part = slice(edges[p], edges[p + 1])
                    keep[part] = _among(ids[part], known(3, i))
                    large[part] = keep[part] & _among(ids[part], known(4, i))
                k = np.flatnonzero(keep & ~large)
                if len(k):
                    n, row = end[k] - begin[k], g.text[g.part[begin[k]]]
                    held.append((ids[k], rid[row], ord_[row], g.start[begin[k]], n, _gathered(g.data, g.at[begin[k]], n + SPAN - 1)))
                    size += int((n + 100).sum())
                for j in np.flatnonzero(large).tolist():  # one refinement deeper: a run of one for each string
                    place, n, row = int(g.at[begin[j]]), int(end[j] - begin[j]), g.text[g.part[begin[j]]]
                    text, one = g.data[place : place + n + SPAN - 1], np.ones(n, dtype=np.int64)
                    each = _gathered(text, np.arange(n), one * SPAN)
                    held.append((refined(np.full(n, ids[j]), span_ids(text)), one * rid[row], one * ord_[row], g.start[begin[j]] + np.arange(n), one, each))
                    size += n * 100
                if size >= FLUSH_BYTES:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


def _spans(rid, start, flags, count):
    """Runs of set flags, window by window, as (rid, lo, hi); runs of windows follow one another."""
    owner = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    on = np.flatnonzero(flags)
    if not len(on):
        return []
    new = _starts(owner[on], on - np.arange(len(on)))
    last = np.append(new[1:], len(on)) - 1
    lo, hi = on[new], on[last]
    return [(rid[owner[lo]], start[owner[lo]] + within[lo], start[owner[hi]] + within[hi] + 1)]


def _refine(batches):
    """Packed runs of a range -> repeated spans (rid, lo, hi) of window starts."""
    for rows in _by_range(batches, ["rid", "lo", "hi", "keys", "rids", "ords", "starts", "counts", "data"]):
        done = [x[:3] for x in rows if x[0] is not None]
        if done:
            yield _table(done, _SPANS)
        packed = [x for x in rows if x[0] is None]
        if not packed:
            continue
        key = _array(packed, 3, np.uint64)
        rid, ord_, start, count = (_array(packed, i, np.int64, True) for i in (4, 5, 6, 7))
        data = _array(packed, 8, np.uint8, True)
        size = count + SPAN - 1
        place = np.cumsum(size) - size
        # whole buckets at a time, about ``CHUNK`` runs, so that memory does not follow the range
        order = np.argsort(key, kind="stable")
        first = _starts(key[order])
        cut = first[np.searchsorted(first, np.arange(0, len(order), CHUNK))[1:] - 1] if len(order) > CHUNK else first[:0]
        for i in np.split(order, np.unique(cut[cut > 0])):
            yield from _refine_buckets(key[i], rid[i], ord_[i], start[i], count[i], place[i], size[i], data)


def _refine_buckets(key, rid, ord_, start, count, place, size, data):
    """Repeated spans among the runs of some buckets; the bytes of run ``i`` are at ``place[i]``."""
    view = memoryview(data)
    digest = np.array([xxhash.xxh3_64_intdigest(view[a : a + n]) for a, n in zip(place.tolist(), size.tolist())], np.uint64)
    # equal runs are one from here on, under the smallest doc_id
    order = np.lexsort((ord_, digest, key))
    first = _starts(key[order], digest[order])
    of = np.empty(len(order), dtype=np.int64)
    of[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    one = order[first]
    whole = ord_ > ord_[one][of]  # a smaller doc_id has the whole run
    if whole.any():
        yield pa.RecordBatch.from_arrays([pa.array(rid[whole]), pa.array(start[whole]), pa.array(start[whole] + count[whole])], schema=_SPANS)
    # buckets of more than one distinct run are refined; ``one`` is sorted by bucket
    fresh = _starts(key[one])
    bucket = np.repeat(np.arange(len(fresh)), np.diff(np.append(fresh, len(one))))
    shared = np.bincount(bucket, minlength=len(fresh))[bucket] > 1
    runs, bucket = one[shared], bucket[shared]
    if not len(runs):
        return
    n = count[runs]
    buf = _gathered(data, place[runs], size[runs])
    begin = np.cumsum(n + SPAN - 1) - (n + SPAN - 1)
    owner = np.repeat(np.arange(len(runs)), n)
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    ids = span_ids(buf)[at]
    order = np.lexsort((ids, bucket[owner]))
    first = _starts(bucket[owner][order], ids[order])
    least = np.minimum.reduceat(ord_[runs][owner][order], first)
    flags = np.empty(len(owner), dtype=bool)
    flags[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < ord_[runs][owner][order]
    # every member that is not wholly repeated has the smallest doc_id of its run: same flags
    number = np.full(len(one), -1)
    number[shared] = np.arange(len(runs))
    member = np.flatnonzero(~whole & (number[of] >= 0))
    lo = np.cumsum(n) - n
    mine = number[of[member]]
    for r, a, b in _spans(rid[member], start[member], _gathered(flags, lo[mine], n[mine]), count[member]):
        yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(a), pa.array(b)], schema=_SPANS)


def repeated_spans(rows: DataFrame, hot: int = HOT) -> DataFrame:
    """``rows``: (rid, ord, text).  Returns (rid, spans): the starts of repeated 50-byte strings as
    half-open ranges, for texts that have any."""
    spark = rows.sparkSession
    n = shuffle_partitions(spark)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one identifier per 19 bytes is exchanged
    ranges = max(1, total // (19 * RANGE_ENTRIES))
    gid = F.shiftright("rid", GROUP_BITS).alias("gid")
    kinds = lambda schema: ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'long'}" for f in schema)
    buckets = rows.select("rid", "text").mapInArrow(_initial_buckets(ranges), kinds(_BUCKETS))
    live = stage(buckets.repartition(n, "r").sortWithinPartitions("r").mapInArrow(_live_buckets(hot), kinds(_LIVE)), "live-buckets")
    release_shuffles(spark)
    by_group = live.groupBy("gid").agg(F.collect_list("live").alias("live"), F.collect_list("hot").alias("hot"))  # of 16 texts
    there = rows.select("rid", "ord", "text", gid).join(by_group, "gid").select("rid", "ord", "text", "live", "hot")
    runs = there.mapInArrow(_packed_runs(ranges), kinds(_RUNS))
    spans = stage(runs.repartition(n, "r").sortWithinPartitions("r").mapInArrow(_refine, kinds(_SPANS)), "repeated-spans")
    discard(live)
    del buckets, live, by_group, there, runs
    release_shuffles(spark)
    return spans.groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # of one text


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges covered by strings that start in ``spans``, merged where they touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + SPAN - 1)
        else:
            out.append([lo, hi + SPAN - 1])
    return [(a, b) for a, b in out]


def whole_characters(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The characters that lie wholly within bytes ``a`` to ``b`` of UTF-8 text."""
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _ordered(docs: DataFrame, id_col: str, text_col: str, rid_col: str | None = None) -> DataFrame:
    return docs.select(
        row_number(rid_col),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("ord"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def suffix_dedup(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: rid (its number), doc_id, n_bytes, n_removed, n_spans, kept_sha256
    and removed (list of byte ranges)."""
    rows = stage(_ordered(docs, id_col, text_col), "numbered", "zstd")
    spans = repeated_spans(rows.select("rid", "ord", "text"), hot)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            out = []
            for text, some in zip(batch.column(2).cast(pa.binary()), batch.column(3).to_pylist()):
                raw = text.as_py()
                gone = covered([(s["lo"], s["hi"]) for s in some]) if some else []
                edges = [0, *(x for g in gone for x in g), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [{"a": a, "b": b} for a, b in gone]))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
            )

    return rows.select("rid", "doc_id", "text").join(spans, "rid", "left").select("rid", "doc_id", "text", "spans").mapInArrow(
        cut, f"rid long, doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<a:long,b:long>>"
    )


def kept_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the characters that lie wholly in the removed byte ranges (one that an edge
    cuts stays: the rest of it would be no text)."""
    raw = text.encode()
    edges = [0, *(x for a, b in covered(spans) for x in whole_characters(raw, a, b)), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()


def without_repeats(docs: DataFrame, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all its rows and columns, repeated strings cut out of the texts (and the length in
    characters counted anew where ``length_col`` is one of its columns)."""
    rows, rid = numbered(docs)
    found = fresh_name(docs, "spans")
    spans = repeated_spans(_ordered(rows, id_col, text_col, rid).select("rid", "ord", "text"), hot)

    @F.pandas_udf("string")
    def cut(text: pd.Series, some: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else kept_text(t, [(x["lo"], x["hi"]) for x in s]) for t, s in zip(text, some)], dtype=object)

    out = rows.join(spans.select(F.col("rid").alias(rid), F.col("spans").alias(found)), rid, "left")
    out = out.withColumn(text_col, cut(F.col(text_col), F.col(found)))
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(found).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(kind)))
    return out.select(*docs.columns)
