"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the split pattern is encoded on its own.  The leaves of the tree are the match's
byte positions; a leaf holds the rank of the pair (token that starts there, next live token) or
infinity, packed with its position so that the root is the leftmost pair of minimum rank.  A merge
changes three leaves (the merged token, its dead right half, its live left neighbour) and climbs
the tree from them, so it costs a logarithmic number of steps.

Short matches are encoded many at a time: one numpy array holds a tree per match, and each step
merges one pair in every match that still has one.  Longer matches use the same tree one by one.
Encoded matches are remembered in a bounded table per worker.

Cases: null text is the empty text (no tokens); special tokens do not exist, their strings are
ordinary text; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corpusrisk.llm.common import id_text, worker_table

NONE = np.int64(1) << 40  # above every packed (rank, position)
BATCH_WIDTH = 64  # matches of up to this many bytes are encoded in batches
REMEMBERED = 300_000  # encoded matches kept per worker before the table is started anew
GROUP_CHARS = 2_000_000  # characters taken up at a time


class ByteBPE:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.token_bytes = {r: t for t, r in ranks.items()}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.known: dict[str, bytes] = worker_table({})

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, -1 if it is no token."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge_long(self, piece: bytes) -> bytes:
        """One match of any length: the tree as a list."""
        n = len(piece)
        w = 1 << max(1, (n - 1).bit_length())
        none, pairs = w << 40, self.pairs
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n))
        tree = [none] * (2 * w)
        for i, r in enumerate(self.pair_rank(np.array(ids[:-1], dtype=np.int64), np.array(ids[1:], dtype=np.int64)).tolist()):
            if r >= 0:
                tree[w + i] = r * w + i
        for p in range(w - 1, 0, -1):
            tree[p] = min(tree[2 * p], tree[2 * p + 1])
        while tree[1] < none:
            rank, i = divmod(tree[1], w)
            j = nxt[i]
            k = nxt[j]
            ids[i], ids[j], nxt[i] = rank, -1, k
            if k < n:
                prv[k] = i
            h = prv[i]
            for leaf, r in ((j, None), (i, pairs.get(rank << 20 | ids[k]) if k < n else None), (h, pairs.get(ids[h] << 20 | rank) if h >= 0 else None)):
                if leaf < 0:
                    continue
                p, now = w + leaf, none if r is None else r * w + leaf
                tree[p] = now
                while p > 1:  # climb as long as the minimum changes
                    p >>= 1
                    now = min(tree[2 * p], tree[2 * p + 1])
                    if tree[p] == now:
                        break
                    tree[p] = now
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def merge_batch(self, pieces: list[bytes], w: int) -> list[bytes]:
        """Matches of at most ``w`` bytes (a power of two): one row, one tree per match."""
        m = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, m)
        raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), np.uint8).reshape(m, w)
        live = np.arange(w) < sizes[:, None]
        ids = np.where(live, self.byte_id[raw], -1)
        tree = np.full((m, 2 * w), NONE)
        both = live[:, 1:]
        r = np.full((m, w - 1), -1, dtype=np.int64)
        r[both] = self.pair_rank(ids[:, :-1][both], ids[:, 1:][both])
        tree[:, w : 2 * w - 1] = np.where(r >= 0, r * w + np.arange(w - 1), NONE)
        lvl = w
        while lvl > 1:
            tree[:, lvl // 2 : lvl] = np.minimum(tree[:, lvl : 2 * lvl : 2], tree[:, lvl + 1 : 2 * lvl : 2])
            lvl //= 2
        # flat views: row q starts at q*2w in the tree, q*(w+2) in the links (slot 0 is the left end)
        tr, stride = tree.reshape(-1), w + 2
        nxt = np.tile(np.arange(1, stride + 1), m)  # slot of the next live token; positions are slots - 1
        prv = np.tile(np.arange(-1, stride - 1), m)
        idf = np.full((m, stride), -1, dtype=np.int64)
        idf[:, 1 : w + 1] = ids
        idf = idf.reshape(-1)
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tr[rows * 2 * w + 1]
            rank, i = root // w, root % w + 1
            base = rows * stride
            j = nxt[base + i]
            k = nxt[base + j]
            idf[base + i] = rank
            idf[base + j] = -1
            nxt[base + i] = k
            prv[base + k] = i
            h = prv[base + i]
            right, left = idf[base + k], idf[base + h]  # -1 beyond either end
            r = self.pair_rank(np.concatenate([rank, np.maximum(left, 0)]), np.concatenate([np.maximum(right, 0), rank]))
            r[: len(rows)][right < 0] = -1
            r[len(rows) :][left < 0] = -1
            t0 = rows * 2 * w + w - 1  # tree index of slot 0's (absent) leaf
            tr[t0 + j] = NONE
            tr[t0 + i] = np.where(r[: len(rows)] >= 0, r[: len(rows)] * w + i - 1, NONE)
            has = h > 0
            tr[(t0 + h)[has]] = np.where(r[len(rows) :] >= 0, r[len(rows) :] * w + h - 1, NONE)[has]
            node = np.concatenate([i, j, np.where(has, h, i)]) + (w - 1)
            off = np.tile(rows * 2 * w, 3)
            lvl = w
            while lvl > 1:
                node >>= 1
                at = off + 2 * node
                tr[off + node] = np.minimum(tr[at], tr[at + 1])
                lvl //= 2
            rows = rows[tr[rows * 2 * w + 1] < NONE]
        idf = idf.reshape(m, stride)
        flat = idf[idf >= 0].astype("<u4").tobytes()
        ends = np.cumsum((idf >= 0).sum(1)).tolist()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, pieces) -> None:
        """Encode distinct matches and remember them."""
        known, by_width = self.known, {}
        for p in pieces:
            b = p.encode()
            if (rank := self.ranks.get(b)) is not None:  # a match that is a token needs no merge
                known[p] = rank.to_bytes(4, "little")
            elif len(b) <= BATCH_WIDTH:
                by_width.setdefault(1 << max(2, (len(b) - 1).bit_length()), []).append((p, b))
            else:
                known[p] = self.merge_long(b)
        for w, some in by_width.items():
            for s in range(0, len(some), 1 << 14):
                part = some[s : s + (1 << 14)]
                known.update(zip([p for p, _ in part], self.merge_batch([b for _, b in part], w)))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set().union(*cut).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def text_groups(batch: pa.RecordBatch, chars: int = GROUP_CHARS, as_bytes: bool = False):
    """Slices of a (doc_id, text) batch with about ``chars`` characters each (one text at least)."""
    texts, start, total = (batch.column(1).cast(pa.binary()) if as_bytes else batch.column(1)).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars or i + 1 == len(texts):
            yield batch.column(0).slice(start, i + 1 - start), texts[start : i + 1]
            start, total = i + 1, 0


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit; null
    unless ``with_ids``), ids_sha256 and decoded_sha256 (of the bytes decoded from the ids)."""
    one = id_text(docs, id_col, text_col)
    id_type = pa.schema([("doc_id", _arrow_type(one))])

    def encode(batches):
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            for ids, texts in text_groups(batch):
                coded = bpe.encode_many(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.cast(id_type.field(0).type),
                        pa.array([len(c) // 4 for c in coded], pa.int64()),
                        pa.array(coded if with_ids else [None] * len(coded), pa.binary()),
                        pa.array([hashlib.sha256(c).hexdigest() for c in coded]),
                        pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in coded]),
                    ],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    kind = one.schema["doc_id"].dataType.simpleString()
    return one.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def _arrow_type(one: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(one.schema["doc_id"].dataType)
