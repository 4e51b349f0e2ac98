"""Hard-negative mining with exact integer scores by residue-number-system matrix products.

Components are whole numbers ``floor(scale * x)``.  The inner products of many anchors with many rows
are computed by float32 matrix products modulo several small primes: residues lie in
[-(p - 1) / 2, (p - 1) / 2], and a product is summed over at most ``DEPTH`` components, so every sum
stays below 2^24 and is exact in float32.  The signed scores are put together from their residues by
Chinese remaindering (mixed radix, int64).  The number of primes follows from the largest norms.

Anchors are a stated query set against all rows, in tiles: rows are packed into blocks of ``BLOCK``,
anchors into tiles of ``TILE``, and each (tile, group of blocks) is one key of one shuffle, so neither
side is broadcast and no task holds more than a tile and a block.  Within a key the best rows so far
are kept per anchor; windows over (anchor) and (anchor, positive) select the first ones overall.
The first pass finds the positives, the second the negatives in each positive's band of scores.
Labels are never exchanged on, so a label with most of the rows is nothing special.

Cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no
part; shorter vectors count as filled up with zeros; rows with one id are different rows, but no row
is a positive of an anchor with its own id; an anchor that repeats is answered once for each time; a
positive score below zero has no negatives (its band is empty); extra columns are ignored; an empty
table gives an empty result.  Scores have to fit: above 2^56 in size the operator raises ValueError.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrisk.llm.common import number_rows, shuffle_partitions, stage

BLOCK = 4096  # rows of a block
TILE = 8192  # anchors of a tile
STRIP = 512  # anchors of a tile that are multiplied at a time
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)  # their product is below 2^63
DEPTH = 1024  # 125 * 125 * 1024 < 2^24
LARGEST = 2**56
HELD = 400_000  # candidates a task holds before it reduces them to the best ones

_PACKED = pa.schema([("tile", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("width", pa.int64()), ("norm", pa.float64()), ("nos", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("kind", pa.string()), ("data", pa.binary())])


def _spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def balanced(x: np.ndarray, p: int) -> np.ndarray:
    """Residues of whole numbers modulo ``p`` nearest to zero, in float32."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def primes_for(bound: float) -> tuple[int, ...]:
    """As many primes as tell all whole numbers from ``-bound`` to ``bound`` apart."""
    if not bound < LARGEST:
        raise ValueError(f"scores of up to {bound:.3g} do not fit; the largest allowed is {LARGEST}")
    for n in range(1, len(PRIMES) + 1):
        if math.prod(PRIMES[:n]) > 2 * bound + 2:
            return PRIMES[:n]
    raise AssertionError("the product of all primes exceeds twice the largest score")


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo ``p`` (0 to p - 1) for residues in float32."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for k in range(0, a.shape[1], DEPTH):
        out += (a[:, k : k + DEPTH] @ b[:, k : k + DEPTH].T).astype(np.int64)
    return np.mod(out, p)


def remaindered(residues: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed whole numbers with these residues, by mixed-radix digits."""
    total, radix = residues[0].copy(), primes[0]
    for r, p in zip(residues[1:], primes[1:]):
        digit = np.mod((r - total) % p * pow(radix, -1, p), p)
        total += digit * radix
        radix *= p
    total[total > radix // 2] -= radix
    return total


def exact_scores(anchors: list[np.ndarray], rows: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Scores of anchors (by prime) with rows (by prime)."""
    return remaindered([product(a, b, p) for a, b, p in zip(anchors, rows, primes)], primes)


def _components(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole components (rows filled up with zeros to one width) and which rows are finite."""
    n = len(vectors)
    sizes = np.diff(np.asarray(vectors.offsets))
    flat = vectors.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are nan
    owner = np.repeat(np.arange(n), sizes)
    ok = np.ones(n, dtype=bool)
    ok[owner[~np.isfinite(values)]] = False
    out = np.zeros((n, int(sizes.max(initial=0))))
    out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(np.isfinite(values), np.floor(scale * values), 0)
    return out, ok


def _packer(scale: int, most: int):
    """(tile, no, id, label, vector) batches -> packed blocks of one tile, at most ``most`` rows each."""

    def packed(rows):
        width = max(m.shape[1] for *_, m in rows)
        tile, no, ids, label = (np.concatenate([r[i] for r in rows]) for i in range(4))
        m = np.vstack([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for *_, m in rows])
        order = np.lexsort((no, ids))  # within a block, ties are in the order of ids
        m = m[order]
        norm = float((m * m).sum(axis=1).max(initial=0))
        top = np.abs(m).max(initial=0)
        kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<i8"
        whole = np.clip(m, -(2.0**62), 2.0**62).astype(kind)  # beyond: refused later, by the norm
        return int(tile[0]), int(no[0]), len(m), width, norm, no[order].tobytes(), ids[order].tobytes(), label[order].tobytes(), kind, whole.tobytes()

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED)], schema=_PACKED)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            tile, no, ids, label = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            for s in range(0, len(tile), most):
                m, ok = _components(batch.column(4).slice(s, most), scale)
                cut = slice(s, s + most)
                t, rest = tile[cut][ok], (no[cut][ok], ids[cut][ok], label[cut][ok], m[ok])
                edges = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
                for a, b in zip(edges[:-1], edges[1:]):
                    if a == b:
                        continue
                    if held and (held[-1][0][0] != t[a] or n + b - a > most):
                        yield table([packed(held)])
                        held, n = [], 0
                    held.append((t[a:b], *(c[a:b] for c in rest)))
                    n += b - a
        if held:
            yield table([packed(held)])

    return run


def _unpacked(row: dict, primes: tuple[int, ...], width: int):
    no, ids, label = (np.frombuffer(row[c], np.int64) for c in ("nos", "ids", "labels"))
    m = np.frombuffer(row["data"], row["kind"]).reshape(row["n"], row["width"]).astype(np.int64)
    m = np.pad(m, ((0, 0), (0, width - row["width"])))
    return no, ids, label, [balanced(m, p) for p in primes]


def best_cells(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ``k`` highest allowed scores of each row, ties to the left."""
    low = np.iinfo(np.int64).min
    x = np.where(allowed, scores, low)
    if x.shape[1] > k:
        least = np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k][:, None]
        above = x > least
        tie = (x == least) & allowed
        allowed = above & allowed | tie & (np.cumsum(tie, axis=1) <= k - above.sum(axis=1, keepdims=True))
    return np.nonzero(allowed)


_FOUND = pa.schema([(c, pa.int64()) for c in ("anchor", "anchor_id", "slot", "other_id", "score")])


class _Best:
    """The best ``k`` rows of each (anchor, slot) so far."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])
        if self.n > HELD:
            self.reduce()

    def reduce(self) -> list[np.ndarray]:
        if not self.parts:
            return []
        anchor, anchor_id, slot, other, score = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((other, -score, slot, anchor))
        a, s = anchor[order], slot[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = order[place < self.k]
        out = [c[keep] for c in (anchor, anchor_id, slot, other, score)]
        self.parts, self.n = [tuple(out)], len(keep)
        return out


def _matcher(primes: tuple[int, ...], width: int, k: int, band: tuple[int, int] | None):
    """Rows of one (tile, group): the anchors' tile first, then blocks of rows -> candidates.

    Without ``band`` the ``k`` best rows of the anchor's own label; with it, for every positive, the
    ``k`` best rows of other labels whose score is in the band of the positive's score."""

    def run(batches):
        tile, best = None, _Best(k)

        def flush():
            out = best.reduce()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], schema=_FOUND)

        for batch in batches:
            for row in batch.to_pylist():
                if row["side"] == 0:
                    yield from flush()
                    best = _Best(k)
                    tile = _unpacked(row, primes, width)
                    if band:  # (anchors, slots) positive scores, and which there are
                        found = np.frombuffer(row["positives"], np.int64).reshape(row["n"], -1)
                    continue
                if tile is None:
                    raise ValueError("a block came before its tile")
                _, ids, label, m = _unpacked(row, primes, width)
                for s in range(0, len(tile[0]), STRIP):
                    cut = slice(s, s + STRIP)
                    no, own, mine = tile[0][cut], tile[1][cut], tile[2][cut]
                    scores = exact_scores([x[cut] for x in tile[3]], m, primes)
                    same = mine[:, None] == label[None, :]
                    if not band:
                        cells = [(0, best_cells(scores, same & (own[:, None] != ids[None, :]), k))]
                    else:
                        f = found[cut]
                        half = f.shape[1] // 2
                        cells = []
                        for j in range(half):
                            p, there = f[:, j : j + 1], f[:, half + j : half + j + 1] > 0
                            inside = (band[0] * p <= 100 * scores) & (100 * scores <= band[1] * p)
                            cells.append((j, best_cells(scores, there & ~same & inside, k)))
                    for j, (x, y) in cells:
                        if len(x):
                            best.add(no[x], own[x], np.full(len(x), j), ids[y], scores[x, y])
        yield from flush()

    return run


def _meet(tiles: DataFrame, blocks: DataFrame, n_tiles: int) -> DataFrame:
    """One shuffle that brings each tile to every group of blocks, the tile first."""
    n = shuffle_partitions(blocks.sparkSession)
    groups = max(1, -(-n // n_tiles))
    each = lambda df, keys: df.withColumn("_k", F.explode(keys))
    t = each(tiles.withColumn("side", F.lit(0)), F.sequence(F.lit(0), F.lit(groups - 1))).withColumn("grp", F.col("_k"))
    b = each(blocks.withColumn("side", F.lit(1)), F.sequence(F.lit(0), F.lit(n_tiles - 1))).withColumn("tile", F.col("_k").cast("long"))
    b = b.withColumn("grp", F.pmod(F.hash("block"), F.lit(groups)).cast("int"))
    both = t.drop("_k").unionByName(b.drop("_k"), allowMissingColumns=True)
    return both.repartition(n, "tile", "grp").sortWithinPartitions("tile", "grp", "side")


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and
    each of its first ``positives`` rows of one label, the first ``negatives`` rows of other labels
    with ``band[0] * positive_score <= 100 * score <= band[1] * positive_score``."""
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    kind = _spark_schema(_PACKED)
    plain = rows.select(F.lit(0).cast("long").alias("tile"), F.monotonically_increasing_id().alias("no"), "id", "label", "vector")
    blocks = stage(plain.mapInArrow(_packer(scale, BLOCK), kind).withColumn("block", F.monotonically_increasing_id()), "vector-blocks", "zstd")
    asked = number_rows(rows.filter("asks").drop("asks"), ["id", "label", "vector"], "anchors", "no")
    asked = asked.select(F.expr(f"no div {TILE}").alias("tile"), "no", "id", "label", "vector")
    n = shuffle_partitions(spark)
    tiles = stage(asked.repartition(n, "tile").sortWithinPartitions("tile", "no").mapInArrow(_packer(scale, TILE), kind), "anchor-tiles", "zstd")
    of_rows, of_tiles = (df.agg(F.max("norm").alias("norm"), F.max("width").alias("width"), F.max("tile").alias("tile")).first() for df in (blocks, tiles))
    if not of_tiles["width"]:
        bound, width, n_tiles = 0.0, 0, 1 + (of_tiles["tile"] or 0)
    else:
        bound, width, n_tiles = math.sqrt(of_rows["norm"]) * math.sqrt(of_tiles["norm"]) * (1 + 1e-9), max(of_rows["width"], of_tiles["width"]), of_tiles["tile"] + 1
    primes = primes_for(bound)
    found = _spark_schema(_FOUND)
    near = _meet(tiles, blocks, n_tiles).mapInArrow(_matcher(primes, width, positives, None), found)
    first = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "other_id")
    chosen = stage(near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives).select("anchor", "anchor_id", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # the tiles again, with their anchors' positive scores; at most ``positives`` rows an anchor
    per_tile = chosen.groupBy(F.expr(f"anchor div {TILE}").alias("tile")).agg(F.collect_list(F.struct("anchor", "place", "positive_score")).alias("found"))

    def with_scores(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                no = np.frombuffer(row["nos"], np.int64)
                at = {int(x): i for i, x in enumerate(no)}
                table = np.zeros((len(no), 2 * positives), dtype=np.int64)
                for f in row.pop("found") or ():
                    i, j = at[f["anchor"]], f["place"] - 1
                    table[i, j], table[i, positives + j] = f["positive_score"], 1
                row["positives"] = table.tobytes()
            yield pa.RecordBatch.from_pylist(rows, schema=_PACKED.append(pa.field("positives", pa.binary())))

    asking = tiles.join(per_tile, "tile").select(*_PACKED.names, "found").mapInArrow(with_scores, f"{kind}, positives binary")
    far = _meet(asking, blocks, n_tiles).mapInArrow(_matcher(primes, width, negatives, band), found)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "other_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return (
        ranked.join(chosen.select("anchor", (F.col("place") - 1).cast("long").alias("slot"), "positive_id", "positive_score"), ["anchor", "slot"])
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )
