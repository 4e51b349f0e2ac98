"""Sequential line diff (``dif_changed_lines``): patience alignment of the two versions of a file.

Lines that are unique on both sides are anchors; the longest increasing run of them (by patience
piles) is matched, and the stretches between neighbouring anchors are aligned the same way, where
further lines are unique.  A stretch without such lines takes equal lines with equal occurrence
numbers for anchors, again along a longest increasing run, until no line is in common.  Matches never cross, so a moved line counts as
changed on both sides.  The work is n log n per level of recursion.

Both versions stand in one row, so the diff is one pass over the versions without a shuffle; a
file pair is aligned by the small helper below, and its changed line numbers are the only output.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.operators.lineage import checked_versions


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in the order of their first numbers, a longest run whose second numbers increase.

    Each pair goes on the leftmost pile whose top is not smaller, and remembers the top of the pile
    before; the run is read back from the last pile."""
    tops, last, before = [], [], []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[pile], last[pile] = j, k
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _unique_pairs(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    at = {b[j]: j for j in range(blo, bhi) if in_b[b[j]] == 1}
    return [(i, at[a[i]]) for i in range(alo, ahi) if in_a[a[i]] == 1 and a[i] in at]


def _numbered_pairs(a: list, b: list, alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Equal lines with equal occurrence numbers."""
    seen: Counter = Counter()
    at = {}
    for j in range(blo, bhi):
        at[b[j], seen[b[j]]] = j
        seen[b[j]] += 1
    seen.clear()
    out = []
    for i in range(alo, ahi):
        key = a[i], seen[a[i]]
        seen[a[i]] += 1
        if key in at:
            out.append((i, at[key]))
    return out


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places ``(i, j)`` of two lists of lines, increasing on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        anchors = longest_increasing(_unique_pairs(a, b, alo, ahi, blo, bhi) or _numbered_pairs(a, b, alo, ahi, blo, bhi))
        if not anchors:  # the stretches have no line in common
            continue
        out += anchors
        edges = [(alo - 1, blo - 1), *anchors, (ahi, bhi)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def blamed_lines(a: list, b: list) -> list[int]:
    """1-based old lines that a change blames: deleted and replaced ones, and for an insertion the
    lines before and after it (0 and n + 1 at the ends)."""
    out: set[int] = set()
    i = j = 0
    for k, m in [*aligned(a, b), (len(a), len(b))]:
        if k > i:
            out.update(range(i + 1, k + 1))
        elif m > j:
            out.update((i, i + 1))
        i, j = k + 1, m + 1
    return sorted(out)


def sequential_changed_lines(file_versions: DataFrame, keys: tuple[str, ...] = ("commit_hash", "a_path")) -> DataFrame:
    """``dif_changed_lines`` + ``dif_insert_anchor`` + ``dif_deleted_file`` by patience alignment:
    ``(keys, line_no)``.  All lines of a deleted file are blamed; a null (undecodable) text has none."""
    keys = list(keys)
    fv = checked_versions(file_versions).select(*keys, (F.col("change_type") == "D").alias("_gone"), "a_text", "b_text")
    kinds = {f.name: f.dataType.simpleString() for f in fv.schema.fields}

    def run(batches):
        for batch in batches:
            gone, old, new = (batch.column(len(keys) + i) for i in range(3))
            at, lines = [], []
            for r in range(len(batch)):
                a, b = (x[r].as_py() for x in (old, new))
                a = [] if a is None else a.split("\n")
                found = range(1, len(a) + 1) if gone[r].as_py() else blamed_lines(a, [] if b is None else b.split("\n"))
                at += [r] * len(found)
                lines += found
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(len(keys))), pa.array(lines, pa.int32())], names=[*keys, "line_no"])

    return fv.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", line_no int").distinct()
