"""Sequential line diff: hand-written cases with moves, a plain quadratic version, long files."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusrisk.operators import linediff as ld

VERSIONS = "commit_hash string, change_type string, a_path string, b_path string, a_text string, b_text string"


@pytest.mark.parametrize(
    "a,b,blamed",
    [
        ("abc", "xabc", [0, 1]),
        ("abc", "abxc", [2, 3]),
        ("abc", "abcx", [3, 4]),
        ("abc", "axc", [2]),
        ("abcd", "ad", [2, 3]),
        ("abcde", "bcdea", [1, 5, 6]),  # first line moved to the end: deleted there, inserted behind the last
        ("abcde", "eabcd", [0, 1, 5]),  # last line moved to the front
        ("abcdefg", "adebcfg", [2, 3, 5, 6]),  # b c moved behind d e
        ("abcdef", "abxdcef", [3, 4, 5]),  # c behind d, x in its place
        ("aXbXc", "aXbc", [4]),
        ("xxabxx", "xxbaxx", [3, 4, 5]),
        ("aaa", "aa", [3]),
        ("ababab", "bababa", [1, 6, 7]),
        ("", "", []),
        ("", "ab", [0, 1]),
        ("ab", "", [1, 2]),
    ],
)
def test_cases_by_hand(a, b, blamed):
    assert ld.blamed_lines(list(a), list(b)) == blamed


def lis_length(values):
    best = []
    for i, v in enumerate(values):
        best.append(1 + max((best[j] for j in range(i) if values[j] < v), default=0))
    return max(best, default=0)


@given(st.lists(st.integers(0, 30), unique=True))
def test_longest_increasing_is_one(values):
    run = ld.longest_increasing(list(enumerate(values)))
    assert len(run) == lis_length(values)
    assert all(x < y and v < w for (x, v), (y, w) in zip(run, run[1:])) and all(values[i] == v for i, v in run)


@settings(max_examples=300)
@given(st.text("abcd", max_size=14), st.text("abcd", max_size=14))
def test_alignment_never_crosses_and_leaves_no_common_line(a, b):
    pairs = ld.aligned(list(a), list(b))
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    # what is left between two neighbouring matches has no line in common
    edges = [(-1, -1), *pairs, (len(a), len(b))]
    for (i, j), (k, m) in zip(edges, edges[1:]):
        assert not set(a[i + 1 : k]) & set(b[j + 1 : m])


def test_long_files_in_near_linear_time():
    rnd = random.Random(1)
    took = []
    for n in (10_000, 40_000):
        a = [f"line {rnd.randrange(n)}" if i % 3 else "}" for i in range(n)]
        b = a[n // 2 :] + a[: n // 2]
        for i in range(0, n, 50):
            b[i] = f"new {i}"
        t = time.perf_counter()
        ld.blamed_lines(a, b)
        took.append(time.perf_counter() - t)
    assert took[1] < 12 * took[0] + 1


def test_versions_of_every_kind(spark):
    fv = spark.createDataFrame(
        [
            ("c", "M", "m.c", "m.c", "a\nb\nc\nd\ne", "b\nc\nd\ne\na"),
            ("c", "D", "d.c", None, "a\nb\n", None),
            ("c", "A", None, "n.c", None, "x"),
            ("c", "R", "r.c", "s.c", "a\nb", "a\nb"),
            ("c", "M", "u.c", "u.c", None, "a"),
            ("c", "M", "v.c", "v.c", "a", None),
            ("d", "M", "m.c", "m.c", "a\nb", "a\nx\nb"),
        ],
        VERSIONS,
    )
    got = sorted(tuple(r) for r in ld.sequential_changed_lines(fv).collect())
    assert got == [("c", "d.c", 1), ("c", "d.c", 2), ("c", "d.c", 3), ("c", "m.c", 1), ("c", "m.c", 5), ("c", "m.c", 6), ("c", "u.c", 0), ("c", "u.c", 1), ("c", "v.c", 1), ("d", "m.c", 1), ("d", "m.c", 2)]


def test_unexpected_change_type_raises(spark):
    with pytest.raises(Exception):
        ld.sequential_changed_lines(spark.createDataFrame([("c", "T", "x", "x", "a", "b")], VERSIONS)).collect()
