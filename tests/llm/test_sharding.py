import zlib
from collections import Counter

import pytest
from helpers import awkward, empty

from corpusrisk.llm.sharding import balanced_shards, label_propagation, quotas, within_quotas


def check(rows, shards):
    count = Counter(r.shard for r in rows)
    assert set(count) <= set(range(shards))
    assert max(count.get(s, 0) for s in range(shards)) - min(count.get(s, 0) for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count.get(s, 0)))
    groups = {}
    for r in rows:
        groups.setdefault((r.text_crc32, r.size), []).append(r.shard)
    return groups


def test_pairs_stay_together_although_every_row_is_linked(spark):
    df = spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id long, text string")
    groups = check(balanced_shards(df).collect(), 40)
    assert all(len(set(g)) == 1 for g in groups.values())


def test_hot_group_is_cut_no_more_than_quotas_ask(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"text {i // 4}") for i in range(1200)], "doc_id long, text string")
    groups = check(balanced_shards(df, shards=10).collect(), 10)
    hot = max(groups.values(), key=len)
    assert len(hot) == 400 and len(set(hot)) >= 4
    assert sum(len(set(g)) > 1 for g in groups.values() if len(g) < 10) <= 0.1 * len(groups)


def test_groups_span_no_more_shards_than_quotas_ask(spark):
    sizes = {"third": 400, "most of two": 220, **{f"part {i}": 36 for i in range(5)}, "quarter": 31}
    texts = [name for name, n in sizes.items() for _ in range(n)]
    texts += [f"text {i // 2}" for i in range(1200 - len(texts))]
    df = spark.createDataFrame([(7 * i % 1200, t) for i, t in enumerate(texts)], "doc_id long, text string")
    groups = check(balanced_shards(df, shards=10).collect(), 10)
    large = sorted((len(g), len(set(g))) for g in groups.values() if len(g) > 2)
    assert large == [(31, 1), *[(36, 1)] * 5, (220, 2), (400, 4)]
    assert sum(len(set(g)) > 1 for g in groups.values() if len(g) == 2) <= 0.1 * len(groups)


def test_quotas_hold_after_propagation(spark):
    blocks = spark.createDataFrame([(f"b{i}", s, 3) for i in range(40) for s in (0, 1)], "block string, shard int, n long")
    sizes = quotas(240, 4)
    out = within_quotas(label_propagation(blocks, sizes), sizes)
    load = Counter()
    for r in out.collect():
        load[r.shard] += r.n
    assert sum(load.values()) == 240 and all(load[s] <= sizes[s] for s in range(4))


def test_awkward_rows_and_empty_table(spark):
    df = awkward(spark)
    rows = balanced_shards(df, shards=5).collect()
    check(rows, 5)
    want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}
    assert balanced_shards(empty(spark)).collect() == []


@pytest.mark.parametrize("rows,shards", [(0, 4), (3, 4), (41, 40), (400, 40)])
def test_quota_sizes(rows, shards):
    q = quotas(rows, shards)
    assert sum(q) == rows and max(q) - min(q) <= 1
