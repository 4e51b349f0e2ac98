import hashlib
import re

import duckdb
import pytest
from helpers import SF, awkward, empty, words

from corpusrisk.llm.exact_dedup import chunk_pattern, exact_dedup, recipes
from corpusrisk.llm.queries import SQL_OP9, op9_exact_dedup


def brute(rows):
    groups = {}
    for n, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((d is None, d or 0, n))
    out = {}
    for text, members in groups.items():
        first = min(members)
        for m in members:
            out[m[2]] = (None if first[0] else first[1], len(members), hashlib.sha256(text.encode()).hexdigest())
    return [out[n] for n in range(len(rows))]


def check(df, **kw):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = exact_dedup(df, **kw).collect()
    key = lambda d: (d is None, d or 0)
    want = sorted(((key(d), key(k), n, h) for (d, _), (k, n, h) in zip(rows, brute(rows))))
    assert sorted((key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got})  # one row of each group stays, repeated rows included
    assert all(r.doc_id == r.keep_id for r in kept)


def test_awkward_rows(spark):
    check(awkward(spark))


def test_empty_table(spark):
    assert exact_dedup(empty(spark)).collect() == []


@pytest.mark.parametrize("hash_bits", [64, 2, 0])
def test_shared_hashes_do_not_merge_contents(spark, hash_bits):
    w = words(1)
    rows = [(i, " ".join(w[(i * 7 + k * (i % 5 + 1)) % 60] for k in range(i % 40))) for i in range(120)] + [(200, "a  b"), (201, "a b"), (202, "a c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, min_chunk=8, max_chunk=40, hash_bits=hash_bits)


def test_chunks_tile_the_text():
    for text in ("", "x", "x" * 20000, "ab cd, ef. gh " * 900, "é\U0001f600 a" * 4000):
        java = chunk_pattern(64, 512)
        assert "".join(re.findall(java, text)) == text


def test_shared_chunks_have_one_identifier(spark):
    text = "some sentence, and more. " * 400
    df = spark.createDataFrame([(1, text), (2, text + "changed at the end")], "doc_id long, text string")
    a, b = (r.recipe for r in recipes(df).orderBy("doc_id").collect())
    assert a != b and len(set(map(tuple, a)) & set(map(tuple, b))) >= 1


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = sorted(tuple(r) for r in con.execute(f"SELECT {', '.join(cols)} FROM ({SQL_OP9})").fetchall())
    assert sorted(tuple(r) for r in op9_exact_dedup(spark, SF).select(*cols).collect()) == want
