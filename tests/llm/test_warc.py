import duckdb
from helpers import SF
from pyspark.sql import functions as F

from corpusrisk.llm import warc
from corpusrisk.llm.queries import SQL_OP10, op10_warc_fixity_audit

PAGES = "page_id long, url string, html string, idx string, hash string"


def pages(spark, n=300):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>page {i}</p>\r\nWARC/1.1\r\nnot a record é" * (i % 5), "clash", "clash") for i in range(n)]
    rows += [(None, None, None, None, None), (7, "http://x/\r\ny", "", "a", "b"), (7, "http://x/\r\ny", "", "a", "b"), (9, "u", "z" * 50000, "a", "b")]
    return spark.createDataFrame(rows, PAGES)


def test_volumes_read_back_what_was_written(spark, tmp):
    df = warc.warc_records(pages(spark))
    warc.write_warc(df, f"{tmp}/w", volume_records=40)
    back = warc.read_warc(spark, f"{tmp}/w", with_record=True).collect()
    assert sorted(bytes(r.record).decode() for r in back) == sorted(r.record for r in df.collect())
    for name in {r.file for r in back}:
        rows = sorted((r.seq, r.offset, r.length) for r in back if r.file == name)
        assert len(rows) <= 40 and [o for _, o, _ in rows] == [sum(n for _, _, n in rows[:k]) for k in range(len(rows))]


def test_damaged_volume_is_parsed_to_its_end():
    rec = lambda n: f"WARC/1.1\r\nContent-Length: {n}\r\n\r\n{'x' * n}\r\n\r\n".encode()
    whole = rec(10) + rec(0) + rec(33)
    assert [r for _, r in warc.parse_volume(whole)] == [rec(10), rec(0), rec(33)]
    short = rec(10)[:-9] + rec(5)
    assert [len(r) for _, r in warc.parse_volume(short)] == [len(rec(10)) - 9, len(rec(5))]
    assert [r for _, r in warc.parse_volume(rec(4)[:-1])] == [rec(4)[:-1]]
    assert list(warc.parse_volume(b"")) == []


def replica(spark, records, label):
    return warc.leaves(warc._hashed(records), warc.ORDER, label)


def statuses(rows):
    return {r.record_id: r.status for r in rows.filter("status <> 'intact'").collect()}


def test_audit_locates_changes(spark):
    base = pages(spark)
    a = replica(spark, warc.warc_records(base), "a")
    same, ra, rb = warc.audit(a, replica(spark, warc.warc_records(base), "b"))
    assert ra == rb and statuses(same) == {} and same.count() == base.count()
    hurt = base.withColumn("html", F.when(F.col("page_id").isin(11, 252), F.concat(F.lit("#"), F.expr("substr(html, 2)"))).otherwise(F.col("html")))
    rows, ra, rb = warc.audit(a, replica(spark, warc.warc_records(hurt), "b"))
    assert ra != rb and statuses(rows) == {11: "changed", 252: "changed"} and rows.count() == base.count()


def test_audit_tells_moved_missing_and_extra(spark):
    base = spark.createDataFrame([(i, f"u{i}", f"body {i:04d}", "", "") for i in range(100)], PAGES)
    a = replica(spark, warc.warc_records(base), "a")
    rows, ra, rb = warc.audit(a, replica(spark, warc.warc_records(base.filter("page_id <> 95")), "b"))
    assert ra != rb and statuses(rows) == {95: "missing", 96: "moved", 97: "moved", 98: "moved", 99: "moved"}
    rows, _, _ = warc.audit(a, replica(spark, warc.warc_records(base.filter("page_id < 98")), "b"))
    assert statuses(rows) == {98: "missing", 99: "missing"}
    more = base.unionByName(spark.createDataFrame([(500, "u", "more", "", "")], PAGES))
    rows, _, _ = warc.audit(a, replica(spark, warc.warc_records(more), "b"))
    assert [r.status for r in rows.filter("status <> 'intact'").collect()] == ["extra"]


def test_status_follows_the_record_not_its_place(spark):
    """One record lost, one changed behind it, one of several copies lost, one new, two header lines damaged."""
    base = spark.createDataFrame([(i, f"u{i}", f"body {i:04d}", "", "") for i in range(40)] + [(50, "c", "copy", "", "")] * 4, PAGES)
    a = replica(spark, warc.warc_records(base), "a")
    kept = base.filter("page_id NOT IN (5, 50)").withColumn("html", F.when(F.col("page_id") == 20, "longer than before").otherwise(F.col("html")))
    more = spark.createDataFrame([(50, "c", "copy", "", "")] * 3 + [(60, "new", "x", "", "")], PAGES)
    rows, _, _ = warc.audit(a, replica(spark, warc.warc_records(kept.unionByName(more)), "b"))
    found = sorted((r.record_id or 0, r.status) for r in rows.filter("status NOT IN ('intact', 'moved')").collect())
    # the new record takes the lost copy's place in the order, but not its identity or bytes
    assert [x for x in found if x[0] not in (0, 50)] == [(5, "missing"), (20, "changed")]
    assert [s for i, s in found if i in (0, 50)] in (["changed"], ["extra", "missing"])
    assert rows.count() == 44 + sum(s == "extra" for _, s in found)


def test_empty_archive(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc.audited_archive(none).collect() == []


def test_height():
    assert [warc.height(n, 16) for n in (0, 1, 2, 16, 17, 256, 257)] == [0, 0, 1, 1, 2, 2, 3]


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    cols = ["page_id", "url", "record_no", "offset", "length", "sha256", "status", "replica_sha256"]
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(r) for r in con.execute(f"SELECT {names} FROM ({SQL_OP10})").fetchall())
    got = sorted(tuple(r) for r in op10_warc_fixity_audit(spark, SF).select(*cols).collect())
    assert got == want and any(r[6] == "changed" for r in got)
