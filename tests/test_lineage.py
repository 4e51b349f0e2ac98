"""Job A end to end on hand-written feeds, commits, file versions and blame rows."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusrisk.operators import lineage as ln
from corpusrisk.sources import readers as rd

GH = "https://github.com/torvalds/linux/commit/{}"


def _item(cve_id, refs, desc):
    return {
        "cve": {
            "CVE_data_meta": {"ID": cve_id},
            "references": {"reference_data": [{"url": u, "refsource": s} for u, s in refs]},
            "description": {"description_data": [{"value": d} for d in desc]},
        }
    }


@pytest.fixture
def feed_dir(tmp):
    d = os.path.join(tmp, "feeds")
    os.makedirs(d)
    a = [_item("CVE-1", [(GH.format("aaa111"), "CONFIRM"), (GH.format("bbb222"), "MISC")], ["Overflow in the foo function in net/x.c"])]
    b = [
        _item("CVE-1", [(GH.format("ccc333"), "CONFIRM"), (GH.format("ccc333"), "CONFIRM")], ["The bar_baz implementation in fs/a.c and fs/b.c"]),
        _item("CVE-2", [(GH.format(h), "CONFIRM") for h in ("d1", "d2", "d3", "d4", "d5")], ["x"]),
        _item("CVE-3", [("https://example.org/", "CONFIRM")], ["y"]),
        _item("CVE-4", [("http://git.kernel.org/cgit/linux/kernel/git/torvalds/linux.git/commit/?id=eee555", "CONFIRM"), (GH.format("fff666"), "CONFIRM"), (GH.format("zzz000"), "CONFIRM")], ["z"]),
    ]
    for name, items in (("2016.json.gz", a), ("2017.json.gz", b)):
        with gzip.open(os.path.join(d, name), "wt") as f:
            json.dump({"CVE_Items": items}, f)
    return d


def test_feed_to_tables(spark, feed_dir):
    recs = ln.advisory_records(ln.feed_items(rd.read_feeds(spark, feed_dir)))
    adv = ln.drop_many_commits(ln.latest_advisories(recs))
    got = {r["cve_id"]: r for r in adv.collect()}
    assert set(got) == {"CVE-1", "CVE-4"}  # CVE-2 has 5 commits, CVE-3 none
    assert got["CVE-1"]["fix_commits"] == ["ccc333"]  # the later file wins, duplicates merged
    assert got["CVE-1"]["desc_files"] == ["fs/a.c", "fs/b.c"] and got["CVE-1"]["desc_functions"] == ["bar_baz"]
    assert sorted(got["CVE-4"]["fix_commits"]) == ["fff666", "zzz000"]  # ?id= URL does not match

    commits = spark.createDataFrame(
        [("ccc333", "2017-01-02T03:04:05+01:00", ["p1"]), ("fff666", "2017-02-01T00:00:00+00:00", []), ("b1", "2010-01-01T00:00:00+00:00", []), ("p1", "2016-12-31T00:00:00+00:00", ["p0"])],
        "commit_hash string, committed_timestamp string, parents array<string>",
    )
    valid, missing = ln.valid_fix_commits(adv, commits)
    assert sorted(map(tuple, valid.collect())) == [("ccc333", "CVE-1"), ("fff666", "CVE-4")] or sorted((r["cve_id"], r["fix_commit_hash"]) for r in valid.collect()) == [("CVE-1", "ccc333"), ("CVE-4", "fff666")]
    assert [r["fix_commit_hash"] for r in missing.collect()] == ["zzz000"]

    fv = spark.createDataFrame(
        [
            ("ccc333", "M", "f.c", "f.c", "l1\nl2\nl3", "l1\nX\nl2\nl3"),
            ("ccc333", "D", "g.c", None, "a\nb", None),
            ("ccc333", "A", None, "new.c", None, "n"),
            ("fff666", "M", "h.c", "h.c", "q", "q"),
        ],
        "commit_hash string, change_type string, a_path string, b_path string, a_text string, b_text string",
    )
    changed = ln.changed_lines(fv)
    assert sorted((r["a_path"], r["line_no"]) for r in changed.collect()) == [("f.c", 1), ("f.c", 2), ("g.c", 1), ("g.c", 2)]
    blame = spark.createDataFrame(
        [("p1", "f.c", i, f"b{i}") for i in (1, 2, 3)] + [("p1", "g.c", i, f"g{i}") for i in (1, 2)], "commit_hash string, path string, line_no int, blame_commit string"
    )
    tables = ln.relational_tables(valid, ln.blame_lines(changed, commits, blame), commits)
    assert sorted(map(tuple, tables["commit_affected_lines"].collect())) == [("ccc333", "f.c", 1, "b1"), ("ccc333", "f.c", 2, "b2"), ("ccc333", "g.c", 1, "g1"), ("ccc333", "g.c", 2, "g2")]
    details = {r["commit_hash"]: r["parent_commit_hash"] for r in tables["commit_details"].collect()}
    assert details == {"ccc333": "p1", "fff666": None, "b1": None}  # b2, g1, g2 unresolvable
    intro = {r["cve_id"]: r for r in ln.introducers(tables).collect()}
    assert intro["CVE-1"]["n_lines"] == 4 and intro["CVE-4"]["n_lines"] == 0
    tree = ln.blame_tree(tables, adv).filter(F.col("cve_id") == "CVE-1").first()
    assert sorted(tree["fix_commits"]["ccc333"]["affected_files"]) == ["f.c", "g.c"]


def test_unexpected_change_type_raises(spark):
    fv = spark.createDataFrame([("c", "T", "x", "x", "a", "b")], "commit_hash string, change_type string, a_path string, b_path string, a_text string, b_text string")
    with pytest.raises(Exception):
        ln.changed_lines(fv).collect()


@pytest.mark.parametrize(
    "a,b,blamed",
    [
        ("a\nb\nc", "x\na\nb\nc", {0, 1}),  # insert at start: the lines around it
        ("a\nb\nc", "a\nb\nx\nc", {2, 3}),  # insert in the middle
        ("a\nb\nc", "a\nb\nc\nx", {3, 4}),  # insert at end
        ("a\nb\nc", "a\nx\nc", {2}),  # replace
        ("a\nb\nc\nd", "a\nd", {2, 3}),  # delete
        ("a\n\nb\n\nc", "a\n\nb\nc", {4}),  # of repeated blank lines the later one goes
    ],
)
def test_changed_lines_on_simple_edits(spark, a, b, blamed):
    fv = spark.createDataFrame([("c", "M", "p", "p", a, b)], "commit_hash string, change_type string, a_path string, b_path string, a_text string, b_text string")
    assert {r["line_no"] for r in ln.changed_lines(fv).collect()} == blamed


def test_deleted_file_counts_empty_tail(spark):
    fv = spark.createDataFrame([("c", "D", "p", None, "a\nb\n", None)], "commit_hash string, change_type string, a_path string, b_path string, a_text string, b_text string")
    assert sorted(r["line_no"] for r in ln.changed_lines(fv).collect()) == [1, 2, 3]


def test_blame_tree_json_round_trip(spark, tmp):
    from corpusrisk.sinks import writers as wr

    fc = spark.createDataFrame([("CVE-9", "c1"), ("CVE-9", "c2")], "cve_id string, fix_commit_hash string")
    al = spark.createDataFrame([("c1", "a.c", 3, "b3"), ("c1", "a.c", 1, "b1"), ("c1", "b.c", 2, "b2")], "affecting_commit_hash string, affected_file string, affected_line int, affected_line_blame_commit_hash string")
    cd = spark.createDataFrame([("c1", "2017-01-01T00:00:00+00:00", None)], "commit_hash string, committed_timestamp string, parent_commit_hash string")
    adv = spark.createDataFrame([("CVE-9", ["c1", "c2"], ["a.c"], ["f"])], "cve_id string, fix_commits array<string>, desc_files array<string>, desc_functions array<string>")
    tree = ln.blame_tree({"fix_commits": fc, "commit_affected_lines": al, "commit_details": cd}, adv)
    t = tree.first()
    assert [x["line_no"] for x in t["fix_commits"]["c1"]["affected_files"]["a.c"]["blame_lines"]] == [1, 3]  # sorted by line
    assert t["fix_commits"]["c2"]["affected_files"] == {}  # commit without files
    wr.write_blame_tree(tree, f"{tmp}/tree")
    back = ln.flatten_blame_tree(tree)
    assert sorted(map(tuple, back["commit_affected_lines"].collect())) == sorted(map(tuple, al.collect()))
    assert sorted(map(tuple, back["fix_commits"].collect())) == sorted(map(tuple, fc.collect()))
    read = rd.read_blame_json(spark, f"{tmp}/tree")
    again = ln.flatten_blame_tree(read)
    assert read.count() == 1
    assert sorted(map(tuple, again["commit_affected_lines"].collect())) == sorted(map(tuple, al.collect()))
    assert sorted(map(tuple, again["fix_commits"].collect())) == sorted(map(tuple, fc.collect()))


def test_label_translate_and_strict_lookup(spark):
    from corpusrisk.operators import evaluate as ev

    df = spark.createDataFrame([("VULNERABLE_FILE",), ("OTHER",)], "t string")
    assert [r[0] for r in df.select(ev.translate_label("t")).collect()] == ["VULNERABLE", "NOT_VULNERABLE"]
    with pytest.raises(Exception):
        spark.createDataFrame([("PATCHED_VULNERABLE_FILE",)], "t string").select(ev.translate_label("t")).collect()
    idx = spark.createDataFrame([(1,), (2,)], "k int")
    lk = spark.createDataFrame([(1, "VULNERABLE")], "k int, label string")
    with pytest.raises(Exception):
        ev.strict_lookup(idx, lk, "k", "label").collect()
    assert ev.strict_lookup(idx.filter("k = 1"), lk, "k", "label").first()["label"] == "VULNERABLE"


def test_baseline_lines(spark):
    from corpusrisk.operators import report as rp

    curve = spark.createDataFrame([("r", 100, "precision", 0.5), ("r", 100, "recall", 0.2)], "run string, training_examples int, metric string, score double")
    stats = spark.createDataFrame([("s", "precision", 0.7), ("s", "recall", 0.4), ("s", "TP", 3.0)], "split string, key string, value double")
    got = {r["metric"]: r["baseline"] for r in rp.baseline_lines(curve, stats).collect()}
    assert got == {"precision": 0.7, "recall": 0.4}
