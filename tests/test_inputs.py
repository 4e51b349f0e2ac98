"""Feed parts and run files are of bounded size, and their items keep their places in the whole file."""

import os

import pytest
from pyspark.sql import functions as F

from corpusrisk.plans import q_inputs as q

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_files_are_of_bounded_size_and_items_keep_their_places(spark, monkeypatch):
    whole = {n: sorted(map(str, f(spark, SF).collect())) for n, f in (("items", q.q_src_feed_items), ("commits", q.q_flt_has_commits), ("runs", q.q_src_runs))}
    monkeypatch.setattr(q, "FILE_CUSTOMERS", 20)
    monkeypatch.setattr(q, "FILE_ORDERS", 50)
    assert q.feed(spark, SF).agg(F.max(F.size("CVE_Items"))).first()[0] <= 20
    assert q.run_files(spark, SF).agg(F.max(F.size("examples"))).first()[0] <= 50
    assert sorted(map(str, q.q_src_feed_items(spark, SF).collect())) == whole["items"]
    assert sorted(map(str, q.q_flt_has_commits(spark, SF).collect())) == whole["commits"]
    assert sorted(map(str, q.q_src_runs(spark, SF).collect())) == whole["runs"]
