import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


def test_every_operator_is_registered_once():
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert {"op6_quality_rules", "op9_exact_dedup", "op10_warc_fixity_audit", "op11_hard_negatives"} <= set(entry.oracle_sql())
