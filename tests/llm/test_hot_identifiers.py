"""In hot buckets strings are equal only if their bucket and their 50-byte identifier agree."""

import numpy as np
import pyarrow as pa

from corpusrisk.llm import suffix_dedup as sd


def test_equal_span_ids_of_different_buckets_do_not_meet(monkeypatch):
    monkeypatch.setattr(sd, "span_ids", lambda data: np.zeros(len(data) - sd.SPAN + 1, dtype=np.uint64))
    texts = [bytes(range(a, a + sd.SPAN)) for a in (0, 60, 60)]
    ids = [[[sd.least_gram(np.frombuffer(t, np.uint8)).tobytes()]] for t in texts]
    live = pa.array([x[0] for x in ids], pa.list_(pa.binary()))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 1, 2]), pa.array(texts, pa.binary()), live, live], names=["rid", "ord", "text", "live", "hot"])
    found = [r["rid"] for b in sd._refine(sd._packed_runs(1)([batch])) for r in b.to_pylist()]
    assert found == [2]
