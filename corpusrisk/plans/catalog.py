"""The query catalogue: every registered query with its DuckDB oracle SQL (or None).

Each query takes ``(spark, sf_dir)``, reads the whole driver tables there and returns a
DataFrame whose columns are named exactly like the oracle's.
"""

from __future__ import annotations

import importlib

_MODULES = ["q_text", "q_eval", "q_seq", "q_lineage", "q_synth", "q_models", "q_features", "q_inputs", "q_search", "q_roundtrip"]


def catalog() -> dict:
    out: dict = {}
    for m in _MODULES:
        mod = importlib.import_module(f"corpusrisk.plans.{m}")
        for k, v in mod.QUERIES.items():
            if k in out:
                raise KeyError(f"duplicate query {k}")
            out[k] = v
    return out
