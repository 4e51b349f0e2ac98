"""Skew-safe dense index and running sums against pandas, with a hot key spanning partitions."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusrisk.operators.prefix import dense_index, running_sum


def test_dense_index(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.integers(0, 5, 3000), "v": rng.permutation(3000)})
    df = spark.createDataFrame(pdf)
    out = dense_index(df, ["k", "v"], num_partitions=7).toPandas().sort_values(["k", "v"])
    assert out["idx"].tolist() == list(range(3000))


def test_running_sum_hot_key(spark):
    rng = np.random.default_rng(1)
    keys = np.where(rng.random(5000) < 0.6, "hot", rng.choice(["a", "b", "c"], 5000))
    pdf = pd.DataFrame({"k": keys, "o": rng.permutation(5000), "v": rng.integers(0, 10, 5000).astype(float)})
    out = running_sum(spark.createDataFrame(pdf), ["k"], ["o"], ["v"], num_partitions=9).toPandas()
    exp = pdf.sort_values(["k", "o"]).assign(cum_v=lambda d: d.groupby("k")["v"].cumsum())
    got = out.sort_values(["k", "o"])
    assert np.allclose(got["cum_v"].to_numpy(), exp["cum_v"].to_numpy())


def test_running_sum_descending_order(spark):
    pdf = pd.DataFrame({"k": ["x"] * 6, "s": [0.9, 0.8, 0.7, 0.6, 0.2, 0.1], "v": [1.0, 0, 1, 0, 1, 0]})
    out = running_sum(spark.createDataFrame(pdf), ["k"], [F.desc("s")], ["v"], num_partitions=3).toPandas().sort_values("s", ascending=False)
    assert out["cum_v"].tolist() == [1, 1, 2, 2, 3, 3]


def test_sample_exact_equals_ordered_limit(spark):
    import pytest

    from corpusrisk.operators.sampling import sample_exact, seeded_key

    df = spark.range(5000).withColumnRenamed("id", "k")
    for n in (1, 250, 4999):
        got = sorted(r["k"] for r in sample_exact(df, "k", n, seed=5).collect())
        exp = sorted(r["k"] for r in df.orderBy(seeded_key(5, "k"), "k").limit(n).collect())
        assert got == exp
    with pytest.raises(ValueError):
        sample_exact(df, "k", 5001)


def test_running_sum_null_keys_ties_and_hot_value(spark):
    """Null keys are a group; a key on a third of the rows equals the plain window."""
    rows = [(None if i % 3 == 0 else i % 5, None if i % 4 == 0 else f"s{i % 2}", i, float(i % 7)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, s string, o int, v double")
    for keys in (["k"], ["s"], ["k", "s"], []):
        got = {r["o"]: r["cum_v"] for r in running_sum(df, keys, ["o"], ["v"], num_partitions=6).collect()}
        run, want = {}, {}
        for k, s, o, v in rows:
            key = tuple({"k": k, "s": s}[x] for x in keys)
            run[key] = run.get(key, 0.0) + v
            want[o] = run[key]
        assert got == want


def test_exact_mean_does_not_depend_on_partitions(spark):
    from corpusrisk.operators.report import exact_mean

    df = spark.range(0, 20000).select((F.col("id") % 3).alias("k"), (F.lit(1.0) / (F.col("id") + 3)).alias("x"))
    means = {n: sorted((r["k"], r["m"]) for r in df.repartition(n).groupBy("k").agg(exact_mean(F.col("x")).alias("m")).collect()) for n in (1, 8, 50)}
    assert means[1] == means[8] == means[50]


def test_quantiles_and_box_with_null_groups_and_ties(spark):
    from corpusrisk.operators.report import box_stats, exact_quantiles

    rows = [(None if i % 2 else "a", 1.0 if i % 3 else float(i)) for i in range(300)] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q0"], r["q1"]) for r in exact_quantiles(df, ["g"], "v", [0.25, 0.9]).collect()}
    for g in ("a", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g], np.quantile(v, [0.25, 0.9]))
    box = {r["g"]: r for r in box_stats(df, ["g"], "v").collect()}
    assert set(box) == {"a", None} and all(b["n_outliers"] >= 0 and b["whisker_low"] == 0.0 or b["whisker_low"] == 1.0 for b in box.values())
