"""The trained sequence model: gradients, one model however rows are dealt, early stopping, history."""

import pickle
import random

import numpy as np
import pytest

from corpusrisk.operators import neural as nn

SPEC = nn.SequenceSpec(vocab_size=12, embed_dim=3, conv_filters=4, conv_kernel_size=3, batch_size=40, max_epochs=2)


def test_gradient_equals_finite_differences():
    rnd = np.random.default_rng(0)
    for stride, dropout, y in ((1, 0.0, 1.0), (2, 0.5, 0.0)):
        spec = nn.SequenceSpec(vocab_size=12, embed_dim=3, conv_filters=4, conv_kernel_size=3, conv_strides=stride, dropout=dropout, class_weight={0: 1.0, 1: 2.5})
        w = nn.initial(spec)
        w["embed"] = rnd.standard_normal(w["embed"].shape)
        x = rnd.integers(0, 12, 15)
        keep = rnd.random(4) >= dropout if dropout else None
        _, g, (ids, rows) = nn.gradient(w, x, y, spec, keep)
        embed = np.zeros_like(w["embed"])
        np.add.at(embed, ids, rows)
        for name, full in {**g, "embed": embed}.items():
            for at in np.ndindex(w[name].shape):
                old, eps = w[name][at], 1e-6
                w[name][at] = old + eps
                up = nn.gradient(w, x, y, spec, keep)[0]
                w[name][at] = old - eps
                down = nn.gradient(w, x, y, spec, keep)[0]
                w[name][at] = old
                assert full[at] == pytest.approx((up - down) / (2 * eps), rel=1e-5, abs=1e-8)


def test_order_is_a_permutation_that_no_dealing_changes():
    for n in (1, 2, 7, 100):
        place = nn.shuffled(np.arange(n), n, 3, 1)
        assert sorted(place) == list(range(n))
        assert list(nn.shuffled(np.arange(n)[::2], n, 3, 1)) == list(place[::2])
    assert list(nn.shuffled(np.arange(50), 50, 0, 1)) != list(nn.shuffled(np.arange(50), 50, 1, 1))


def rows(n=80):
    """Class 1 holds the pair 7 8 somewhere."""
    rnd = random.Random(3)
    out = []
    for i in range(n):
        x = [rnd.randrange(1, 7) for _ in range(rnd.randrange(0, 20))]
        if i % 2:
            at = rnd.randrange(len(x) + 1)
            x[at:at] = [7, 8]
        out.append((f"f{i}", x, i % 2))
    return out


def test_two_partition_counts_give_one_model(spark):
    df = spark.createDataFrame(rows(), "file string, tokens array<int>, y int")
    one, first = nn.fit(df, SPEC, workers=1)
    three, again = nn.fit(df.repartition(5), SPEC, workers=3)
    assert all((one[k] == three[k]).all() for k in one)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) and first.count() == 2


def test_learns():
    spec = nn.SequenceSpec(vocab_size=12, embed_dim=8, conv_filters=8, conv_kernel_size=2, max_epochs=60)
    data = [(i, nn.prepared(x, spec), float(y)) for i, (_, x, y) in enumerate(rows(200))]
    epochs = list(nn.train(data, 180, 20, spec, lambda x: [x]))
    model = epochs[-1]["model"]
    assert epochs[-1]["loss"] < epochs[0]["loss"] / 2
    assert np.mean([(nn.logit(model, x, spec) > 0) == (y > 0) for _, x, y in data]) > 0.95


def test_steps_of_any_size_use_every_row_once():
    spec = nn.SequenceSpec(vocab_size=12, embed_dim=3, conv_filters=4, conv_kernel_size=3, batch_size=7, max_epochs=2)
    data = [(i, nn.prepared(x, spec), float(y)) for i, (_, x, y) in enumerate(rows(40))]
    split = [data[k::3] for k in range(3)]
    alone = list(nn.train(data, 36, 4, spec, lambda x: [x]))
    # three tasks in step, by hand: each runs until it waits for the others
    import threading

    barrier, box, results = threading.Barrier(3), [None] * 3, [None] * 3

    def gather(k):
        def exchange(x):
            box[k] = x
            barrier.wait()
            out = list(box)
            barrier.wait()
            return out

        return exchange

    def task(k):
        results[k] = list(nn.train(split[k], 36, 4, spec, gather(k)))

    threads = [threading.Thread(target=task, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    for other in results:
        assert all((alone[-1]["model"][k] == other[-1]["model"][k]).all() for k in alone[-1]["model"])
        assert [e["loss"] for e in other] == [e["loss"] for e in alone]


def test_metrics_and_history(spark):
    df = spark.createDataFrame(rows(60), "file string, tokens array<int>, y int")
    m, ex, history = nn.train_and_evaluate(df, df, SPEC, workers=2)
    assert 0 <= m.first()["roc_auc"] <= 1 and ex.count() == 60 and history.columns == ["epoch", "loss", "val_loss", "val_accuracy"]


def test_early_stopping_keeps_the_best():
    spec = nn.SequenceSpec(vocab_size=12, embed_dim=3, conv_filters=4, conv_kernel_size=3, batch_size=4, max_epochs=30, es_patience=2, learning_rate=0.2)
    rnd = random.Random(1)
    noise = [(i, nn.prepared([rnd.randrange(12) for _ in range(10)], spec), float(rnd.random() < 0.5)) for i in range(40)]
    epochs = list(nn.train(noise, 30, 10, spec, lambda x: [x]))
    val = [e["val_loss"] for e in epochs]
    assert len(val) < 30 and min(val[-2:]) > min(val) - spec.es_min_delta and epochs[-1]["model"] is not None
    best = epochs[-1]["model"]
    assert np.mean([nn.cross_entropy(nn.logit(best, x, spec), y) for i, x, y in noise if i >= 30]) == pytest.approx(min(val[:-2]), abs=spec.es_min_delta)


def test_awkward_rows(spark):
    df = spark.createDataFrame([("a", [], 0), ("b", None, 1), ("c", [1], 1), ("c", [1], 1), ("d", [5] * 5000, 0)], "file string, tokens array<int>, y int")
    model, history = nn.fit(df, SPEC, workers=4)
    assert history.count() >= 1 and nn.predict(df, model, SPEC).count() == 5
    with pytest.raises(ValueError, match="no rows"):
        nn.fit(df.filter("y > 1"), SPEC)
    with pytest.raises(ValueError, match="parameters"):
        nn.fit(df, nn.SequenceSpec(vocab_size=10_000_000))


def test_a_step_holds_gradients_of_few_rows():
    """What a step over all rows holds is bounded by the vocabulary, not by the rows; sums stay the same."""
    import tracemalloc

    spec = nn.SequenceSpec(vocab_size=50)
    rnd = np.random.default_rng(2)
    held = [(i, rnd.integers(0, 50, 12), float(i % 2)) for i in range(4000)]
    w = nn.initial(spec)
    tracemalloc.start()
    loss, dense, ids, embed = nn._summed(held, w, spec, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # the gradients of all rows are 80 MB
    want, total = np.zeros((50, spec.embed_dim), np.int64), 0
    for _, x, y in held:
        one, _, (at, rows_) = nn.gradient(w, x, y, spec)
        np.add.at(want, at, np.rint(rows_ * nn.UNIT).astype(np.int64))
        total += int(round(one * nn.UNIT))
    assert loss == total and list(ids) == sorted(set(ids)) and (want[ids] == embed).all() and not want[np.setdiff1d(np.arange(50), ids)].any()


def test_rows_of_an_arrow_column():
    import pyarrow as pa

    lists = pa.array([[9], [1, 2], None, [], [3, 1 << 40]], pa.list_(pa.int64())).slice(1)
    assert [list(x) for x in nn._id_rows(lists)] == [[1, 2], [], [], [3, 1 << 40]]
    assert nn._narrow(np.array([1, 2])).dtype == np.int32 and nn._narrow(np.array([1 << 40]))[0] == 1 << 40


def test_an_exchange_is_bounded_whatever_the_vocabulary(monkeypatch):
    """Above the bound the embedding's gradients go in several exchanges, and the model stays the same."""
    spec = nn.SequenceSpec(vocab_size=5000, embed_dim=16, max_epochs=2)
    rnd = np.random.default_rng(5)
    data = [(i, rnd.integers(0, 5000, 60), float(i % 2)) for i in range(60)]
    sizes = []

    def gather(x):
        sizes.append(len(pickle.dumps(x, protocol=5)))
        return [x]

    once = list(nn.train(data, 50, 10, spec, gather))
    assert len(sizes) == 3 and max(sizes) > 200_000  # one exchange for each epoch and one for the last losses
    monkeypatch.setattr(nn, "EXCHANGED", 1 << 16)
    sizes.clear()
    often = list(nn.train(data, 50, 10, spec, gather))
    assert max(sizes) < 100_000
    assert [e["loss"] for e in once] == [e["loss"] for e in often]
    assert all((once[-1]["model"][k] == often[-1]["model"][k]).all() for k in once[-1]["model"])


def test_long_rows_are_cut_before_they_are_dealt(spark):
    df = spark.createDataFrame([(f"f{i}", [i % 7] * 30 + [7, 8][: i % 3], i % 2) for i in range(20)], "file string, tokens array<int>, y int")
    spec = nn.SequenceSpec(vocab_size=12, embed_dim=3, conv_filters=4, conv_kernel_size=3, max_epochs=1, max_length=4)
    short = df.selectExpr("file", "slice(tokens, -4, 4) AS tokens", "y")
    one, two = nn.fit(df, spec, workers=2)[0], nn.fit(short, spec, workers=2)[0]
    assert all((one[k] == two[k]).all() for k in one)
