"""``ml_sequence`` and ``ml_history``: a convolutional sequence classifier, trained by synchronous
data-parallel gradient steps in Spark's barrier mode.

Model: token embedding -> convolution (kernel, stride, rectified) -> maximum over all positions ->
dropout -> one sigmoid unit; weighted cross-entropy, Adam.  It stands for the reference's
convolutional recurrent network: the pooling over the whole length takes the recurrent layer's place.

Training: rows are numbered in a random order, the last tenth is the validation part.  Every barrier task
holds the rows it was dealt and a replica of the parameters.  A step takes one batch of all rows, wherever
they are: each task adds up the gradients of its own rows of the batch, the tasks exchange the sums by
``allGather``, and all apply the same update.  Gradients of single rows are rounded to whole multiples of
2^-40 and added as integers, so that the model does not depend on how rows are dealt.  Training stops early
when the validation loss has not improved for some epochs; losses per epoch come back as a table.  An
exchange takes about a second whatever it carries (Spark looks for its end once a second), so steps are
large: by default one per epoch, over all rows, with the validation sums in the same exchange.

Every task gets the messages of all.  The gradients of the embedding grow with the vocabulary, so above
``EXCHANGED`` bytes they are exchanged and applied one range of token ids after another; the ranges follow
from the numbers of entries, which all tasks exchange first.

Parameters are bounded by the vocabulary, which its thresholds bound; ``MAX_PARAMETERS`` is checked.  A
task's memory holds its share of the token ids; more data asks for more tasks (``workers``).
"""

from __future__ import annotations

import base64
import math
import pickle
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.functions import rand
from corpusrisk.operators import models as md
from corpusrisk.operators.prefix import dense_index
from corpusrisk.session import ensure_checkpoint_dir, pin

MAX_PARAMETERS = 20_000_000
UNIT = float(1 << 40)  # whole parts of a gradient entry
HELD = 1 << 14  # token ids whose embedding gradients are held before they are added up
EXCHANGED = 24 << 20  # bytes of embedding gradients, of all tasks together, that one exchange carries
RANGE = 256  # neighbouring token ids whose entries go into one exchange


@dataclass(frozen=True)
class SequenceSpec:
    """Hyperparameters; the defaults are plain choices, every one is an argument."""

    vocab_size: int
    embed_dim: int = 16
    conv_filters: int = 32
    conv_kernel_size: int = 5
    conv_strides: int = 1
    batch_size: int | None = None  # rows of a step; None: all
    max_length: int = 2048
    dropout: float = 0.0
    class_weight: dict = field(default_factory=lambda: {0: 1.0, 1: 1.0})
    es_min_delta: float = 0.0001
    es_patience: int = 2
    max_epochs: int = 50
    learning_rate: float = 0.02
    validation_split: float = 0.1
    seed: int = 1


def initial(spec: SequenceSpec) -> dict[str, np.ndarray]:
    rnd = np.random.default_rng(spec.seed)
    e, k, f = spec.embed_dim, spec.conv_kernel_size, spec.conv_filters
    bound = math.sqrt(6.0 / (k * e + f))
    w = {
        "embed": rnd.uniform(-0.05, 0.05, (spec.vocab_size, e)),
        "kernel": rnd.uniform(-bound, bound, (k * e, f)),
        "bias": np.zeros(f),
        "out": rnd.uniform(-math.sqrt(6.0 / (f + 1)), math.sqrt(6.0 / (f + 1)), f),
        "shift": np.zeros(1),
    }
    if sum(x.size for x in w.values()) > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} parameters; raise the vocabulary's thresholds")
    return w


def prepared(ids, spec: SequenceSpec) -> np.ndarray:
    """The last ``max_length`` ids, at least one kernel long (zeros in front)."""
    x = np.asarray(ids if ids is not None else [], dtype=np.int64)[-spec.max_length :]
    return np.concatenate([np.zeros(max(0, spec.conv_kernel_size - len(x)), np.int64), x])


def _id_rows(lists: pa.Array):
    """The id arrays of an Arrow column one by one, never as Python numbers; a null one is empty."""
    edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    flat = lists.flatten().to_numpy()
    return (flat[lo:hi] for lo, hi in zip(edges[:-1], edges[1:]))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same ids in half the bytes where they fit."""
    small = x.astype(np.int32)
    return small if (small == x).all() else x


def _forward(w: dict, x: np.ndarray, spec: SequenceSpec):
    places = np.arange(0, len(x) - spec.conv_kernel_size + 1, spec.conv_strides)
    at = x[places[:, None] + np.arange(spec.conv_kernel_size)]  # token ids under the kernel
    conv = w["embed"][at].reshape(len(places), -1) @ w["kernel"] + w["bias"]
    best = conv.argmax(axis=0)
    top = np.maximum(conv[best, np.arange(conv.shape[1])], 0.0)
    return at, best, top


def logit(w: dict, x: np.ndarray, spec: SequenceSpec) -> float:
    return float(_forward(w, x, spec)[2] @ w["out"] + w["shift"][0])


def cross_entropy(z: float, y: float) -> float:
    return math.log1p(math.exp(-abs(z))) + max(z, 0.0) - y * z


def gradient(w: dict, x: np.ndarray, y: float, spec: SequenceSpec, keep: np.ndarray | None = None):
    """Weighted loss of one row and its gradient; that of the embedding as (ids, rows)."""
    at, best, top = _forward(w, x, spec)
    scale = keep / (1.0 - spec.dropout) if keep is not None else np.ones_like(top)
    z = float((top * scale) @ w["out"] + w["shift"][0])
    weight = float(spec.class_weight[int(y)])
    dz = weight * (1.0 / (1.0 + math.exp(-z)) - y) if z > -700 else -weight * y
    d_top = dz * w["out"] * scale * (top > 0)
    ids = at[best]  # (filters, kernel size)
    under = w["embed"][ids].reshape(len(best), -1)
    g = {"kernel": under.T * d_top, "bias": d_top, "out": dz * top * scale, "shift": np.array([dz])}
    rows = (w["kernel"].T * d_top[:, None]).reshape(-1, spec.embed_dim)
    return weight * cross_entropy(z, y), g, (ids.ravel(), rows)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * UNIT).astype(np.int64)


def _folded(ids: np.ndarray, sums: np.ndarray, at: list, values: list) -> tuple[np.ndarray, np.ndarray]:
    """Sums by token id with some more entries added; ids rising."""
    out, inverse = np.unique(np.concatenate([ids, *at]), return_inverse=True)
    total = np.zeros((len(out), sums.shape[1]), np.int64)
    np.add.at(total, inverse, np.concatenate([sums, *values]))
    return out, total


def _summed(rows, w: dict, spec: SequenceSpec, epoch: int):
    """Whole sums of losses and gradients of some rows ``(number, ids, label)``.  Gradients of few rows are held
    at a time; what stays is one entry per token id."""
    loss, dense, at, values, held = 0, {k: np.zeros(v.shape, np.int64) for k, v in w.items() if k != "embed"}, [], [], 0
    ids, embed = np.zeros(0, np.int64), np.zeros((0, spec.embed_dim), np.int64)
    for number, x, y in rows:
        keep = np.random.default_rng([spec.seed, epoch, number]).random(spec.conv_filters) >= spec.dropout if spec.dropout else None
        one, g, (under, e) = gradient(w, x, y, spec, keep)
        loss += int(round(one * UNIT))
        for k, v in g.items():
            dense[k] += _whole(v)
        at.append(under)
        values.append(_whole(e))
        held += len(under)
        if held >= max(HELD, len(ids) // 2):
            ids, embed = _folded(ids, embed, at, values)
            at, values, held = [], [], 0
    if at:
        ids, embed = _folded(ids, embed, at, values)
    return loss, dense, ids, embed


class _Adam:
    def __init__(self, w: dict, rate: float):
        self.rate, self.step = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def apply(self, w: dict, g: dict) -> None:
        """Begin a step with the gradients of some parameters."""
        self.step += 1
        for k, x in g.items():
            self.move(w, k, slice(None), x)

    def move(self, w: dict, k: str, at: slice, x: np.ndarray) -> None:
        """The step of some rows of parameter ``k``."""
        m, v = self.m[k][at], self.v[k][at]
        m += 0.1 * (x - m)
        v += 0.001 * (x * x - v)
        w[k][at] -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-7)


def _spans(entries: np.ndarray, each: int, n: int) -> list[tuple[int, int]]:
    """Ranges of token ids 0 to ``n`` - 1, each with at most ``EXCHANGED`` bytes of entries or ``RANGE`` ids;
    ``entries``: how many all tasks have in every ``RANGE`` ids."""
    out, first, held = [], 0, 0
    for i, c in enumerate(entries.tolist()):
        if held and (held + c) * each > EXCHANGED:
            out.append((first * RANGE, i * RANGE))
            first, held = i, 0
        held += c
    return [*out, (first * RANGE, n)]


def shuffled(number: np.ndarray, n: int, epoch: int, seed: int) -> np.ndarray:
    """Each row's place in the epoch's order: an affine map of 0 to n - 1 onto itself."""
    rnd = np.random.default_rng([seed, epoch, n])
    factor = int(rnd.integers(1, n + 1))
    while math.gcd(factor, n) != 1:
        factor += 1
    shift = int(rnd.integers(n))
    return np.array([(int(i) * factor + shift) % n for i in number], dtype=np.int64)


def train(rows, n_train: int, n_valid: int, spec: SequenceSpec, gather, tasks: int = 1, keeps: bool = True):
    """Train on this task's ``rows`` (number, ids, label); ``gather`` exchanges one object with all ``tasks``.
    Yields one dict per epoch; the last one carries the best parameters, if this task ``keeps`` them."""
    own = [r for r in rows if r[0] < n_train]
    tail = [r for r in rows if r[0] >= n_train]
    number = np.array([r[0] for r in own], dtype=np.int64)
    w = initial(spec)
    adam, best, waited, kept = _Adam(w, spec.learning_rate), math.inf, 0, w
    batch = min(spec.batch_size or n_train, n_train)
    loss = None
    each = 8 * (1 + spec.embed_dim)  # bytes of an entry of the embedding's gradient: id and row
    whole = spec.vocab_size * each * tasks <= EXCHANGED
    for epoch in range(spec.max_epochs + 1):
        # the validation sums of the epoch before travel with the first gradients of this one
        seen = [(logit(w, x, spec), y) for _, x, y in tail] if epoch else []
        checked = sum(int(round(cross_entropy(z, y) * UNIT)) for z, y in seen), sum((z > 0) == (y > 0) for z, y in seen)
        place = shuffled(number, n_train, epoch, spec.seed)
        order = np.argsort(place)
        edges = np.searchsorted(place[order], np.arange(0, n_train + batch, batch))
        total = 0
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            some, dense, ids, embed = _summed((own[i] for i in order[lo:hi]) if epoch < spec.max_epochs else [], w, spec, epoch)
            parts = gather((some, dense, (ids, embed) if whole else np.bincount(ids // RANGE, minlength=-(-spec.vocab_size // RANGE)), checked))
            if epoch and not b:
                val_loss = sum(p[3][0] for p in parts) / UNIT / n_valid if n_valid else loss
                val_accuracy = sum(p[3][1] for p in parts) / n_valid if n_valid else None
                if val_loss < best - spec.es_min_delta:
                    best, waited, kept = val_loss, 0, {k: v.copy() for k, v in w.items()} if keeps else None
                else:
                    waited += 1
                last = waited >= spec.es_patience or epoch == spec.max_epochs
                yield {"epoch": epoch - 1, "loss": loss, "val_loss": val_loss, "val_accuracy": val_accuracy, "model": kept if last else None}
                if last:
                    return
            size = min(batch, n_train - b * batch)
            adam.apply(w, {k: sum(p[1][k] for p in parts) / (UNIT * size) for k in dense})
            total += sum(p[0] for p in parts)
            for start, stop in [(0, spec.vocab_size)] if whole else _spans(sum(p[2] for p in parts), each, spec.vocab_size):
                at = np.searchsorted(ids, [start, stop])
                found = [p[2] for p in parts] if whole else gather((ids[at[0] : at[1]], embed[at[0] : at[1]]))
                for s in range(start, stop, max(1, EXCHANGED // each)):  # what a task adds up at a time
                    e = min(stop, s + max(1, EXCHANGED // each))
                    g = np.zeros((e - s, spec.embed_dim), np.int64)
                    for i, values in found:
                        x, y = np.searchsorted(i, [s, e])
                        g[i[x:y] - s] += values[x:y]
                    adam.move(w, "embed", slice(s, e), g / (UNIT * size))
            parts = found = ids = embed = None  # not held while the next gradients are added up
        loss = total / UNIT / n_train


def _gatherer(context):
    return lambda x: [pickle.loads(base64.b64decode(m)) for m in context.allGather(base64.b64encode(pickle.dumps(x, protocol=5)).decode())]


def fit(df: DataFrame, spec: SequenceSpec, workers: int | None = None, tokens: str = "tokens", y: str = "y", id_col: str = "file") -> tuple[dict[str, np.ndarray], DataFrame]:
    """Parameters and the history ``(epoch, loss, val_loss, val_accuracy)`` of a training on ``df``."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.col(tokens).cast("array<long>").alias("x"), F.col(y).cast("double").alias("y"))
    # of a long row only the last ids count, see prepared(); the place of a row follows from all of them
    last = F.slice("x", F.greatest(F.size("x") - spec.max_length + 1, F.lit(1)), F.lit(spec.max_length)).cast("array<int>")
    placed = rows.select("_id", rand.uniform(spec.seed, F.col("_id")).alias("_u"), F.hash("x", "y").alias("_h"), last.alias("x"), "y")
    numbered = pin(dense_index(placed, ["_u", "_id", "_h"], "number").select("number", "x", "y"))
    n = numbered.count()
    n_valid = int(n * spec.validation_split)
    n_train = n - n_valid
    if not n_train:
        raise ValueError("no rows to train on")
    initial(spec)  # refuses a vocabulary that is too large, before any task starts
    tasks = min(workers or spark.sparkContext.defaultParallelism, n)

    def run(batches):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        own = [(i, _narrow(prepared(x, spec)), t) for b in batches for i, x, t in zip(b.column(0).to_pylist(), _id_rows(b.column(1)), b.column(2).to_pylist())]
        first = context.partitionId() == 0
        for e in train(own, n_train, n_valid, spec, _gatherer(context), tasks, first):
            if first:
                model = pickle.dumps(e["model"]) if e["model"] else None
                yield pa.RecordBatch.from_pylist([{**e, "model": model}], schema=pa.schema([("epoch", pa.int32()), ("loss", pa.float64()), ("val_loss", pa.float64()), ("val_accuracy", pa.float64()), ("model", pa.binary())]))

    dealt = numbered.repartition(tasks, "number")
    # written once: a barrier stage cannot be read in parts
    columns = "epoch int, loss double, val_loss double, val_accuracy double, model binary"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/training-{uuid.uuid4().hex}"
    dealt.mapInArrow(run, columns, barrier=True).write.parquet(path)
    out = spark.read.schema(columns).parquet(path)
    model = pickle.loads(out.filter(F.col("model").isNotNull()).first()["model"])
    return model, out.drop("model")


def predict(df: DataFrame, model: dict[str, np.ndarray], spec: SequenceSpec, tokens: str = "tokens", y: str = "y", id_col: str = "file") -> DataFrame:
    """``(file, label, score)`` of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most MAX_PARAMETERS numbers

    def run(batches):
        for b in batches:
            z = np.array([logit(shared.value, prepared(x, spec), spec) for x in _id_rows(b.column(2))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(1.0 / (1.0 + np.exp(-z)), pa.float64())], names=["file", "label", "score"])

    rows = df.select(F.col(id_col).alias("file"), F.col(y).cast("double").alias("label"), F.col(tokens).cast("array<long>").alias("x"))
    return rows.mapInArrow(run, f"file {kind}, label double, score double")


def train_and_evaluate(train_rows: DataFrame, test_rows: DataFrame, spec: SequenceSpec, workers: int | None = None, tokens: str = "tokens") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(metrics, examples, history)``."""
    model, history = fit(train_rows, spec, workers, tokens)
    scored = pin(predict(test_rows, model, spec, tokens).withColumnRenamed("label", md.LABEL))
    return md.evaluate_scores(scored), scored, history
