"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed in one pass over whole texts and staged (a few numbers per document).
Training bins each statistic into at most ``BINS`` quantile bins and grows complete trees level by
level from gradient histograms (logistic loss).  Trees are flattened into arrays - feature and
threshold by node, value by leaf - and scoring walks all rows of a batch through all trees with
array indexing, one step per level.

Training rows: a bounded sample, about ``TRAIN_ROWS`` labelled rows drawn by a hash of doc_id, none
of them held out.

Cases: null text is the empty text and gets a score like any other; null labels are not used;
repeated rows are scored alike; with no labelled row every score is 0.5; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.llm.common import held_out, id_text, stage

TRAIN_ROWS = 20_000
BINS, DEPTH, TREES, RATE, L2, MIN_HESSIAN = 64, 4, 80, 0.15, 1.0, 2.0
THRESHOLD = 0.7

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "loud": b"!?",
    "stop": b".",
    "comma": b",;:",
    "mark": b"@/\\_=+~^{}[]()\"'",
    "space": b" \t\x0b\x0c\r",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
_TABLE = np.zeros((256, len(_CLASSES)), dtype=np.int64)
for _i, _chars in enumerate(_CLASSES.values()):
    _TABLE[list(_chars), _i] = 1
FEATURES = [
    "log_bytes", "log_words", "log_lines", *(f"share_{k}" for k in _CLASSES),
    "word_bytes", "word_bytes_sd", "long_words", "short_words", "distinct_words", "top_word", "top_five_words", "repeated_next",
    "line_bytes", "distinct_lines", "top_line", "ends_in_stop", "words_with_symbol", "packed",
]


def statistics(text: str) -> list[float]:
    """The numbers of ``FEATURES`` for one whole text."""
    raw = text.encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, dtype=np.int64)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, ln = max(1, len(words)), max(1, len(lines))
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, dtype=np.int64)
    by_word = Counter(words)
    top = [c for _, c in by_word.most_common(5)] or [0]
    by_line = Counter(lines)
    ends = sum(x.endswith((b".", b"!", b"?")) for x in by_line) / max(1, len(by_line))
    with_symbol = sum(c for x, c in by_word.items() if not x.isalnum() and x.strip(b"#*$%&|<>") != x)
    # compressed a megabyte at a time, so that memory stays bounded
    packer = zlib.compressobj(1)
    packed = sum(len(packer.compress(raw[s : s + (1 << 20)])) for s in range(0, n, 1 << 20)) + len(packer.flush())
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *(counts @ _TABLE / max(1, n)),
        size.mean(), size.std(), (size > 15).mean(), (size < 2).mean(), len(by_word) / w, top[0] / w, sum(top) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        n / ln, len(by_line) / ln, max(by_line.values(), default=0) / ln, ends, with_symbol / w, packed / max(1, n),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, doc_id and x (array<float>, ``FEATURES``) of each row."""
    one = id_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    kind = one.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(2)], dtype=np.float32).reshape(-1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(x))], names=["rid", "doc_id", "x"])

    return one.mapInArrow(run, f"rid long, doc_id {kind}, x array<float>")


@dataclass
class Trees:
    """Complete trees of one depth: node ``i`` has children ``2i+1`` (value <= threshold) and ``2i+2``."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        at_tree = np.arange(trees)
        for s in range(0, len(x), 2000):
            part = x[s : s + 2000]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), trees), dtype=np.int64)
            while inner and node[0, 0] < inner:
                right = part[rows, self.feature[at_tree, node]] > self.threshold[at_tree, node]
                node = 2 * node + 1 + right
            out[s : s + 2000] += self.value[at_tree, node - inner].sum(1)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boosted trees for labels 0 and 1 (no rows: score 0.5; one class: its smoothed share)."""
    inner, leaves = 2**depth - 1, 2**depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if len(y) == 0 or y.min() == y.max():
        return model
    features = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(features)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(features)], axis=1)  # bin <= c: value <= cuts[c]
    flat = binned + np.arange(features) * bins
    margin = np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width = 2**level
            key = (node[:, None] * (features * bins) + flat).ravel()
            shape = (width, features, bins)
            g = np.bincount(key, np.repeat(grad, features), width * features * bins).reshape(shape).cumsum(2)
            h = np.bincount(key, np.repeat(hess, features), width * features * bins).reshape(shape).cumsum(2)
            gt, ht = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + L2) + (gt - g) ** 2 / (ht - h + L2) - gt**2 / (ht + L2)
            gain[(h < MIN_HESSIAN) | (ht - h < MIN_HESSIAN)] = 0
            best = gain.reshape(width, -1).argmax(1)
            f, b = best // bins, best % bins
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for k in np.flatnonzero(split):
                model.feature[t, width - 1 + k] = f[k]
                model.threshold[t, width - 1 + k] = cuts[f[k]][b[k]]
            right = split[node] & (binned[np.arange(len(y)), f[node]] > b[node])
            node = 2 * node + right
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        model.value[t] = rate * g / (h + L2)
        margin += model.value[t][node]
    return model


def training_rows(stats: DataFrame, labels: DataFrame, label_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, x, y) of about ``rows`` labelled documents, none held out."""
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out("doc_id")).select("doc_id", F.col(label_col).cast("int").alias("y"))
    share = min(1.0, rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / (1 << 30)
    return stats.join(known.filter(draw < share), "doc_id").select("doc_id", "x", "y")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """rid, doc_id, held_out, score and predicted of each row of ``docs``."""
    stats = stage(document_statistics(docs), "statistics")
    # bounded: about ``rows`` short arrays; sorted, so that the fit does not depend on their order
    sample = sorted((r["doc_id"], r["y"], r["x"]) for r in training_rows(stats, labels, label_col, rows).collect())
    x = np.array([s[2] for s in sample], dtype=np.float32).reshape(-1, len(FEATURES))
    trees = stats.sparkSession.sparkContext.broadcast(fit(x, np.array([s[1] for s in sample], dtype=np.float64)))

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        return pd.Series(trees.value.score(np.stack(column.to_numpy()).astype(np.float32)) if len(column) else [], dtype="float64")

    return stats.select("rid", "doc_id", held_out("doc_id").alias("held_out"), score("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
