"""Language identification with a string kernel.

Kernel: blended-spectrum presence, ``k(x, y)`` = distinct n-grams (1 to 3 characters, lower-cased,
a space at either end) that x and y share, over the geometric mean of how many each has.
Nystroem: ``LANDMARKS`` training texts per language span the feature space; kernel ridge regression
against the rest is solved per language in that space.  Scoring is two matrix products per batch:
presence of the landmarks' n-grams times the landmarks, times the weights.

Training: a bounded sample, about ``PER_LANGUAGE`` labelled texts of each language (drawn by a hash
of doc_id among rows that are not held out, in proportion to the language's count).

Cases: null text or text without a letter is ``und`` with score 0; with no labelled row at all every
text is ``und``; repeated rows are predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusrisk.llm.common import held_out, row_number

PER_LANGUAGE = 500
LANDMARKS = 32
RIDGE = 1e-2
BATCH_DOCS = 256
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """Sorted distinct 1-, 2- and 3-grams of a text as 64-bit codes (21 bits per character; the
    shorter ones follow from the longer ones, so one sort serves all three)."""
    c = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    three = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    two = _distinct(three >> 21, c[-2] << 21 | c[-1])
    one = _distinct(two >> 21, c[-1])
    return np.concatenate([one, two, three])  # codes of fewer characters are smaller: sorted


def _distinct(ordered: np.ndarray, last: np.int64) -> np.ndarray:
    at = np.searchsorted(ordered, last)
    if at == len(ordered) or ordered[at] != last:
        ordered = np.insert(ordered, at, last)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class KernelModel:
    languages: list[str]
    vocabulary: np.ndarray  # sorted codes of all landmarks
    landmarks: np.ndarray  # n-grams x landmarks, presence over the root of the landmark's size
    weights: np.ndarray  # landmarks x languages

    def kernel(self, texts: list[str]) -> np.ndarray:
        present = np.zeros((len(texts), len(self.vocabulary)), dtype=np.float32)
        size = np.empty(len(texts))
        for i, t in enumerate(texts):
            g = grams(t)
            at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
            present[i, at[self.vocabulary[at] == g]] = 1
            size[i] = len(g)
        return (present @ self.landmarks).astype(np.float64) / np.sqrt(size)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        out = self.kernel(texts) @ self.weights
        best = out.argmax(1)
        # one-versus-rest targets are 1 and -1
        return [self.languages[b] for b in best], np.clip((out[np.arange(len(best)), best] + 1) / 2, 0, 1)


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in labels])
    chosen = [i for k in range(len(languages)) for i in np.flatnonzero(y == k)[:landmarks]]
    own = [grams(texts[i]) for i in chosen]
    vocabulary = np.unique(np.concatenate(own))
    presence = np.zeros((len(vocabulary), len(own)), dtype=np.float32)
    for j, g in enumerate(own):
        presence[np.searchsorted(vocabulary, g), j] = 1 / np.sqrt(len(g))
    model = KernelModel(languages, vocabulary, presence, np.zeros((len(own), len(languages))))
    between = presence.T.astype(np.float64) @ presence
    value, vector = np.linalg.eigh(between)
    keep = value > 1e-8 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    phi = np.vstack([model.kernel(texts[s : s + BATCH_DOCS]) for s in range(0, len(texts), BATCH_DOCS)]) @ whiten
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # languages weigh the same, however many rows the sample has of each
    w = (1 / np.bincount(y, minlength=len(languages)))[y][:, None]
    w = w / w.mean()
    model.weights = whiten @ np.linalg.solve(phi.T @ (w * phi) + ridge * len(texts) * np.eye(phi.shape[1]), phi.T @ (w * target))
    return model


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(text, lang): about ``per_language`` rows of each language, drawn by hash, none held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("doc_id")).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in docs.filter(F.col("lang").isNotNull() & ~held_out("doc_id")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.select("text", "lang", "doc_id").limit(0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / (1 << 30)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))]), F.col("lang"))
    return rows.filter(draw < share).select("text", "lang", "doc_id")


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    # bounded: about ``per_language`` texts a language
    sample = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["text"]) for r in training_sample(docs, per_language).collect())
    return fit([x[3] for x in sample], [x[2] for x in sample], landmarks, ridge)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rid_col: str | None = None) -> DataFrame:
    """rid (the row number in ``rid_col``, or one of this scan), doc_id, held_out, lang_pred and score."""
    one = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = one.sparkSession.sparkContext.broadcast(train(one, per_language, landmarks, ridge))
    rows = docs.select(row_number(rid_col), F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = model.value
        for batch in batches:
            for s in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(s, BATCH_DOCS)
                texts = part.column(3).to_pylist()
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                good = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
                if good:
                    names, value = m.predict([texts[i] for i in good])
                    score[good] = value
                    for i, n in zip(good, names):
                        lang[i] = n
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(lang), pa.array(score)], names=["rid", "doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, f"rid long, doc_id {kind}, held_out boolean, lang_pred string, score double")
