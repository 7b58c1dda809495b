"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters are hashed into a fixed number of
features.  Document frequencies count every learnable document.  The weights
come from follow-the-regularised-leader with an elastic-net penalty (many are
exactly zero) over a bounded sample, and one temperature, fitted on a part of
the sample that the weights did not see, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import by_bytes, held_out, unit_hash

BITS = 15
N_FEATURES = 1 << BITS
#: Characters of a long text that are counted at a time.
SLICE = 1 << 20
_MIX = np.uint32(0x9E3779B1)
UNKNOWN = "und"


def feature_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of one to three lower-case characters occurs in the whole text."""
    counts = np.zeros(N_FEATURES, dtype=np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(text), SLICE):
            c = np.frombuffer(text[max(0, at - 2):at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
            two = c[:-1] * np.uint32(0x01000193) + c[1:]
            three = two[:-1] * np.uint32(0x01000193) + c[2:]
            new = min(2, at)  # characters of the slice before, for n-grams across the cut
            for n, grams in ((1, c[new:]), (2, two[max(0, new - 1):]), (3, three)):
                counts += np.bincount(((grams + np.uint32(n * 0x3C6EF372)) * _MIX) >> np.uint32(32 - BITS), minlength=N_FEATURES)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tf_idf(feature_counts(text), self.idf)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.vector(text)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = _softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return at, x / norm if norm else x


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of follow-the-regularised-leader over (feature ids, values, class) rows."""
    z, n = (np.zeros((N_FEATURES + 1, n_classes)) for _ in range(2))  # the last feature is the bias

    def weights(at):
        zs = z[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, N_FEATURES), np.append(x, 1.0)
            w = weights(at)
            g = _softmax(x @ w)
            g[y] -= 1
            g = x[:, None] * g
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(N_FEATURES + 1))
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss, by golden-section search on its logarithm."""
    def loss(t):
        return -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """In how many documents each feature occurs; the last entry is the number of documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(N_FEATURES + 1, dtype=np.int64)
        for batch in by_bytes(batches, "t"):
            for text in batch.column(0).to_pylist():
                df[:-1] += feature_counts(text) > 0
                df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["feature", "n"])

    sums = docs.select(F.col(text_col).alias("t")).mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    df = np.zeros(N_FEATURES + 1, dtype=np.int64)
    for r in sums.collect():  # one row per feature at most
        df[r["feature"]] = r["n"]
    return df


def train(docs: DataFrame, per_language: int = 500, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> LanguageModel:
    """Fit the weights on about ``per_language`` documents of each language, none over ``max_chars`` characters.

    That bounded sample is taken by a hash of the id outside the held-out
    fold; document frequencies count all documents there.  Rows with a null
    or empty text, language or id are not learned from.
    """
    learn = (docs.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
             .select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    found = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(found)
    if not languages:
        return LanguageModel([], np.ones(N_FEATURES), np.zeros((N_FEATURES, 0)), np.zeros(0), 1.0)
    df = document_frequencies(learn)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, per_language / found[k])]), F.col("lang"))
    rows = (learn.where((unit_hash("id") < share) & (F.length("text") <= max_chars))
            .select("text", "lang", unit_hash(F.lit("part"), "id").alias("u")).orderBy("u")
            .limit(2 * per_language * len(languages)).collect())
    examples = [(*tf_idf(feature_counts(r["text"]), idf), languages.index(r["lang"]), r["u"]) for r in rows if has_letter(r["text"])]
    weights, bias = ftrl([e[:3] for e in examples if e[3] < 0.8], len(languages))
    rest = [e for e in examples if e[3] >= 0.8]
    temperature = 1.0
    if rest:
        temperature = _temperature(np.array([x @ weights[at] + bias for at, x, _, _ in rest]), np.array([e[2] for e in rest]))
    return LanguageModel(languages, idf, weights, bias, temperature)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` per row, from the whole text alone.

    A null text or one without letters is ``und`` with score 0, as is every
    text where no language was learned.  Repeated rows and null ids are
    predicted row by row; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed number of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in by_bytes(batches, "t"):
            found = [m.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {id_type}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
