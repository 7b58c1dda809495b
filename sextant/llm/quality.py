"""Compression classifier: how much better one dictionary compresses a text than the other.

Pairs of zstandard dictionaries are built from good and from bad labelled
texts, each pair from other texts.  A text is compressed in blocks with both
dictionaries of a pair; the difference of the two sizes per byte of text is
its feature, as a mean over the pairs, since what one dictionary happens to
hold varies (in rare languages above all).  A logistic curve, fitted on labelled texts that
no dictionary saw, turns the feature into a probability of the good label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import as_bytes, by_bytes, give_back, held_out, result_schema, unit_hash

BLOCK = 2048
DICTIONARY_BYTES = 112_640
#: Pairs of dictionaries at most, and labelled texts that a pair is built from at least.
PAIRS, PAIR_TEXTS = 8, 100
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    pairs: tuple[tuple[bytes, bytes], ...]  # of a good and a bad dictionary each
    slope: float
    offset: float

    def score(self, feature: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * feature + self.offset, -40, 40)))


class _Sizes:
    """Compressed sizes of whole texts, block by block, under the dictionaries."""

    def __init__(self, pairs: tuple[tuple[bytes, bytes], ...]):
        self.packers = []  # the good ones, then the bad ones
        for side in (0, 1):
            for pair in pairs:
                dictionary = zstandard.ZstdCompressionDict(pair[side])
                dictionary.precompute_compress(level=LEVEL)
                self.packers.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False))

    def feature(self, text: bytes) -> float:
        """(bytes under the bad dictionary - under the good one) / bytes; 0 for an empty text."""
        if not text:
            return 0.0
        blocks = [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]
        sizes = [sum(len(p.compress(b)) for b in blocks) for p in self.packers]
        n = len(sizes) // 2
        return (sum(sizes[n:]) - sum(sizes[:n])) / n / len(text)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """A curve in one feature by damped Newton steps, with smoothed targets so that separable samples stay finite."""
    n_good, n_bad = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    centre, scale = x.mean(), x.std() or 1.0
    X = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    penalty = np.array([ridge, 0.0])

    def loss(w):
        z = X @ w
        return np.logaddexp(0, z).sum() - target @ z + 0.5 * (penalty * w * w).sum()

    w = np.array([0.0, math.log((n_good + 1) / (n_bad + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -500, 500)))
        hessian = X.T @ (X * (p * (1 - p))[:, None]) + np.diag(penalty) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hessian, X.T @ (p - target) + penalty * w)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slope = w[0] / scale
    return float(slope), float(w[1] - slope * centre)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; raw content where there is too little text to train one."""
    blocks = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, blocks)) // 8)), blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b"\0" * 8


def train(docs: DataFrame, labels: DataFrame, per_label: int = 4000, max_bytes: int = 16_384, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "quality") -> CompressionModel:
    """Fit on at most about ``per_label`` labelled texts of each label, none longer than ``max_bytes``.

    That bounded sample is taken by a hash of the id from labelled rows
    outside the held-out fold.  Half of it builds the dictionaries, the other
    half the curve.  Null labels, ids and texts are not learned from; with a
    label missing altogether, the curve only knows the share of each.
    """
    usable = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
              .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct())
    found = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = F.element_at(F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, per_label / max(1, found.get(k, 0)))]), F.col("label"))
    chosen = F.broadcast(usable.where(unit_hash("id") < share).limit(4 * per_label))  # so few rows
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
              .where(F.octet_length("text").between(1, max_bytes))
              .select("label", "text", unit_hash(F.lit("half"), "id").alias("u")))
    rows = sample.orderBy("u").limit(4 * per_label).collect()
    return fit([(r["text"].encode(), r["label"], r["u"]) for r in rows])


def fit(rows: list[tuple[bytes, int, float]]) -> CompressionModel:
    """From (text, label, number in [0, 1)) rows; those below a half build the dictionaries."""
    half = [r for r in rows if r[2] < 0.5]
    n = max(1, min(PAIRS, len(half) // PAIR_TEXTS))
    pairs = tuple(tuple(_dictionary([t for t, label, u in half if label == k and int(2 * n * u) == e]) for k in (1, 0)) for e in range(n))
    sizes = _Sizes(pairs)
    rest = [(sizes.feature(t), label) for t, label, u in rows if u >= 0.5]
    x, y = (np.array([r[k] for r in rest], dtype=float) for k in (0, 1))
    slope, offset = _logistic(x, y) if len(rest) else (0.0, 0.0)
    return CompressionModel(pairs, slope, offset)


def score(docs: DataFrame, model: CompressionModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``(keep or id .., held_out, score, predicted)`` per row; only the text decides the score.

    A null or empty text has feature 0 and so the curve's offset as its
    score.  Texts of any length are compressed whole, block by block.
    Repeated rows, null ids and columns of any name pass through.
    """
    keep = keep or [id_col]
    held = [F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]
    rows = docs.select(*held, held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("t"))
    names = [f"c{k}" for k in range(len(keep))]
    schema = result_schema(docs, dict(zip(names, keep)), "held_out boolean, score double, predicted int")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of fixed size and number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = _Sizes(m.pairs)
        for batch in by_bytes(batches, "t"):
            x = np.array([sizes.feature(t or b"") for t in as_bytes(batch.column(batch.num_columns - 1))], dtype=float)
            p = m.score(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                [*names, "held_out", "score", "predicted"])
        del sizes  # its compressors' memory is the worker's until it is given back
        give_back()

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "held_out", "score", "predicted")
