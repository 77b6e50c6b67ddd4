"""A quality classifier: regularised quadratic discriminant analysis of document statistics.

Statistics of the whole text are transformed to be near normal; each class has a mean and
a covariance shrunk towards the pooled one and its diagonal. The score is the logistic of
the difference of the classes' log densities (Mahalanobis distances through Cholesky
factors, inverted once) and log priors.

Fitting reads at most about ``sample`` labelled rows, chosen by a hash of the id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share, small_batches

_CLASS = np.zeros(256, np.int64)
for _n, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()", b"!?", b"*#$%&@^~=+_<>{}[]\\/`", b"|"), start=1):
    _CLASS[list(_set)] = _n
_CLASS[128:] = 10


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; an empty one has zeros."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 11)
    words = data.split()
    k = len(words)
    if not k:
        return [0.0] * 16
    seen = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    p = counts[counts > 0] / n
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    part = lambda c: float(c) / n
    root = lambda x: float(np.sqrt(x))
    return [
        np.log1p(k),
        root(kinds[2] / max(1.0, kinds[1] + kinds[2])),
        root(part(kinds[3])),
        root(part(kinds[6])),
        root(part(kinds[7])),
        root(part(kinds[8])),
        root(part(kinds[9])),
        root(part(kinds[4])),
        root(part(kinds[5])),
        np.log(len(seen) / k),
        root(seen.most_common(1)[0][1] / k),
        root(repeats / k),
        np.log((pairs + 1) / k),
        np.log((n - kinds[4] - kinds[5]) / k),
        1.0 - len(set(lines)) / len(lines),
        float(-(p * np.log(p)).sum()),
    ]


@dataclass
class Discriminant:
    means: np.ndarray  # class 0 and 1
    whiten: np.ndarray  # inverse Cholesky factors
    constant: np.ndarray  # log prior less half the log determinant

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for rows of statistics."""
        density = []
        for c in (0, 1):
            z = (x - self.means[c]) @ self.whiten[c].T
            density.append(self.constant[c] - 0.5 * (z * z).sum(axis=1))
        return 1.0 / (1.0 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1) -> Discriminant:
    """One class without rows gets the other's shape and a small prior."""
    d = x.shape[1]
    if not len(x):
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    centre = np.stack([x[y == c].mean(axis=0) if (y == c).any() else x.mean(axis=0) for c in (0, 1)])
    pooled = (x - centre[y]).T @ (x - centre[y]) / max(1, len(x) - 2)
    scale = np.diag(pooled).mean() or 1.0
    whiten, constant = [], []
    for c in (0, 1):
        own = x[y == c] - centre[c]
        s = own.T @ own / max(1, len(own) - 1)
        s = (1 - shrink) * s + shrink * (0.5 * pooled + 0.5 * np.diag(np.diag(pooled))) + 1e-4 * scale * np.eye(d)
        factor = np.linalg.cholesky(s)
        whiten.append(np.linalg.inv(factor))
        constant.append(np.log((len(own) + 1) / (len(x) + 2)) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, np.stack(whiten), np.array(constant))


def _features(texts: Iterator[pa.Array]) -> Iterator[list[list[float]]]:
    for array in texts:
        rows: list[list[float]] = []
        for at in range(0, len(array), 256):
            rows += [statistics(t) for t in array.slice(at, 256).to_pylist()]
        yield rows


def labelled(docs: DataFrame, labels: DataFrame, label: str, trains: Column, doc_id: str, bounds: dict[int, int]) -> DataFrame:
    """(__id, __label, and docs' columns) of about so many rows of each class; the label side is bounded, so it is broadcast."""
    known = labels.where(F.col(label).isin(list(bounds)) & F.col(doc_id).isNotNull() & trains).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label"))
    sizes = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    chosen = F.lit(False)
    for c, n in sizes.items():
        chosen = chosen | ((F.col("__label") == c) & share(F.col("__id"), min(1.0, bounds[c] / n)))
    return docs.join(F.broadcast(known.where(chosen)), docs[doc_id] == F.col("__id"))


def train(docs: DataFrame, labels: DataFrame, trains: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = 12_000, shrink: float = 0.1) -> Discriminant:
    """Fit on about ``sample`` labelled rows at most, the classes in their proportions.

    ``trains`` is a condition on the labels' id. Null labels and ids do not train.
    """
    n = labels.where(trains & F.col(label).isin([0, 1])).groupBy(label).count().collect()
    total = sum(r["count"] for r in n)
    bounds = {int(r[label]): max(1, round(sample * r["count"] / max(total, 1))) for r in n} or {0: 1}

    @F.arrow_udf("array<double>")
    def features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in _features(texts):
            yield pa.array(rows, pa.list_(pa.float64()))

    chosen = labelled(docs.select(doc_id, F.col(text).alias("__text")), labels, label, trains, doc_id, bounds)
    rows = sorted((r["i"], r["y"], r["x"]) for r in chosen.select(F.col("__id").alias("i"), F.col("__label").alias("y"), features("__text").alias("x")).collect())
    x = np.array([r[2] for r in rows], float).reshape(len(rows), -1 if rows else 16)
    return fit(x, np.array([r[1] for r in rows], int), shrink)


def score(docs: DataFrame, model: Discriminant, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score of every row; null texts count as empty. Repeated rows score alike; other columns are not read."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in _features(texts):
            yield pa.array(shared.value.score(np.array(rows).reshape(len(rows), 16)), pa.float64())

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("score"))
