"""Quality classifier: naive Bayes support vectors (Wang and Manning) on n-gram indicators.

n-grams are the words of a text and the 1-, 2- and 3-grams of its shapes, where the shape of a chunk between white space is its run of
letter cases, digits and punctuation, or '=' if it repeats the chunk before it. The indicator of an n-gram is scaled
by its log-count ratio between the classes, a linear hinge-loss model is fitted by dual coordinate descent, and its weights are
interpolated with their mean magnitude. The score is the logistic function of the margin.

The model is fitted on at most `fit_rows` labelled documents and FIT_BYTES of their n-grams (documented bounds); all documents are
scored, whole, where they lie. The weights are one number for each of BUCKETS hash buckets.

Defined cases: null and empty texts have no n-gram and get the score of the bias; without labels of both classes every text
gets the share of label 1 (0.5 without any label); repeated rows are each scored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .labelled import labelled_sample, sample_features, score_texts
from .tokens import slices

BUCKETS = 1 << 18
FIT_ROWS = 8000
SHAPE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")


def shape_of(chunk: str) -> str:
    """Letters by case (a, A for a capital first, U for capitals only), digits as 9, punctuation as it is, runs once."""
    out = []
    for part in SHAPE.findall(chunk):
        if part[0].isalpha():
            kind = "U" if len(part) > 1 and part.isupper() else "A" if part[0].isupper() else "a"
        else:
            kind = "9" if part[0].isdigit() else part
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:4])


class NGrams:
    """The hash buckets of a text's n-grams; remembers chunks up to a bound."""

    def __init__(self, limit: int = 300_000):
        self.chunks: dict[str, tuple[str, int]] = {}
        self.buckets: dict = {}
        self.limit = limit

    def bucket(self, *gram: str) -> int:
        return xxhash.xxh64_intdigest("\0".join(gram)) % BUCKETS

    def __call__(self, text: str) -> set[int]:
        chunks = text.split()
        if len(self.chunks) > self.limit:
            self.chunks.clear()
        if len(self.buckets) > self.limit:
            self.buckets.clear()
        known, grams = self.chunks, self.buckets
        for c in set(chunks).difference(known):
            known[c] = shape_of(c), self.bucket("w", c.lower())
        parts = list(map(known.__getitem__, chunks))
        out = {w for _, w in parts}
        shapes = [s for s, _ in parts]
        shapes[1:] = ["=" if a == b else s for a, b, s in zip(chunks, chunks[1:], shapes[1:])]
        for grams_of in (set(shapes), set(zip(shapes, shapes[1:])), set(zip(shapes, shapes[1:], shapes[2:]))):
            for g in grams_of:
                if (b := grams.get(g)) is None:
                    b = grams[g] = self.bucket("s", *g) if isinstance(g, tuple) else self.bucket("s", g)
                out.add(b)
        return out


@dataclass
class LinearModel:
    weights: np.ndarray  # one for each bucket
    bias: float

    def score(self, features: Iterable[int]) -> float:
        at = np.fromiter(features, np.int64)
        margin = float(self.weights[at].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, sign: np.ndarray, c: float, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """The linear model with hinge loss and squared L2 norm (Hsieh et al.); values[f] is the value of feature f where it occurs."""
    w, bias, alpha = np.zeros(len(values)), 0.0, np.zeros(len(rows))
    scaled = [values[r] for r in rows]
    norm = np.array([v @ v + 1.0 for v in scaled])
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            gradient = sign[i] * (w[rows[i]] @ scaled[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * scaled[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * c:
            break
    return w, bias


def fit_nbsvm(rows: list[np.ndarray], label: np.ndarray, *, c: float = 1.0, smoothing: float = 1.0, beta: float = 0.25, epochs: int = 20) -> LinearModel:
    if len(set(label.tolist())) < 2:
        share = float(label.mean()) if len(label) else 0.5
        return LinearModel(np.zeros(BUCKETS), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    count = [np.bincount(np.concatenate([r for r, y in zip(rows, label, strict=True) if y == k]), minlength=BUCKETS) + smoothing for k in (0, 1)]
    total = [(label == k).sum() + 2 * smoothing for k in (0, 1)]
    ratio = np.log(count[1] / total[1]) - np.log(count[0] / total[0])
    ratio[count[0] + count[1] <= 2 * smoothing + 2] = 0  # in two documents or fewer
    rows = [r[ratio[r] != 0] for r in rows]
    w, bias = dual_coordinate_descent(rows, ratio, 2.0 * label - 1, c, epochs)
    used = ratio != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    return LinearModel(((1 - beta) * mean + beta * w) * ratio, bias * beta)


def fit_quality(docs: DataFrame, labels: DataFrame, usable, *, label: str = "quality", fit_rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text") -> LinearModel:
    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams()
        for rows, texts in slices(batches):
            data = [np.array(sorted(grams(t)), "<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column("order"), rows.column("label"), pa.array(data, pa.binary())], names=["order", "label", "data"])

    sample = labelled_sample(docs, labels, label, usable, fit_rows, key=key, text=text)
    found = sample_features(sample, features, "order long, label int, data binary", fit_rows)
    return fit_nbsvm([np.frombuffer(r.data, "<i4").astype(np.int64) for r in found], np.array([r.label for r in found]))


def score_quality(docs: DataFrame, model: LinearModel, *, text: str = "text") -> DataFrame:
    """docs, packed as struct `doc`, with score."""
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def scorer():
        grams, linear = NGrams(), fitted.value
        return lambda t: linear.score(grams(t))

    return score_texts(docs, scorer, text=text)
