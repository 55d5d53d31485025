"""Text quality by a generalised additive model with pairwise interactions.

Each text becomes a few numbers about its shape (lengths, letter classes, repetition). Numbers fall into quantile bins. A
feature's effect is a table with a value for each bin, learnt by boosting shallow trees in turn over the features, so that
no feature takes what another explains; then tables over pairs of features that explain most of what is left. A score is
the sum of one cell of each table: bins and additions, for a whole batch at a time.

Edge cases. A null or empty text has the numbers of an empty text and is scored like any other. Without labelled rows
of both labels the only label's share is the score of all (0.5 with no labels). Null labels teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import labelled_sample
from .segment import mix, raw, slices, span_hashes, words

FEATURES = (
    "words", "word_length", "upper", "marks", "symbols", "bars", "digits", "other_letters", "capital_words", "stops",
    "distinct", "commonest", "adjacent", "lines", "repeated_lines", "repeated_runs",
)
#: Bound of the sample: labelled rows of each label.
PER_LABEL = 8000
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS = 32, 120, 0.15, 8, 40

# Byte classes, each a share of the text's bytes.
_CLASSES = {
    "upper": [*range(65, 91)], "marks": [*b"!?"], "symbols": [*b"#$%&*@^~<>{}[]\\/=+_`"], "bars": [*b"|"], "digits": [*range(48, 58)],
    "other_letters": [*range(128, 256)], "stops": [*b".,;:"],
}


def shape(texts: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    data, offsets = raw(texts)
    w = words(texts)
    size = np.maximum(np.diff(offsets), 1)
    count = np.diff(w.first)
    out = {}
    for name, members in _CLASSES.items():
        one = np.zeros(256, np.int64)
        one[members] = 1
        out[name] = np.diff(np.concatenate([[0], np.cumsum(one[data])])[offsets]) / size
    out["words"] = np.log1p(count)
    length = np.concatenate([[0], np.cumsum(w.end - w.begin)])
    some = np.maximum(count, 1)
    out["word_length"] = np.diff(length[w.first]) / some
    capital = np.zeros(256, np.int64)
    capital[65:91] = 1
    out["capital_words"] = np.diff(np.concatenate([[0], np.cumsum(capital[data[w.begin]])])[w.first]) / some
    same = np.zeros(len(w.hash) + 1, np.int64)
    if len(w.hash) > 1:
        same[2:] = np.cumsum(w.hash[1:] == w.hash[:-1])
    out["adjacent"] = np.diff(same[w.first]) / some
    # Lines, and runs of three words: how much of them is repeated.
    brk = np.zeros(len(data) + 1, bool)
    brk[1:] |= data == 10
    brk[offsets] = True
    at = np.flatnonzero(brk)
    line = span_hashes(data, at[:-1], at[1:]) if len(data) else np.zeros(0, np.uint64)
    line_first = np.searchsorted(at[:-1], offsets) if len(data) else np.zeros(len(texts) + 1, np.int64)
    lines = np.diff(line_first)
    out["lines"] = np.log1p(count / np.maximum(lines, 1))
    run = mix(w.hash[:-2] * np.uint64(3) + w.hash[1:-1] * np.uint64(5) + w.hash[2:] * np.uint64(7)) if len(w.hash) > 2 else np.zeros(0, np.uint64)
    distinct, commonest, repeated, runs = (np.zeros(len(texts)) for _ in range(4))
    for k in range(len(texts)):
        a, b = w.first[k], w.first[k + 1]
        if b > a:
            _, n = np.unique(w.hash[a:b], return_counts=True)
            distinct[k], commonest[k] = len(n) / (b - a), n.max() / (b - a)
            if b - a > 2:
                runs[k] = 1 - len(np.unique(run[a : b - 2])) / (b - a - 2)
        c, d = line_first[k], line_first[k + 1]
        if d > c:
            repeated[k] = 1 - len(np.unique(line[c:d])) / (d - c)
    out |= {"distinct": distinct, "commonest": commonest, "repeated_lines": repeated, "repeated_runs": runs}
    return np.stack([out[name] for name in FEATURES], 1)


@dataclass
class QualityModel:
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1)

    def logit(self, bins: np.ndarray) -> np.ndarray:
        """Sum of one cell of each table."""
        f = np.full(len(bins), self.bias)
        for k, t in enumerate(self.tables):
            f += t[bins[:, k]]
        for a, b, t in self.pairs:
            f += t[bins[:, a], bins[:, b]]
        return f

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(self.bins(x)) if self.cuts else np.full(len(x), self.bias), -30, 30)))


_DAMP = 5.0  # added to a leaf's weight


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + _DAMP)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values of a shallow tree over the bins, from sums of gradients and curvatures per bin."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
        k = int(gain.argmax())
        if gain[k] > 1e-6:
            return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1), _tree(g[k + 1 :], h[k + 1 :], depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + _DAMP))


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of two features at once: its gain, and the values of its four parts as a table."""
    cg, ch = (np.cumsum(np.cumsum(v, 0), 1) for v in (g, h))
    parts = []
    for c in (cg, ch):
        a = c[:-1, :-1]
        row, col, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        parts.append((a, row - a, col - a, all_ - row - col + a))
    gain = sum(_gain(x, y) for x, y in zip(*parts)) - _gain(cg[-1, -1], ch[-1, -1])
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    value = [-x[i, j] / (y[i, j] + _DAMP) for x, y in zip(*parts)]
    table = np.zeros_like(g)
    table[: i + 1, : j + 1], table[: i + 1, j + 1 :], table[i + 1 :, : j + 1], table[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), table


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> QualityModel:
    """Boost feature tables in turn, then pair tables, on the sample."""
    m = QualityModel(cuts=[np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])])
    bins = m.bins(x)
    width = [len(c) + 1 for c in m.cuts]
    share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    m.bias = float(np.log(share / (1 - share)))
    m.tables = [np.zeros(n) for n in width]
    f = np.full(len(y), m.bias)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return (p - y) * weight, np.maximum(p * (1 - p), 1e-6) * weight

    for _ in range(ROUNDS):
        for k in range(len(width)):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, k], g, width[k]), np.bincount(bins[:, k], h, width[k]))
            m.tables[k] += step
            f += step[bins[:, k]]

    def grid(a, b, v):
        return np.bincount(bins[:, a] * width[b] + bins[:, b], v, width[a] * width[b]).reshape(width[a], width[b])

    g, h = slopes()
    wide = [k for k in range(len(width)) if width[k] > 1]
    ranked = sorted(((_quadrants(grid(a, b, g), grid(a, b, h))[0], a, b) for i, a in enumerate(wide) for b in wide[i + 1 :]), reverse=True)
    m.pairs = [(a, b, np.zeros((width[a], width[b]))) for _, a, b in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in m.pairs:
            g, h = slopes()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            table += step
            f += step[bins[:, a], bins[:, b]]
    return m


def _shapes(batches):
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(texts):
            x = shape(texts.slice(low, high - low))
            keep = [batch.column(c).slice(low, high - low) for c in batch.schema.names if c != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*keep, *[pa.array(x[:, k]) for k in range(x.shape[1])]], [*names, *[f"f_{c}" for c in FEATURES]])


def text_shape(docs: DataFrame) -> DataFrame:
    """(doc_id, f_...) for each document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_shapes, T.StructType([docs.schema["doc_id"], *[T.StructField(f"f_{c}", T.DoubleType()) for c in FEATURES]]))


def fit_quality(shapes: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> QualityModel:
    """Learn from text_shape rows and labels (doc_id, label 0 or 1), on a bounded sample of each label.

    Sampled rows are weighted back to the share that their label has among all labelled rows.
    """
    labels = labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("label in (0, 1)")
    rows = shapes.join(labels, "doc_id")
    counts = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count("*")).collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(next(iter(counts)))
        return QualityModel(bias=float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    got = labelled_sample(rows, "label", "doc_id", per_label).select("label", *[f"f_{c}" for c in FEATURES]).collect()
    sample = np.array(sorted(tuple(r) for r in got), float)
    y = sample[:, 0]
    weight = np.where(y == 1, counts[1] / max(y.sum(), 1), counts[0] / max((1 - y).sum(), 1)) * len(y) / sum(counts.values())
    return fit(sample[:, 1:], y, weight)


def _score(model):
    def run(batches):
        m = QualityModel(**model.value)
        for batch in batches:
            x = np.stack([batch.column(f"f_{c}").to_numpy(zero_copy_only=False) for c in FEATURES], 1)
            score = m.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def score_quality(shapes: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score, predicted) for each row of text_shape: score is the probability of label 1."""
    schema = T.StructType([shapes.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return shapes.mapInArrow(_score(shapes.sparkSession.sparkContext.broadcast(vars(model))), schema)
