"""Toxicity by online logistic regression: FTRL-proximal over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z lower-cased. A text's features are the words, their stems (the first four bytes,
which inflected and compound words share), word pairs and pairs with one word between them that it contains, hashed to 2^20 slots. Each coordinate has its own learning rate; L1 keeps most weights at
exactly zero, so what is broadcast is a short list of slots and weights, at most 2^20 of them.

Edge cases. A null or empty text has no features: its score is the base rate. Without labelled rows of both labels the
share of label 1 is the score of all (0.5 with no labels). Null labels teach nothing; repeated rows are each scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import labelled_sample
from .segment import LOWER, Words, mix, slices, span_hashes, words

BITS = 20
#: Bound of the sample: labelled texts of each label.
PER_LABEL = 3000
#: FTRL-proximal: rate, smoothing, L1, L2, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 3.0, 1.0, 6.0, 1.0, 4

_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalnum()]] = 0x20

_PAIR, _SKIP, _STEM = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
STEM = 4


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every n-gram and skip-gram, repeats included."""
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    stems = span_hashes(w.data, w.begin, np.minimum(w.begin + STEM, w.end)) if len(doc) else w.hash
    docs, slots = [doc, doc], [w.hash, mix(stems * _STEM)]
    for gap, factor in ((1, _PAIR), (2, _SKIP)):
        same = doc[:-gap] == doc[gap:]
        docs.append(doc[:-gap][same])
        slots.append(mix(w.hash[:-gap][same] * factor + w.hash[gap:][same]))
    return np.concatenate(docs), (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class ToxicityModel:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS)
        table[self.slots] = self.weights
        return table


def score_words(w: Words, table: np.ndarray, bias: float) -> np.ndarray:
    """Probability of label 1 of each document; a feature counts once."""
    doc, slot = features(w)
    hit = table[slot] != 0
    once = np.unique((doc[hit] << BITS) | slot[hit])
    logit = bias + np.bincount(once >> BITS, table[once & ((1 << BITS) - 1)], minlength=len(w.first) - 1)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, passes: int = PASSES, alpha=ALPHA, beta=BETA, l1=L1, l2=L2) -> ToxicityModel:
    """FTRL-proximal over the sample, a row at a time in shuffled order; the bias is shifted to the share ``prior``."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0
    order = np.random.default_rng(1)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            at = rows[k]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            p = 1 / (1 + np.exp(-min(30.0, max(-30.0, bias + w.sum()))))
            g = p - labels[k]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    slots = np.flatnonzero(w)
    share = float(np.mean(labels))
    shift = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return ToxicityModel(slots, w[slots], bias + shift)


def _sample_rows(batches):
    """Distinct slots of each text, as numbers or, where shorter, as a bit for each slot (128 kB)."""
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(texts):
            doc, slot = features(words(texts.slice(low, high - low), _LETTERS))
            once = np.unique((doc << BITS) | slot)
            cut = np.searchsorted(once, np.arange(high - low + 1) << BITS)
            packed = []
            for a, b in zip(cut, cut[1:]):
                ids = once[a:b] & ((1 << BITS) - 1)
                if len(ids) * 32 < 1 << BITS:
                    packed.append(ids.astype("<u4").tobytes())
                else:
                    bits = np.zeros(1 << BITS, bool)
                    bits[ids] = True
                    packed.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(low, high - low), pa.array(packed, pa.binary())], ["label", "slots"])


def _unpack(blob: bytes) -> np.ndarray:
    if len(blob) == 1 << (BITS - 3):
        return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8)))
    return np.frombuffer(blob, "<u4").astype(np.int64)


def fit_toxicity(rows: DataFrame, per_label: int = PER_LABEL, labels: DataFrame | None = None) -> ToxicityModel:
    """Learn from (doc_id, text, label), label 0 or 1: a bounded sample of ``per_label`` rows of each label.

    With ``labels`` (doc_id, label), ``rows`` need no label, and only ids are shuffled: the sample's labels are broadcast to the texts.
    """
    label = F.col("label").cast("int").alias("label")
    text = F.col("text").cast("string").alias("text")
    if labels is None:
        known = rows = rows.select("doc_id", text, label).filter("label in (0, 1)")
    else:
        rows, labels = rows.select("doc_id", text), labels.select("doc_id", label).filter("label in (0, 1)")
        known = rows.select("doc_id").join(labels, "doc_id")
    counts = {r[0]: r[1] for r in known.groupBy("label").agg(F.count("*")).collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(next(iter(counts)))
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    if labels is None:
        sample = labelled_sample(rows, "label", "doc_id", per_label, counts)
    else:  # a label of no row takes no part
        chosen = labelled_sample(labels, "label", "doc_id", per_label, counts).join(rows.select("doc_id"), "doc_id", "left_semi")
        sample = rows.join(F.broadcast(chosen), "doc_id")
    got = sample.select("text", "label").mapInArrow(_sample_rows, "label int, slots binary").collect()
    got = sorted((r["label"], bytes(r["slots"])) for r in got)
    return fit([_unpack(b) for _, b in got], np.array([x for x, _ in got], float), counts[1] / sum(counts.values()))


def _score(model):
    def run(batches):
        m = ToxicityModel(**model.value)
        table = m.dense()
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(texts):
                score = score_words(words(texts.slice(low, high - low), _LETTERS), table, m.bias)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(low, high - low).columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The columns of ``docs`` with score (0 to 1) and predicted (1 if score >= 0.5); columns of these names are replaced."""
    docs = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(vars(model))), schema)
