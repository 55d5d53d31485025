"""Language of a text by a string kernel.

Two texts are as alike as the sets of byte n-grams (1 to 4 letters, all lengths together) that they contain:
k(s, t) = |S ∩ T| / sqrt(|S| |T|). Landmarks, some texts of each language, span the kernel's feature space (Nyström):
phi(s) = k(s, landmarks) W^-1/2. One kernel ridge regression for each language learns +1 against -1 on phi. N-grams are
counted as present in a table of 2^16 slots. Since scoring is linear in the landmark kernels, they fold into one matrix
of slots by languages, and a batch of texts is scored by one product with it. Beside it stands which slots each language's
landmarks have, from which a text of no learned language is known.

Edge cases. Very long texts are read whole, a few at a time. A text without a letter, or null, is ``und`` with score 0. Without labelled rows every text is ``und``. Ties
go to the language first in alphabetical order. Repeated rows and extra columns do not matter; null labels teach nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sampling import labelled_sample
from .segment import mix, slices

SLOTS = 1 << 16
GRAMS = 4
#: Bounds of the sample: labelled texts and landmarks of each language.
PER_LANGUAGE, LANDMARKS = 300, 40
RIDGE = 1e-2
#: Confidence of a decision: softmax of the regressions' outputs times this.
SHARPNESS = 3.0
UNKNOWN = "und"
RESULTS = ("lang_pred", "score", "lang_familiar")
#: A text is of a learned language if so much of its n-grams, beyond chance, is known from that language's landmarks.
LEAST_FAMILIAR = 0.2


def presence(texts: list[str]) -> np.ndarray:
    """Which n-gram slots each text has: a row of booleans for each."""
    out = np.zeros((len(texts), SLOTS), bool)
    for row, text in zip(out, texts):
        data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint64)
        code = np.zeros(len(data), np.uint64)
        for n in range(1, GRAMS + 1):
            if len(data) < n:
                break
            code = (code[: len(data) - n + 1] << np.uint64(8)) | data[n - 1 :]
            row[(mix(code + np.uint64(n << 40)) >> np.uint64(48)).astype(np.int64)] = True
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # slots x languages
    seen: np.ndarray  # slots x languages: 1 where a landmark of the language has the slot

    def predict(self, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language of each presence row, its share among the learned ones, and how familiar the text is in it."""
        n = np.maximum(present.sum(1), 1)
        both = (present.astype(np.float32) @ np.hstack([self.weights, self.seen])).astype(np.float64)
        f = both[:, : len(self.languages)] / np.sqrt(n)[:, None] * SHARPNESS
        rows, best = np.arange(len(f)), f.argmax(1)
        e = np.exp(f - f.max(1, keepdims=True))
        chance = self.seen.mean(0)[best]  # of a foreign n-gram to meet a taken slot
        share = both[rows, len(self.languages) + best] / n
        return best, (e / e.sum(1, keepdims=True))[rows, best], (share - chance) / np.maximum(1 - chance, 1e-9)


def _unit_rows(bits: np.ndarray) -> np.ndarray:
    """Packed presence rows as vectors of length 1."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Nyström landmarks and ridge regression on packed presence rows (bounded by the sample), a few rows unpacked at a time."""
    languages = sorted(set(labels))
    truth = np.array([languages.index(x) for x in labels])
    # Landmarks are spread over the sample by a hash of their features, whatever the order of the rows.
    place = np.array([zlib.crc32(row.tobytes()) for row in bits])
    chosen = np.concatenate([own[np.argsort(place[own], kind="stable")][:landmarks] for own in (np.flatnonzero(truth == k) for k in range(len(languages)))])
    marks = _unit_rows(bits[chosen])
    kernel = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # W^-1/2
    phi = np.concatenate([_unit_rows(bits[k : k + 64]) @ marks.T for k in range(0, len(bits), 64)]) @ root
    target = np.where(truth[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = np.bincount(truth, minlength=len(languages)) / len(truth)
    weight = (1 / share)[truth][:, None]  # languages count alike, however many rows they have
    beta = np.linalg.solve(phi.T @ (phi * weight) + ridge * len(truth) * np.eye(phi.shape[1]), phi.T @ (target * weight))
    seen = [np.unpackbits(np.bitwise_or.reduce(bits[chosen[truth[chosen] == k]], axis=0)) for k in range(len(languages))]
    return LanguageModel(languages, marks.T @ (root @ beta).astype(np.float32), np.array(seen, np.float32).T)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Presence rows as bits: 8 kB for a text of any length."""
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            part = batch.slice(low, 64)
            bits = np.packbits(presence([t or "" for t in part.column("text").to_pylist()]), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([b.tobytes() for b in bits], pa.binary())], ["label", "bits"])


def fit_language(docs: DataFrame, label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> LanguageModel | None:
    """Learn from a bounded sample of the labelled rows: about ``per_language`` of each label. None without labels."""
    rows = docs.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    sample = labelled_sample(rows.filter(F.col("text").rlike(r"\p{L}")), "label", "key", per_language).select("text", "label")
    got = sample.mapInArrow(_features, "label string, bits binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r["label"], bytes(r["bits"])))
    bits = np.array([np.frombuffer(r["bits"], np.uint8) for r in got])
    return fit(bits, [r["label"] for r in got], landmarks)


def _predict(model):
    def run(batches):
        m = LanguageModel(**model.value) if model.value else None
        for batch in batches:
            texts = batch.column("text")
            for low, high in slices(texts, 1 << 20):
                for at in range(low, high, 64):
                    part = texts.slice(at, min(64, high - at)).to_pylist()
                    names, scores, familiar = [UNKNOWN] * len(part), np.zeros(len(part)), np.zeros(len(part))
                    known = [k for k, t in enumerate(part) if t and any(map(str.isalpha, t))]
                    if m is not None and known:
                        best, scores[known], familiar[known] = m.predict(presence([part[k] for k in known]))
                        for k, b in zip(known, best):
                            names[k] = m.languages[b]
                    yield pa.RecordBatch.from_arrays(
                        [*batch.slice(at, len(part)).columns, pa.array(names), pa.array(scores, pa.float64()), pa.array(familiar, pa.float64())], [*batch.schema.names, *RESULTS])

    return run


def _identified(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """``docs``, which has no columns of these names, with lang_pred, score and lang_familiar."""
    spark = docs.sparkSession
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in zip(RESULTS, (T.StringType(), T.DoubleType(), T.DoubleType()))]])
    return docs.mapInArrow(_predict(spark.sparkContext.broadcast(vars(model) if model else None)), schema)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The columns of ``docs`` with lang_pred and score (0 to 1); columns of these names are replaced.

    ``text`` is read as string; the model (slots x languages) is broadcast.
    """
    docs = docs.drop("lang_pred", "score")
    if "lang_familiar" in docs.columns:  # the row's own column of this name stays
        rows = _identified(docs.select("text", F.struct("*").alias("whole_row")), model)
        return rows.withColumn("whole_row", F.col("whole_row").withField("text", F.col("text"))).select("whole_row.*", "lang_pred", "score")
    return _identified(docs, model).drop("lang_familiar")


def known_language(docs: DataFrame, model: LanguageModel | None, least: float = LEAST_FAMILIAR) -> DataFrame:
    """Documents whose language is one of the learned ones; the columns of ``docs``.

    Rejected are texts without a letter and those too little of whose n-grams the landmarks of their language have: 0 is
    what chance gives a text in a foreign script, 1 a text all of whose n-grams are known. The regressions themselves
    cannot tell: they are near 0 for such a text. The bar looks at one language, so it does not depend on their number.
    """
    known = (F.col("lang_pred") != UNKNOWN) & (F.col("lang_familiar") >= least)
    if set(RESULTS) & set(docs.columns):  # the row's own columns of these names stay
        rows = docs.select("text", F.struct("*").alias("whole_row"))
        return _identified(rows, model).filter(known).select("whole_row.*")
    return _identified(docs, model).filter(known).select(*[F.col(f"`{c}`") for c in docs.columns])
