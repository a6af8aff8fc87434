"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams (1 to ORDER, over the lower-cased text with white space and digits folded),
each hashed to one of BINS bins; the kernel of two texts is |A and B| / sqrt(|A| |B|) over these sets. A Nyström map
replaces the kernel matrix by LANDMARKS texts: phi(x) = K(x, landmarks) K(landmarks, landmarks)^(-1/2). On phi one
ridge regression per language is fitted against all others (+1 or -1). Texts are scored in batches: one product of
their presence matrix with the landmarks', and one with the fitted weights. Whole texts are used.

The model is fitted on a bounded sample of labelled rows: at most about SAMPLE rows of each language, picked by a hash
of the id. What travels to the driver is one bit per bin and row, whatever the texts' length.

Cases: a null text or one without a letter is `und` with score 0; if nothing was learned, all rows are; rows without a
language are never learned from; repeated rows get the same prediction; a null id is kept; an empty table gives no rows
and other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches

ORDER = 4
BINS = 1 << 15
SAMPLE = 400
LANDMARKS = 96
RIDGE = 1e-4
UNKNOWN = "und"
#: Texts in one presence matrix, and code points hashed at once.
ROWS, POINTS = 64, 1 << 20

_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


@dataclass
class Model:
    languages: list[str]
    bins: np.ndarray  # the bins that a landmark has
    landmarks: np.ndarray  # presence of these bins, a column per landmark
    sizes: np.ndarray  # bins of each landmark
    weights: np.ndarray  # from kernel values to one decision per language
    bias: np.ndarray


def presence(text: str, order: int = ORDER, bins: int = BINS) -> np.ndarray:
    """Which bins the text's n-grams fall in, as booleans."""
    seen = np.zeros(bins, dtype=bool)
    for at in range(0, len(text), POINTS):
        part = text[at : at + POINTS + order - 1].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = np.where((code < 65) & (code != 39), np.uint32(32), code)
        h = np.zeros(len(code), dtype=np.uint32)
        for n in range(min(order, len(code))):
            h = (h[: len(code) - n] + code[n:] * np.uint32(_ODD[n])) * np.uint32(0x2C1B3C6D)
            seen[(h ^ (h >> np.uint32(15))) % np.uint32(bins)] = True
    return seen


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None,
        sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Learns from the rows of docs with a language for which `learn` holds; None if there is none."""
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if learn is None else learn))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    share = F.lit(1.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 20)) < share * (1 << 20))
    found = picked.select("id", "lang", "text").mapInArrow(_bits, "id long, lang string, bits binary").collect()
    found.sort(key=lambda r: (r.lang, r.id is None, r.id or 0, r.bits))
    return _fit([r.lang for r in found], [r.bits for r in found], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (0 to 1)."""
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scorer(model), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known."""
    predicted = F.pandas_udf(_series_scorer(model), "string")
    return bounded_batches(docs).where(predicted(F.col(text_col)) != UNKNOWN)


def _bits(parts):
    import pyarrow as pa

    for part in parts:
        bits = [np.packbits(presence(t.as_py())).tobytes() for t in part.column(2)]
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(bits, pa.binary())], names=["id", "lang", "bits"])


def _fit(langs: list[str], bits: list[bytes], landmarks: int, ridge: float) -> Model:
    names = sorted(set(langs))
    each = max(1, landmarks // len(names))
    chosen = [i for lang in names for i in [k for k, x in enumerate(langs) if x == lang][:each]]
    unpacked = lambda rows: np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(rows), -1), axis=1)
    marks = unpacked([bits[i] for i in chosen])
    sizes = marks.sum(1).astype(np.float64)
    bins = np.flatnonzero(marks.any(0))
    marks = marks[:, bins].astype(np.float32).T
    kernel = []
    for a in range(0, len(bits), ROWS):
        x = unpacked(bits[a : a + ROWS])
        kernel.append(_kernel(x[:, bins].astype(np.float32) @ marks, x.sum(1), sizes))
    kernel = np.concatenate(kernel)
    values, vectors = np.linalg.eigh(kernel[chosen])
    keep = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = kernel @ root
    target = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    weight = np.array([1.0 / langs.count(x) for x in langs])[:, None] * len(langs) / len(names)
    mean, goal = (weight * phi).mean(0) / weight.mean(), (weight * target).mean(0) / weight.mean()
    centred = phi - mean
    beta = np.linalg.solve(centred.T @ (weight * centred) + ridge * len(langs) * np.eye(phi.shape[1]), centred.T @ (weight * (target - goal)))
    return Model(names, bins, marks, sizes, root @ beta, goal - mean @ beta)


def _kernel(shared: np.ndarray, sizes: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    return shared / np.sqrt(np.maximum(np.outer(sizes, landmark_sizes), 1.0))


def _score(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    import regex

    letter = regex.compile(r"\p{L}")
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    asked = [i for i, t in enumerate(texts) if t and letter.search(t)]
    for a in range(0, len(asked), ROWS):
        rows = asked[a : a + ROWS]
        seen = np.stack([presence(texts[i]) for i in rows])
        kernel = _kernel(seen[:, model.bins].astype(np.float32) @ model.landmarks, seen.sum(1), model.sizes)
        decision = kernel @ model.weights + model.bias
        best = decision.argmax(1)
        for i, k, d in zip(rows, best, decision, strict=True):
            langs[i], scores[i] = model.languages[k], float(np.clip((1 + d[k]) / 2, 0, 1))
    return langs, scores


def _scorer(model: Model | None):
    def run(parts):
        import pyarrow as pa

        for part in parts:
            langs, scores = _score(part.column(1).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"]
            )

    return run


def _series_scorer(model: Model | None):
    def predicted(texts: pd.Series) -> pd.Series:
        return pd.Series(_score([t if isinstance(t, str) else None for t in texts], model)[0])

    return predicted
