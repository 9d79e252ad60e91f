"""Language identification with string kernels.

The kernel of two texts is the normalised count of n-grams that both contain (presence, blended over n = 1 to 3, of
lower-cased characters), n-grams being hashed to a fixed number of columns. A bounded sample of labelled texts trains
one-versus-rest kernel ridge regression on Nyström landmarks; whole texts are scored by batched matrix products with
the landmarks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, columns, crc_fold, discard, small_batches

COLUMNS = 1 << 16
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHIFT = np.uint64(64 - 16)


def presence(text: str, row: np.ndarray) -> None:
    """Mark the columns of all n-grams of the whole text in a zeroed row."""
    text = text.lower()
    for k in range(0, max(len(text) - 2, 1), 1 << 18):  # pieces overlap by two characters
        code = np.frombuffer(text[k : k + (1 << 18) + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        with np.errstate(over="ignore"):
            h = (code + np.uint64(1)) * _A
            row[(h * _B) >> _SHIFT] = 1
            one = h
            for n in (1, 2):
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _B + one[n:]
                row[(h * _B) >> _SHIFT] = 1


@dataclass
class Model:
    """Landmark presence over the columns that any landmark has, the landmarks' sizes, and class weights."""

    columns: np.ndarray
    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    classes: list[str]

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        both = rows[:, self.columns].astype(np.float32) @ self.landmarks.astype(np.float32).T
        size = np.maximum(rows.sum(1, dtype=np.int64), 1)
        return both / np.sqrt(size[:, None] * np.maximum(self.sizes, 1)[None, :])

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best class and its share of the softmax over the one-versus-rest values."""
        value = self.kernel(rows) @ self.weights
        e = np.exp(4 * (value - value.max(1, keepdims=True)))
        best = value.argmax(1)
        return best, (e[np.arange(len(best)), best] / e.sum(1)).astype(float)


def fit(rows: list[bytes], langs: list[str], landmarks: int, ridge: float) -> Model:
    """rows: packed presence bits; the first landmarks of each class become the Nyström landmarks."""
    classes = sorted(set(langs))
    y = np.array([classes.index(x) for x in langs])
    picked = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(classes))])
    unpack = lambda some: np.unpackbits(np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1), axis=1)
    marks = unpack([rows[i] for i in picked])
    columns = np.flatnonzero(marks.any(0))
    model = Model(columns, marks[:, columns], marks.sum(1, dtype=np.int64), np.zeros((len(picked), len(classes)), np.float32), classes)
    k = np.concatenate([model.kernel(unpack(rows[i : i + 128])) for i in range(0, len(rows), 128)]).astype(float)
    kmm = model.kernel(marks).astype(float)
    target = np.where(y[:, None] == np.arange(len(classes))[None, :], 1.0, -1.0)
    model.weights = np.linalg.solve(k.T @ k + ridge * len(rows) * kmm + 1e-6 * np.eye(len(kmm)), k.T @ target).astype(np.float32)
    if not np.isfinite(model.weights).all():
        raise ArithmeticError("the ridge solution is not finite")
    return model


def train(docs: DataFrame, per_class: int = 300, landmarks: int = 32, ridge: float = 1e-4, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on at most per_class labelled rows of each language, chosen by a hash of their key and text.

    The bound is this sample's only limit; its presence rows (8 KB each) go to the driver. Rows without key or
    label, and texts without a letter (null, empty, white space, numbers) teach nothing, repeated rows count once, and rows of equal keys are rows of their own; very long texts count
    whole; other columns play no part. None if there is no labelled text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    labelled = columns(docs, id=key, lang=lang, text=text).where("lang is not null and id is not null").where(F.regexp_like("text", F.lit(r"\p{L}")))
    labelled = labelled.select("id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    sample = bounded_sample(labelled, "lang", dict.fromkeys(counts, per_class), counts)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                row = np.zeros(COLUMNS, np.uint8)
                presence(t, row)
                out.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["turn", "lang", "bits"])

    rows = sorted(sample.select("turn", "lang", "text").mapInArrow(features, "turn long, lang string, bits binary").collect(), key=lambda r: (r.turn, r.lang, r.bits))
    discard(sample)
    return fit([bytes(r.bits) for r in rows], [r.lang for r in rows], landmarks, ridge)


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1).

    und with score 0 where the text is null or has no letter, or where nothing was learned. Only the text counts, however
    long; rows of equal or null keys and repeated rows are scored apart; other columns, whatever their names, play no
    part; an empty table gives no rows. Ties go to the language first by name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rows = shared.value, np.zeros((64, COLUMNS), np.uint8)
        for batch in batches:
            names, scores = [], []
            for a in range(0, batch.num_rows, 64):
                texts = batch.column(1).slice(a, 64).to_pylist()
                known = np.array([m is not None and t is not None and _LETTER.search(t) is not None for t in texts])
                rows[: len(texts)] = 0
                for i in np.flatnonzero(known):
                    presence(texts[i], rows[i])
                best, value = m.predict(rows[: len(texts)]) if m else (np.zeros(len(texts), int), np.zeros(len(texts)))
                names += [m.classes[c] if k else UNKNOWN for c, k in zip(best, known, strict=True)]
                scores += np.where(known, value, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = columns(docs, doc_id=key, text=text).withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(key: str = "doc_id", folds: int = 5):
    """Whether a document belongs to the fold that training leaves out; a null key does not."""
    return F.coalesce(crc_fold(key, folds) == 0, F.lit(False))
