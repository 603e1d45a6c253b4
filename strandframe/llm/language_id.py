"""Language identification by a string kernel: Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import crc_of_id

BUCKET_BITS = 18
LONGEST = 3
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """For every code point, its place or a space where it is no letter."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], dtype=np.uint64)


def presence(text: str, letters: np.ndarray, seen: np.ndarray) -> bool:
    """Mark in ``seen`` the hashed n-grams of 1 to ``LONGEST`` code points of the lower-cased text; False without a letter."""
    seen[:] = False
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = letters[points]
    if not (c != 32).any():
        return False
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]  # runs of spaces count as one
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(LONGEST):
        h = (h[: len(c) - n] ^ c[n:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        seen[(h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)] = True
    return True


@dataclass
class KernelModel:
    """``buckets``: n-grams of the landmarks; ``landmarks``: their presence, scaled; ``weights``: landmarks x languages."""

    languages: list[str]
    buckets: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return (rows @ self.landmarks.T) / np.sqrt(np.maximum(sizes, 1))[:, None]

    def predict(self, texts: list[str | None], letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; one product for all texts of the batch with all landmarks, one with the weights."""
        seen = np.zeros(1 << BUCKET_BITS, dtype=bool)
        rows = np.zeros((len(texts), len(self.buckets)), dtype=np.float32)
        sizes, known = np.ones(len(texts), dtype=np.float32), np.zeros(len(texts), dtype=bool)
        for i, text in enumerate(texts):
            if text and presence(text, letters, seen) and self.languages:
                known[i], sizes[i], rows[i] = True, seen.sum(), seen[self.buckets]
        if not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        values = self.kernel(rows, sizes) @ self.weights
        best = values.argmax(axis=1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
        return names, np.where(known, (np.clip(values.max(axis=1), -1, 1) + 1) / 2, 0.0)


def fit(texts: list[str], languages: list[str], per_language: int, ridge: float) -> KernelModel:
    """Nyström features z = K(x, landmarks) K(landmarks, landmarks)^(-1/2), and ridge regression on +-1 targets."""
    letters, seen = letter_table(), np.zeros(1 << BUCKET_BITS, dtype=bool)
    names = sorted(set(languages))
    if not names:
        return KernelModel([], np.zeros(0, int), np.zeros((0, 0)), np.zeros((0, 0)))
    marks = []
    for text in texts:
        presence(text, letters, seen)
        marks.append(np.flatnonzero(seen))
    chosen = [i for name in names for i in [j for j, y in enumerate(languages) if y == name][:per_language]]
    buckets = np.unique(np.concatenate([marks[i] for i in chosen]))
    rows = np.stack([np.isin(buckets, m) for m in marks]).astype(np.float32)
    sizes = np.array([len(m) for m in marks], dtype=np.float32)
    landmarks = rows[chosen] / np.sqrt(np.maximum(sizes[chosen], 1))[:, None]
    model = KernelModel(names, buckets, landmarks, np.zeros((0, 0)))
    k_all = model.kernel(rows, sizes).astype(np.float64)
    values, vectors = np.linalg.eigh(k_all[chosen])
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.hstack([k_all @ root, np.ones((len(rows), 1))])
    y = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    w = np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ y)
    # the constant is given to the kernel part, whose rows have length about one: dropping it keeps the order of languages
    model.weights = (root @ w[:-1]).astype(np.float32)
    return model


def training_rows(docs: DataFrame, per_language: int, max_chars: int) -> DataFrame:
    """At most ``per_language`` labelled texts of each language, in an order drawn from a hash of the id."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.char_length("text") <= max_chars) & F.col("text").rlike(r"\p{L}"))
    drawn = usable.where(crc_of_id() % 3 != 1).select("doc_id", "lang", F.xxhash64("doc_id").alias("draw"))
    order = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    picked = drawn.withColumn("place", order).where(F.col("place") <= per_language).select("doc_id", "lang", "place")
    # bounded by per_language rows for each language
    return usable.select("doc_id", "lang", "text").join(F.broadcast(picked), ["doc_id", "lang"]).orderBy("lang", "place", "text")


def identify_language(docs: DataFrame, per_language: int = 200, landmarks: int = 32, ridge: float = 1e-2, max_chars: int = 20_000, batch: int = 256) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (columns doc_id, text, lang).

    Learns from at most ``per_language`` texts of up to ``max_chars`` characters for each language, from documents whose
    crc32(doc_id) mod 3 is not 1; ``landmarks`` of them for each language span the kernel space. ``held_out`` says that the
    remainder is 1 (null without doc_id). Predictions read the whole text and nothing else. Null texts and texts without a
    letter are ``und`` with score 0, and so is everything if nothing could be learnt. Texts are scored in batches of
    ``batch`` rows within each task; the model has a fixed size.
    """
    sample = training_rows(docs, per_language, max_chars).collect()
    model = fit([r.text for r in sample], [r.lang for r in sample], landmarks, ridge)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                names, scores = model.predict([t if isinstance(t, str) else None for t in part["text"]], letters)
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "held_out": part["held_out"].values, "lang_pred": names, "score": scores})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), (crc_of_id() % 3 == 1).alias("held_out"), "text")
    out = rows.mapInPandas(predict, "doc_id string, held_out boolean, lang_pred string, score double")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
