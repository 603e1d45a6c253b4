"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import crc_of_id

BUCKET_BITS = 18
SHORTEST, LONGEST = 3, 6
_WORD = re.compile(r"[^\W_]+")
_CACHED = 200_000


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of ``<word>`` and of the word itself, and where each word's begin."""
    points = [np.frombuffer(f"<{w}>".encode("utf-32-le", "surrogatepass"), dtype="<u4") for w in words]
    lengths = np.array([len(p) for p in points])
    c = np.concatenate(points).astype(np.uint64) if points else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    h = np.zeros(len(c), dtype=np.uint64)
    for n in range(min(LONGEST, len(c))):
        h = (h[: len(c) - n] ^ c[n:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n + 1 >= SHORTEST:
            inside = owner[: len(owner) - n] == owner[n:]
            buckets.append((h[inside] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS))
            owners.append(owner[: len(owner) - n][inside])
    whole = np.array([hash_word(p) for p in points], dtype=np.uint64)
    buckets.append(whole)
    owners.append(np.arange(len(words)))
    owners_ = np.concatenate(owners)
    order = np.argsort(owners_, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), np.searchsorted(owners_[order], np.arange(len(words) + 1))


def hash_word(points: np.ndarray) -> int:
    import zlib

    return (zlib.crc32(points.tobytes()) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BUCKET_BITS)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class SubwordModel:
    """``table``: what a subword adds to the log odds, its embedding times the softmax weights; ``bias``: their constant."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        """Probability of label 1. The average over words is linear, so a word's share is computed once and cached."""
        words = [tokens(t) for t in texts]
        if len(cache) > _CACHED:
            cache.clear()
        new = list({w for doc in words for w in doc if w not in cache})
        if new:
            buckets, at = subwords(new)
            cache.update(zip(new, (np.add.reduceat(self.table[buckets], at[:-1]) / np.diff(at)).tolist()))
        odds = np.array([sum(map(cache.__getitem__, doc)) / len(doc) if doc else 0.0 for doc in words]) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit(texts: list[str], labels: list[int], size: int, epochs: int, rate: float, min_docs: int = 40, few: int = 3, decay: float = 3e-4, weigh: float = 1.0, seed: int = 7) -> SubwordModel:
    """Embeddings and softmax trained together by AdaGrad on the mean of word vectors, a word being the mean of its subwords.

    Subwords of fewer than ``min_docs`` training texts (2 % of them in samples of under 1,950) and of fewer than ``few`` texts
    of the smaller class keep the zero vector: they would only memorise their texts.
    """
    y = np.array(labels)
    if len(set(labels)) < 2:
        return SubwordModel(np.zeros(1 << BUCKET_BITS), 8.0 if labels and labels[0] == 1 else -8.0)
    rng = np.random.default_rng(seed)
    bags = []
    for text in texts:
        doc = tokens(text)
        names, counts = np.unique(np.array(doc, dtype=object), return_counts=True) if doc else ([], np.zeros(0))
        if not len(names):
            bags.append((np.zeros(0, np.int64), np.zeros(0, np.float32)))
            continue
        buckets, at = subwords(list(names))
        share = np.repeat(counts / counts.sum() / np.diff(at), np.diff(at))
        ids, place = np.unique(buckets, return_inverse=True)
        bags.append((ids, np.bincount(place, share).astype(np.float32)))
    scarce = int(y.sum() * 2 <= len(y))
    held = [np.bincount(np.concatenate([ids for (ids, _), label in zip(bags, y) if label == k]), minlength=1 << BUCKET_BITS) for k in (0, 1)]
    found = (held[0] + held[1] >= min(min_docs, 1 + len(y) // 50)) | (held[scarce] >= few)
    bags = [(ids[found[ids]], share[found[ids]]) for ids, share in bags]
    table = rng.uniform(-1 / size, 1 / size, (1 << BUCKET_BITS, size)).astype(np.float32) * found[:, None]
    weights, bias = rng.normal(0, 0.1, (size, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    past, past_w, past_b = np.full(1 << BUCKET_BITS, 1e-8, dtype=np.float32), np.full((size, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    balance = (len(y) / (2 * np.bincount(y, minlength=2))) ** weigh
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(y)):
            ids, share = bags[i]
            hidden = share @ table[ids] if len(ids) else np.zeros(size, np.float32)
            z = hidden @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p = (p * balance[y[i]]).astype(np.float32)
            back = weights @ p
            g = np.outer(hidden, p)
            past_w += g * g
            weights -= step * 0.2 * g / np.sqrt(past_w)
            past_b += p * p
            bias -= step * 0.2 * p / np.sqrt(past_b)
            if len(ids):
                past[ids] += (share * share) * (back @ back) / size
                table[ids] -= step * ((share / np.sqrt(past[ids]))[:, None] * back + decay * table[ids])
    turn = weights[:, 1] - weights[:, 0]
    return SubwordModel((table @ turn).astype(np.float64), float(bias[1] - bias[0]))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int, max_chars: int) -> DataFrame:
    """At most ``per_class`` labelled texts of either class, in an order drawn from a hash of the id; conflicting labels count as 1."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = docs.where(F.col("doc_id").isNotNull() & (F.char_length("text").between(1, max_chars))).where(crc_of_id() % 5 != 0)
    drawn = usable.select("doc_id").join(marked, "doc_id").select("doc_id", "toxic", F.xxhash64("doc_id").alias("draw"))
    order = F.row_number().over(W.partitionBy("toxic").orderBy("draw", "doc_id"))
    picked = drawn.withColumn("place", order).where(F.col("place") <= per_class).select("doc_id", "toxic", "place")
    # bounded by per_class rows for either class
    return usable.select("doc_id", "text").join(F.broadcast(picked), "doc_id").orderBy("toxic", "place", "text")


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 3000, max_chars: int = 10_000, size: int = 8, epochs: int = 10, rate: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from at most ``per_class`` labelled texts of up to ``max_chars`` characters of either class, of documents whose
    crc32(doc_id) mod 5 is not 0; ``held_out`` says that the remainder is 0 (null without doc_id). Scores read the whole
    text and nothing else. Null, empty and wordless texts get the constant of the model; with labels of one class or none
    every text gets a constant score. The model has a fixed size.
    """
    sample = training_rows(docs, labels, per_class, max_chars).collect()
    model = fit([r.text for r in sample], [int(r.toxic != 0) for r in sample], size, epochs, rate)

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                scores = model.scores([t if isinstance(t, str) else None for t in part["text"]], cache)
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "held_out": part["held_out"].values, "score": scores, "predicted": (scores >= 0.5).astype("int32")})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), (crc_of_id() % 5 == 0).alias("held_out"), "text")
    out = rows.mapInPandas(predict, "doc_id string, held_out boolean, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
