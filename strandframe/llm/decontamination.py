"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them against test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import ngrams
from .text import written

#: size of the bitmap of seeds, whatever the benchmark: 8 MB
SEED_BITS = 26
#: fixed scores of the alignment; gaps cost one per word
MATCH, MISMATCH = 2, -1
_CACHED = 500_000


class _Hashes(dict):
    """Word to the hash of its letters and digits, 0 without any; a new word is hashed when it is first looked up."""

    def __missing__(self, word: str) -> int:
        plain = Words.plain(word)
        h = self[word] = max(1, xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"))) if plain else 0
        return h


class Words:
    """Lower-cased words with everything but letters and digits taken out; words of nothing else are passed over."""

    def __init__(self):
        self.known = _Hashes()

    @staticmethod
    def plain(word: str) -> str:
        return "".join(c for c in word if c.isalnum())

    def of(self, text: str) -> tuple[list[str], np.ndarray]:
        """The words as written (lower-cased) and their hashes."""
        if len(self.known) > _CACHED:
            self.known.clear()
        words = text.lower().split()
        hashes = np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))
        if not hashes.all():
            words = [w for w, h in zip(words, hashes.tolist()) if h]
            hashes = hashes[hashes > 0]
        return words, hashes


def align(item: np.ndarray, passage: np.ndarray) -> int:
    """Best Smith-Waterman score of two word sequences; a row of the table at a time, gaps along it by a running maximum."""
    places = np.arange(len(passage))
    row, best = np.zeros(len(passage) + 1, dtype=np.int64), 0
    for word in item:
        diagonal = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        reached = np.maximum(np.maximum(diagonal, row[1:] - 1), 0)
        row[1:] = np.maximum.accumulate(reached + places) - places
        best = max(best, int(row.max()))
    return best


def ceiling(item: np.ndarray, passage: np.ndarray) -> int:
    """No less than ``align`` gives: each word of an aligned stretch adds MATCH at most, and MISMATCH if the item lacks it."""
    shared = np.where(np.isin(passage, item), MATCH, MISMATCH).cumsum()
    before = np.minimum.accumulate(np.append(0, shared[:-1]))
    return min(int((shared - before).max(initial=0)), MATCH * int(np.isin(item, passage).sum()))


def _bitmap(grams: DataFrame) -> np.ndarray:
    """Bits of the low part of ``gram``: of a fixed size, so it can go to every task; bits set by chance are joined away."""
    low = F.col("gram").bitwiseAND((1 << SEED_BITS) - 1)
    words = grams.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(gram & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (SEED_BITS - 6), dtype=np.int64)
    table = words.toArrow()
    bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return bitmap.view(np.uint8)


def _marked(bitmap: np.ndarray, grams: np.ndarray) -> np.ndarray:
    low = grams & ((1 << SEED_BITS) - 1)
    return (bitmap[low >> 3] >> (low & 7).astype(np.uint8)) & 1 > 0


def item_grams(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, place, gram, n_words) of every run of ``size`` words of the items."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for frame in frames:
            out = []
            for item, text in zip(frame["item_id"], frame["text"]):
                hashes = words.of(text)[1]
                out += [(item, i, g, len(hashes)) for i, g in enumerate(ngrams(hashes, size).view(np.int64).tolist())]
            yield pd.DataFrame(out, columns=["item_id", "place", "gram", "n_words"])

    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").dropDuplicates(["item_id"])
    kind = dict(items.dtypes)["item_id"]
    return items.mapInPandas(rows, f"item_id {kind}, place int, gram long, n_words int")


def _passages(docs: DataFrame, bitmap: np.ndarray, size: int, reach: int) -> DataFrame:
    """Passages around seeds: (doc_id, row, passage, grams, words). Seeds less than ``reach`` words apart share a passage."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for frame in frames:
            out = []
            for doc_id, row, text in zip(frame["doc_id"], frame["row"], frame["text"]):
                own, hashes = words.of(text)
                grams = ngrams(hashes, size).view(np.int64)
                at = np.flatnonzero(_marked(bitmap, grams))
                if len(at):
                    for k, run in enumerate(np.split(at, np.flatnonzero(np.diff(at) >= reach) + 1)):
                        cut = own[max(0, run[0] - reach) : run[-1] + size + reach]
                        out.append((doc_id, row, k, np.unique(grams[run]), " ".join(map(words.plain, cut))))
            yield pd.DataFrame(out, columns=["doc_id", "row", "passage", "grams", "words"])

    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    return texts.mapInPandas(rows, "doc_id string, row long, passage int, grams array<long>, words string")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 3, least: float = 0.5) -> DataFrame:
    """``doc_id, row, item_id, score``: texts (by id and hash of the text) that hold a passage like a benchmark item.

    ``score`` is the best local alignment of words over the score of the whole item, kept from ``least`` on; it is 1 for an
    exact copy and stays high with words replaced, put in or left out. Words are compared lower-cased without punctuation.

    Every run of ``size`` words of an item is a seed, however frequent: a copy is found if any ``size`` of its words in a row
    are the item's. One without such a run is not found, though with every third word replaced it still scores 0.5. Items of
    under ``size`` words have no seeds and are not looked for. Null texts hold nothing. Rows that repeat are found alike; rows
    without ``doc_id`` are found with a null id. Of items that repeat an id one is taken. Other columns are not looked at.

    Only passages around seeds leave the scan. A passage is aligned once with each item it shares a seed with, wherever
    that item's other copies are, so a passage in a third of all documents costs that many alignments and no pairs.
    """
    items = written(item_grams(benchmark, size))
    longest = items.agg(F.max("n_words")).first()[0] or 0
    seeds = written(items.select("item_id", "gram").distinct())
    # as far as an alignment that scores ``least`` can reach from a seed within it
    reach = longest + int(MATCH * longest * (1 - least)) + 1
    passages = written(_passages(docs, _bitmap(seeds.select("gram")), size, reach))

    pairs = passages.select("doc_id", "row", "passage", F.explode("grams").alias("gram")).join(seeds, "gram").select("doc_id", "row", "passage", "item_id").distinct()
    texts = benchmark.where("text IS NOT NULL").select("item_id", F.col("text").alias("item")).dropDuplicates(["item_id"])
    same = F.col("p.doc_id").eqNullSafe(F.col("q.doc_id")) & (F.col("p.row") == F.col("q.row")) & (F.col("p.passage") == F.col("q.passage"))
    distinct = passages.dropDuplicates(["doc_id", "row", "passage"]).select("doc_id", "row", "passage", "words")
    both = pairs.alias("p").join(distinct.alias("q"), same).select("p.doc_id", "p.row", "p.item_id", "q.words").join(texts, "item_id")

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for frame in frames:
            values = []
            for item, passage in zip(frame["item"], frame["words"]):
                own, there = words.of(item)[1], words.of(passage)[1]
                whole = MATCH * len(own)
                values.append(align(own, there) / whole if ceiling(own, there) >= least * whole else 0.0)
            yield frame[["doc_id", "row", "item_id"]].assign(score=np.array(values, dtype=float))

    kind = dict(texts.dtypes)["item_id"]
    found = both.mapInPandas(scored, f"doc_id string, row long, item_id {kind}, score double").where(F.col("score") >= least)
    best = found.groupBy("doc_id", "row", "item_id").agg(F.max("score").alias("score"))
    return best.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns unchanged, in whose text no benchmark item was found."""
    found = contaminated(docs, benchmark, least=least).select(F.col("doc_id").alias("found_id"), F.col("row").alias("found_row")).distinct()
    # a list that grows with the table is never sent to every task
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))  # its columns may have any names
    same = F.col("whole_row.doc_id").eqNullSafe(F.col("found_id")) & (F.xxhash64("whole_row.text") == F.col("found_row"))
    return packed.join(found.hint("merge"), same, "left_anti").select("whole_row.*")
