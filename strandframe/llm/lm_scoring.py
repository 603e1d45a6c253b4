"""Language-model scoring by a weighted backoff automaton over smoothed n-grams.

A state is a context of up to ``order - 1`` words that the training texts hold. Every n-gram seen is an arc from its context
to the state of its own last words; every state has a failure arc to the state without its first word. With K the
smoothing weight and c the counts, an arc weighs log P(w | h) = log((c(hw) + K P(w | h')) / (c(h) + K)) and a failure arc
log(K / (c(h) + K)), so that every state's probabilities sum to one over the words of the state below.

The automaton of the whole corpus grows with it, so no task holds it. Documents form blocks; a block asks the shards of the
count table for just the n-grams its texts hold, builds that part of the automaton and runs its texts through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import K1, WordHashes, mixed
from .text import crc_of_id, pieces

#: text of a block and n-grams of a shard stay small against a task's memory
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _token_hashes(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of start, words and end of all texts in a row, and where each text begins (one place more at the end)."""
    parts, at = [], [0]
    for text in texts:
        h = hashes.of(hashes.words(text))
        parts += [[_START], h, [_END]]
        at.append(at[-1] + len(h) + 2)
    return np.concatenate(parts).astype(np.uint64) if parts else np.zeros(0, np.uint64), np.array(at)


def _grams(tokens: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order``, the key of the n-gram that ends at each place; 0 where it would begin before its text."""
    begin = np.repeat(at[:-1], np.diff(at))
    place = np.arange(len(tokens)) - begin
    out, h = [], None
    for n in range(1, order + 1):
        if n == 1:
            h = mixed(tokens + np.uint64(1))
        else:
            shifted = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
            h = mixed((shifted * K1 + tokens) * K1 + np.uint64(n))
        # 0 is kept for "none"; a word at the lowest place of its text has no context
        out.append(np.where(place >= n - 1, np.maximum(h, np.uint64(1)), np.uint64(0)))
    return out


def _packed(values: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane: the planes of small numbers are zero and vanish in the shuffle's compression."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _steps(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences."""
    return np.diff(keys, prepend=np.uint64(0))


def _shard_bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    edges = np.array([(s << 64) // shards for s in range(1, shards)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _block_keys(texts: list[str], train: np.ndarray, order: int, hashes: WordHashes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct keys of each order with their counts in training texts, and the key streams they come from."""
    tokens, at = _token_hashes(texts, hashes)
    streams = _grams(tokens, at, order)
    learnt = np.repeat(train, np.diff(at))
    keys, counts = [], []
    for stream in streams:
        there = stream > 0
        values, place = np.unique(stream[there], return_inverse=True)
        keys.append(values)
        counts.append(np.bincount(place, learnt[there], len(values)).astype(np.int64))
    return streams, at, (keys, counts)


def _walk(arcs: list[list[float]], fails: list[list[float]], first: int, last: int, order: int) -> float:
    """One left-to-right run: ``state`` is how many words the current state remembers.

    ``arcs[k][i]`` is the weight of the arc for token i from the state of its k preceding words, NaN where there is none;
    ``fails[k][i]`` that state's failure weight.
    """
    total, state = 0.0, min(1, order - 1)
    for i in range(first, last):
        weight = arcs[state][i]
        while weight != weight:
            total += fails[state][i]
            state -= 1
            weight = arcs[state][i]
        total += weight
        state = state + 1 if state < order - 1 else order - 1
    return total


def score_texts(docs: DataFrame, train: str, order: int = 2, smoothing: float = 10.0, add: float = 0.1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Learns from rows where the SQL condition ``train`` over ``doc_id`` holds (not where it is null). Tokens are words, A-Z
    lowered, then one end per text; null texts are empty and consist of the end. ``base_score`` is the log10 probability by
    single tokens with ``add`` added to every count and one place for unknown tokens; ``score`` that of the automaton, whose
    lowest state has the same distribution. With nothing to learn from, both are defined by the added counts alone. Repeated
    rows are scored, and learnt from, as often as they come; other columns are not looked at.

    n-grams are known by 64-bit hashes: among V distinct ones about V^2 / 2^65 pairs share one, under one pair up to 6 billion.

    Work: texts are dealt to blocks once. A block sends each shard its distinct n-grams with their training counts (a
    frequent n-gram once, however often it comes); the shard adds them up over blocks and answers with totals in the same
    order, so keys travel one way only. Nothing is collected; corpus totals reach the blocks as a scalar subquery.
    """
    blocks = pieces(docs, BLOCK_BYTES)
    shards = pieces(docs, SHARD_BYTES // (order + 1))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def ask(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        _, _, (keys, counts) = _block_keys(group["text"].to_pylist(), group["train"].to_numpy(zero_copy_only=False), order, WordHashes())
        out: dict[str, list] = {"shard": [], "gram": [], "keys": [], "counts": []}
        for n, (k, c) in enumerate(zip(keys, counts), 1):
            bounds = _shard_bounds(k, shards)
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[s], bounds[s + 1])
                for name, value in (("shard", s), ("gram", n), ("keys", _packed(_steps(k[part]))), ("counts", _packed(c[part]))):
                    out[name].append(value)
        kinds = {"shard": pa.int32(), "gram": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
        return pa.table({"block": pa.array([key[0].as_py()] * len(out["shard"]), pa.int32()), **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, shard int, gram int, keys binary, counts binary").repartition(shards, "shard")

    def flat(column: pa.ChunkedArray) -> list[np.ndarray]:
        return [_unpacked(x) for x in column.to_pylist()]

    def totals(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Distinct keys, their training counts over all blocks, the place of every key asked for, and how many each row asked."""
        keys = [np.cumsum(x.view(np.uint64)) for x in flat(group["keys"])]
        values, place = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_inverse=True)
        counts = np.concatenate(flat(group["counts"])) if keys else np.zeros(0, np.int64)
        return values, np.bincount(place, counts, len(values)).astype(np.int64), place, [len(k) for k in keys]

    def answer(key: tuple, group: pa.Table) -> pa.Table:
        _, sums, place, sizes = totals(group)
        parts = np.split(sums[place], np.cumsum(sizes)[:-1])
        return pa.table({"block": group["block"], "shard": group["shard"], "gram": group["gram"], "totals": pa.array([_packed(x) for x in parts], pa.binary())})

    def measure(key: tuple, group: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        group = group.filter(pc.equal(group["gram"], 1))
        values, sums, _, _ = totals(group)
        start = values == mixed(np.array([_START + np.uint64(1)]))[0]
        return pa.table({"tokens": pa.array([int(sums[~start].sum())]), "known": pa.array([int((sums[~start] > 0).sum())])})

    answers = asked.groupBy("shard").applyInArrow(answer, "block int, shard int, gram int, totals binary")
    corpus = asked.groupBy("shard").applyInArrow(measure, "tokens long, known long")
    total = corpus.agg(F.struct(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("known"), F.lit(0)).alias("known")).alias("corpus"))

    def score(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        texts = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        replies = replies.sort_by([("gram", "ascending"), ("shard", "ascending")])
        streams, at, (keys, _) = _block_keys(texts["text"].to_pylist(), texts["train"].to_numpy(zero_copy_only=False), order, WordHashes())
        answered = flat(replies["totals"])
        found = np.concatenate(answered) if answered else np.zeros(0, np.int64)
        ends = np.cumsum([len(k) for k in keys])
        counts = []
        for stream, k, end in zip(streams, keys, ends):
            own = np.append(found[end - len(k) : end], 0)
            counts.append(own[np.where(stream > 0, np.searchsorted(k, stream), len(k))].astype(np.float64))
        n_train, known = (texts["corpus"][0].as_py()[x] for x in ("tokens", "known")) if texts.num_rows else (0, 0)
        base = (counts[0] + add) / (n_train + add * (known + 1))
        arcs, fails, below = [np.log10(base)], [np.zeros(len(base))], base
        for n in range(2, order + 1):
            context = np.concatenate([[0.0], counts[n - 2][:-1]])
            weight = (counts[n - 1] + smoothing * below) / (context + smoothing)
            arcs.append(np.where(counts[n - 1] > 0, np.log10(weight), np.nan))
            fails.append(np.log10(smoothing / (context + smoothing)))
            below = np.where(streams[n - 1] > 0, weight, below)
        lists = [a.tolist() for a in arcs], [f.tolist() for f in fails]
        held = np.concatenate([[0.0], np.cumsum(np.log10(base))])
        seen = np.concatenate([[0], np.cumsum(counts[0] > 0)])
        first, last = at[:-1] + 1, at[1:]
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "n_tokens": pa.array(last - first),
                "n_known": pa.array(seen[last] - seen[first]),
                "train_tokens": pa.array(np.full(len(first), n_train, dtype=np.int64)),
                "base_score": pa.array(held[last] - held[first]),
                "score": pa.array([_walk(*lists, a, b, order) for a, b in zip(first.tolist(), last.tolist())], pa.float64()),
            }
        )

    with_corpus = dealt.withColumn("corpus", total.scalar())
    scored = with_corpus.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored
