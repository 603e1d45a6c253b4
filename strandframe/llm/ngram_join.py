"""N-gram Jaccard join: T-occurrence search over inverted lists by heap merge and binary probes (DivideSkip).

The lists are spread over blocks. Documents that share a rare-first prefix shingle go to the block of the smallest of them, so
any two documents that can link meet in a block; inside, DivideSkip finds the links. Every text travels once for each block
it is in. Identical sets are one document from the start, and links are gathered as spanning edges, so neither copies nor
near copies are expanded into pairs.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shingles import shingle_set, word_hashes
from .text import written

#: size of the bitmap of common shingles, whatever the corpus: 4 MB
COMMON_BITS = 25
#: a shingle in so many documents of one batch is common
COMMON_IN_BATCH = 4
#: documents of a block that one task searches
BLOCK_DOCS = 512
#: fixed value of the method: weight of long lists in its choice of how many to skip
MU = 0.0085


def _least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection with 100 * intersection >= percent * union for sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def merge_counts(lists: list[list[int]]) -> dict[int, int]:
    """How many of the sorted lists hold each document, by one merge over a heap of their heads."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    counts: dict[int, int] = {}
    while heap:
        doc, k, at = heap[0]
        counts[doc] = counts.get(doc, 0) + 1
        if at + 1 < len(lists[k]):
            heapq.heapreplace(heap, (lists[k][at + 1], k, at + 1))
        else:
            heapq.heappop(heap)
    return counts


def divide_skip(lists: list[list[int]], needed: int) -> Iterator[tuple[int, int, list[list[int]]]]:
    """Documents that may be in ``needed`` lists: (document, count in the short lists, the long lists left to probe)."""
    lists = sorted(lists, key=len, reverse=True)
    longest = len(lists[0]) if lists else 0
    skipped = min(needed - 1, len(lists), int(needed / (MU * math.log2(longest + 1) + 1))) if longest else 0
    for doc, count in merge_counts(lists[skipped:]).items():
        if count + skipped >= needed:
            yield doc, count, lists[:skipped]


def probe(doc: int, count: int, lists: list[list[int]], needed: int) -> bool:
    """Binary search for ``doc`` in the long lists, given up once the rest cannot reach ``needed``."""
    for left, x in zip(range(len(lists), 0, -1), lists):
        if count >= needed:
            return True
        if count + left < needed:
            return False
        at = bisect_left(x, doc)
        count += at < len(x) and x[at] == doc
    return count >= needed


def search(sets: list[np.ndarray], queries: list[int], percent: int) -> list[tuple[int, int]]:
    """Spanning links of ``queries`` with all ``sets`` (positions): enough to connect whatever is linked, no more."""
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    edges: list[tuple[int, int]] = []
    lists: dict[int, list[int]] | None = None

    def link(a: int, b: int) -> None:
        edges.append((a, b))
        label[label == label[b]] = label[a]

    for q in queries:
        size = int(sizes[q])
        if not size:
            continue
        fits = (label != label[q]) & (100 * sizes >= percent * size) & (percent * sizes <= 100 * size)
        others = np.flatnonzero(fits)
        if not len(others):
            continue
        if len(others) <= 4:  # all lists are long for so few: probe them at once
            for other in others.tolist():
                small, large = (sets[q], sets[other]) if size <= sizes[other] else (sets[other], sets[q])
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if label[other] != label[q] and common >= _least_overlap(size, int(sizes[other]), percent):
                    link(q, other)
            continue
        if lists is None:
            tokens = np.concatenate(sets)
            owners = np.repeat(np.arange(n), sizes)
            order = np.argsort(tokens, kind="stable")
            tokens, owners = tokens[order], owners[order]
            begins = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            ends = np.append(begins[1:], len(tokens))
            lists = {int(tokens[b]): owners[b:e].tolist() for b, e in zip(begins, ends) if e - b > 1}
        own = [lists[t] for t in sets[q].tolist() if t in lists]
        needed = -(-percent * size // 100)
        if len(own) < needed:
            continue
        for doc, count, long_lists in divide_skip(own, needed):
            if fits[doc] and label[doc] != label[q] and probe(doc, count, long_lists, _least_overlap(size, int(sizes[doc]), percent)):
                link(q, doc)
    return edges


def _common_bitmap(docs: DataFrame, size: int) -> np.ndarray:
    """Bitmap by hash of shingles that come often. It only orders shingles, so bits set by chance cost no link."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(word_hashes(t), size) for t in batch.column(0).to_pylist() if t]
            if found:
                values = np.sort(np.concatenate(found))
                ahead = COMMON_IN_BATCH - 1
                often = values[ahead:][values[ahead:] == values[: max(len(values) - ahead, 0)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(often) & ((1 << COMMON_BITS) - 1))], names=["h"])

    words = docs.select("text").mapInArrow(frequent, "h long").groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    bitmap = np.zeros(1 << (COMMON_BITS - 6), dtype=np.int64)
    table = words.toArrow()
    bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy()
    return np.unpackbits(bitmap.view(np.uint8), bitorder="little").astype(bool)


def prefix_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: number of shingles, a 128-bit hash of the set, and the prefix that shares a shingle with any linked set's prefix."""
    common = np.packbits(_common_bitmap(docs, size))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(common).astype(bool)
        for batch in batches:
            counts, marks, prefixes = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(word_hashes(text or ""), size)
                n = len(s)
                often = bits[s & ((1 << COMMON_BITS) - 1)]
                order = np.concatenate([np.flatnonzero(~often), np.flatnonzero(often)])
                counts.append(n)
                marks.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                prefixes.append(s[order[: n - (-(-percent * n // 100)) + 1]] if n else s)
            flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(marks, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "n", "mark", "prefix"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, mark binary, prefix array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node of ``edges`` (a, b), by large-star and small-star rounds.

    Every round is written to the shared folder; rounds end when count and hash sum of the edges stay the same.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    seen = state(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _members(tokens: DataFrame, percent: int) -> DataFrame:
    """(pivot, doc_id): the blocks of every document, from its prefix shingles (rep, n, pos, t).

    Documents with the shingle t are ordered by set size n. A document stays only if the next larger or the next smaller one
    can reach the overlap with what is left of their sets from t on, which the first common shingle of linked sets always
    allows; sizes too far apart break the group up. Groups of two and more have a pivot, their smallest document.
    """
    by_size = W.partitionBy("t").orderBy("n", "rep")
    larger, smaller = F.lead("n").over(by_size), F.lag("n").over(by_size)
    reach = percent * (F.col("n") + larger) <= (100 + percent) * (F.col("n") - F.col("pos"))
    near = tokens.withColumn("fits", F.coalesce(reach, F.lit(False)) | F.coalesce(100 * smaller >= percent * F.col("n"), F.lit(False))).where("fits")
    gap = F.coalesce(100 * smaller < percent * F.col("n"), F.lit(True)).cast("int")
    runs = near.withColumn("gap", gap).withColumn("run", F.sum("gap").over(by_size.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("t", "run")
    shared = runs.select("rep", F.min("rep").over(run).alias("pivot"), F.max("rep").over(run).alias("last")).where("pivot < last")
    return shared.select("pivot", F.col("rep").alias("doc_id")).distinct()


def _searched(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) inside each group (pivot, part, slice) of ``rows`` (with doc_id and text), whose ``asks`` tells queries."""

    def find(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # the pivot first: it is the document most likely to be linked with the others
        group = group.sort_values(["asks", "doc_id"], ascending=[False, True], kind="stable")
        ids = group["doc_id"].tolist()
        sets = [shingle_set(word_hashes(t), size) for t in group["text"]]
        links = search(sets, np.flatnonzero(group["asks"].to_numpy()).tolist(), percent)
        return pd.DataFrame([(ids[a], ids[b]) for a, b in links], columns=["a", "b"]).astype("int64")

    return rows.groupBy("pivot", "part", "slice").applyInPandas(find, "a long, b long")


def similar_groups(docs: DataFrame, size: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    A document's set holds the distinct runs of ``size`` words (all words as one, if there are fewer). Two documents link
    if 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest ``doc_id`` reachable over links. Null,
    empty and blank texts have no set and are linked with nothing. Rows that repeat a ``doc_id`` are one document, linked by
    any of its texts; rows without ``doc_id`` have no component (null) and link nothing. Other columns are not looked at.

    1. A scan marks common shingles; a second one makes prefixes, rare shingles first. Both cover every text.
    2. Equal sets become one. Documents that share a prefix shingle meet in the block of the smallest of them.
    3. Blocks of up to ``block_docs`` documents are searched whole. A larger one is cut into parts, each searched whole
       and with the block's smallest document. Members that end up in another component than that one are then searched
       against all parts, so no link is missed, while a group of near copies costs about one pass.
    """
    first = written(prefix_rows(docs, size, percent))
    some = first.where("n > 0 AND doc_id IS NOT NULL")
    sets = some.groupBy("mark").agg(F.min("doc_id").alias("rep"), F.min_by("prefix", "doc_id").alias("prefix"), F.max("n").alias("n"))
    members = written(_members(sets.select("rep", "n", F.posexplode("prefix").alias("pos", "t")), percent))
    blocks = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("k")).select("pivot", F.ceil(F.col("k") / block_docs).cast("int").alias("parts"))
    placed = members.join(blocks, "pivot").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), "parts")).otherwise(0).cast("int"))
    placed = written(placed)
    # a copy of the pivot for every other part of its block
    guests = blocks.where("parts > 1").select("pivot", F.col("pivot").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    whole = placed.select("pivot", "doc_id", "part").unionByName(guests).distinct()
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # one exchange of the texts by id; the parts with their texts are read again if large blocks have more to ask
    shipped = written(whole.join(texts.hint("merge"), "doc_id"))
    links = written(_searched(shipped.withColumn("slice", F.lit(0)).withColumn("asks", F.lit(True)), size, percent))
    labels = components(links)

    large = placed.where("parts > 1")
    if not large.isEmpty():
        named = large.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        heads = named.where("doc_id = pivot").select("pivot", F.col("component").alias("head"))
        asking = written(named.join(heads, "pivot").where("component <> head").select("pivot", "doc_id", "parts"))
        slices = asking.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("int").alias("slices"))
        asked = asking.join(slices, "pivot").select(
            "pivot", "doc_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.pmod(F.xxhash64("doc_id"), "slices").cast("int").alias("slice"), F.lit(True).alias("asks")
        )
        data = large.join(slices, "pivot").select("pivot", "doc_id", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(False).alias("asks"))
        both = asked.unionByName(data).groupBy("pivot", "part", "slice", "doc_id").agg(F.max("asks").alias("asks"))
        held = shipped.join(slices.select("pivot"), "pivot").select("pivot", "doc_id", "text").distinct()
        labels = components(links.unionByName(_searched(both.join(held, ["pivot", "doc_id"]), size, percent)))

    marks = sets.select("mark", "rep")
    named = some.join(marks, "mark").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    texts = named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    rest = first.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return texts.unionByName(rest)


def keep_one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component; rows without ``doc_id`` stay."""
    groups = similar_groups(docs, size, percent)
    dropped = groups.where("component_id < doc_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    # a list that grows with the table is never sent to every task
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
