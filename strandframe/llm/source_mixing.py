"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import pieces

#: takes every source without a target of its own
OTHER = ""


def schedule(shares: Mapping[str, int]) -> list[tuple[int, str, int, int, int]]:
    """One round of slots: (slot, source, block, release, deadline), earliest deadline first among released blocks.

    A source with share a of the total q must have its j-th block placed in the window from floor(j q / a) to
    ceil((j + 1) q / a). All windows can be met together, so after any number of slots every source is less than one
    block away from its weight; the next round repeats the pattern, as q slots hold exactly a blocks of each source.
    """
    q = sum(shares.values())
    waiting = [(0, name, 0) for name in sorted(shares)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slots = []
    for slot in range(q):
        while waiting and waiting[0][0] <= slot:
            release, name, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * q // shares[name]), name, j, release))
        deadline, name, j, release = heapq.heappop(ready)
        slots.append((slot, name, j, release, deadline))
        if j + 1 < shares[name]:
            heapq.heappush(waiting, ((j + 1) * q // shares[name], name, j + 1))
    return slots


def _running(df: DataFrame, value: str, tiles: int) -> DataFrame:
    """Add ``before``, the sum of ``value`` over rows of the same ``mix_source`` with a smaller (doc_id, row).

    A source of any size is cut into tiles of equal id ranges; tile sums are scanned per source, rows per tile.
    """
    span = df.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    low, width = span.select("low").scalar(), span.select(F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / tiles))).scalar()
    tiled = df.withColumn("tile", F.coalesce(F.floor((F.col("doc_id") - low) / width), F.lit(-1)))
    sums = tiled.groupBy("mix_source", "tile").agg(F.sum(value).alias("held"))
    carry = sums.withColumn("carry", F.sum("held").over(W.partitionBy("mix_source").orderBy("tile")) - F.col("held")).drop("held")
    inside = W.partitionBy("mix_source", "tile").orderBy(F.asc_nulls_first("doc_id"), "row").rowsBetween(W.unboundedPreceding, -1)
    rows = tiled.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(carry, ["mix_source", "tile"]).withColumn("before", F.col("carry") + F.col("inside")).drop("carry", "inside", "tile")


def mix(docs: DataFrame, shares: Mapping[str, int], other: int = 1, block_chars: int = 1 << 16) -> DataFrame:
    """Place every document in the mixed order.

    Returns one row per input row: ``doc_id, source, row`` (a hash of the text), ``block`` (of its source), ``slot``,
    ``release``, ``deadline``, ``at`` (characters of its source before it). Sorting by ``slot, at, doc_id, row`` gives the mixture.

    A source is a stream of its texts by ``doc_id``, cut into blocks of ``block_chars`` characters; a document belongs to the
    block in which it begins, and a text over several blocks uses up their slots. Blocks are placed by ``schedule`` of
    ``shares``; sources without a share (and null sources) form one stream with share ``other``. When a source has ended its
    slots stay empty and the others keep their proportions, so no document is left out or repeated. Rows without ``doc_id``
    come first in their stream. Null texts are empty. The schedule has as many rows as the shares sum to, whatever the data.
    """
    if any(int(a) != a or a < 1 for a in [*shares.values(), other]):
        raise ValueError("shares are whole numbers of blocks, 1 at least")
    whole = {**shares, OTHER: other}
    q = sum(whole.values())
    spark = docs.sparkSession
    slots = spark.createDataFrame([(n, j, s, r, d, whole[n]) for s, n, j, r, d in schedule(whole)], "mix_source string, j int, first int, r int, d int, share int")
    rows = docs.select(
        "doc_id",
        F.col("source").alias("source"),
        F.when(F.col("source").isin(*shares), F.col("source")).otherwise(F.lit(OTHER)).alias("mix_source"),
        F.xxhash64("text").alias("row"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("size"),
    )
    share = F.create_map(*[F.lit(x) for item in whole.items() for x in item])[F.col("mix_source")]
    placed = _running(rows, "size", 4 * pieces(docs, 64 << 20)).select(
        "doc_id", "source", "row", "mix_source", F.col("before").alias("at"), F.floor(F.col("before") / block_chars).alias("block"), share.alias("share")
    )
    keyed = placed.withColumn("j", (F.col("block") % F.col("share")).cast("int")).withColumn("round", F.floor(F.col("block") / F.col("share")) * q).drop("share")
    # the schedule is as long as the shares sum to, so sending it to every task is bounded by the caller's targets
    return keyed.join(F.broadcast(slots), ["mix_source", "j"]).select(
        "doc_id", "source", "row", "block",
        (F.col("round") + F.col("first")).cast("long").alias("slot"), (F.col("round") + F.col("r")).cast("long").alias("release"), (F.col("round") + F.col("d")).cast("long").alias("deadline"),
        "at",
    )


def mixed_rows(docs: DataFrame, shares: Mapping[str, int], other: int = 1, block_chars: int = 1 << 16) -> DataFrame:
    """The rows of ``docs``, columns unchanged, in the order of ``mix``: over the partitions and so over the files they are written to.

    Equal rows (same id and text) stand side by side.
    """
    placed = mix(docs, shares, other, block_chars).select(F.col("doc_id").alias("mix_id"), F.col("row").alias("mix_row"), F.struct("slot", "at", "doc_id", "row").alias("mix_place"))
    first = placed.groupBy("mix_id", "mix_row").agg(F.min("mix_place").alias("mix_place"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))  # its columns may have any names
    both = packed.join(first.hint("merge"), F.col("whole_row.doc_id").eqNullSafe(F.col("mix_id")) & (F.xxhash64("whole_row.text") == F.col("mix_row")))
    ordered = both.repartitionByRange(pieces(docs, 32 << 20), "mix_place").sortWithinPartitions("mix_place")
    return ordered.select("whole_row.*")
